"""Stages of the pipeline over odd rows, and the whole run against a brute-force account of each stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from factspan.llm.queries import TOKENIZER
from factspan.llm.shared import table
from tests.llm.test_operators import DOCS, invented, odd_rows

SMALL = "/root/testdata/sf0.001"
PROSE = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your"

LONG = " ".join(PROSE.split()[::-1] * 3000)


def odd_docs(spark, extra=""):
    rows = odd_rows() + [(100 + i, " ".join(PROSE.split()[i:] + PROSE.split()[:i]), "en", "s", 9) for i in range(6)]
    rows += [(None, PROSE, "en", None, None)] * 3 + [(200, LONG, "en", "s", 9), (200, LONG, "en", "s", 9), (201, invented(4, 300), None, None, 0)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in extra.split():
        frame = frame.withColumn(name, F.lit(1))
    return frame


@pytest.mark.parametrize("extra", ["", "id __id __text __row row queue size key component score part label taken digest"])
@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_rows(spark, stage, extra):
    step, docs = dict(corpus_pipeline.STAGES)[stage], odd_docs(spark, extra)
    before = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    kept = step(spark, docs, SMALL)
    assert kept.columns == docs.columns
    after = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    if stage == "mixing":  # thins and repeats, of what is there
        assert {i for i, _ in after} <= {i for i, _ in before}
    else:
        assert all(after[k] <= before[k] for k in after)
    if stage in ("language_id", "toxicity"):
        assert after[200, LONG] == 2  # whole texts, every row judged
    if stage == "near_dedup":
        assert after[200, LONG] == 1 and after[None, PROSE] == 3  # rows without id stay
        assert after[5, "word"] == 1 and after[6, "word"] == 0


def test_packing_stage_takes_odd_rows(spark):
    docs = odd_docs(spark)
    pieces = corpus_pipeline.packed(spark, docs, SMALL).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == want


def test_run_accounts_for_every_document(spark):
    """What each stage keeps, stated from its input by hand, is what the run packs."""
    docs = table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SMALL, "labels").collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    packed = {r["doc_id"] for r in rows}
    assert packed <= texts.keys()

    def words(i):
        return texts[i].translate({c: c + 32 for c in range(65, 91)}).split()

    def shingles(i):
        w = words(i)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(i) for i in texts}
    alike = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = sorted(packed)
    assert not [(a, b) for n, a in enumerate(kept) for b in kept[n + 1 :] if alike(a, b)]
    # a document that is gone is toxic, wordless, near to one that stands for it, or thinned out by its source's target
    size = sum(len(words(i)) for i in kept)
    lost = [i for i in texts if i not in packed and labels.get(i) == 0 and words(i) and not any(alike(i, k) for k in kept)]
    assert sum(len(words(i)) for i in lost) <= 0.5 * (size + 1)
