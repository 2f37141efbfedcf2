"""I-Match prints, periodic runs and hard negatives against brute force and over odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factspan.llm import hard_negatives, lexicon_prints, periods, queries
from factspan.llm.words import split_words
from tests.llm.test_operators import CLASH, DOCS, doc, invented, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + (99, 98, "k", 97, 0.5, 96, "q", 95, 94) for r in odd_rows()], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# I-Match


def edited_texts(rows):
    """Edited text per row of unique ids."""
    rows = sorted((i, t or "") for i, t in rows if i is not None)
    out = {}
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 4
        out[i] = text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut]
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_prints_take_the_next_document_at_any_split(spark, parts):
    r = random.Random(parts)
    rows = [(i * 7 + r.randrange(7), invented(i, r.randrange(60), 300) + " Üß日本"[: r.randrange(6)]) for i in range(120)]
    rows += [(2**60, "x y z"), (2**60 + 1, None), (2**60 + 2, "")]  # the same number in double precision
    frame = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string").repartition(parts)
    held = lexicon_prints.lexicon(frame)
    got = {x["id"]: x for x in lexicon_prints.with_next(frame, held).collect()}
    want = edited_texts(rows)
    assert got.keys() == want.keys()
    order = sorted(want)
    for k, i in enumerate(order):
        row, after = got[i], got[order[(k + 1) % len(order)]]
        assert row["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
        assert row["n_chars"] == len(dict(rows)[i] or "")
        a, b, c = (lexicon_prints.Prints.parse([t]) for t in (row["fingerprint"], row["edited_fingerprint"], after["fingerprint"]))
        assert row["near_edited"] == pytest.approx(lexicon_prints.likeness(a, b)[0])
        assert row["near_next"] == pytest.approx(lexicon_prints.likeness(a, c)[0])
    alone = lexicon_prints.fingerprints(frame, held)
    assert {x["id"]: x["fingerprint"] for x in alone.collect()} == {i: x["fingerprint"] for i, x in got.items()}


def test_lexicon_is_the_band_of_all_documents(spark):
    rows = [(i, " ".join(["all", f"half{i % 2}", f"tenth{i % 10}", f"tenth{i % 10}", f"pair{i // 2}", f"one{i}"])) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    word = lambda names: {int(x) for x in lexicon_prints.distinct_terms(pa.array([" ".join(names)]))[0]}
    held = set(lexicon_prints.lexicon(frame).tolist())
    assert held == word([f"tenth{i}" for i in range(10)] + [f"pair{i}" for i in range(50)])
    small = lexicon_prints.lexicon(frame, size=100)  # 500 postings: 5 documents at least
    assert set(small.tolist()) == word([f"tenth{i}" for i in range(10)])
    copies = spark.createDataFrame([(i, "the same text") for i in range(50)], "doc_id long, text string")
    assert not len(lexicon_prints.lexicon(copies))


def test_likeness_estimates_the_terms_in_common():
    held, gaps = np.empty(0, np.uint64), []
    for seed in range(60):
        r = random.Random(seed)
        size = r.choice([8, 30, 100, 400])
        a = [f"a{seed}w{i}" for i in range(size)]
        shared = r.randrange(size + 1)
        b = a[:shared] + [f"b{seed}w{i}" for i in range(size - shared)]
        found = lexicon_prints.prints(pa.array([" ".join(a), " ".join(b)]), held)
        gaps.append(lexicon_prints.likeness(found.row(0), found.row(1))[0] - shared / size)
    assert abs(np.mean(gaps)) < 0.05 and np.sqrt(np.mean(np.square(gaps))) < 0.12


def test_prints_of_odd_rows(spark, odd, empty):
    held = lexicon_prints.lexicon(odd)
    rows = lexicon_prints.with_next(odd, held).collect()
    assert len(rows) == len(odd_rows())
    by_id = {}
    for x in rows:
        by_id.setdefault(x["id"], []).append(x)
    assert by_id[None][0]["near_next"] is None and by_id[None][0]["fingerprint"]
    assert by_id[2][0]["fingerprint"] == by_id[3][0]["fingerprint"] == by_id[4][0]["fingerprint"]
    assert by_id[5][0]["fingerprint"] == by_id[6][0]["fingerprint"] and by_id[5][0]["near_next"] == 1
    assert by_id[0][0]["fingerprint"] == by_id[1][0]["fingerprint"]  # case of A to Z does not count
    assert by_id[7][0]["near_next"] > 0.9
    assert len(by_id[13]) == 2 and by_id[13][0] == by_id[13][1]
    # the next of 9 is the least text of 10
    nine = next(r[1] for r in odd_rows() if r[0] == 9)
    want = hashlib.sha256((nine[: len(nine) - len(nine) // 4] + "x y"[: len(nine) // 4]).encode()).hexdigest()
    assert by_id[9][0]["edited_sha256"] == want
    assert lexicon_prints.with_next(empty, lexicon_prints.lexicon(empty)).count() == 0
    one = spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")
    assert lexicon_prints.with_next(one, held).first()["near_next"] == 1


# periodic runs


def brute_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(documents):
    flat, bounds = split_words(pa.array([" ".join(d) for d in documents], pa.string()))
    rows, stays = periods.text_runs(flat, bounds)
    found = [[tuple(r[1:]) for r in rows.tolist() if r[0] == i] for i in range(len(documents))]
    return found, [stays[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def check_runs(documents):
    found, stays = runs_of(documents)
    for words, got, kept in zip(documents, found, stays, strict=True):
        assert got == brute_runs(words)
        gone = {i for s, n, q in got for i in range(s + q, s + n)}
        assert [i not in gone for i in range(len(words))] == kept


block = st.lists(st.sampled_from("abc"), min_size=1, max_size=40)
piece = st.builds(lambda root, times, cut: (root * times)[: len(root) * times - cut], block, st.integers(1, 9), st.integers(0, 5))
nested = st.builds(lambda inner, tail, times: (inner + tail) * times, piece, block, st.integers(1, 5))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(block, piece, nested), max_size=4).map(lambda x: sum(x, [])), max_size=5))
def test_runs_equal_brute_force(documents):
    check_runs(documents)


def test_runs_of_hard_words():
    a, b = ["0"], ["0", "1"]
    for _ in range(11):
        a, b = b, b + a
    thue = ["0"]
    for _ in range(8):
        thue += ["1" if x == "0" else "0" for x in thue]
    ruler = []
    for x in "abcdefg":
        ruler = ruler + [x] + ruler + [x] + ruler
    edges = [(["a"] * k + ["b"]) * 4 for k in range(1, 60, 7)]  # highly periodic within the period
    flat = [["a"] * n for n in (0, 1, 23, 24, 25, 700)]
    long = [f"w{i % 500}" for i in range(1600)]
    check_runs([b, thue, ruler[:900], long, *edges, *flat, (["a", "b"] * 40 + ["c"]) * 3, (["a"] * 30 + ["b"] * 30) * 3])


def test_runs_of_very_long_texts():
    r = random.Random(2)
    words = [str(r.randrange(3000)) for _ in range(200_000)]
    words[1000:40_000] = (words[1000:11_000] * 4)[:39_000]  # period 10 000
    words[50_000:50_090] = words[50_000:50_030] * 3
    found, _ = runs_of([words])
    assert {(s, q) for s, _, q in found[0]} >= {(1000, 10_000), (50_000, 30)}
    assert all(n >= max(24, 3 * q) and words[s : s + n - q] == words[s + q : s + n] for s, n, q in found[0])


def test_collapse_and_its_query_on_odd_rows(spark, odd, empty, tmp_path):
    rows = periods.collapse(odd).collect()
    assert len(rows) == len(odd_rows())
    assert sorted((x["id"] is None, x["id"] or 0, x["collapsed"]) for x in rows) == sorted(
        (r[0] is None, r[0] or 0, " ".join(WORD.findall(r[1] or ""))) for r in odd_rows()
    )
    assert periods.collapse(empty).count() == 0
    texts = [(i, " ".join(f"w{(k * k + i) % 7 if i % 3 else k}" for k in range(i * 5))) for i in range(60)]
    texts += [(None, "a " * 30), (61, None), (62, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op12_synchronising_runs(spark, str(tmp_path)).collect()}
    for i, text in texts:
        words = WORD.findall(text or "")
        if i is not None and zlib.crc32(str(i).encode()) % 10 == 0 and words:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(len(words))]
        runs = brute_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        x = got[i]
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), *best)
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert x["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


# hard negatives


def test_packed_scores_are_exact():
    r = np.random.default_rng(1)
    for high in (1, 3, 300, 2**20, 2**25, 2**29):
        for rows, dims in ((1, 1), (5, 3), (130, 8)):
            a = r.integers(-high, high + 1, (4, dims))
            b = r.integers(-high, high + 1, (rows, dims))
            want = a.astype(object).dot(b.T.astype(object))
            assert (hard_negatives.packed_scores(a, b).astype(object) == want).all()
    with pytest.raises(OverflowError):
        hard_negatives.packed_scores(np.full((1, 2), 2**40), np.full((1, 2), 2**40))


def brute_negatives(rows, asks):
    known = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all():
            pair = (str(label), [int(np.floor(256 * float(np.float32(x)))) for x in v])
            known[i] = min(known.get(i, pair), pair)
    out = set()
    for a, (label, v) in known.items():
        if a % asks:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, (own, w) in known.items() if i != a and len(w) == len(v)]
        for score, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and -50 * score <= -100 * s[0] <= -95 * score)[:3]
            out |= {(a, p, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(fit)}
    return out


@pytest.mark.parametrize("block", [4096, 37])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    r = np.random.default_rng(block)
    rows = [(i, int(x) % 4 if x < 7 else 0, [float(np.float32(c)) for c in r.normal(0.05, 0.2, 6)]) for i, x in enumerate(r.integers(0, 10, 400))]
    rows += [(400 + i, 1, rows[0][2]) for i in range(200)]  # copies: ties
    rows += [rows[5], (7, 3, [0.5] * 6), (None, 1, [0.1] * 6), (900, None, [0.1] * 6), (950, 1, None), (1000, 1, [])]
    rows += [(1050, 1, [None] + [0.1] * 5), (1100, 1, [float("nan")] * 6), (1150, 1, [float("inf")] + [0.0] * 5), (1200, 2, [0.0] * 6)]
    rows += [(1300 + i, i % 3, [0.1 * i, 0.2]) for i in range(30)]  # of another length
    frame = spark.createDataFrame([r_ + ("x", 1.0) for r_ in rows], "vec_id long, label int, embedding array<float>, id string, score double")
    got = [tuple(x) for x in hard_negatives.mine(frame.repartition(5), F.col("id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, 10)
    assert hard_negatives.mine(frame.where("false"), F.lit(True)).count() == 0


def test_vectors_of_several_lengths_and_large_ones(spark):
    from factspan.llm import exact_search, neighbours

    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100 + i, [1.0, 2.0, float(i % 5)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search, scale in ((exact_search.top_products, 256), (neighbours.nearest, 1)):
        got = {(x["query_id"], x["rank"]): x["vec_id"] for x in search(frame, F.col("id") % 20 == 0, k=5).collect()}
        for q, v in rows:
            if q % 20 == 0:
                scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
                assert [got[q, k + 1] for k in range(5)] == [i for _, i in scored[:5]]
    for large, message in ((1e17, "beyond 64 bits"), (1e10, "beyond 53 bits")):
        huge = spark.createDataFrame([(0, [large, large]), (1, [large, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=message):
            exact_search.top_products(huge, F.lit(True)).count()


def test_queries_skip_shards_out_of_reach(spark, monkeypatch):
    from factspan.llm import exact_search

    monkeypatch.setattr(exact_search, "SHARD_ROWS", 40)
    r = np.random.default_rng(6)
    centres = r.normal(size=(8, 6)) * 20
    rows = [(i, [float(x) for x in centres[i % 8] + r.normal(size=6)]) for i in range(640)]
    sent, split = [], exact_search.in_shares
    monkeypatch.setattr(exact_search, "in_shares", lambda asks, *rest: (sent.append(asks.count()), split(asks, *rest))[1])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): x["vec_id"] for x in exact_search.top_products(frame, F.col("id") % 10 == 0, scale=16).collect()}
    whole = np.floor(16 * np.array([v for _, v in rows]))
    for q in range(0, 640, 10):
        best = sorted((-float(whole[q] @ whole[i]), i) for i in range(640) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [i for _, i in best]
    assert sent[0] == 64 and sent[1] < 64 * 15 / 3  # 16 shards, most of them out of reach
