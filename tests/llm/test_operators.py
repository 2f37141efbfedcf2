"""Operators against brute force and over odd tables: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factspan.llm import (
    exact_search,
    language,
    license_scan,
    mixing,
    near_dedup,
    neighbours,
    packing,
    quotation,
    shared,
    toxicity,
    training_order,
    words,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASH = DOCS + ", id long, size long, key string, component long, score double, part int, queue string, row int, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def doc(i, text, source="a", lang="en"):
    return (i, text, lang, source, len(text or ""))


def invented(seed, count, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(count))


def odd_rows():
    long = invented(1, 30_000)
    return [
        doc(0, "one two three four five six seven eight nine ten"), doc(1, "ONE two three four five six seven eight nine ten"),
        doc(2, None), doc(3, ""), doc(4, " \t\n"), doc(5, "word"), doc(6, "word"), doc(7, long), doc(8, long + " end"),
        doc(9, "Ü é ß 日本"), (None, "no id here at all", None, None, None), (10, "x y", None, None, None), doc(10, "x y"),
        doc(11, "12 34 !!"), doc(12, "a<|endoftext|>b  c \n d　 e "), doc(13, "dup row"), doc(13, "dup row"), doc(14, "\u0085 x y "),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [r + (99, 98, "k", 97, 0.5, 96, "q", 95, 94) for r in odd_rows()]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


# words


def test_words_and_shingles_of_slices():
    texts = pa.array([r[1] for r in odd_rows()] * 2, pa.string())
    for start, part in words.slices(texts.slice(3), 50):
        flat, bounds = words.split_words(part)
        for i, text in enumerate(part.to_pylist()):
            assert flat[bounds[i] : bounds[i + 1]].to_pylist() == WORD.findall(text or "")
    hashes, _ = words.word_hashes(pa.array(["A b", "a B", "É é"]))
    assert list(hashes[:2]) == list(hashes[2:4]) and hashes[4] != hashes[5]
    assert len(words.shingles(hashes[:1], 2)) == 1 and len(words.shingles(hashes[:3], 2)) == 2


# near duplicates


def brute_components(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed):
    """A base text with copies of growing distance, so some link only over others, and boilerplate docs."""
    r = random.Random(seed)
    out, base = [], [f"b{i}" for i in range(60)]
    for i in range(60):
        copy = list(base)
        for _ in range(r.randrange(9)):
            copy[r.randrange(60)] = f"n{r.randrange(10**6)}"
        out.append((i, " ".join(copy)))
    return out + [(100 + i, "shared line of text here " + invented(seed * 100 + i, 8)) for i in range(40)]


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 2), (3, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, width):
    rows = near_copies(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["size"], r["component"]) for r in near_dedup.near_duplicates(frame, width=width).collect()}
    assert got == brute_components(rows, width)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd, width=2).collect()
    assert len(got) == len(odd_rows())
    want = brute_components([r[:2] for r in odd_rows() if r[0] is not None], 2)
    for r in got:
        if r["id"] is None:
            assert r["component"] is None and r["kept"]
        else:
            assert (r["size"], r["component"]) == want[r["id"]] and r["kept"] == (r["id"] == r["component"])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_keep_one_keeps_a_row_of_every_group(odd, empty):
    kept = near_dedup.keep_one(odd, width=2)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, i) for i in (0, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14)] + [(True, 0)]
    assert near_dedup.keep_one(empty).count() == 0


def test_components_follow_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000 - i, 999 - i) for i in range(100)] + [(5000, 5000)]
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(900, 1001), 900)}


def test_min_max_signature_is_unbiased():
    values = words.mix(np.arange(3000, dtype=np.uint64))
    factors, offsets = near_dedup._permutations(400, 3)
    a = near_dedup.signature(values[:2500], factors, offsets)
    b = near_dedup.signature(values[500:], factors, offsets)
    assert abs((a == b).mean() - 2000 / 3000) < 0.05


# training order


@pytest.mark.parametrize("count", [1, 2, 3, 16, 17, 1000])
def test_permutation_is_one_to_one(count):
    slots = training_order.permuted(np.arange(count), count, 5)
    assert sorted(slots) == list(range(count))
    if count > 16:
        assert list(slots) != list(training_order.permuted(np.arange(count), count, 6))


def test_training_order_round_trip(spark, odd):
    index = training_order.write_in_order(odd, TOKENIZER, length=64, per_shard=100)
    rows = index.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) == sorted(r["sequence"] for r in rows)
    folder, kind = rows[0]["path"].rsplit("/", 1)[0], packing.id_type(TOKENIZER)
    back = {r["slot"]: r["ids"] for r in training_order.sequences(spark, folder, kind=kind, length=64, per_shard=100).collect()}
    assert len(back) == len(rows)
    for r in rows:
        assert zlib.crc32(np.array(back[r["slot"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["byte_offset"] == (r["slot"] % 100) * 64 * kind.itemsize and r["shard"] == r["slot"] // 100
    some = training_order.read_from(folder, 1, 3, 2, kind=kind, length=64)
    assert [list(x) for x in some] == [back[103], back[104]]
    # every token comes back, in the order of the documents within a task's run
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted(i for r in odd_rows() for i in tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    held = sorted(i for r in rows for i in back[r["slot"]][: r["tokens"]])
    assert held == want


def test_training_order_is_repeatable_and_takes_empty_tables(odd, empty):
    first, again, other = (
        {(r["slot"], r["ids_crc32"]) for r in training_order.write_in_order(odd.coalesce(1), TOKENIZER, length=64, key=k).collect()}
        for k in (1, 1, 2)
    )
    assert first == again != other
    assert training_order.write_in_order(empty, TOKENIZER).count() == 0


# language


def speech(lang, seed, count=60):
    r = random.Random(f"{lang}{seed}")
    parts = {"en": "the ing tion ed ly of and", "de": "der ung sch keit ver und ö", "fr": "le eau eux que de é", "es": "el ción os que la ñ"}
    return " ".join(r.choice(parts[lang].split()) + r.choice(parts[lang].split()) for _ in range(count))


def test_language_on_held_out_rows(spark):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(frame, F.col("doc_id") % 7 != 0).join(frame, F.col("id") == F.col("doc_id")).where("doc_id % 7 = 0").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, empty):
    got = {}
    for r in language.identify(odd, F.lit(True)).collect():
        got.setdefault(r["id"], (r["lang_pred"], r["score"]))
    assert [got[i][0] for i in (2, 3, 4, 11)] == ["und"] * 4 and got[2][1] == 0.0
    assert got[0] == ("en", 1.0) and got[9][0] == "en"
    assert language.identify(empty, F.lit(True)).count() == 0
    nothing = language.identify(odd, F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_unknown_languages_are_families_of_their_own(spark):
    rows = [(i, speech(s, i), lang) for i, (s, lang) in enumerate([("en", "en"), ("fr", "zz"), ("de", "yy")] * 20)]
    model = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert [f for f, _ in model.families] == ["germanic", "yy", "zz"]
    assert model.predict(speech("fr", 99))[0] == "zz"


# toxicity


def toxic_rows(count):
    r = random.Random(4)
    rows = []
    for i in range(count):
        bad = i % 5 == 0
        text = invented(i, 40, 300).split()
        for _ in range(3 if bad else 0):
            text[r.randrange(40)] = r.choice(["idiotic", "idiot,", "Scum", "scummy"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(600)
    frame = spark.createDataFrame(rows, "id long, text string, label int")
    model = toxicity.fit(frame.where("id % 4 <> 2"))
    assert 0 < len(model.places) < 5000
    scored = toxicity.score(frame, model, {"id": F.col("id"), "__text": F.col("text")}, "id bigint").collect()
    held = [(rows[r["id"]][2], r["score"] >= 0.3) for r in scored if r["id"] % 4 == 2]
    assert sum(label == said for label, said in held) >= 0.97 * len(held)


def test_toxicity_score_is_the_sum_over_distinct_features():
    rows = [r[1] for r in toxic_rows(200)]
    lists = list(toxicity.feature_lists(pa.array(rows)))
    model = toxicity.ftrl(lists, np.array([r[2] for r in toxic_rows(200)], float), np.ones(200))
    dense = np.zeros(toxicity.DIMENSIONS)
    dense[model.places] = model.weights
    want = [1 / (1 + np.exp(-(model.bias + dense[at].sum()))) for at in lists]
    assert np.allclose(model.scores(pa.array(rows)), want, atol=1e-6)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 1), (7, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    learned = toxicity.marked(odd, labels, F.lit(True))
    assert sorted((r["id"], r["label"]) for r in learned.collect()) == [(0, 1), (2, 1), (7, 0)]
    texts = odd.select(F.col("doc_id").cast("long").alias("id"), "text")
    model = toxicity.fit(learned, texts)
    again = toxicity.fit(learned.unionAll(learned), texts.unionAll(texts).repartition(5))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias  # repeated rows teach once
    scores = toxicity.score(odd, model, {"id": F.col("doc_id"), "__text": F.col("text")}, "id bigint").collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scores)
    none = toxicity.fit(learned.where("false"), texts)
    assert toxicity.accepted(odd, none).count() == len(odd_rows())
    assert toxicity.accepted(empty, model).columns == empty.columns


# license


def whole_alignment(template, text):
    """Local alignment over the whole table."""
    score = np.zeros((len(template) + 1, len(text) + 1), int)
    match = np.zeros_like(score)
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            same = template[i - 1] == text[j - 1]
            options = [(score[i - 1, j - 1] + (2 if same else -1), match[i - 1, j - 1] + same),
                       (score[i - 1, j] - 1, match[i - 1, j]), (score[i, j - 1] - 1, match[i, j - 1])]
            top = max(options)
            score[i, j], match[i, j] = top if top[0] > 0 else (0, 0)
    at = np.unravel_index(score.argmax(), score.shape)
    return match[at], at[1]


def test_license_scan_against_whole_alignment(spark):
    r = random.Random(9)
    rows = []
    for i, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items()) * 2):
        notice = text.split()
        if i >= len(license_scan.TEMPLATES):  # second half: every tenth word changed
            notice = [w if r.random() > 0.1 else "changed" for w in notice]
        rows.append((i, invented(i, 20) + "\n" + " ".join(notice).upper() + "\n" + invented(i + 50, 20), name))
    frame = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = {(x["id"], x["license"]): x for x in license_scan.scan(frame).collect()}
    index = license_scan.Index(license_scan.TEMPLATES)
    for i, text, name in rows:
        template = index.words[index.names.index(name)]
        own, _ = words.word_hashes(words.plain(pa.array([text])))
        matched, end = whole_alignment(template, own)
        found = got.get((i, name))
        if matched >= 0.6 * len(template) and found is None:
            assert any(k[0] == i and v["matched"] >= matched for k, v in got.items())
        elif found:
            assert (found["matched"], found["end_word"]) == (matched, end)
            assert found["coverage"] == matched / len(template)
    assert all((i, name) in got for i, _, name in rows[: len(license_scan.TEMPLATES)])


def test_license_places_and_odd_rows(spark, odd, empty):
    twice = "Released under the MIT License. " + invented(3, 30) + " released under the mit license"
    frame = spark.createDataFrame([(1, twice), (1, twice), (2, None), (3, "MIT")], "doc_id long, text string")
    got = sorted((r["id"], r["license"], r["start_word"]) for r in license_scan.scan(frame).collect())
    assert got == [(1, "MIT", 0), (1, "MIT", 0), (1, "MIT", 35), (1, "MIT", 35)]
    assert license_scan.scan(odd).count() == 0 == license_scan.scan(empty).count()


def test_license_copies_next_to_each_other(spark):
    names = sorted(license_scan.TEMPLATES)
    index = license_scan.Index(license_scan.TEMPLATES)
    rows = [(i, " ".join([license_scan.TEMPLATES[name]] * 40)) for i, name in enumerate(names)]
    got = {i: [] for i in range(len(names))}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["id"]].append((r["license"], r["start_word"], r["end_word"], r["coverage"]))
    for i, name in enumerate(names):
        size = len(index.words[index.names.index(name)])
        assert sorted(got[i], key=lambda r: r[1]) == [(name, k * size, (k + 1) * size, 1.0) for k in range(40)]


def test_license_places_with_any_words_changed(spark):
    r = random.Random(10)
    index = license_scan.Index(license_scan.TEMPLATES)
    rows = [(0, "Released under an MIT License", "MIT", 4)]
    for name, own in zip(index.names, index.words, strict=True):
        notice = words.plain(pa.array([license_scan.TEMPLATES[name]]))[0].as_py().split()
        least = -(-6 * len(own) // 10)
        # from the second word on, as a changed end is outside the alignment; the last kind leaves no four in a row
        kinds = [{k} for k in range(1, len(own) - 1)] if len(own) < 12 else [set(range(2, len(own) - 1, 3))]
        kinds += [set(r.sample(range(1, len(own) - 1), (len(own) - least) // 2)) for _ in range(3)]
        for changed in kinds:
            text = " ".join("changed" if k in changed else w for k, w in enumerate(notice))
            rows.append((len(rows), f"{invented(len(rows), 20)}\n{text}\n{invented(len(rows) + 900, 20)}", name, 0))
    got = {}
    for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, name string, n int")).collect():
        got[x["id"]] = max(got.get(x["id"], 0), x["matched"])
    assert got[0] == 4
    for i, text, name, _ in rows[1:]:
        template = index.words[index.names.index(name)]
        matched, _ = whole_alignment(template, words.word_hashes(words.plain(pa.array([text])))[0])
        assert matched >= 0.6 * len(template), name
        assert got.get(i, 0) >= matched, (name, text)


def test_licenses_are_not_taken_for_their_kin(spark):
    want = {
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "Licensed under CC BY-NC-SA 3.0.": "CC-BY-NC-SA-3.0",
        "Licensed under CC BY 2.0.": "unknown",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 1.": "unknown",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Released under the BSD 3-Clause License.": "BSD-3-Clause",
        "Released under the Foo License.": "unknown",
        "Licensed under CC0 1.0.": "CC0-1.0",
        "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0",
        "Licensed under the Apache License, Version 1.1.": "unknown",
        license_scan.TEMPLATES["Unlicense"]: "Unlicense",
        license_scan.TEMPLATES["BSD-2-Clause-text"]: "BSD-2-Clause-text",
        license_scan.TEMPLATES["LGPL-2.1-header"]: "LGPL-2.1-header",
    }
    frame = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = sorted((r["id"], r["license"]) for r in license_scan.scan(frame).collect())
    assert got == list(enumerate(want.values()))


# vectors


def vector_rows(seed, count, dims=8):
    r = np.random.default_rng(seed)
    v = r.normal(size=(count, dims)) * r.uniform(0.2, 2, size=(count, 1))
    v[: count // 3] = v[0]  # one vector holds a third of the rows
    rows = [(i, [float(np.float32(x)) for x in v[i]], 1.0) for i in range(count)]
    odd = [None, [], [0.0] * dims, [1.0] * (dims + 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [None] + [1.0] * (dims - 1)]
    return rows + [(10_000 + 100 * i, o, 1.0) for i, o in enumerate(odd)] + [(None, [1.0] * dims, 1.0)]


VECTORS = "vec_id long, embedding array<float>, score double"


def best_of(rows, asks, k, change=lambda v: v, zero=False):
    known = {i: change(np.array(v, float)) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and (zero or any(v))}
    out = {}
    for q in known:
        if q % asks == 0:
            scored = sorted((-float(known[q] @ v), i) for i, v in known.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_exact_products_equal_brute_force(spark):
    rows = vector_rows(1, 700)
    frame = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in sorted(exact_search.top_products(frame, F.col("id") % 50 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == best_of(rows, 50, 5, lambda v: np.floor(256 * v), zero=True)
    assert exact_search.top_products(frame.where("false"), F.lit(True)).count() == 0


def test_exact_products_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "SHARD_ROWS", 60)
    rows = vector_rows(2, 500)
    got = {}
    for r in sorted(exact_search.top_products(spark.createDataFrame(rows, VECTORS), F.col("id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == best_of(rows, 20, 5, lambda v: np.floor(256 * v), zero=True)


def test_neighbours_recall(spark):
    rows = vector_rows(3, 1500)
    want = best_of(rows, 20, 20)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    assert got.keys() == want.keys()
    scores = {q: dict(v) for q, v in want.items()}
    hits = [len(got[q].keys() & scores[q].keys()) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert sorted(rank for rank, _ in found.values()) == list(range(1, 21))
        assert all(abs(s - scores[q][i]) < 1e-9 for i, (_, s) in found.items() if i in scores[q])


def test_neighbours_of_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(frame, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 21), (0, 2, 20), (20, 1, 21), (20, 2, 0)]
    assert neighbours.nearest(frame.where("false"), F.lit(True)).count() == 0


# packing


def test_encoder_equals_the_tokenizer():
    texts = [r[1] for r in odd_rows()] + ["", " lead", "trail ", "a  b", "a \n b", "\n\n x", "don't we'll", " x y  z", "x\ty z"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = list(packing.Encoder(TOKENIZER).encode(pa.array(texts, pa.string())))
    for text, ids in zip(texts, got, strict=True):
        assert list(ids) == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def check_pieces(rows, length):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    full = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at == length or at & (at - 1) == 0
        full += at == length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert len(by_sequence) - full <= length.bit_length()


def test_packing_loses_no_token(odd, empty):
    rows = packing.pack(odd, TOKENIZER, window=256, length=64).collect()
    check_pieces(rows, 64)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = {}
    for r in odd_rows():
        texts.setdefault(r[0], []).append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    held = {}
    for r in rows:
        held.setdefault(r["id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert held.keys() == texts.keys()
    for i, ids in texts.items():
        assert sum(n for _, n, _ in held[i]) == sum(map(len, ids))
        for start, n, crc in held[i]:
            assert zlib.crc32(np.array(ids[0][start : start + n], "<u4").tobytes()) == crc
    assert packing.pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1, "c": 1}, {"a": 0.5}])
def test_windows_hold_the_target_mixture(spark, weights):
    docs = [doc(i, invented(i, 20 + i % 50), "abc"[i % 3]) for i in range(300)]
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    rows = packing.pack(frame, TOKENIZER, weights=weights, window=1024, length=64).collect()
    check_pieces(rows, 64)
    totals, served = {}, {}
    for r in rows:
        totals[r["source"]] = totals.get(r["source"], 0) + r["length"]
    share = {s: (weights or totals).get(s) or totals[s] for s in totals}
    # the first quarter of the run, before any queue can be dry
    windows = sum(totals.values()) // 1024 // 4
    for r in rows:
        if r["sequence_id"] * 64 < windows * 1024:
            served[r["source"]] = served.get(r["source"], 0) + r["length"]
    for s in totals:
        want = min(totals[s], windows * 1024 * share[s] / sum(share.values()))
        if weights is None or "b" in weights:
            assert abs(served.get(s, 0) - want) <= 64 + 0.02 * want


def test_schedule_places_every_token_once():
    from fractions import Fraction

    totals, weights = [500, 3, 0, 1000, 77], [Fraction(w) for w in (3, 1, 1, Fraction(1, 2), 9)]
    schedule = packing.Schedule([t for t in totals if t], [w for t, w in zip(totals, weights, strict=True) if t], 50, 16)
    seen = []
    for q, total in enumerate([t for t in totals if t]):
        for first in range(0, total, 7):
            for start, size, position in schedule.place(q, first, min(7, total - first)):
                seen += range(position, position + size)
    assert sorted(seen) == list(range(sum(totals)))


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 3)
    docs = [doc(i, invented(i, 30), f"s{i % 11}") for i in range(80)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS).repartition(4), TOKENIZER, window=256, length=64).collect()
    check_pieces(rows, 64)
    assert {r["id"] for r in rows} == set(range(80)) and {r["source"] for r in rows} == {f"s{i}" for i in range(11)}


@pytest.mark.parametrize("weights", [None, {"a": 6, "b": 2, "c": 2}])
def test_mixture_holds_beyond_the_limit_of_queues(spark, monkeypatch, weights):
    monkeypatch.setattr(packing, "QUEUES", 8)
    names = ["a", "b", "c", None, *(f"s{k}" for k in range(40))]
    docs = [doc(i, invented(i, 20 + i % 30), "abc"[i % 3] if i % 2 else names[i % len(names)]) for i in range(1600)]
    frame = spark.createDataFrame(docs, DOCS).repartition(5, "source")  # a source lies in one part
    rows = packing.pack(frame, TOKENIZER, weights=weights, window=1024, length=64).collect()
    check_pieces(rows, 64)
    totals, served = {}, {}
    for r in rows:
        totals[r["source"]] = totals.get(r["source"], 0) + r["length"]
    given = {s: (weights or {}).get(s) or n for s, n in totals.items()}
    windows = sum(totals.values()) // 1024 // 4
    if weights:  # they are far below token counts, so the named sources come last
        given_total = sum(given.values())
        early = {s: windows * 1024 * given[s] / given_total for s in totals}
    else:
        early = {s: n * windows * 1024 / sum(totals.values()) for s, n in totals.items()}
    for r in rows:
        if r["sequence_id"] * 64 < windows * 1024:
            served[r["source"]] = served.get(r["source"], 0) + r["length"]
    longest = max(r["tokens"] for r in rows)
    for s in totals:
        slack = 64 if s in ("a", "b", "c") else 2 * longest
        assert abs(served.get(s, 0) - early[s]) <= slack + 0.02 * early[s], s


# quotation

TALK = "conv_id long, turn long, role string, text string, level int, piece string"


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello World\nsecond line\n\nthird para"), (1, 1, "a", "On Monday, X wrote:\n> hello   world\n> second line\nYes it is."),
        (1, 2, "u", "unrelated"), (1, 3, "u", "> On Monday, X wrote:\n>> hello world\n> Yes it is.\nGood >not a quote\n"),
        (1, 4, "a", "> nothing known\nfoo"), (1, 5, "u", ">third para\n> foo\nend"), (2, 0, "u", None), (2, 1, "u", ""), (2, 2, "u", "> "),
        (None, 0, "u", "> a\nb"), (3, 5, "u", "> later\nsooner"), (3, 6, "u", "later"), (1, 2, "u", "unrelated"), (4, None, "u", "> q\nr"),
    ]
    frame = spark.createDataFrame([r + (7, "clash") for r in rows], TALK)
    found = quotation.link(frame).collect()
    assert len(found) == len(rows)
    got = {(r["conv_id"], r["turn"]): (r["text"], r["reply_to"], r["thread"], r["depth"]) for r in found}
    assert got[1, 1] == ("Yes it is.", 0, 0, 1)
    assert got[1, 3] == ("Good >not a quote", 1, 0, 2)
    assert got[1, 4] == ("foo", None, 4, 0)
    assert got[1, 5] == ("end", 0, 0, 1)
    assert got[1, 2] == ("unrelated", None, 2, 0)
    assert got[2, 0] == (None, None, 0, 0) and got[2, 1][0] == "" and got[2, 2][0] == ""
    assert got[None, 0][0] == "b" and got[4, None][0] == "r"
    assert got[3, 5] == ("sooner", None, 5, 0)
    order = [(r["turn"]) for r in sorted((r for r in found if r["conv_id"] == 1), key=lambda r: (r["thread"], r["turn"]))]
    assert order == [0, 1, 3, 5, 2, 2, 4]
    assert quotation.link(frame.where("false")).count() == 0


def test_long_reply_chains_and_native_plan(spark):
    rows = [(1, 0, "u", "message 0")] + [(1, i, "u", f"> message {i - 1}\nmessage {i}") for i in range(1, 40)]
    linked = quotation.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert all((r["thread"], r["depth"]) == (0, r["turn"]) for r in linked.collect())
    assert "Python" not in linked._jdf.queryExecution().toString()


# mixing


def water_levels(sizes, weights, share, epochs):
    """Redistribution until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > epochs * sizes[s]]
        if not over:
            return {**capped, **target}
        capped.update({s: epochs * sizes[s] for s in over})


@pytest.mark.parametrize("seed", range(3))
def test_mixture_equals_stepwise_redistribution(spark, seed):
    r = random.Random(seed)
    sources = ["b", "a", "", "é", "Z", None, "aa"]
    docs = [doc(i, invented(i, r.randrange(60)), sources[min(6, int(r.expovariate(0.5)))]) for i in range(200)]
    found = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    sizes, taken = {}, {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + len(WORD.findall(d[1]))
    want = water_levels(sizes, (5, 2, 1), 1.5, 2)
    for x in found:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6 * (1 + want[x["source"]])
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(0 <= want[s] - taken[s] < 1 + 1e-6 for s in sizes)


def test_mixture_of_odd_rows(odd, empty):
    found = mixing.mix(odd).collect()
    assert len(found) == len(odd_rows())
    assert sorted((x["id"] or 0, x["size"]) for x in found) == sorted((r[0] or 0, len(WORD.findall(r[1] or ""))) for r in odd_rows())
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix(empty).count() == 0 == mixing.sample(empty).count()


def test_sampled_texts_hold_the_taken_words(spark, odd):
    taken = sum(x["taken"] for x in mixing.mix(odd).collect())
    rows = mixing.sample(odd)
    assert rows.columns == odd.columns
    known = [r[1] or "" for r in odd_rows()]
    texts = [r["text"] or "" for r in rows.collect()]
    assert sum(len(WORD.findall(t)) for t in texts) == taken
    assert all(any(k.startswith(t) for k in known) for t in texts)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
