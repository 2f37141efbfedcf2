"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from factspan.llm.queries import QUERIES, SQL
from factspan.llm.shared import table

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "n_shingles", "component_id", "kept"},
    "op3": {"doc_id", "held_out", "lang_pred", "score"},
    "op4": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"query_id", "rank", "vec_id", "score"},
    "op7": {"query_id", "rank", "vec_id", "score"},
    "op8": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10": {"doc_id", "size", "source_size", "target", "taken"},
    "op11": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op12": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_its_columns_and_rows(spark, name):
    rows = QUERIES[name](spark, SMALL)
    assert COLUMNS.get(name.split("_")[0], set()) <= set(rows.columns)
    found = rows.collect()
    if name.split("_")[0] in ("op1", "op3", "op4", "op10", "op11", "op12"):
        docs = [r["doc_id"] for r in table(spark, SMALL, "documents").select("doc_id").collect()]
        assert sorted(r["doc_id"] for r in found) == sorted(docs)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rows = QUERIES[name](spark, SMALL)
    columns = sorted(rows.columns)
    got = sorted((tuple(r) for r in rows.select(*columns).collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert got == sorted(want, key=repr)


def test_stages_pass_on_the_columns_of_documents(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL)
        assert docs.columns == columns, name
    assert 0 < docs.count() <= 2 * before


def test_stages_take_empty_documents(spark):
    docs = table(spark, SMALL, "documents").where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SMALL)
    assert docs.count() == 0


def test_filter_stages_keep_clean_documents(spark):
    docs = table(spark, SMALL, "documents")
    assert corpus_pipeline.language_id(spark, docs, SMALL).count() == docs.count()
    clean = docs.join(table(spark, SMALL, "labels").where("toxic = 0"), "doc_id", "left_semi")
    kept = corpus_pipeline.non_toxic(spark, docs, SMALL)
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()


def test_language_stage_rejects_unknown_languages_and_noise(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki",
        " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(60)),
        "".join(r.choice(letters + letters.upper() + "0123456789+/") for _ in range(600)),
        "12 34 !!", "", None,
    ]
    docs = table(spark, SMALL, "documents")
    planted = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.language_id(spark, docs.unionByName(planted, allowMissingColumns=True), SMALL)
    assert sorted(x["doc_id"] for x in kept.select("doc_id").collect()) == sorted(
        x["doc_id"] for x in docs.select("doc_id").collect()
    )


def test_pipeline_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    docs = table(spark, SMALL, "documents")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SMALL)
    # where pieces are cut follows the order of the written rows; what they hold does not
    held = [sorted(map(tuple, d.groupBy("doc_id").agg({"length": "sum"}).collect())) for d in (rows, docs)]
    assert held[0] == held[1]
