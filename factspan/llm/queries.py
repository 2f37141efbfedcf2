"""One query per operator over its whole table, and the SQL that states its answer where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.llm import (
    exact_search,
    hard_negatives,
    language,
    lexicon_prints,
    license_scan,
    mixing,
    near_dedup,
    neighbours,
    packing,
    periods,
    quotation,
    toxicity,
    training_order,
)
from factspan.llm.shared import bucket_of, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _held(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op1_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), "kept"
    )


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.write_in_order(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_language_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, bucket_of("doc_id", 3) != 1)
    return found.select(F.col("id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", _held(3, 1))


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = {"doc_id": F.col("doc_id").cast("long"), "__text": F.col("text")}
    marks = toxicity.marked(docs, table(spark, sf_dir, "labels"), bucket_of("id", 4) != 2)
    model = toxicity.fit(marks, docs.select(columns["doc_id"].alias("id"), "text"))
    scored = toxicity.score(docs, model, columns, "doc_id bigint")
    return scored.withColumn("held_out", _held(4, 2)).withColumn("predicted", (F.col("score") >= toxicity.LIMIT).cast("int"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset"
    )


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(table(spark, sf_dir, "conversations"))


def op10_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexicon_prints.with_next(docs, lexicon_prints.lexicon(docs)).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def repeated_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten, by the crc32 of its id, the words from place ``a`` on
    repeat those of one period; all other texts are as they were."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), words.alias("w"))
    n = F.size("w").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    rest = (n - F.col("a")).cast("int")
    root = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(edited).alias("text"))


def op12_synchronising_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse(repeated_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), F.lit(""))
    best = periods.strongest(F.col("runs"))
    rows = found.select("id", "runs", "collapsed", lines.alias("lines"), best.alias("best"))
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_min_max_near_dedup, op2_training_order, op3_language_family, op4_ftrl_toxicity, op5_license_scan,
        op6_posting_lists, op7_ball_tree, op8_mixture_packing, op9_quotation_linking, op10_capped_water_filling,
        op11_i_match, op12_synchronising_runs, op13_kronecker_negatives,
    )
}

SQL = {
    "op1_min_max_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
), smallest AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN smallest USING (doc_id)
""",
    "op7_ball_tree": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.z, c.z)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op9_quotation_linking": r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS m, conv_id, turn, role, text,
    string_split_regex(text, '\r?\n') AS raw FROM conversations
), lines AS (
  SELECT m, conv_id, turn, i, raw[i] AS line,
    len(regexp_replace(regexp_extract(raw[i], '^[ \t]*>[ \t>]*'), '[^>]', '', 'g')) AS level
  FROM cut, unnest(range(1, len(raw) + 1)) AS u(i)
), runs AS (
  SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY i) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY m ORDER BY i) AS before,
               lead(level) OVER (PARTITION BY m ORDER BY i) AS after FROM lines)
), passages AS (
  SELECT m, conv_id, turn, level, list(regexp_replace(line, '^[ \t]*>[ \t>]*', '') ORDER BY i) AS ls
  FROM runs GROUP BY m, conv_id, turn, level, run
), pieces AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(translate(p,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g')) AS piece
  FROM passages, unnest(list_concat([array_to_string(ls, chr(10))],
    list_concat(string_split_regex(array_to_string(ls, chr(10)), '\n[ \t\r]*\n'), ls))) AS u(p)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), quoted AS (SELECT * FROM pieces WHERE level > 0 AND piece <> ''),
origins AS (SELECT conv_id, piece, min(turn) AS origin FROM pieces WHERE level = 0 AND piece <> '' GROUP BY ALL),
hits AS (
  SELECT q.*, o.origin FROM quoted q LEFT JOIN origins o
    ON o.conv_id = q.conv_id AND o.piece = q.piece AND o.origin < q.turn
), weights AS (
  SELECT conv_id, turn, level, origin, sum(len(piece)) AS chars FROM hits WHERE origin IS NOT NULL GROUP BY ALL
), answers AS (
  SELECT conv_id, turn, origin AS up FROM weights
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, origin DESC) = 1
), walk AS (
  SELECT conv_id, turn, up AS thread, 1 AS depth FROM answers
  UNION ALL SELECT w.conv_id, w.turn, a.up, w.depth + 1 FROM walk w JOIN answers a ON a.conv_id = w.conv_id AND a.turn = w.thread
), roots AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM walk GROUP BY ALL),
counts AS (SELECT conv_id, turn, count(*) AS quotes, count(origin) AS linked FROM hits GROUP BY ALL),
clean AS (
  SELECT m, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (
    level = 0 AND NOT (regexp_matches(line, 'wrote:[ \t\r]*$') AND coalesce(after, 0) > 0)), ''),
    '^([ \t\r]*\n)+|(\n[ \t\r]*)+$', '', 'g') AS text
  FROM runs GROUP BY m HAVING max(level) > 0
)
SELECT c.conv_id, c.turn, c.role, CASE WHEN k.m IS NULL THEN c.text ELSE k.text END AS text, a.up AS reply_to,
  coalesce(r.thread, c.turn) AS thread, coalesce(r.depth, 0)::BIGINT AS depth,
  coalesce(n.quotes, 0)::BIGINT AS quotes, coalesce(n.linked, 0)::BIGINT AS linked
FROM cut c LEFT JOIN clean k USING (m)
LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn
LEFT JOIN roots r ON r.conv_id = c.conv_id AND r.turn = c.turn
LEFT JOIN counts n ON n.conv_id = c.conv_id AND n.turn = c.turn
""",
    "op10_capped_water_filling": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight,
    2 * source_size AS cap FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), free AS (
  SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1
), goals AS (
  SELECT source, source_size, least(coalesce((SELECT level FROM free) * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM weighed
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goals
), running AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.copies, floor(p.target)::BIGINT - p.copies * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY digest, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM running
""",
    "op12_synchronising_runs": r"""
WITH bits AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS e
  FROM documents
), hashed AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, e), lambda c, b: CASE
    WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) AS h FROM bits
), placed AS (
  SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS parts FROM hashed
), words AS MATERIALIZED (
  SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END] AS t
  FROM placed, unnest(range(n)) AS u(i)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.t = y.t AND x.i < y.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS r FROM runs
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  floor(1000 * length / period)::BIGINT AS exponent_milli, sha256(coalesce(told.s, '')) AS runs_sha256,
  sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (doc_id)
""",
    "op13_kronecker_negatives": """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.z, c.z)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.z) = len(c.z) WHERE q.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), held AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS r
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM held WHERE r <= 3
""",
}
