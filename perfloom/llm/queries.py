"""The training-data operators as queries over the benchmark tables, each with its oracle text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.llm import (
    ann, decontaminate, html_template, packing, periodic, piecewise, pitman_yor, preference, quality, resample, sharding, simhash, tokencount)
from perfloom.llm.common import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_nb_svm")
def op1_nb_svm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")  # other columns may be called as the results
    out = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, max_distance=4)


@query("op3_rendezvous")
def op3_rendezvous(spark, sf_dir):
    return sharding.shard_slots(table(spark, sf_dir, "documents"), weights=[1.0] * 8)


@query("op4_harmonic")
def op4_harmonic(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


DECONTAMINATION_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, w, least(len(w), 10) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
bench AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT n FROM bench),
grams AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT rid, i, grams.n AS n, item_id FROM grams JOIN bench USING (n, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items FROM hits GROUP BY rid),
named AS (SELECT rid, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid) LEFT JOIN named USING (rid)
"""


@query("op7_decontaminate", DECONTAMINATION_SQL)
def op7_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


@query("op5_viterbi_count")
def op5_viterbi_count(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


PREFERENCE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT conv_id, max(struct_pack(turn, role, text)) AS r FROM t WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT conv_id, 'c' AS side, turn, role, text FROM t
  UNION ALL
  SELECT t.conv_id, 'r', t.turn, t.role, t.text FROM t LEFT JOIN last USING (conv_id)
  WHERE last.r IS NULL OR struct_pack(turn := t.turn, role := t.role, text := t.text) < last.r
  UNION ALL
  SELECT own.conv_id, 'r', own.r.turn, other.r.role, other.r.text FROM last own JOIN last other ON other.conv_id = own.conv_id + 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS k FROM sides),
met AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.k, r.k) AS k,
         coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM placed WHERE side = 'c') c FULL JOIN (SELECT * FROM placed WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.k = r.k),
prefix AS (SELECT conv_id, coalesce(min(k) FILTER (NOT same), max(k) + 1) - 1 AS n FROM met GROUP BY conv_id),
shown AS (
  SELECT p.*, n, '<|' || role || '|>
' AS head, '<|' || role || '|>
' || text || '<|end|>
' AS line
  FROM placed p JOIN prefix USING (conv_id)),
laid AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, side, k > n ORDER BY k
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM shown),
spanned AS (SELECT *, CAST(pos + length(head) AS VARCHAR) || '-' || CAST(pos + length(line) AS VARCHAR) AS span FROM laid)
SELECT conv_id, CAST(any_value(n) AS BIGINT) AS n_shared,
       coalesce(string_agg(line, '' ORDER BY k) FILTER (side = 'c' AND k <= n), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY k) FILTER (side = 'c' AND k > n), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 'c' AND k > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(line, '' ORDER BY k) FILTER (side = 'r' AND k > n), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 'r' AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM spanned GROUP BY conv_id
"""


@query("op9_preference", PREFERENCE_SQL)
def op9_preference(spark, sf_dir):
    convs = preference.turns(table(spark, sf_dir, "conversations"))
    pairs = preference.preference_pairs(preference.with_other_reply(convs))
    return pairs.select(
        F.col("id").alias("conv_id"), "n_shared", "prompt", "chosen", preference.spans_text(F.col("chosen_spans")).alias("chosen_mask"),
        "rejected", preference.spans_text(F.col("rejected_spans")).alias("rejected_mask"))


@query("op10_adaptive_scan")
def op10_adaptive_scan(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op8_template")
def op8_template(spark, sf_dir):
    return html_template.main_text(table(spark, sf_dir, "pages"))


@query("op6_pitman_yor")
def op6_pitman_yor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = pitman_yor.score(docs, ~pitman_yor.held_out())
    return out.withColumn("held_out", pitman_yor.held_out())


#: crc32 byte by byte over a table that a rule gives; DuckDB has no such function.
RESAMPLING_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT] || list_transform(range(8), lambda k: k::BIGINT),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS rid, text FROM documents
  UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
words AS (
  SELECT side, doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, rid, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT side, rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
grams AS (SELECT side, rid, g, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (
  SELECT g, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda b: ('0x' || b)::BIGINT),
                            lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM grams), crc),
sums AS (
  SELECT bucket, coalesce(sum(k) FILTER (side = 'd'), 0) AS s, coalesce(sum(k) FILTER (side = 'b'), 0) AS t
  FROM grams JOIN hashed USING (g) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s::DOUBLE) OVER () + 10000)
                                      / ((CAST(s AS DOUBLE) + 1) * (sum(t::DOUBLE) OVER () + 10000)))) AS BIGINT) AS gain FROM sums),
weighed AS (SELECT rid, sum(k) AS n_features, sum(k * gain) AS weight FROM grams JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (
  SELECT doc_id, rid, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (rid) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


@query("op11_line_resampling", RESAMPLING_SQL)
def op11_line_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42, least_words=20)


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents"), alter=True)


@query("op13_piecewise_hash")
def op13_piecewise_hash(spark, sf_dir):
    return piecewise.against_next(table(spark, sf_dir, "documents"))
