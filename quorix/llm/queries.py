"""Queries p3 to p8 on whole tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.llm import encoding, mixing, sampling, similar_vectors, term_counts, truncation
from quorix.session import snapshot, table

#: Asking rows of the search query: ids divisible by this.
ASK_EVERY = 100


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled Records; a value that is no number is shown as null."""
    ratings = table(spark, sf_dir, "ratings")
    value = F.when(~F.isnan("value"), F.col("value")).alias("value")
    return sampling.sample_records(ratings, sampling.batch_weights(ratings)).select("rec_id", "row_idx", "col_idx", value, "batch_no", "sample_probability")


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.selected_cells(sampling.batch_weights(table(spark, sf_dir, "ratings")))


def p3_grown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells from weights stored and advanced batch after batch."""
    return sampling.selected_cells(sampling.stored_weights(table(spark, sf_dir, "ratings")))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "factors_r").unionByName(table(spark, sf_dir, "factors_c"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.similar_pairs(_factors(spark, sf_dir), min_cos=0.95, k=10)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors.similar_vectors(_factors(spark, sf_dir), k=10, asks=F.col("id") % ASK_EVERY == 0, exhaustive=True)
    return near.select("side", "id", "nbr", F.round("cos", 6).alias("cos"), "rank")


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of the asking ids through the index, without a threshold."""
    near = similar_vectors.similar_vectors(_factors(spark, sf_dir), k=10, asks=F.col("id") % ASK_EVERY == 0)
    return near.select("side", "id", "nbr", F.round("cos", 6).alias("cos"), "rank")


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 10 true neighbours of the asking ids the index finds, per side."""
    true = p4_neighbours(spark, sf_dir).select("side", "id", "nbr")
    found = p4_nearest(spark, sf_dir).select("side", "id", "nbr", F.lit(1).alias("hit"))
    both = true.join(found, ["side", "id", "nbr"], "left").groupBy("side")
    return both.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = term_counts.mark_terms(table(spark, sf_dir, "sparse_blocks"))
    return marked.where(F.col("mark").isNotNull()).select("term_id", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.mark_terms(table(spark, sf_dir, "sparse_blocks"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p6_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts share a chunk with another, and how many of the chunks are distinct."""
    return encoding.chunk_reuse(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(snapshot(encoding.token_counts(docs)), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report.where("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).documents


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.detect_truncated(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(truncation.detect_truncated(table(spark, sf_dir, "documents")))


def p8_by_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each kind of evidence marks, the named method's (trigram) first asked of every text."""
    judged = truncation.detect_truncated(table(spark, sf_dir, "documents"))
    return judged.where("truncated").groupBy("evidence").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {
    f.__name__: f
    for f in (p3_sample, p3_cells, p3_grown_cells, p4_found, p4_neighbours, p4_nearest, p4_recall, p5_found, p5_counts, p6_ids, p6_reuse, p7_found, p7_report, p7_mix, p8_found, p8_rates, p8_by_evidence)
}

_SAMPLED = """
WITH b AS (SELECT row_idx, col_idx, batch_no, count(*) AS n FROM ratings WHERE row_idx IS NOT NULL AND col_idx IS NOT NULL GROUP BY ALL),
w AS (SELECT row_idx, col_idx, max(n) AS weight FROM b GROUP BY ALL),
s AS (SELECT *, least(1.0::DOUBLE, weight * 0.05::DOUBLE) AS probability FROM w
  WHERE CAST(CAST('0x' || substr(md5('0:' || row_idx || ':' || col_idx), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < weight * 0.05::DOUBLE)
"""
_USABLE = """
WITH u AS (
  SELECT DISTINCT side, id, CAST(f AS DOUBLE[]) AS f FROM (SELECT * FROM factors_r UNION ALL SELECT * FROM factors_c)
  WHERE len(f) = 48 AND len(list_filter(f, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(f, lambda x: x <> 0)) > 0
)
"""
_TERMS = """
WITH d AS (SELECT DISTINCT * FROM sparse_blocks),
r AS (SELECT row_map, col_map, col_idx, row_ptr, unnest(range(1, len(row_map) + 1)) AS i FROM d WHERE row_ptr IS NOT NULL AND col_idx IS NOT NULL AND col_map IS NOT NULL),
e AS (SELECT row_map[i] AS record, col_map, unnest(col_idx[row_ptr[i] + 1 : row_ptr[i + 1]]) AS c FROM r WHERE i < len(row_ptr)),
x AS (SELECT record, col_map[c + 1] AS term_id FROM e WHERE c >= 0),
t AS (SELECT term_id, count(*) AS n_entries, count(DISTINCT record) AS n_records FROM x WHERE term_id IS NOT NULL AND record IS NOT NULL GROUP BY term_id),
a AS (SELECT count(DISTINCT record) AS n_all FROM (SELECT unnest(row_map) AS record FROM sparse_blocks)),
m AS (SELECT term_id, n_entries, n_records, CASE WHEN n_records <= 3 THEN 'rare' WHEN n_records >= 0.2 * n_all THEN 'common' END AS mark FROM t, a)
"""

ORACLE = {
    "p3_cells": _SAMPLED + "SELECT row_idx, col_idx, weight, probability FROM s",
    "p3_grown_cells": _SAMPLED + "SELECT row_idx, col_idx, weight, probability FROM s",
    "p3_sample": _SAMPLED
    + "SELECT rec_id, r.row_idx, r.col_idx, CASE WHEN NOT isnan(value) THEN value END AS value, batch_no, probability AS sample_probability FROM ratings r JOIN s ON r.row_idx = s.row_idx AND r.col_idx = s.col_idx",
    "p4_found": _USABLE
    + """SELECT DISTINCT a.side, a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.side = b.side AND a.id < b.id
WHERE list_cosine_similarity(a.f, b.f) >= 0.95""",
    "p4_neighbours": _USABLE
    + """, c AS (SELECT a.side, a.id, b.id AS nbr, list_cosine_similarity(a.f, b.f) AS cos FROM u a JOIN u b ON a.side = b.side AND a.id <> b.id WHERE a.id % 100 = 0)
SELECT side, id, nbr, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY side, id ORDER BY cos DESC, nbr) AS rank FROM c) WHERE rank <= 10""",
    "p5_found": _TERMS + "SELECT term_id, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": _TERMS + "SELECT term_id, n_entries, n_records, mark FROM m",
}
