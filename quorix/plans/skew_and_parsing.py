"""Queries p1 (rows that fail to parse) and p2 (a few keys holding most records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.operators import compressed_stats as cs
from quorix.operators import record_parser as rp
from quorix.session import table

#: A key is hot from this share of all rows on.
HOT_SHARE = 0.02


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.rejects(rp.parse_lines(table(spark, sf_dir, "rating_lines"))).select("line_id", "reason")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rp.parse_lines(table(spark, sf_dir, "rating_lines"))
    return rp.records(parsed).select("line_id", "feed", "ordinal", "row_idx", "col_idx", "value", "ts")


def p1_rejects_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rp.parse_lines(table(spark, sf_dir, "rating_lines"))
    return rp.rejects(parsed).groupBy("feed", "reason").agg(F.count(F.lit(1)).alias("n"))


def _compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.compress(table(spark, sf_dir, "ratings"), {"row": "row_idx", "col": "col_idx"}, "value")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.heavy_keys(_compressed(spark, sf_dir), HOT_SHARE).select("side", "key_id")


def p2_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.key_stats(_compressed(spark, sf_dir))


def p2_key_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least, the quartiles and the largest value of every key."""
    return cs.weighted_quantiles(_compressed(spark, sf_dir), [0.0, 0.25, 0.75, 1.0])


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_rejects_by_reason, p2_found, p2_key_stats, p2_key_quantiles)}

# The parser's rules once more, as regular expressions over whole lines.
_PARSE_SQL = r"""
WITH l AS (
  SELECT line_id, feed, rtrim(coalesce(line, ''), ' ' || chr(13)) AS s FROM rating_lines
), q AS (
  SELECT *, feed IN ('triple', 'noted')
      AND NOT regexp_full_match(s, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS broken,
    len(string_split(regexp_replace(s, '"([^"]|"")*"', 'Q', 'gs'), ',')) AS n_comma,
    string_split(s, '::') AS ml,
    string_split(s, chr(9)) AS tabs
  FROM l
), f AS (
  SELECT line_id, feed, s, broken,
    CASE WHEN s = '' THEN false
         WHEN feed = 'triple' THEN n_comma = 3
         WHEN feed = 'noted' THEN n_comma = 4
         WHEN feed = 'movielens' THEN len(ml) = 4
         ELSE len(tabs) = 2 END AS counted,
    CASE WHEN feed = 'movielens' THEN trim(ml[1], ' ' || chr(13)) WHEN feed = 'adjacency' THEN trim(tabs[1], ' ' || chr(13))
         ELSE regexp_extract(s, '^("([^"]|"")*"|[^",]*)', 1, 's') END AS a,
    CASE WHEN feed = 'movielens' THEN trim(ml[2], ' ' || chr(13))
         WHEN feed <> 'adjacency' THEN regexp_extract(s, '^("([^"]|"")*"|[^",]*),("([^"]|"")*"|[^",]*)', 3, 's') END AS b,
    CASE WHEN feed = 'movielens' THEN trim(ml[3], ' ' || chr(13))
         WHEN feed <> 'adjacency' THEN regexp_extract(s, '^("([^"]|"")*"|[^",]*),("([^"]|"")*"|[^",]*),("([^"]|"")*"|[^",]*)', 5, 's') END AS c,
    CASE WHEN feed = 'movielens' THEN trim(ml[4], ' ' || chr(13)) END AS d,
    CASE WHEN feed = 'adjacency' THEN list_filter(list_transform(string_split(tabs[2], ' '), lambda x: trim(x, ' ' || chr(13))), lambda x: x <> '') END AS pairs
  FROM q
), u AS (
  SELECT * REPLACE (
    CASE WHEN feed IN ('triple', 'noted') THEN CASE WHEN a[1] = '"' THEN replace(a[2:-2], '""', '"') ELSE trim(a, ' ' || chr(13)) END ELSE a END AS a,
    CASE WHEN feed IN ('triple', 'noted') THEN CASE WHEN b[1] = '"' THEN replace(b[2:-2], '""', '"') ELSE trim(b, ' ' || chr(13)) END ELSE b END AS b,
    CASE WHEN feed IN ('triple', 'noted') THEN CASE WHEN c[1] = '"' THEN replace(c[2:-2], '""', '"') ELSE trim(c, ' ' || chr(13)) END ELSE c END AS c)
  FROM f
), r AS (
  SELECT *, CASE
    WHEN broken THEN 'quoting'
    WHEN NOT counted THEN 'column_count'
    WHEN feed = 'adjacency' AND (len(pairs) = 0 OR len(list_filter(pairs, lambda x: len(string_split(x, ':')) <> 2)) > 0) THEN 'column_count'
    WHEN NOT regexp_full_match(a, '[0-9]+') OR coalesce(try_cast(a AS HUGEINT), 9999999999) > 2147483647 THEN 'row_idx'
    WHEN feed = 'adjacency' AND len(list_filter(pairs, lambda x: NOT regexp_full_match(string_split(x, ':')[1], '[0-9]+')
         OR coalesce(try_cast(string_split(x, ':')[1] AS HUGEINT), 9999999999) > 2147483647)) > 0 THEN 'col_idx'
    WHEN feed = 'adjacency' AND len(list_filter(pairs, lambda x: NOT regexp_full_match(string_split(x, ':')[2], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
         OR NOT isfinite(coalesce(try_cast(string_split(x, ':')[2] AS FLOAT), 'inf'::FLOAT)))) > 0 THEN 'value'
    WHEN feed = 'adjacency' THEN NULL
    WHEN NOT regexp_full_match(b, '[0-9]+') OR coalesce(try_cast(b AS HUGEINT), 9999999999) > 2147483647 THEN 'col_idx'
    WHEN NOT regexp_full_match(c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
         OR NOT isfinite(coalesce(try_cast(c AS FLOAT), 'inf'::FLOAT)) THEN 'value'
    WHEN feed = 'movielens' AND (NOT regexp_full_match(d, '[0-9]+') OR coalesce(try_cast(d AS HUGEINT), 9999999999) > 2147483647) THEN 'ts'
    END AS reason
  FROM u
)
"""

ORACLE = {
    "p1_found": _PARSE_SQL + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_rejects_by_reason": _PARSE_SQL + "SELECT feed, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "p1_records": _PARSE_SQL
    + r"""SELECT line_id, feed, CAST(0 AS INTEGER) AS ordinal, CAST(a AS INTEGER) AS row_idx, CAST(b AS INTEGER) AS col_idx,
  CAST(c AS FLOAT) AS value, CAST(d AS INTEGER) AS ts FROM r WHERE reason IS NULL AND feed <> 'adjacency'
UNION ALL
SELECT line_id, feed, CAST(i - 1 AS INTEGER), CAST(a AS INTEGER), CAST(string_split(pairs[i], ':')[1] AS INTEGER),
  CAST(string_split(pairs[i], ':')[2] AS FLOAT), NULL
FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM r WHERE reason IS NULL AND feed = 'adjacency')""",
    "p2_found": """
WITH k AS (SELECT 'row' AS side, row_idx AS key_id FROM ratings UNION ALL SELECT 'col', col_idx FROM ratings)
SELECT side, key_id FROM k WHERE key_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM ratings)""",
    "p2_key_stats": """
WITH k AS (SELECT 'row' AS side, row_idx AS key_id, value FROM ratings UNION ALL SELECT 'col', col_idx, value FROM ratings),
v AS (SELECT side, key_id, CASE WHEN isnan(value) THEN NULL ELSE CAST(value AS DOUBLE) END AS v FROM k WHERE key_id IS NOT NULL),
m AS (SELECT side, key_id, v, count(*) AS w FROM v WHERE v IS NOT NULL GROUP BY ALL),
o AS (SELECT side, key_id, v AS value_mode FROM m QUALIFY row_number() OVER (PARTITION BY side, key_id ORDER BY w DESC, v) = 1)
SELECT v.side, v.key_id, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS n_values, sum(v) AS value_sum, avg(v) AS value_mean,
  CAST(count(DISTINCT v) AS BIGINT) AS n_distinct, any_value(o.value_mode) AS value_mode, quantile_disc(v, 0.5) AS value_median
FROM v LEFT JOIN o ON v.side = o.side AND v.key_id = o.key_id GROUP BY ALL""",
    "p2_key_quantiles": """
WITH k AS (SELECT 'row' AS side, row_idx AS key_id, value FROM ratings UNION ALL SELECT 'col', col_idx, value FROM ratings),
v AS (SELECT side, key_id, CAST(value AS DOUBLE) AS v FROM k WHERE key_id IS NOT NULL AND NOT isnan(value))
SELECT side, key_id, min(v) AS q0, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q2, max(v) AS q3 FROM v GROUP BY ALL""",
}
