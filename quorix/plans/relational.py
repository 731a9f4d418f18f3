"""Queries for counting, parsing, blocking, vector and one-step model operators, each with its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.functions import exprs as X
from quorix.functions import vectors as V
from quorix.models.consensus import global_step, mean_gamma
from quorix.models.lda import DocBlocks, Topics, e_pass, m_step
from quorix.models.lr import Blocks, fit_lr
from quorix.models.mf import Links, triangle
from quorix.operators import counts as N
from quorix.operators import metrics as M
from quorix.operators import partition as P
from quorix.schema import LrParams, LrStrategy, MfParams, MfStrategy, Optimizer
from quorix.session import snapshot, table
from quorix.sources import datasets
from quorix.sources import text as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- shared inputs ----------------------------------------------------------------------------------


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, value): parts x suppliers with the mean quantity, one row per pair."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("row"), F.col("l_suppkey").cast("int").alias("col")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))


_RATINGS = "r AS (SELECT CAST(l_partkey AS INTEGER) AS row, CAST(l_suppkey AS INTEGER) AS col, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", "fmt", F.explode(F.filter(F.split("text", " "), lambda t: t != "")).alias("token"))


_TOKENS = "t AS (SELECT * FROM (SELECT doc_id, fmt, unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL) WHERE token <> '')"


def clicks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    c = (F.col("event_type") == "click").cast("int")
    i = F.col("event_type").isin("click", "view").cast("int")
    return e.select("user_id", "event_type", "ts", "value", c.alias("clicks"), i.alias("impressions"))


_CLICKS = "c AS (SELECT user_id, event_type, ts, value, CAST(event_type = 'click' AS INTEGER) AS clicks, CAST(event_type IN ('click', 'view') AS INTEGER) AS impressions FROM events)"


def lr_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    label = F.when(F.col("label") == 0, 1).otherwise(-1)
    val = F.concat(F.array(F.lit(1.0)), F.col("embedding").cast("array<double>"))
    return e.select(F.col("vec_id").alias("row_id"), label.alias("label"), F.sequence(F.lit(0), F.size("embedding")).alias("idx"), val.alias("val"))


def lr_weights(spark: SparkSession, d: str) -> DataFrame:
    """Closed-form start: mean difference of both classes per feature."""
    pos, neg = (F.avg(F.when(F.col("label") == s, F.col("value"))) for s in (1, -1))
    return T.explode_vectors(lr_vectors(spark, d)).groupBy("feature").agg((pos - neg).alias("w"))


def lr_blocks(spark: SparkSession, d: str) -> Blocks:
    return Blocks.of(lr_vectors(spark, d), 4)


_LR = """x AS (SELECT row_id, label, feature, value FROM (
  SELECT vec_id AS row_id, CASE WHEN label = 0 THEN 1 ELSE -1 END AS label, 0 AS feature, 1.0::DOUBLE AS value FROM embeddings WHERE embedding IS NOT NULL
  UNION ALL SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE -1 END, unnest(range(1, len(embedding) + 1)), CAST(unnest(embedding) AS DOUBLE) FROM embeddings)),
w AS (SELECT feature, avg(value) FILTER (label = 1) - avg(value) FILTER (label = -1) AS w FROM x GROUP BY feature),
s AS (SELECT row_id, label, sum(w * value) AS score FROM x JOIN w USING (feature) GROUP BY ALL),
m AS (SELECT row_id, label, score, label * score AS margin, CASE WHEN label * score < -10 THEN 4.5398e-05 WHEN label * score > 10 THEN 1 - 1e-05 ELSE 1 / (1 + exp(-label * score)) END AS sg FROM s)"""


def _r(c: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(c)


# --- counts, vocabularies ---------------------------------------------------------------------------


@query(f"WITH {_TOKENS} SELECT token, count(*) AS n FROM t GROUP BY token")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return N.token_counts(tokens(spark, d))


@query(f"""WITH {_TOKENS}, k AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT token, n, row_number() OVER (ORDER BY n DESC, encode(token)) - 1 AS index FROM k QUALIFY index < 200""")
def token_topk(spark: SparkSession, d: str) -> DataFrame:
    return N.top_tokens(N.token_counts(tokens(spark, d)), 200).withColumn("index", F.col("index").cast("bigint"))


@query(f"WITH {_TOKENS} SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) > 20")
def vocab_threshold(spark: SparkSession, d: str) -> DataFrame:
    return N.vocabulary(N.token_counts(tokens(spark, d)), 20)


@query(f"WITH {_TOKENS}, k AS (SELECT token, count(*) AS n FROM t GROUP BY token) SELECT n, count(*) AS tokens FROM k GROUP BY n")
def count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return N.count_histogram(N.token_counts(tokens(spark, d)))


@query(f"""WITH {_TOKENS}, d AS (SELECT DISTINCT doc_id, token, CASE WHEN fmt = 'md' THEN 1 ELSE -1 END AS label FROM t)
SELECT token AS feature, CAST(sum(CASE WHEN label = 1 THEN 10 ELSE 1 END) AS BIGINT) AS weight FROM d GROUP BY token HAVING sum(CASE WHEN label = 1 THEN 10 ELSE 1 END) >= 20""")
def weighted_df_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens(spark, d).select("doc_id", F.when(F.col("fmt") == "md", 1).otherwise(-1).alias("label"), F.col("token").alias("feature")).distinct()
    return N.weighted_document_frequency(rows, 20)


@query(f"""WITH {_TOKENS}, v AS (SELECT token, row_number() OVER (ORDER BY encode(token)) - 1 AS word FROM (SELECT token FROM t GROUP BY token HAVING count(*) > 20)),
c AS (SELECT doc_id AS doc, word, count(*) AS count FROM t JOIN v USING (token) GROUP BY ALL)
SELECT doc, string_agg(word || ':' || count, ' ' ORDER BY word) AS line FROM c GROUP BY doc""")
def doc_bow_lines(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    vocab = P.dense_index(N.vocabulary(N.token_counts(t), 20), "token", "word")
    c = t.join(vocab, "token").groupBy(F.col("doc_id").alias("doc"), "word").agg(F.count(F.lit(1)).alias("count"))
    return T.bag_of_words_lines(c)


@query(f"""WITH {_CLICKS} SELECT user_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round((sum(clicks) + 0.05 * 75) / (sum(impressions) + 75), 9) AS rate FROM c GROUP BY user_id""")
def ctr_by_user(spark: SparkSession, d: str) -> DataFrame:
    s = clicks(spark, d).groupBy("user_id").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return s.withColumn("rate", F.round(X.smoothed_rate(F.col("clicks"), F.col("impressions")), 9))


@query(f"""WITH {_CLICKS}, h AS (SELECT user_id, hour(ts) AS hour, clicks, impressions FROM c)
SELECT CASE WHEN grouping(user_id) = 0 THEN 'user_id' ELSE 'hour' END AS entity, CASE WHEN grouping(user_id) = 0 THEN user_id ELSE hour END AS id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions
FROM h GROUP BY GROUPING SETS ((user_id), (hour))""")
def ctr_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    c = clicks(spark, d).select("user_id", F.hour("ts").cast("bigint").alias("hour"), "clicks", "impressions")
    return N.clicks_by(c, ["user_id", "hour"])


@query(f"""WITH {_CLICKS}, u AS (SELECT user_id, (sum(clicks) + 3.75) / (sum(impressions) + 75) AS rate FROM c GROUP BY user_id), z AS (SELECT max(rate) / 100 AS size FROM u)
SELECT user_id, CAST(least(floor(rate / size), 99) AS INTEGER) AS bin FROM u, z""")
def ctr_bins(spark: SparkSession, d: str) -> DataFrame:
    s = clicks(spark, d).groupBy("user_id").agg(X.smoothed_rate(F.sum("clicks"), F.sum("impressions")).alias("rate"))
    top = s.agg((F.max("rate") / 100).alias("size"))
    return s.crossJoin(F.broadcast(top)).select("user_id", X.bucketize(F.col("rate"), F.col("size"), 100).alias("bin"))


@query(f"""WITH {_CLICKS}, u AS (SELECT user_id, CAST(sum(clicks) AS INTEGER) AS clicks, CAST(sum(impressions) AS INTEGER) AS impressions FROM c GROUP BY user_id)
SELECT user_id, nth, CASE WHEN nth <= clicks THEN 1 ELSE -1 END AS label FROM (SELECT *, CAST(unnest(range(1, impressions + 1)) AS INTEGER) AS nth FROM u WHERE impressions > 0)""")
def impression_expand(spark: SparkSession, d: str) -> DataFrame:
    s = clicks(spark, d).groupBy("user_id").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return N.expand_impressions(s).select("user_id", "nth", "label")


@query("SELECT CAST(floor(epoch(ts) / 21600) AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY 1")
def time_bucket_hist(spark: SparkSession, d: str) -> DataFrame:
    return N.bucket_counts(table(spark, d, "events"), X.time_bucket(F.unix_timestamp("ts"), 21600))


@query("""WITH RECURSIVE b AS (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1),
o AS (SELECT bucket, n, row_number() OVER (ORDER BY bucket) AS k, sum(n) OVER () / 10.0 AS slice FROM b),
f AS (SELECT k, bucket, n, slice, CASE WHEN slice - n < slice / 5 THEN 1 ELSE 0 END AS frame, CASE WHEN slice - n < slice / 5 THEN 0 ELSE n END AS acc FROM o WHERE k = 1
  UNION ALL SELECT o.k, o.bucket, o.n, o.slice, CASE WHEN o.slice - (f.acc + o.n) < o.slice / 5 THEN f.frame + 1 ELSE f.frame END, CASE WHEN o.slice - (f.acc + o.n) < o.slice / 5 THEN 0 ELSE f.acc + o.n END FROM f JOIN o ON o.k = f.k + 1)
SELECT bucket, CAST(frame AS INTEGER) AS frame, CAST(n AS BIGINT) AS n FROM f""")
def equal_mass_frames(spark: SparkSession, d: str) -> DataFrame:
    e = N.with_time_frames(table(spark, d, "events"), X.time_bucket(F.unix_timestamp("ts"), 21600), 10)
    return e.groupBy("bucket", "frame").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, (year(o_orderdate) - 1999) * 365 + (month(o_orderdate) - 1) * 30 + day(o_orderdate) AS day_no FROM orders")
def day_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.day_number(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("bigint").alias("day_no"))


# --- ratings, blocks --------------------------------------------------------------------------------

_GRID = _RATINGS + ", g AS (SELECT *, row % 4 AS rb, col % 3 AS cb, (row % 4) * 3 + col % 3 AS block FROM r)"


@query(f"WITH {_RATINGS} SELECT max(row) AS max_row, max(col) AS max_col, count(*) AS n, round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_mean FROM r")
def rating_summary(spark: SparkSession, d: str) -> DataFrame:
    s = N.rating_summary(ratings(spark, d))
    return s.withColumns({"value_sum": F.round("value_sum", 4), "value_mean": F.round("value_mean", 6)})


@query(f"WITH {_GRID} SELECT row, col, rb, cb, block FROM g")
def ratings_blocks_2d(spark: SparkSession, d: str) -> DataFrame:
    return P.rating_blocks(ratings(spark, d), 4, 3, by="modulo").select("row", "col", "rb", "cb", "block")


@query(f"WITH {_GRID} SELECT block, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols, count(*) AS nnz FROM g GROUP BY block")
def block_stats(spark: SparkSession, d: str) -> DataFrame:
    return N.block_stats(P.rating_blocks(ratings(spark, d), 4, 3, by="modulo"))


@query(f"WITH {_GRID} SELECT row, list_sort(list(DISTINCT block)) AS blocks FROM g GROUP BY row")
def block_membership(spark: SparkSession, d: str) -> DataFrame:
    return N.block_membership(P.rating_blocks(ratings(spark, d), 4, 3, by="modulo"), "row", "block")


@query(f"WITH {_GRID} SELECT row, list_sort(list(DISTINCT block)) AS blocks FROM g GROUP BY row HAVING count(DISTINCT block) > 1")
def multi_block_ids(spark: SparkSession, d: str) -> DataFrame:
    return N.multi_block(N.block_membership(P.rating_blocks(ratings(spark, d), 4, 3, by="modulo"), "row", "block"))


@query("SELECT p_partkey, CAST(least(p_partkey // 300, 4) AS INTEGER) AS block FROM part")
def range_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", P.range_block("p_partkey", 300, 5).alias("block"))


@query("SELECT l_orderkey, l_linenumber, CAST((l_partkey % 2) * 6 + (l_suppkey % 3) * 2 + (quarter(l_shipdate) % 2) AS INTEGER) AS block FROM lineitem")
def cube_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = P.cube_block(P.modulo_block("l_partkey", 2), P.modulo_block("l_suppkey", 3), P.modulo_block(F.quarter("l_shipdate"), 2), 3, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b.alias("block"))


@query("SELECT n_nationkey, r_regionkey, CAST(n_nationkey * 5 + r_regionkey AS INTEGER) AS block FROM nation, region")
def cross_blocks(spark: SparkSession, d: str) -> DataFrame:
    # two fixed tables of 25 and 5 rows: block coordinates, not data
    n, r = table(spark, d, "nation").select("n_nationkey"), table(spark, d, "region").select("r_regionkey")
    return n.crossJoin(F.broadcast(r)).withColumn("block", P.grid_block(F.col("n_nationkey"), F.col("r_regionkey"), 5))


@query("SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS index FROM (SELECT DISTINCT o_custkey FROM orders)")
def dense_index(spark: SparkSession, d: str) -> DataFrame:
    return P.dense_index(table(spark, d, "orders"), "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def probe_split_anti(spark: SparkSession, d: str) -> DataFrame:
    return _probe(spark, d)[0]


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def probe_split_semi(spark: SparkSession, d: str) -> DataFrame:
    return _probe(spark, d)[1]


def _probe(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    probe = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.probe_split(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), probe, ("l_orderkey",))


@query(f"WITH {_RATINGS}, p AS (SELECT r.*, avg(value) OVER (PARTITION BY row) AS pred FROM r) SELECT round(sqrt(avg((pred - value) * (pred - value))), 6) AS rmse FROM p")
def rmse_row_mean(spark: SparkSession, d: str) -> DataFrame:
    r = ratings(spark, d)
    row_f = r.groupBy(F.col("row").alias("id")).agg(F.array(F.avg("value")).alias("f"))
    col_f = r.select(F.col("col").alias("id")).distinct().withColumn("f", F.array(F.lit(1.0)))
    return M.rmse(M.predictions(r, row_f, col_f)).select(_r("rmse"))


@query(f"""WITH {_RATINGS}, f AS (SELECT col, [1.0::DOUBLE, avg(value), (col % 7)::DOUBLE] AS f FROM r GROUP BY col),
e AS (SELECT row, value, f, unnest(range(0, 3)) AS a FROM r JOIN f USING (col)), u AS (SELECT *, unnest(range(-1, 3)) AS b FROM e)
SELECT row, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(sum(f[a + 1] * CASE WHEN b = -1 THEN value ELSE f[b + 1] END), 4) AS xtx FROM u WHERE b = -1 OR b >= a GROUP BY ALL""")
def als_normal_eq(spark: SparkSession, d: str) -> DataFrame:
    r = ratings(spark, d)
    f = r.groupBy("col").agg(F.avg("value").alias("m")).select(F.col("col").alias("id"), F.array(F.lit(1.0), "m", (F.col("col") % 7).cast("double")).alias("f"))
    f = f.withColumn("prec", F.transform("f", lambda _: F.lit(float("inf"))))
    sums = Links.of(r, "row", "col", 4).normal_equations(f, 3)
    # packed: the upper triangle of X'X row by row, then X'y
    places = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.get("packed", F.lit(i)).alias("v")) for i, (a, b) in enumerate([*zip(*(x.tolist() for x in triangle(3))), (0, -1), (1, -1), (2, -1)])))
    return sums.select(F.col("id").alias("row"), F.inline(places)).groupBy("row", "a", "b").agg(F.round(F.sum("v"), 4).alias("xtx"))


@query(f"""WITH {_GRID}, s AS (SELECT row AS id, block, [avg(value), count(*)::DOUBLE] AS f, [1.0::DOUBLE + block, 2.0::DOUBLE] AS g FROM g GROUP BY row, block),
e AS (SELECT id, unnest(range(0, 2)) AS k, f, g FROM s)
SELECT id, CAST(k AS INTEGER) AS k, round(CASE WHEN count(*) <= 1 THEN 0 ELSE sum(f[k + 1] * g[k + 1]) / (sum(g[k + 1]) + 0.5) END, 6) AS f FROM e GROUP BY ALL""")
def consensus_l2(spark: SparkSession, d: str) -> DataFrame:
    merged = global_step(_factor_state(spark, d), lam=0.5, regularizer="L2", dual=False, weighted=False, plain=False, own_only=F.lit(False))
    return merged.select("id", F.posexplode("f").alias("k", "f")).withColumn("f", F.round("f", 6))


# --- text formats -----------------------------------------------------------------------------------


@query("""SELECT CAST(l_orderkey AS BIGINT) AS row_id, CASE WHEN l_linenumber = 1 THEN 1 ELSE -1 END AS label, [0, CAST(l_partkey AS INTEGER) + 1, CAST(l_suppkey AS INTEGER) + 1] AS idx, [1.0, CAST(l_quantity AS DOUBLE), 1.0] AS val FROM lineitem""")
def libsvm_parse(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    sign = F.when(F.col("l_linenumber") == 1, "+1").otherwise("-1")
    line = F.concat_ws(" ", sign, F.concat_ws(":", "l_partkey", F.col("l_quantity").cast("double")), "l_suppkey")
    return T.libsvm(li.select(F.col("l_orderkey").cast("bigint").alias("row_id"), line.alias("value")))


@query("SELECT CAST(l_orderkey AS INTEGER) AS row, CAST(l_partkey AS INTEGER) AS col, CAST(l_quantity AS DOUBLE) AS value FROM lineitem")
def adjacency_parse(spark: SparkSession, d: str) -> DataFrame:
    pair = F.concat_ws(":", "l_partkey", F.col("l_quantity").cast("double"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(pair), " ").alias("p"))
    return T.adjacency(g.select(F.concat_ws("\t", "l_orderkey", "p").alias("value")))


@query("SELECT CAST(l_orderkey AS INTEGER) AS i, CAST(l_partkey AS INTEGER) AS j, CAST(l_suppkey AS INTEGER) AS k, (CAST(l_quantity AS DOUBLE) - 25) / 10 AS value FROM lineitem")
def tensor_adjacency_parse(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat_ws(":", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(cell), " ").alias("p"))
    return T.adjacency(g.select(F.concat_ws("\t", "l_orderkey", "p").alias("value")), ("i", "j", "k"), 25.0, 10.0)


@query("SELECT CAST(l_partkey AS INTEGER) AS row, CAST(l_suppkey AS INTEGER) AS col, CAST(l_quantity AS DOUBLE) AS value FROM lineitem")
def delimited_parse(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("|", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double"))
    return T.delimited(table(spark, d, "lineitem").select(line.alias("value")), ("row", "col"), "|")


@query("""WITH e AS (SELECT CAST(user_id AS INTEGER) AS i, CAST(event_id % 50 AS INTEGER) AS j, CAST(epoch(ts) AS BIGINT) AS ts, value FROM events)
SELECT i, j, CAST(ts // 86400 - (SELECT min(ts // 86400) FROM e) AS INTEGER) AS k, round(value, 6) AS value FROM e""")
def time_tensor(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("::", "user_id", F.col("event_id") % 50, "value", F.unix_timestamp("ts"))
    parsed = T.movielens(table(spark, d, "events").select(line.alias("value")))
    return T.time_tensor(parsed, 86400).withColumn("value", F.round("value", 6))


@query("SELECT CAST(event_id AS BIGINT) AS row_id, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS label, CAST(2 AS INTEGER) AS n_tokens FROM events")
def ads_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.concat_ws("\t", "event_id", (F.col("event_type") == "click").cast("int"), "user_id", F.concat_ws(" ", "event_type", "user_id"))
    return T.ads(e.select(F.col("event_id").cast("bigint").alias("row_id"), line.alias("value"))).select("row_id", "label", F.size("tokens").alias("n_tokens"))


@query("SELECT CAST(l_suppkey AS INTEGER) AS row, CAST(l_orderkey AS INTEGER) AS col, CAST(l_quantity AS DOUBLE) AS value, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem")
def headed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Header lines carried forward: one file per order with the order as header."""
    return T.netflix(_headed_lines(spark, d))


def _headed_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    body = li.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") + 1).alias("line_no"), F.concat_ws(",", "l_suppkey", F.col("l_quantity").cast("double"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("value"))
    head = li.select(F.col("l_orderkey").alias("file")).distinct().select("file", F.lit(0).alias("line_no"), F.concat("file", F.lit(":")).alias("value"))
    return head.unionByName(body)


@query("""WITH RECURSIVE n AS (SELECT CAST(l_suppkey AS INTEGER) AS i, CAST(l_orderkey AS INTEGER) AS j, CAST(l_quantity AS DOUBLE) AS q, (year(l_shipdate) - 1999) * 365 + (month(l_shipdate) - 1) * 30 + day(l_shipdate) AS bucket FROM lineitem),
b AS (SELECT bucket, count(*) AS n FROM n GROUP BY 1), o AS (SELECT bucket, n, row_number() OVER (ORDER BY bucket) AS k, sum(n) OVER () / 8.0 AS slice FROM b),
f AS (SELECT k, bucket, CASE WHEN slice - n < slice / 5 THEN 1 ELSE 0 END AS frame, CASE WHEN slice - n < slice / 5 THEN 0 ELSE n END AS acc FROM o WHERE k = 1
  UNION ALL SELECT o.k, o.bucket, CASE WHEN o.slice - (f.acc + o.n) < o.slice / 5 THEN f.frame + 1 ELSE f.frame END, CASE WHEN o.slice - (f.acc + o.n) < o.slice / 5 THEN 0 ELSE f.acc + o.n END FROM f JOIN o ON o.k = f.k + 1)
SELECT i, j, CAST(frame AS INTEGER) AS k, (q - 25) / 10 AS value FROM n JOIN f USING (bucket)""")
def framed_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Files with header lines to a tensor whose third dimension are time frames of about equal mass."""
    return datasets.netflix_tensor(_headed_lines(spark, d), 8, mean=25.0, scale=10.0)[0]


def _sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One LibSVM row per event: the user with the value, and the event's number modulo 997."""
    e = table(spark, d, "events")
    line = F.concat_ws(" ", F.when(F.col("event_type") == "click", "+1").otherwise("-1"), F.concat_ws(":", "user_id", "value"), F.col("event_id") % 997 + 1_000_000)
    return T.libsvm(e.select(F.col("event_id").cast("bigint").alias("row_id"), line.alias("value")))


@query("""WITH x AS (SELECT event_id AS row_id, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS label, unnest([0, user_id + 1, event_id % 997 + 1000001]) AS feature, unnest([1.0::DOUBLE, value::DOUBLE, 1.0::DOUBLE]) AS value FROM events),
k AS (SELECT feature FROM x WHERE feature <> 0 GROUP BY feature HAVING sum(CASE WHEN label = 1 THEN 20 ELSE 1 END) >= 41),
i AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS index FROM k UNION ALL SELECT 0, 0)
SELECT CAST(row_id AS BIGINT) AS row_id, label, list(index ORDER BY index) AS idx, list(value ORDER BY index) AS val FROM x JOIN i USING (feature) GROUP BY row_id, label""")
def lr_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Training data with the features that reach a weighted document frequency of 41, renumbered."""
    return datasets.lr_dataset(_sparse_vectors(spark, d), threshold=41)


@query("""SELECT CAST(event_id AS INTEGER) AS id, CAST(user_id AS INTEGER) AS user, CAST(hour(ts) AS INTEGER) AS ad, CAST(event_type = 'click' AS INTEGER) AS clicks, CAST(1 AS INTEGER) AS impressions FROM events WHERE event_type IN ('click', 'view')""")
def ctr_test_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Test rows and their labels, from two files' lines, joined by id."""
    e = table(spark, d, "events")
    features = T.int_table(e.select(F.concat_ws("\t", "event_id", F.lit("x"), F.hour("ts"), "user_id").alias("value")), ("id", "ad", "user"), drop=(1,))
    clicks = (F.col("event_type") == "click").cast("int")
    labels = T.int_table(e.where("event_type IN ('click', 'view')").select(F.concat_ws("\t", "event_id", clicks, F.lit(1)).alias("value")), ("id", "clicks", "impressions"))
    return datasets.ctr_test_pairs(features, labels)


# --- vectors ----------------------------------------------------------------------------------------

_PAIR = "p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query(f"WITH {_PAIR} SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(list_dot_product(list_transform(list_zip(a, b), lambda z: z[1] + z[2]), b), 6) AS plus_dot FROM p")
def vec_dot(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return p.select("vec_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(V.plus_dot(F.col("a"), F.col("b"), F.col("b")), 6).alias("plus_dot"))


@query(f"WITH {_PAIR} SELECT vec_id, round(list_dot_product(a, a), 6) AS sq, round(sqrt(list_dot_product(a, a)), 6) AS l2, round(list_sum(list_transform(a, lambda x: abs(x))), 6) AS l1, round(list_avg(a), 6) AS mean, round(list_var_pop(a), 6) AS variance FROM p")
def vec_norms(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _pairs(spark, d).select("vec_id", F.round(V.squared_norm(a), 6).alias("sq"), F.round(V.norm(a), 6).alias("l2"), F.round(V.l1_norm(a), 6).alias("l1"), F.round(V.mean(a), 6).alias("mean"), F.round(V.variance(a), 6).alias("variance"))


@query(f"WITH {_PAIR} SELECT vec_id, round(list_distance(a, b), 6) AS dist, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2] * 2 + z[1] - z[2])), 6) AS mixed FROM p")
def vec_dist(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    mixed = V.total(V.add(V.scale(V.multiply(a, b), 2.0), V.subtract(a, b)))
    return _pairs(spark, d).select("vec_id", F.round(V.distance(a, b), 6).alias("dist"), F.round(mixed, 6).alias("mixed"))


@query("""WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT label, k, sum(x) AS s FROM e GROUP BY ALL)
SELECT label, list(round(s, 5) ORDER BY k) AS vector_sum FROM s GROUP BY label""")
def vec_sum_by_label(spark: SparkSession, d: str) -> DataFrame:
    s = V.vector_sum(table(spark, d, "embeddings"), ["label"], "embedding")
    return s.select("label", F.transform("vector_sum", lambda x: F.round(x, 5)).alias("vector_sum"))


def _sparse_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per supplier, the quantities by part modulo 50 in even and in odd orders."""
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).cast("int").alias("i"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_orderkey") % 2).alias("side"))
    g = li.groupBy("l_suppkey", "side", "i").agg(F.sum("q").alias("q"))
    both = g.groupBy("l_suppkey", "side").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("e")).select("l_suppkey", "side", F.col("e.i").alias("idx"), F.col("e.q").alias("val"))
    return both.where("side = 0").drop("side"), both.where("side = 1").drop("side")


_SPARSE = """g AS (SELECT l_suppkey, CAST(l_partkey % 50 AS INTEGER) AS idx, sum(CAST(l_quantity AS DOUBLE)) FILTER (l_orderkey % 2 = 0) AS x, sum(CAST(l_quantity AS DOUBLE)) FILTER (l_orderkey % 2 = 1) AS y FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {_SPARSE} SELECT l_suppkey, idx, coalesce(x, 0) + coalesce(y, 0) AS value FROM g")
def sparse_add(spark: SparkSession, d: str) -> DataFrame:
    return V.sparse_combine(*_sparse_sides(spark, d), "l_suppkey", lambda x, y: x + y)


@query(f"WITH {_SPARSE} SELECT l_suppkey, sum(x * y) AS dot FROM g WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY l_suppkey")
def sparse_dot(spark: SparkSession, d: str) -> DataFrame:
    return V.sparse_dot(*_sparse_sides(spark, d), "l_suppkey")


@query(f"WITH {_SPARSE} SELECT l_suppkey, sum((coalesce(x, 0) - coalesce(y, 0)) ** 2) AS squared_distance, sum(abs(coalesce(x, 0) - coalesce(y, 0))) AS l1_distance FROM g GROUP BY l_suppkey")
def sparse_distances(spark: SparkSession, d: str) -> DataFrame:
    return V.sparse_distances(*_sparse_sides(spark, d), "l_suppkey")


# --- proximal steps and clamps ----------------------------------------------------------------------

_BY_LABEL = "e AS (SELECT label, unnest(range(0, len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT label, k, sum(x) AS num, CAST(count(*) AS DOUBLE) AS den FROM e GROUP BY ALL)"


def _by_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return e.groupBy("label", F.col("k").cast("bigint").alias("k")).agg(F.sum(F.col("x").cast("double")).alias("num"), F.count(F.lit(1)).cast("double").alias("den"))


@query(f"WITH {_BY_LABEL} SELECT label, k, round(CASE WHEN num > 1 THEN num - 1 WHEN num < -1 THEN num + 1 ELSE 0 END / den, 8) + 0.0 AS w FROM s")
def prox_l1(spark: SparkSession, d: str) -> DataFrame:
    return _by_label(spark, d).select("label", "k", (F.round(X.l1_prox(F.col("num"), F.col("den"), 1.0), 8) + 0.0).alias("w"))


@query(f"WITH {_BY_LABEL} SELECT label, k, round(num / (den + 1), 8) AS w FROM s")
def prox_l2(spark: SparkSession, d: str) -> DataFrame:
    return _by_label(spark, d).select("label", "k", F.round(X.l2_prox(F.col("num"), F.col("den"), 1.0), 8).alias("w"))


@query(f"""WITH {_BY_LABEL}, v AS (SELECT label, list(num / den ORDER BY k) AS v FROM s GROUP BY label), q AS (SELECT label, v, list_dot_product(v, v) AS sq FROM v)
SELECT label, list_transform(v, lambda x: round(CASE WHEN sq > 0.01 THEN x * sqrt(0.01 / sq) ELSE x END, 8)) AS w FROM q""")
def prox_maxnorm(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_label(spark, d).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "num", "den"))).alias("e"))
    w = X.max_norm(F.col("e.num"), F.col("e.den"), 0.01)
    return rows.select("label", F.transform(w, lambda x: F.round(x, 8)).alias("w"))


@query(f"WITH {_BY_LABEL} SELECT label, k, round((num / den - 0.1 * num) / 0.9, 8) AS w FROM s")
def savgm_fix(spark: SparkSession, d: str) -> DataFrame:
    return _by_label(spark, d).select("label", "k", F.round(X.savgm_fix(F.col("num") / F.col("den"), F.col("num"), 0.1), 8).alias("w"))


@query("SELECT event_id, round(CASE WHEN v < -10 THEN 4.5398e-05 WHEN v > 10 THEN 1 - 1e-05 ELSE 1 / (1 + exp(-v)) END, 9) AS sg, round(CASE WHEN v > -10 THEN -ln(1 + exp(-v)) ELSE v END, 6) AS ll, round(ln(abs(v) + 1), 2) AS lc FROM (SELECT event_id, value / 5 - 10 AS v FROM events)")
def clamps(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") / 5 - 10
    return table(spark, d, "events").select("event_id", F.round(X.sigmoid(v), 9).alias("sg"), F.round(X.log_likelihood(v), 6).alias("ll"), X.log_count(F.abs(v)).alias("lc"))


# --- logistic regression at fixed weights -----------------------------------------------------------


def _lr_evaluation(spark: SparkSession, d: str) -> DataFrame:
    w = lr_weights(spark, d)
    return M.evaluation(lr_blocks(spark, d).scores(w), w, 1.0)


@query(f"WITH {_LR} SELECT row_id, label, round(margin, 6) AS margin FROM m")
def lr_margin(spark: SparkSession, d: str) -> DataFrame:
    return M.margins(lr_blocks(spark, d).scores(lr_weights(spark, d))).withColumn("margin", F.round("margin", 6))


@query(f"WITH {_LR} SELECT CAST(feature AS INTEGER) AS feature, round(sum(m.label * (1 - sg) * value), 5) AS g FROM x JOIN m USING (row_id) GROUP BY feature")
def lr_gradient(spark: SparkSession, d: str) -> DataFrame:
    return lr_blocks(spark, d).gradient(lr_weights(spark, d)).withColumn("g", F.round("g", 5))


@query(f"WITH {_LR} SELECT round(sum(greatest(sg * (1 - sg), 1e-5) * score * score), 5) AS h FROM m")
def lr_curvature(spark: SparkSession, d: str) -> DataFrame:
    return lr_blocks(spark, d).curvature(lr_weights(spark, d).withColumn("d", F.col("w"))).withColumn("h", F.round("h", 5))


@query(f"WITH {_LR} SELECT round(sum(CASE WHEN margin > -10 THEN -ln(1 + exp(-margin)) ELSE margin END), 5) AS llh FROM m")
def lr_llh(spark: SparkSession, d: str) -> DataFrame:
    return _lr_evaluation(spark, d).select(F.round("llh", 5).alias("llh"))


@query(f"WITH {_LR} SELECT round(sum(CASE WHEN margin > -10 THEN ln(1 + exp(-margin)) ELSE -margin END) + 0.5 * (SELECT sum(w * w) FROM w), 5) AS objective FROM m")
def lr_objective(spark: SparkSession, d: str) -> DataFrame:
    return _lr_evaluation(spark, d).select(F.round("objective", 5).alias("objective"))


@query(f"""WITH {_LR}, p AS (SELECT label, CASE WHEN score < -10 THEN 4.5398e-05 WHEN score > 10 THEN 1 - 1e-05 ELSE 1 / (1 + exp(-score)) END AS p FROM s),
i AS (SELECT unnest(range(0, 502)) AS i), c AS (SELECT i, avg(CAST(p > (i - 1) / 500.0 AS DOUBLE)) FILTER (label = 1) AS tpr, avg(CAST(p > (i - 1) / 500.0 AS DOUBLE)) FILTER (label = -1) AS fpr FROM i, p GROUP BY i),
z AS (SELECT *, lead(tpr, 1, 0) OVER (ORDER BY i) AS t0, lead(fpr, 1, 0) OVER (ORDER BY i) AS f0 FROM c)
SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM z""")
def lr_auc500(spark: SparkSession, d: str) -> DataFrame:
    return _lr_evaluation(spark, d).select(F.round("auc", 6).alias("auc"))


_FIRST = """c AS (SELECT row_id % 4 AS block, row_id, label, feature, value FROM x),
g AS (SELECT {b}, feature, sum(label * 0.5 * value) AS g FROM c GROUP BY ALL),
m AS (SELECT c.block, row_id, sum(g * value) AS dx FROM c JOIN g ON c.feature = g.feature AND {on} GROUP BY ALL),
h AS (SELECT {b}, sum(0.25 * dx * dx) AS h FROM m GROUP BY ALL),
s AS (SELECT {b}, sum(g * g) AS gg, sum(g * g) FILTER (feature <> 0) AS reg FROM g GROUP BY ALL)"""


@query(f"WITH {_LR.split('s AS (SELECT row_id')[0].rstrip().rstrip(',')}, {_FIRST.format(b='0 AS one', on='true')} SELECT CAST(feature AS INTEGER) AS feature, round(g * gg / (h + reg), 7) AS w FROM g, s, h")
def lr_first_exact_step(spark: SparkSession, d: str) -> DataFrame:
    """Weights after the first iteration of the exact gradient."""
    w = fit_lr(lr_vectors(spark, d), LrParams(strategy=LrStrategy.DGM, blocks=4, outer=1)).weights
    return w.select("feature", F.round("w", 7).alias("w"))


@query(f"WITH {_LR.split('s AS (SELECT row_id')[0].rstrip().rstrip(',')}, {_FIRST.format(b='block', on='c.block = g.block')} SELECT CAST(feature AS INTEGER) AS feature, round(avg(g * gg / (h + reg)), 7) AS w FROM g JOIN s USING (block) JOIN h USING (block) GROUP BY feature")
def lr_first_average(spark: SparkSession, d: str) -> DataFrame:
    """Weights after the first averaging of four blocks, each one step from zero."""
    v = lr_vectors(spark, d).withColumn("block", (F.col("row_id") % 4).cast("int"))
    w = fit_lr(v, LrParams(strategy=LrStrategy.AVGM, optimizer=Optimizer.CG, blocks=4, outer=1, inner=1)).weights
    return w.select("feature", F.round("w", 7).alias("w"))


# --- factorization at given factors -----------------------------------------------------------------


@query(f"""WITH {_RATINGS}, f AS (SELECT col, 1.0::DOUBLE AS x, avg(value) / 25 AS y FROM r GROUP BY col),
s AS (SELECT row, count(*) AS n, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(x * value) AS p, sum(y * value) AS q FROM r JOIN f USING (col) GROUP BY row),
t AS (SELECT row, a + 0.1 * n AS a, b, c + 0.1 * n AS c, p, q FROM s)
SELECT row AS id, round((c * p - b * q) / (a * c - b * b), 6) AS f0, round((a * q - b * p) / (a * c - b * b), 6) AS f1 FROM t""")
def als_first_half_step(spark: SparkSession, d: str) -> DataFrame:
    """Row factors of rank 2 solved from given column factors."""
    r = ratings(spark, d)
    f = r.groupBy(F.col("col").alias("id")).agg(F.array(F.lit(1.0), F.avg("value") / 25).alias("f")).withColumn("prec", F.array(F.lit(float("inf")), F.lit(float("inf"))))
    p = MfParams(strategy=MfStrategy.DMAP, rank=2, gamma=0.1, weighted=True)
    old = spark.createDataFrame([], "id int, f array<double>")
    got = Links.of(r, "row", "col", 4).half_step(f, old, p, "ALS", False, 0.1)
    return got.select("id", F.round(F.col("f")[0], 6).alias("f0"), F.round(F.col("f")[1], 6).alias("f1"))


def _factor_state(spark: SparkSession, d: str) -> DataFrame:
    """State rows of grid blocks: mean and number of each row's ratings as factors, 1 + block and 2 as precisions."""
    g = P.rating_blocks(ratings(spark, d), 4, 3, by="modulo").groupBy(F.col("row").alias("id"), "block").agg(F.avg("value").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    return g.select("block", F.lit(0).alias("dim"), "id", F.array("m", "n").alias("f"), zero.alias("lag"), F.array(1.0 + F.col("block"), F.lit(2.0)).alias("gamma"), F.lit(1.0).alias("n_obs"))


@query(f"""WITH {_GRID}, s AS (SELECT row AS id, block, avg(value) AS m, count(*)::DOUBLE AS n, 1.0 + block AS g FROM g GROUP BY row, block),
v AS (SELECT id, sum(g * m) / sum(g) AS x, sum(n) * 2 / (2.0 * count(*)) AS y, list_sort(list(block)) AS blocks FROM s GROUP BY id HAVING count(*) > 1)
SELECT id, [round(x * least(1, sqrt(400.0 / (x * x + y * y))), 6), round(y * least(1, sqrt(400.0 / (x * x + y * y))), 6)] AS f, blocks FROM v""")
def consensus_maxnorm_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Global factors of ids in several blocks under the max norm, with the blocks they come from."""
    merged = global_step(_factor_state(spark, d), lam=400.0, regularizer="MAX", dual=False, weighted=False, plain=False, own_only=F.lit(False), blocks=True)
    return merged.where(F.size("blocks") > 1).select("id", F.transform("f", lambda x: F.round(x, 6)).alias("f"), "blocks")


@query(f"WITH {_GRID}, b AS (SELECT DISTINCT block FROM g) SELECT CAST(0 AS INTEGER) AS dim, [round(avg(1.0 + block), 9), 2.0] AS gamma FROM b")
def mean_block_gamma(spark: SparkSession, d: str) -> DataFrame:
    return mean_gamma(_factor_state(spark, d)).select("dim", F.transform("gamma", lambda x: F.round(x, 9)).alias("gamma"))


# --- topic model at fixed parameters ----------------------------------------------------------------


def _topic_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = ratings(spark, d).select(F.col("row").alias("doc_id"), F.col("col").alias("word"), F.floor("value").cast("int").alias("count"))
    words = docs.select("word").distinct()
    topics = words.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("topic"), "word").withColumn("eta", 0.1 + ((F.col("word") * (F.col("topic") + 1)) % 11))
    gammas = docs.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("topic")).withColumn("gamma", 1.0 + (F.col("doc_id") + F.col("topic")) % 3)
    return docs, topics, gammas


_TOPICS = f"""{_RATINGS}, d AS (SELECT row AS doc_id, col AS word, CAST(floor(value) AS INTEGER) AS count FROM r),
t AS (SELECT topic, word, 0.1 + (word * (topic + 1)) % 11 AS eta FROM (SELECT DISTINCT word FROM d), (SELECT unnest(range(0, 4)) AS topic)),
b AS (SELECT topic, word, eta / sum(eta) OVER (PARTITION BY topic) AS beta FROM t),
g AS (SELECT doc_id, topic, (1.0 + (doc_id + topic) % 3) AS gamma FROM (SELECT DISTINCT doc_id FROM d), (SELECT unnest(range(0, 4)) AS topic)),
h AS (SELECT doc_id, topic, gamma / sum(gamma) OVER (PARTITION BY doc_id) AS theta FROM g)"""


@query(f"""WITH {_TOPICS}, p AS (SELECT d.doc_id, d.word, d.count, sum(theta * beta) AS p FROM d JOIN b ON d.word = b.word JOIN h ON h.doc_id = d.doc_id AND h.topic = b.topic GROUP BY ALL)
SELECT round(sum(count * ln(p)), 3) AS llh, CAST(sum(count) AS BIGINT) AS tokens, round(exp(-sum(count * ln(p)) / sum(count)), 6) AS perplexity FROM p""")
def lda_loglik(spark: SparkSession, d: str) -> DataFrame:
    docs, topics = _topic_tables(spark, d)
    r = e_pass(docs, topics, np.ones(4), rounds=0)
    return spark.createDataFrame([(round(r.llh, 3), int(r.tokens), round(math.exp(-r.llh / r.tokens), 6))], "llh double, tokens bigint, perplexity double")


def _topic_tables(spark: SparkSession, d: str) -> tuple[DocBlocks, Topics]:
    """Documents with gamma in blocks, and topics with a row per word."""
    docs, topics, gammas = _topic_inputs(spark, d)
    words = docs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "count"))).alias("e")).select("doc_id", F.col("e.word").alias("words"), F.col("e.count").alias("counts"))
    starts = gammas.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic", "gamma"))).alias("g")).select("doc_id", F.col("g.gamma").alias("gamma"))
    rows = topics.groupBy(F.col("word").cast("int").alias("word")).agg(F.array_sort(F.collect_list(F.struct("topic", "eta"))).alias("t")).select("word", F.transform("t", lambda e: e["eta"].cast("double")).alias("eta"))
    return DocBlocks.of(words.join(starts, "doc_id"), 4), Topics.of(snapshot(rows), 4, 0.1)


def _psi(x: str) -> str:
    """The digamma function as SQL: eight recurrences and the asymptotic series."""
    z = f"(({x}) + 8)"
    series = f"ln({z}) - 0.5 / {z} - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) + 1 / (240 * {z} ** 8)"
    return f"({series} - ({' + '.join(f'1.0 / (({x}) + {i})' for i in range(8))}))"


@query(f"""WITH {_TOPICS}, xb AS (SELECT topic, word, exp({_psi("eta")} - {_psi("sum(eta) OVER (PARTITION BY topic)")}) AS eb FROM t),
th AS (SELECT doc_id, topic, exp({_psi("gamma")} - {_psi("sum(gamma) OVER (PARTITION BY doc_id)")}) AS theta FROM g),
ph AS (SELECT d.doc_id, d.word, d.count, sum(theta * eb) AS phi FROM d JOIN xb ON d.word = xb.word JOIN th ON th.doc_id = d.doc_id AND th.topic = xb.topic GROUP BY ALL),
g2 AS (SELECT th.doc_id, th.topic, 1.0 + any_value(theta) * sum(eb * count / phi) AS gamma FROM ph JOIN xb ON ph.word = xb.word JOIN th ON th.doc_id = ph.doc_id AND th.topic = xb.topic GROUP BY th.doc_id, th.topic),
t2 AS (SELECT doc_id, topic, exp({_psi("gamma")} - {_psi("sum(gamma) OVER (PARTITION BY doc_id)")}) AS theta FROM g2),
p2 AS (SELECT d.doc_id, d.word, d.count, sum(theta * eb) AS phi FROM d JOIN xb ON d.word = xb.word JOIN t2 ON t2.doc_id = d.doc_id AND t2.topic = xb.topic GROUP BY ALL)
SELECT CAST(xb.topic AS INTEGER) AS topic, CAST(xb.word AS INTEGER) AS word, round(any_value(eb) * sum(theta * count / phi) + 0.1, 5) AS eta
FROM p2 JOIN xb ON p2.word = xb.word JOIN t2 ON t2.doc_id = p2.doc_id AND t2.topic = xb.topic GROUP BY xb.topic, xb.word""")
def lda_one_step(spark: SparkSession, d: str) -> DataFrame:
    """One E-step and M-step from given topics."""
    docs, topics = _topic_tables(spark, d)
    made = m_step(e_pass(docs, topics, np.ones(4), rounds=1), topics, 0.1)
    return made.long().select("topic", "word", F.round("eta", 5).alias("eta"))


@query(f"""WITH {_TOPICS} SELECT CAST(topic AS INTEGER) AS topic, word, round(beta, 9) AS p, CAST(row_number() OVER (PARTITION BY topic ORDER BY beta DESC, word) AS INTEGER) AS rank FROM b QUALIFY rank <= 10""")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    _, topics, _ = _topic_inputs(spark, d)
    return N.top_words(topics, 10).withColumn("p", F.round("p", 9))


@query("SELECT round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS mean_norm FROM embeddings")
def mean_factor_norm(spark: SparkSession, d: str) -> DataFrame:
    return N.mean_factor_norm(table(spark, d, "embeddings"), "embedding").select(_r("mean_norm"))


@query("""SELECT date_trunc('hour', ts) AS window_start, user_id, CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS clicks, CAST(sum(CAST(event_type IN ('click', 'view') AS INTEGER)) AS BIGINT) AS impressions,
round((sum(CAST(event_type = 'click' AS INTEGER)) + 3.75) / (sum(CAST(event_type IN ('click', 'view') AS INTEGER)) + 75), 9) AS rate FROM events GROUP BY 1, 2""")
def ctr_by_hour(spark: SparkSession, d: str) -> DataFrame:
    from quorix.streaming.rates import windowed_rates

    return windowed_rates(clicks(spark, d), "ts", "user_id", F.col("clicks"), F.col("impressions")).withColumn("rate", F.round("rate", 9))
