"""Queries of readers and writers (round trips through files), vector accessors, special functions, local sparse
structures and first iterations of the models, each with its SQL.

Files go to the session's checkpoint folder, which all executors share.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorix.etl import ctr
from quorix.functions import special as S
from quorix.functions import vectors as V
from quorix.models.lr import fit_lr
from quorix.models.mf import fit_mf
from quorix.models.tf import fit_tf
from quorix.operators import counts as N
from quorix.operators import partition as P
from quorix.operators import sparse as D
from quorix.operators.metrics import factor_penalty
from quorix.plans.relational import _CLICKS, _PAIR, _RATINGS, _TOKENS, _pairs, _psi, clicks, lr_vectors, ratings, tokens
from quorix.schema import Bound, LrParams, LrStrategy, MfParams, MfStrategy, Optimizer, TfParams
from quorix.session import ensure_checkpoint_dir, ship_package, table
from quorix.sources import readers
from quorix.sources import text as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/quorix-io-{uuid.uuid4().hex}"


# --- round trips ------------------------------------------------------------------------------------

_INT_RATINGS = "SELECT CAST(l_partkey AS INTEGER) AS row, CAST(l_suppkey AS INTEGER) AS col, CAST(l_quantity AS DOUBLE) AS value FROM lineitem"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("row"), F.col("l_suppkey").cast("int").alias("col"), F.col("l_quantity").cast("double").alias("value"))


@query(_INT_RATINGS)
def file_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Rating records written and read again."""
    at = _place(spark)
    readers.write_ratings(_rated(spark, d), at)
    return readers.read_ratings(spark, at)


@query(_INT_RATINGS.replace("CAST(l_quantity AS DOUBLE)", "(CAST(l_quantity AS DOUBLE) - 25) / 10"))
def file_ratings_text(spark: SparkSession, d: str) -> DataFrame:
    """Delimited rating lines, centred and scaled while read."""
    at = _place(spark)
    _rated(spark, d).select(F.concat_ws(";", "row", "col", "value").alias("value")).write.text(at)
    return readers.read_ratings(spark, at, "delimited", ";", 25.0, 10.0)


@query(_INT_RATINGS.replace(" FROM", ", CAST(l_partkey % 4 AS INTEGER) AS rb, CAST(l_suppkey % 3 AS INTEGER) AS cb FROM"))
def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Ratings written as one folder per block and read again."""
    at = _place(spark)
    readers.write_blocks(P.rating_blocks(_rated(spark, d), 4, 3, by="modulo").drop("block"), at, 3)
    return spark.read.parquet(at).select("row", "col", "value", "rb", "cb")


@query(_INT_RATINGS.replace(" FROM", ", CAST(l_partkey % 4 AS INTEGER) AS rb, CAST(l_suppkey % 3 AS INTEGER) AS cb FROM"))
def unblocked_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of parallel arrays back to ratings."""
    g = P.rating_blocks(_rated(spark, d), 4, 3, by="modulo").groupBy("rb", "cb", F.pmod(F.hash("row"), F.lit(16)))
    blocks = g.agg(F.collect_list(F.struct("row", "col", "value")).alias("e")).select("rb", "cb", F.col("e.row").alias("rows"), F.col("e.col").alias("cols"), F.col("e.value").alias("vals"))
    return readers.unblock(blocks)


@query("SELECT CAST(l_partkey AS INTEGER) AS i, CAST(l_suppkey AS INTEGER) AS j, CAST(l_linenumber AS INTEGER) AS k, CAST(l_quantity AS DOUBLE) / 2 AS value FROM lineitem")
def file_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Tensor cells written and read again, scaled."""
    at = _place(spark)
    li = table(spark, d, "lineitem")
    readers.write_tensor(li.select(*(F.col(c).cast("int").alias(n) for c, n in zip(("l_partkey", "l_suppkey", "l_linenumber"), "ijk")), F.col("l_quantity").cast("double").alias("value")), at)
    return readers.read_tensor(spark, at, scale=2.0)


@query("SELECT CAST(l_partkey AS INTEGER) AS i, CAST(l_suppkey AS INTEGER) AS j, CAST(l_linenumber AS INTEGER) AS k, CAST(l_quantity AS DOUBLE) AS value FROM lineitem")
def file_tensor_text(spark: SparkSession, d: str) -> DataFrame:
    """Delimited and adjacency tensor lines, the odd and the even suppliers."""
    at = _place(spark)
    li = table(spark, d, "lineitem")
    li.where("l_suppkey % 2 = 1").select(F.concat_ws(",", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("double")).alias("value")).write.text(f"{at}/a")
    li.where("l_suppkey % 2 = 0").select(F.concat("l_partkey", F.lit("\t"), F.concat_ws(":", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("double"))).alias("value")).write.text(f"{at}/b")
    return readers.read_tensor(spark, f"{at}/a", "delimited").unionByName(readers.read_tensor(spark, f"{at}/b", "adjacency"))


@query("SELECT label, list_transform(range(0, 64), lambda k: CAST(k AS INTEGER)) AS idx, vec_id FROM embeddings WHERE embedding IS NOT NULL")
def file_records(spark: SparkSession, d: str) -> DataFrame:
    """Int-array records with the label last, written and read again."""
    at = _place(spark)
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    numbers = F.sequence(F.lit(0), F.lit(63))
    readers.write_records(e.select(F.concat(numbers, F.array(F.col("vec_id").cast("int")), F.array(F.col("label").cast("int"))).alias("features")), at)
    back = T.int_records(spark.read.parquet(at))
    return back.select("label", F.slice("idx", 1, 64).alias("idx"), F.element_at("idx", -1).cast("bigint").alias("vec_id"))


@query(f"WITH {_RATINGS} SELECT CASE WHEN block = 1 THEN 'r' ELSE 'c' END AS side, id, round(f, 9) AS f0 FROM (SELECT 1 AS block, row AS id, avg(value) AS f FROM r GROUP BY row UNION ALL SELECT 2, col, avg(value) FROM r GROUP BY col)")
def file_factors(spark: SparkSession, d: str) -> DataFrame:
    """Factors of both sides, one folder per side."""
    at = _place(spark)
    r = ratings(spark, d)
    parts = [r.groupBy(F.col(c).alias("id")).agg(F.array(F.avg("value")).alias("f")).withColumn("side", F.lit(s)) for c, s in (("row", "r"), ("col", "c"))]
    readers.write_factors(parts[0].unionByName(parts[1]), at)
    return spark.read.parquet(at).select("side", "id", F.round(F.col("f")[0], 9).alias("f0"))


@query(f"""WITH {_TOKENS}, k AS (SELECT token, count(*) AS n FROM t GROUP BY token HAVING n > 50), h AS (SELECT n, count(*) AS tokens FROM k GROUP BY n)
SELECT 'tokens' AS file, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total FROM k UNION ALL SELECT 'histogram', count(*), CAST(sum(n * tokens) AS BIGINT) FROM h""")
def file_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Token counts and their histogram as CSV files."""
    at = _place(spark)
    readers.write_frequencies(N.vocabulary(N.token_counts(tokens(spark, d)), 50), at)
    k = spark.read.csv(f"{at}/frequencies", header=True, schema="token string, n bigint", multiLine=True)
    h = spark.read.csv(f"{at}/histogram", header=True, schema="n bigint, tokens bigint")
    one = k.agg(F.lit("tokens").alias("file"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
    return one.unionByName(h.agg(F.lit("histogram").alias("file"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") * F.col("tokens")).alias("total")))


@query("SELECT CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS label, [CAST(user_id AS INTEGER), CAST(event_id AS INTEGER)] AS idx FROM events")
def file_labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Remapped rows as `label id id` lines, read again as binary vectors."""
    at = _place(spark)
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("label"), F.array("user_id", "event_id").alias("idx"))
    readers.write_labelled_lines(e, at)
    return T.libsvm(readers.read_lines(spark, at), binary=True, intercept=False).select("label", "idx")


@query(f"""WITH {_RATINGS} SELECT words, list_transform(words, lambda w: CAST(w % 7 + 1 AS INTEGER)) AS counts FROM (SELECT list(col ORDER BY col) AS words FROM r GROUP BY row)""")
def file_documents(spark: SparkSession, d: str) -> DataFrame:
    """Document lines `word:count ...`, written in a training and a validation folder and read again."""
    at = _place(spark)
    lines = T.bag_of_words_lines(ratings(spark, d).select(F.col("row").alias("doc"), F.col("col").alias("word"), (F.col("col") % 7 + 1).alias("count")))
    readers.write_split(lines, at)
    return readers.read_documents(spark, f"{at}/*")


@query("SELECT CAST(p_partkey - (SELECT min(p_partkey) FROM part) AS INTEGER) AS word_id, 'word ' || p_partkey AS word FROM part")
def file_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary file: the line number is the id."""
    at = _place(spark)
    table(spark, d, "part").orderBy("p_partkey").select(F.concat(F.lit("word "), "p_partkey").alias("value")).coalesce(1).write.text(at)
    return readers.read_dictionary(spark, at)


@query("SELECT CAST(event_id % 9 AS INTEGER) AS iteration, 'value' AS metric, avg(value) AS value FROM events GROUP BY 1")
def file_history(spark: SparkSession, d: str) -> DataFrame:
    """A run's metrics as JSON lines."""
    at = _place(spark)
    readers.write_history(table(spark, d, "events").groupBy((F.col("event_id") % 9).cast("int").alias("iteration")).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("value")), at)
    return spark.read.schema("iteration int, metric string, value double").json(at)


@query("SELECT true AS small, count(*) AS lines FROM orders")
def file_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Text in files of at most 500 lines."""
    at = _place(spark)
    readers.write_rolling(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("value")), at, 500)
    per = spark.read.text(at).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.max("n") <= 500).alias("small"), F.sum("n").alias("lines"))


# --- further text formats ---------------------------------------------------------------------------


@query("SELECT CAST(l_orderkey AS INTEGER) AS doc, CAST(l_partkey AS INTEGER) AS word, CAST(l_quantity AS INTEGER) AS count FROM lineitem")
def docword_parse(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.concat_ws(" ", F.col("l_orderkey") + 1, F.col("l_partkey") + 1, F.col("l_quantity").cast("int")).alias("value"))
    head = spark.createDataFrame([("100",), ("200",), ("300",)], "value string")
    return T.docword(head.unionByName(li))


@query("SELECT CAST(o.o_custkey AS INTEGER) AS row, CAST(l_partkey AS INTEGER) AS col, CAST(l_quantity AS DOUBLE) AS value, CAST(l_linenumber AS INTEGER) AS day FROM lineitem JOIN orders o ON o_orderkey = l_orderkey WHERE o.o_custkey % 100 < 90")
def yahoo_parse(spark: SparkSession, d: str) -> DataFrame:
    """`user|n` headers, one file per order; users that claim too many ratings are dropped."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.lit(0).alias("line_no"), F.concat_ws("|", "o_custkey", F.when(F.col("o_custkey") % 100 < 90, 5).otherwise(10_000)).alias("value"))
    li = table(spark, d, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    body = li.select(F.col("l_orderkey").alias("file"), rank.alias("line_no"), F.concat_ws("\t", "l_partkey", F.col("l_quantity").cast("double"), "l_linenumber", F.lit("10:00:00")).alias("value"))
    return T.yahoo_music(o.unionByName(body), group="file")


@query("SELECT CAST(l_suppkey AS INTEGER) AS row, CAST(l_orderkey AS INTEGER) AS col FROM lineitem")
def probe_parse(spark: SparkSession, d: str) -> DataFrame:
    """`movie:` headers with one user per line."""
    li = table(spark, d, "lineitem")
    head = li.select(F.col("l_orderkey").alias("file")).distinct().select("file", F.lit(0).alias("line_no"), F.concat("file", F.lit(":")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    return T.netflix_probe(head.unionByName(li.select(F.col("l_orderkey").alias("file"), rank.alias("line_no"), F.col("l_suppkey").cast("string").alias("value"))), group="file")


@query("""WITH e AS (SELECT CAST(event_id AS INTEGER) AS id, CAST(user_id AS INTEGER) AS u, CAST(hour(ts) AS INTEGER) AS h FROM events)
SELECT 'token' AS kind, id, [u, h] AS fields FROM e UNION ALL SELECT 'profile', id, [u % 3, h % 6 + 1] FROM e UNION ALL SELECT 'log', id, [u, h, 4, 5, 6, 7, 8, 9, 10, id] FROM e""")
def ctr_files_parse(spark: SparkSession, d: str) -> DataFrame:
    """Token table, user profile and click log lines."""
    e = table(spark, d, "events").select("event_id", "user_id", F.hour("ts").alias("h"))
    token = T.token_table(e.select(F.concat("event_id", F.lit("\t"), F.concat_ws("|", "user_id", "h")).alias("value"))).select(F.lit("token").alias("kind"), "id", F.col("tokens").alias("fields"))
    profile = T.int_table(e.select(F.concat_ws("\t", "event_id", F.col("user_id") % 3, F.col("h") % 6 + 1).alias("value")), ("user", "gender", "age")).select(F.lit("profile").alias("kind"), F.col("user").alias("id"), F.array("gender", "age").alias("fields"))
    log = T.click_log(e.select(F.concat_ws("\t", "event_id", "user_id", F.lit("dropped"), "h", *(F.lit(i) for i in range(4, 11)), "event_id").alias("value")))
    rest = [c for c in T.CTR_COLUMNS if c != "clicks"]
    return token.unionByName(profile).unionByName(log.select(F.lit("log").alias("kind"), F.col("clicks").alias("id"), F.array(*rest).alias("fields")))


@query(f"""WITH {_CLICKS}, e AS (SELECT user_id % 7 AS title, user_id % 6 AS description, clicks, impressions FROM c)
SELECT 'title' AS entity, CAST(title AS BIGINT) AS id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round((sum(clicks) + 3.75) / (sum(impressions) + 75), 9) AS rate FROM e GROUP BY title
UNION ALL SELECT 'description', CAST(description AS BIGINT), CAST(sum(clicks) AS BIGINT), CAST(sum(impressions) AS BIGINT), round((sum(clicks) + 3.75) / (sum(impressions) + 75), 9) FROM e GROUP BY description""")
def ctr_text_rates(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed rates of titles and descriptions."""
    c = clicks(spark, d).withColumns({"title": (F.col("user_id") % 7).cast("bigint"), "description": (F.col("user_id") % 6).cast("bigint")})
    return ctr.all_rates(c, ("title", "description")).withColumn("rate", F.round("rate", 9))


# --- vectors and special functions ------------------------------------------------------------------


@query(f"""WITH {_PAIR} SELECT vec_id, list_transform(a, lambda x: CAST(trunc(x * 10) AS BIGINT)) AS whole, list_transform(a, lambda x: CAST(trunc(x * 10) AS BIGINT) // 3) AS thirds,
round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * 3)), 6) AS diff_scaled, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) * 3)), 6) AS sum_scaled, round(a[5], 9) AS fifth, len(a) AS n, round(list_sum(a) - a[5] + 7, 6) AS with_seven FROM p""")
def vec_accessors(spark: SparkSession, d: str) -> DataFrame:
    """Whole-number vectors, scaled sums and differences, reading and writing an element."""
    p = _pairs(spark, d)
    a, b = F.col("a"), F.col("b")
    whole = V.int_vector(V.scale(a, 10.0))
    return p.select(
        "vec_id", whole.alias("whole"), V.int_divide(whole, 3).alias("thirds"), F.round(V.total(V.scale(V.subtract(a, b), 3.0)), 6).alias("diff_scaled"), F.round(V.total(V.scale(V.add(a, b), 3.0)), 6).alias("sum_scaled"),
        F.round(a[4].cast("double"), 9).alias("fifth"), F.size(a).cast("bigint").alias("n"), F.round(V.total(V.put(a, F.lit(4), F.lit(7.0))), 6).alias("with_seven"),
    )


@query("""WITH g AS (SELECT l_orderkey AS id, CAST(l_partkey % 40 AS INTEGER) AS i, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2)
SELECT id, list(i ORDER BY i) AS idx, list(v ORDER BY i) AS val, coalesce(bool_or(i = 7), false) AS has_seven, coalesce(sum(v) FILTER (i = 7), 0) AS seven, list_transform(range(0, 40), lambda k: coalesce(list_extract(list(v ORDER BY i), list_position(list(i ORDER BY i), k)), 0)) AS dense,
sum(v * v) AS sq, sum(abs(v)) AS l1, sum(v * i) AS dot, list(i * 10.0::DOUBLE ORDER BY i) AS gathered, list(v * 2 ORDER BY i) AS doubled, CAST(count(*) AS DOUBLE) AS ones FROM g GROUP BY id""")
def sparse_accessors(spark: SparkSession, d: str) -> DataFrame:
    """Reading, sorting, densifying, gathering and norms of sparse vectors."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 40).cast("int").alias("i")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    g = li.groupBy("id").agg(F.collect_list(F.struct("i", "v")).alias("e")).select("id", V.sorted_sparse(F.col("e.i"), F.col("e.v")).alias("s")).select("id", "s.idx", "s.val")
    idx, val = F.col("idx"), F.col("val")
    ramp = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i.cast("double"))
    return g.select(
        "id", "idx", "val", V.sparse_contains(idx, F.lit(7)).alias("has_seven"), V.sparse_get(idx, val, F.lit(7)).alias("seven"), V.densify(idx, val, 40).alias("dense"), V.sparse_squared_norm(idx, val).alias("sq"),
        V.sparse_l1_norm(idx, val).alias("l1"), V.sparse_dot_dense(idx, val, ramp).alias("dot"), V.gather(idx, V.scale(ramp, 10.0)).alias("gathered"), V.sparse_scale(val, idx, 2.0).alias("doubled"),
        V.sparse_squared_norm(idx, F.lit(None).cast("array<double>")).alias("ones"),
    )


def _psi1(x: str) -> str:
    z = f"(({x}) + 8)"
    series = f"1 / {z} + 0.5 / {z} ** 2 + 1 / (6 * {z} ** 3) - 1 / (30 * {z} ** 5) + 1 / (42 * {z} ** 7) - 1 / (30 * {z} ** 9)"
    return f"({series} + ({' + '.join(f'1.0 / (({x}) + {i}) ** 2' for i in range(8))}))"


def _psi2(x: str) -> str:
    z = f"(({x}) + 8)"
    series = f"-1 / {z} ** 2 - 1 / {z} ** 3 - 1 / (2 * {z} ** 4) + 1 / (6 * {z} ** 6) - 1 / (6 * {z} ** 8) + 3 / (10 * {z} ** 10)"
    return f"({series} - ({' + '.join(f'2.0 / (({x}) + {i}) ** 3' for i in range(8))}))"


@query(f"""SELECT event_id, round({_psi("x")}, 6) AS digamma, round({_psi1("x")}, 6) AS trigamma, round({_psi2("x")}, 6) AS tetragamma, round(lgamma(x), 6) AS lgamma,
round(ln(exp(x / 50) + exp(1 / x)), 6) AS log_sum, round(CASE WHEN x - 12 < -10 THEN 4.54e-5 WHEN x - 12 > 10 THEN 22026 ELSE exp(x - 12) END, 5) AS clamped FROM (SELECT event_id, 0.5 + abs(value) AS x FROM events)""")
def special_functions(spark: SparkSession, d: str) -> DataFrame:
    """Digamma and its derivatives, log gamma, log sum and clamped exponential of a column."""
    ship_package(spark)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = np.asarray(b.column(1), np.float64)
            made = (S.digamma(x), S.trigamma(x), S.tetragamma(x), S.lgamma(x), S.log_sum(x / 50, 1 / x), S.clamped_exp(x - 12))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made)], names=["event_id", "digamma", "trigamma", "tetragamma", "lgamma", "log_sum", "clamped"])

    e = table(spark, d, "events").select("event_id", (0.5 + F.abs("value")).alias("x"))
    names = ("digamma", "trigamma", "tetragamma", "lgamma", "log_sum")
    got = e.mapInArrow(run, "event_id bigint, " + ", ".join(f"{n} double" for n in (*names, "clamped")))
    return got.select("event_id", *(F.round(n, 6).alias(n) for n in names), F.round("clamped", 5).alias("clamped"))


@query("SELECT p_partkey, CAST(xor(xor(y, y >> 7), y >> 4) AS INTEGER) AS h FROM (SELECT p_partkey, xor(xor(x, x >> 20), x >> 12) AS y FROM (SELECT p_partkey, p_partkey * 1000 AS x FROM part))")
def mixed_ids(spark: SparkSession, d: str) -> DataFrame:
    """A bit-mixing hash of ids, for seeds."""
    return table(spark, d, "part").select("p_partkey", P.mix32(F.col("p_partkey") * 1000).alias("h"))


@query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey")
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    """Training and validation parts: together each row once."""
    train, validate = P.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8)
    return train.unionByName(validate).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, true AS own, true AS near, CAST(3 AS INTEGER) AS topics, 1.0::DOUBLE AS unit FROM part")
def document_starts(spark: SparkSession, d: str) -> DataFrame:
    """Unit and random starts of documents, and the block that always holds a replicated id."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("doc_id"))
    rep = P.replicated_blocks(p.select("p_partkey"), "p_partkey", 5, 2.0).groupBy("p_partkey").agg(F.max(F.col("block") == P.hash_block(5, "p_partkey")).alias("own"))
    g = T.with_random_gamma(T.with_unit_gamma(p, 3).withColumnRenamed("gamma", "ones"), 3)
    near = F.forall("gamma", lambda x: F.abs(x - 1) < 0.6)
    return g.join(rep, "p_partkey").select("p_partkey", "own", near.alias("near"), F.size("gamma").alias("topics"), F.array_max("ones").alias("unit"))


@query(f"""WITH {_RATINGS}, f AS (SELECT row, [avg(value) / 25, 1.0::DOUBLE] AS f FROM r GROUP BY row) SELECT round(0.5 * sum(f[1] * f[1] + f[2] * f[2]), 5) AS l2, round(sum(abs(f[1]) + abs(f[2])), 5) AS l1, count(*) FILTER (f[1] * f[1] + f[2] * f[2] > 2) AS over FROM f""")
def factor_penalties(spark: SparkSession, d: str) -> DataFrame:
    """Regulariser values of factors."""
    f = ratings(spark, d).groupBy("row").agg(F.array(F.avg("value") / 25, F.lit(1.0)).alias("f"))
    r = factor_penalty(f, 1.0, 2.0)
    return r.select(F.round("l2", 5).alias("l2"), F.round("l1", 5).alias("l1"), "over")


# --- local sparse structures ------------------------------------------------------------------------

_BLOCKED = f"{_RATINGS}, g AS (SELECT *, row % 3 AS block, row / 1000.0::DOUBLE AS fr, (col % 5)::DOUBLE AS fc FROM r)"


@query(f"""WITH {_BLOCKED}, b AS (SELECT block, count(*) AS nnz, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols, round(sum((value - fr * fc) ** 2), 3) AS se FROM g GROUP BY block),
w AS (SELECT block, row, count(*) AS n FROM g GROUP BY ALL) SELECT CAST(b.block AS BIGINT) AS block, nnz, n_rows, n_cols, se, nnz AS by_column, (SELECT max(n) FROM w WHERE w.block = b.block) AS longest FROM b""")
def block_structures(spark: SparkSession, d: str) -> DataFrame:
    """Compressed rows and columns of a block, its jagged rows, and its squared error for given factors."""
    ship_package(spark)

    def run(t: pa.Table) -> pa.Table:
        b = D.build_block(t["row"].to_numpy(), t["col"].to_numpy(), t["value"].to_numpy())
        fr, fc = D.gather_factors(b.row_map, b.row_map, b.row_map[:, None] / 1000.0), (b.col_map % 5)[:, None].astype(float)
        col, row, value = D.column_view(b)
        jagged = D.jagged_rows(row, col, value)
        at = D.id_position(b.row_map, row)
        back = np.zeros(len(b.row_map))
        np.add.at(back, at, 1)
        out = (int(t["block"][0].as_py()), len(b.value_r), len(b.row_map), len(b.col_map), D.squared_error(b, fr, fc), int(back.sum()), max(map(len, jagged[1])))
        return pa.table({n: pa.array([x], pa.float64() if n == "se" else pa.int64()) for n, x in zip(("block", "nnz", "n_rows", "n_cols", "se", "by_column", "longest"), out)})

    g = ratings(spark, d).withColumn("block", (F.col("row") % 3).cast("bigint"))
    return g.groupBy("block").applyInArrow(run, "block bigint, nnz bigint, n_rows bigint, n_cols bigint, se double, by_column bigint, longest bigint").withColumn("se", F.round("se", 3))


@query("""WITH g AS (SELECT l_partkey % 2 AS block, l_partkey AS i, l_suppkey AS j, l_linenumber AS k, CAST(l_quantity AS DOUBLE) AS v FROM lineitem)
SELECT CAST(block AS BIGINT) AS block, count(*) AS nnz, round(sum((v - i / 100.0::DOUBLE * (j % 3) * k) ** 2), 2) AS se FROM g GROUP BY block""")
def cube_structures(spark: SparkSession, d: str) -> DataFrame:
    """A sorted three-way block and its squared error for given factors."""
    ship_package(spark)

    def run(t: pa.Table) -> pa.Table:
        c = D.build_cube(*(t[x].to_numpy() for x in "ijk"), t["v"].to_numpy())
        a, b, f = c.maps[0][:, None] / 100.0, (c.maps[1] % 3)[:, None].astype(float), c.maps[2][:, None].astype(float)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int64()), "nnz": pa.array([int(c.ptr1[-1])], pa.int64()), "se": pa.array([D.cube_squared_error(c, a, b, f)])})

    li = table(spark, d, "lineitem")
    g = li.select((F.col("l_partkey") % 2).cast("bigint").alias("block"), *(F.col(c).cast("int").alias(n) for c, n in zip(("l_partkey", "l_suppkey", "l_linenumber"), "ijk")), F.col("l_quantity").cast("double").alias("v"))
    return g.groupBy("block").applyInArrow(run, "block bigint, nnz bigint, se double").withColumn("se", F.round("se", 2))


@query("""WITH x AS (SELECT vec_id % 4 AS block, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT CAST(block AS BIGINT) AS block, feature, count(*) AS n, round(sum(v), 5) AS total FROM x GROUP BY ALL""")
def feature_major(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of examples turned into rows of features."""
    ship_package(spark)

    def run(t: pa.Table) -> pa.Table:
        b = D.feature_major([(np.arange(len(v)), np.array(v, float)) for v in t["embedding"].to_pylist()])
        n = np.diff(b.row_ptr)
        return pa.table({"block": pa.array(np.full(len(n), t["block"][0].as_py()), pa.int64()), "feature": pa.array(b.row_map, pa.int64()), "n": pa.array(n, pa.int64()), "total": np.add.reduceat(b.value_r, b.row_ptr[:-1])})

    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select((F.col("vec_id") % 4).cast("bigint").alias("block"), "embedding")
    return e.groupBy("block").applyInArrow(run, "block bigint, feature bigint, n bigint, total double").withColumn("total", F.round("total", 5))


# --- first iterations -------------------------------------------------------------------------------

# one binary feature, the intercept, so that a block's coordinate step has a closed form
_ONES = "x AS (SELECT vec_id % 4 AS block, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM embeddings WHERE embedding IS NOT NULL), b AS (SELECT block, count(*)::DOUBLE AS n, sum(y) / 2 AS r FROM x GROUP BY block)"


def _ones(spark: SparkSession, d: str) -> DataFrame:
    v = lr_vectors(spark, d)
    return v.select("row_id", "label", F.array(F.lit(0)).alias("idx"), F.lit(None).cast("array<double>").alias("val"), (F.col("row_id") % 4).cast("int").alias("block"))


@query(f"""WITH {_ONES}, a AS (SELECT * FROM (VALUES ('TAYLOR', 0.25), ('BOHNING', 0.25), ('JAAKKOLA', 1 / (1 + exp(-1)) - 0.5)) AS v(bound, a))
SELECT bound, CAST(0 AS INTEGER) AS feature, round(avg(r / (a * n + 2 + 1e-5)), 8) AS w FROM a, b GROUP BY bound""")
def lr_first_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The first coordinate step of each bound in four blocks, averaged."""
    out = None
    for bound in Bound:
        w = fit_lr(_ones(spark, d), LrParams(strategy=LrStrategy.AVGM, optimizer=Optimizer.CD, bound=bound, blocks=4, outer=1, inner=1, reg=2.0)).weights
        part = w.select(F.lit(bound.value).alias("bound"), "feature", F.round("w", 8).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_ONES}, s AS (SELECT 0.25 * n + 3 + 1e-5 AS prec, r / (0.25 * n + 3 + 1e-5) AS w FROM b), g AS (SELECT w, (0.005 + 1) / (0.005 + 1.5 * (w * w + 1 / prec)) AS gamma FROM s)
SELECT CAST(0 AS INTEGER) AS feature, round(sum(gamma * w) / (sum(gamma) + 0.5), 8) AS w FROM g""")
def lr_first_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """The first hierarchical-Bayes iteration: block steps, their precisions and the global prox."""
    w = fit_lr(_ones(spark, d), LrParams(strategy=LrStrategy.HMEM, blocks=4, outer=1, inner=1, reg=0.5, rho=1.5, gamma=2.0)).weights
    return w.select("feature", F.round("w", 8).alias("w"))


@query(f"""WITH {_ONES}, s AS (SELECT block, n, r, r / (0.25 * n + 2 + 1e-5) AS w FROM b), z AS (SELECT avg(w) AS w0 FROM s),
u AS (SELECT n, w, w0, w - w0 AS lag, (n + 2 * r) / 2 AS pos, 1 / (1 + exp(-w)) AS p FROM s, z),
t AS (SELECT n * (p - p * p) AS ax2, pos - n * p + n * (p - p * p) * w AS pull, w0 - lag AS target FROM u)
SELECT CAST(0 AS INTEGER) AS feature, round(avg((pull + 2 * target) / (ax2 + 2 + 1e-5)), 8) AS w FROM t""")
def lr_second_admm(spark: SparkSession, d: str) -> DataFrame:
    """Two ADMM iterations: the second starts from the blocks' weights, their duals and the average."""
    w = fit_lr(_ones(spark, d), LrParams(strategy=LrStrategy.ADMM, optimizer=Optimizer.CD, blocks=4, outer=2, inner=1, rho=2.0, stop_auc=-1.0)).weights
    return w.select("feature", F.round("w", 8).alias("w"))


def _mixed(x: str, shift: int, factor: int) -> str:
    """One round of the id hash of the starts, in 64-bit arithmetic."""
    return f"CAST(CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _start(table_of_ids: str) -> str:
    """SQL of (id, u): the seeded start of each id of rank 1, uniform in [-0.05, 0.05)."""
    return (
        f"h0 AS (SELECT id, CAST(id * 1000003 AS UBIGINT) AS x FROM ({table_of_ids})), h1 AS (SELECT id, {_mixed('x', 30, 0xBF58476D1CE4E5B9)} AS x FROM h0), "
        f"h2 AS (SELECT id, {_mixed('x', 27, 0x94D049BB133111EB)} AS x FROM h1), s AS (SELECT id, 0.1 * (CAST(xor(x, x >> 31) >> 11 AS DOUBLE) / 9007199254740992.0 - 0.5) AS u FROM h2)"
    )


_CENTRED = f"{_RATINGS}, v AS (SELECT row, col, (value - 25.5) / 15.0 AS v FROM r), {_start('SELECT DISTINCT row AS id FROM v')}"


@query(f"""WITH {_CENTRED}, c AS (SELECT col, sum((0.05 + u) * v) / (sum((0.05 + u) * (0.05 + u)) + 0.1 * count(*) + 1e-12) AS f FROM v JOIN s ON row = id GROUP BY col),
k AS (SELECT row, sum(f * v) / (sum(f * f) + 0.1 * count(*) + 1e-12) AS f FROM v JOIN c USING (col) GROUP BY row)
SELECT CAST(0 AS INTEGER) AS dim, row AS id, round(f, 6) AS f FROM k UNION ALL SELECT 1, col, round(f, 6) FROM c""")
def mf_first_iteration(spark: SparkSession, d: str) -> DataFrame:
    """Both half-steps of the first exact iteration of rank 1, from the seeded start."""
    p = MfParams(strategy=MfStrategy.DMAP, rank=1, outer=1, gamma=0.1, weighted=True, mean=25.5, scale=15.0)
    return fit_mf(ratings(spark, d), p).factors.select("dim", "id", F.round(F.col("f")[0], 6).alias("f"))


@query(f"""WITH {_CENTRED}, g AS (SELECT v.*, u, row % 2 AS rb, col % 2 AS cb FROM v JOIN s ON row = id),
c AS (SELECT rb, col, sum(u * v) / (sum(u * u) + 0.5) AS f FROM g GROUP BY rb, col),
k AS (SELECT cb, row, sum(f * v) / (sum(f * f) + 2) AS f FROM g JOIN c USING (rb, col) GROUP BY cb, row)
SELECT CAST(0 AS INTEGER) AS dim, row AS id, round(CASE WHEN count(*) > 1 THEN 2 * sum(f) / (2 * count(*) + 0.25) ELSE 0 END, 6) AS f FROM k GROUP BY row
UNION ALL SELECT 1, col, round(CASE WHEN count(*) > 1 THEN 0.5 * sum(f) / (0.5 * count(*) + 0.25) ELSE 0 END, 6) FROM c GROUP BY col""")
def mf_first_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The first iteration of four blocks of rank 1: each block's MAP sweep, then the global prox."""
    p = MfParams(strategy=MfStrategy.HECMEM, rank=1, row_blocks=2, col_blocks=2, outer=1, inner=1, reg=0.25, gamma=2.0, gamma_cols=0.5, block_by="modulo", mean=25.5, scale=15.0)
    return fit_mf(ratings(spark, d), p).factors.select("dim", "id", F.round(F.col("f")[0], 6).alias("f"))


def _tensor_round(n: int) -> str:
    """SQL of one round of a block's sweep, dimension by dimension, from a{n}, c{n} (and b)."""
    a, c = f"a{n}", f"c{n}"
    return (
        f"b{n + 1} AS (SELECT block, j, sum(v * a * c) / (sum(a * a * c * c) + 0.5) AS b FROM t JOIN {a} USING (block, i) JOIN {c} USING (block, k) GROUP BY block, j), "
        f"a{n + 1} AS (SELECT block, i, sum(v * b * c) / (sum(b * b * c * c) + 1) AS a FROM t JOIN b{n + 1} USING (block, j) JOIN {c} USING (block, k) GROUP BY block, i), "
        f"c{n + 1} AS (SELECT block, k, sum(v * a * b) / (sum(a * a * b * b) + 2) AS c FROM t JOIN a{n + 1} USING (block, i) JOIN b{n + 1} USING (block, j) GROUP BY block, k)"
    )


@query(f"""WITH t AS (SELECT l_partkey % 2 AS block, l_partkey AS i, l_suppkey AS j, l_linenumber AS k, CAST(l_quantity AS DOUBLE) / 10 AS v FROM lineitem), {_start("SELECT DISTINCT l_partkey AS id FROM lineitem")},
a0 AS (SELECT DISTINCT block, i, u AS a FROM t JOIN s ON i = id), c0 AS (SELECT DISTINCT block, k, 1.0::DOUBLE AS c FROM t), {_tensor_round(0)}, {_tensor_round(1)}
SELECT CAST(0 AS INTEGER) AS dim, CAST(i AS INTEGER) AS id, round(a, 5) AS f FROM a2 UNION ALL SELECT 1, CAST(j AS INTEGER), round(CASE WHEN count(*) > 1 THEN avg(b) ELSE 0 END, 5) FROM b2 GROUP BY j
UNION ALL SELECT 2, CAST(k AS INTEGER), round(CASE WHEN count(*) > 1 THEN avg(c) ELSE 0 END, 5) FROM c2 GROUP BY k""")
def tf_first_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The first iteration of a tensor of rank 1 in two blocks: two rounds of each block's sweep, then the global step."""
    li = table(spark, d, "lineitem")
    cells = li.select(*(F.col(c).cast("int").alias(n) for c, n in zip(("l_partkey", "l_suppkey", "l_linenumber"), "ijk")), (F.col("l_quantity").cast("double") / 10).alias("value"))
    p = TfParams(rank=1, blocks=(2, 1, 1), outer=1, inner=2, gamma=(1.0, 0.5, 2.0), block_by="modulo")
    return fit_tf(cells, p).factors.select("dim", "id", F.round(F.col("f")[0], 5).alias("f"))
