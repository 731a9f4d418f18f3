"""Queries that train models; iterative, so checked by invariants and independent kernels in the tests.

Each returns the run's history (iteration, metric, value), or a part of the model where named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix import synth
from quorix.etl import ads as ads_etl
from quorix.etl import ctr as ctr_etl
from quorix.models.lda import fit_lda
from quorix.models.lr import fit_lr
from quorix.models.mf import fit_mf
from quorix.models.tf import fit_tf
from quorix.operators import counts as N
from quorix.operators.partition import dense_index
from quorix.plans.relational import clicks, lr_vectors, ratings, tokens
from quorix.schema import LdaParams, LdaStrategy, LrParams, LrStrategy, MfOptimizer, MfParams, MfStrategy, Optimizer, Regularizer, TfParams
from quorix.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


def _lr(name: str, **options: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fit_lr(lr_vectors(spark, d), LrParams(blocks=4, outer=3, inner=3, stop_auc=-1.0, **options)).history

    run.__name__ = name
    query(run)


_lr("lr_dgm", strategy=LrStrategy.DGM)
_lr("lr_dgm_lbfgs", strategy=LrStrategy.DGM, optimizer=Optimizer.LBFGS)
_lr("lr_avgm", strategy=LrStrategy.AVGM, optimizer=Optimizer.CG)
_lr("lr_savgm", strategy=LrStrategy.SAVGM)
_lr("lr_mem", strategy=LrStrategy.MEM)
_lr("lr_hmem", strategy=LrStrategy.HMEM)
_lr("lr_hecmem", strategy=LrStrategy.HECMEM, regularizer=Regularizer.L1, reg=0.01)
_lr("lr_admm", strategy=LrStrategy.ADMM, optimizer=Optimizer.LBFGS)


def _mf(name: str, **options: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fit_mf(ratings(spark, d), MfParams(rank=5, outer=3, inner=2, mean=25.5, scale=15.0, **options)).history

    run.__name__ = name
    query(run)


_mf("mf_als", strategy=MfStrategy.DMAP, weighted=True, gamma=0.1)
_mf("mf_dmap_cd", strategy=MfStrategy.DMAP, optimizer=MfOptimizer.CD)
_mf("mf_dvb", strategy=MfStrategy.DVB)
_mf("mf_avgm", strategy=MfStrategy.AVGM, optimizer=MfOptimizer.CD)
_mf("mf_mem", strategy=MfStrategy.MEM, em_bayes=True)
_mf("mf_hmem", strategy=MfStrategy.HMEM, em_bayes=True)
_mf("mf_hecmem", strategy=MfStrategy.HECMEM, em_bayes=True)
_mf("mf_admm", strategy=MfStrategy.ADMM, regularizer=Regularizer.MAX, reg=4.0)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    quarter = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    li = table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("i"), F.col("l_suppkey").cast("int").alias("j"), quarter.cast("int").alias("k"), F.col("l_quantity").cast("double").alias("q"))
    return li.groupBy("i", "j", "k").agg(((F.avg("q") - 25.5) / 15.0).alias("value"))


def _tf(name: str, **options: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fit_tf(_cells(spark, d), TfParams(rank=3, outer=3, inner=3, **options)).history

    run.__name__ = name
    query(run)


_tf("tf_map", vb=False)
_tf("tf_vb", vb=True, dual=False)
_tf("tf_markov", vb=True, markov=1.0)


def bags(spark: SparkSession, d: str, above: int = 50) -> DataFrame:
    """(doc_id, words, counts) over the tokens that occur more than `above` times."""
    t = tokens(spark, d)
    vocab = dense_index(N.vocabulary(N.token_counts(t), above), "token", "word")
    c = t.join(vocab, "token").groupBy("doc_id", F.col("word").cast("int").alias("word")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    e = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("e"))
    return e.select("doc_id", F.col("e.word").alias("words"), F.col("e.n").alias("counts"))


def _lda(name: str, **options: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fit_lda(bags(spark, d), LdaParams(topics=8, outer=3, inner=5, sample_docs=200, **options)).history

    run.__name__ = name
    query(run)


_lda("lda_mrlda", strategy=LdaStrategy.MRLDA, update_alpha=True)
_lda("lda_hdlda", strategy=LdaStrategy.HDLDA)
_lda("lda_vadmm", strategy=LdaStrategy.VADMM)


@query
def lda_top_words(spark: SparkSession, d: str) -> DataFrame:
    return N.top_words(fit_lda(bags(spark, d), LdaParams(topics=8, outer=2, inner=5)).topics, 10)


@query
def synth_matrix(spark: SparkSession, d: str) -> DataFrame:
    return synth.moments(synth.synth_matrix(spark, 2000, 500, rank=5))


@query
def synth_tensor(spark: SparkSession, d: str) -> DataFrame:
    return synth.moments(synth.synth_tensor(spark, (200, 40, 20), rank=3))


#: A log row per event, and the token lists of ids 0 to 59, as in `ctr_features`.
_CTR = """WITH e AS (SELECT CAST(event_type = 'click' AS INTEGER) AS clicks, CAST(event_type IN ('click', 'view') AS INTEGER) AS impressions, hour(ts) AS ad, hour(ts) % 5 AS advertiser, minute(ts) % 3 AS position, minute(ts) AS query,
  minute(ts) % 10 AS keyword, minute(ts) % 7 AS title, minute(ts) % 6 AS description, user_id AS usr FROM events),
z AS (SELECT max(usr) + 1 AS n FROM e),
l AS (SELECT id, pos, pos + id % 9 AS token FROM (SELECT unnest(range(0, 60)) AS id) CROSS JOIN LATERAL (SELECT unnest(range(0, id % 4 + 1)) AS pos)),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS ix FROM l GROUP BY token QUALIFY ix < 20),
t AS (SELECT id, list(ix ORDER BY pos) FILTER (ix IS NOT NULL) AS toks FROM l LEFT JOIN v USING (token) GROUP BY id),
""" + ",\n".join(
    f"r_{x} AS (SELECT {x} AS id, sum(clicks) > 0 AS hit, (sum(clicks)::DOUBLE + 3.75::DOUBLE) / (sum(impressions)::DOUBLE + 75) AS rate FROM e GROUP BY {x}), "
    f"b_{x} AS (SELECT id, hit, least(floor(rate / ((SELECT max(rate) FROM r_{x}) / 100)), 99) AS bin, row_number() OVER (ORDER BY id) - 1 AS ix FROM r_{x})"
    for x in ("ad", "advertiser", "query", "usr", "keyword")
)
ORACLE["ctr_features"] = _CTR + """
SELECT CAST([0, 1 + a.bin, 101 + d.bin, 201 + q.bin, 301 + u.bin, 401 + k.bin]
  || CASE WHEN u.hit THEN [501 + usr] ELSE [] END || CASE WHEN a.hit THEN [501 + n + a.ix] ELSE [] END || CASE WHEN q.hit THEN [525 + n + query] ELSE [] END
  || [585 + n + least(usr // greatest(n // 10, 1), 9), 595 + n + least(query // 6, 9), 605 + n + least(coalesce(len(tq.toks), 0), 19), 625 + n + least(coalesce(len(tt.toks), 0), 29),
      655 + n + least(coalesce(len(td.toks), 0), 49), 705 + n + least(coalesce(len(tk.toks), 0), 9), 715 + n + usr % 3, 718 + n + usr % 6, 724 + n + 2 * position]
  || CASE WHEN q.hit THEN list_transform(coalesce(tq.toks, []), lambda x: 730 + n + x) ELSE [] END || CASE WHEN k.hit THEN list_transform(coalesce(tk.toks, []), lambda x: 750 + n + x) ELSE [] END
  || [CASE WHEN clicks >= 1 THEN 1 ELSE -1 END] AS INTEGER[]) AS features
FROM e CROSS JOIN z JOIN b_ad a ON a.id = e.ad JOIN b_advertiser d ON d.id = e.advertiser JOIN b_query q ON q.id = e.query JOIN b_usr u ON u.id = e.usr JOIN b_keyword k ON k.id = e.keyword
JOIN t tq ON tq.id = e.query JOIN t tt ON tt.id = e.title JOIN t td ON td.id = e.description JOIN t tk ON tk.id = e.keyword WHERE impressions > 0"""


@query
def ctr_features(spark: SparkSession, d: str) -> DataFrame:
    """The click feature builder over `events`: each event as a log row, ids derived from its columns."""
    c = clicks(spark, d).withColumn("minute", F.minute("ts")).withColumn("hour", F.hour("ts"))
    log = c.select(
        "clicks", "impressions", F.col("hour").alias("ad"), (F.col("hour") % 5).alias("advertiser"), F.lit(3).alias("depth"), (F.col("minute") % 3).alias("position"), F.col("minute").alias("query"),
        (F.col("minute") % 10).alias("keyword"), (F.col("minute") % 7).alias("title"), (F.col("minute") % 6).alias("description"), F.col("user_id").cast("int").alias("user"),
    )
    ids = table(spark, d, "events").select(F.explode(F.sequence(F.lit(0), F.lit(59))).alias("id")).distinct()
    lists = ids.select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 4), lambda i: (i + F.col("id") % 9).cast("int")).alias("tokens"))
    indexed = ctr_etl.indexed_tokens(lists, ctr_etl.vocabulary(lists, top=20))
    profile = log.select("user").distinct().select("user", (F.col("user") % 3).alias("gender"), (F.col("user") % 6 + 1).alias("age"))
    # minutes and hours are 60 and 24 whatever the table; users are as many as it holds
    users = (log.agg(F.max("user")).first()[0] or 0) + 1
    layout = ctr_etl.CtrLayout(users=users, queries=60, ads=24, query_tokens=20, keyword_tokens=20, id_bins=10)
    return ctr_etl.features(log, log, {e: indexed for e in ("query", "title", "description", "keyword")}, profile, layout)


def _ads(spark: SparkSession, d: str) -> ads_etl.AdsTables:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    rows = docs.select(F.col("doc_id").alias("row_id"), F.when(F.col("fmt") == "md", 1).otherwise(-1).alias("label"), F.filter(F.split("text", " "), lambda t: t != "").alias("tokens"), (F.col("doc_id") % 10 == 0).alias("test"))
    return ads_etl.build(rows.where("NOT test"), rows.where("test"), above=20)


_ADS = """WITH d AS (SELECT doc_id AS row_id, CASE WHEN fmt = 'md' THEN 1 ELSE -1 END AS label, doc_id % 10 = 0 AS test, string_split(text, ' ') AS ts FROM documents WHERE text IS NOT NULL),
x AS (SELECT * FROM (SELECT row_id, label, test, unnest(ts) AS token FROM d) WHERE token <> ''),
k AS (SELECT token, count(*) AS n FROM x WHERE NOT test GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY encode(token)) - 1 AS index FROM k WHERE n > 20),
r AS (SELECT row_id, list_sort(list(DISTINCT index)) AS idx FROM x JOIN v USING (token) GROUP BY row_id)
"""
ORACLE["ads_tables"] = _ADS + "SELECT d.row_id, CAST(label AS INTEGER) AS label, coalesce(idx, []) AS idx, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM d LEFT JOIN r ON d.row_id = r.row_id"
ORACLE["ads_counts"] = _ADS + "SELECT token, n FROM k"
ORACLE["ads_histogram"] = _ADS + "SELECT n, count(*) AS tokens FROM k GROUP BY n"
ORACLE["ads_dictionary"] = _ADS + "SELECT token, index FROM v"


@query
def ads_tables(spark: SparkSession, d: str) -> DataFrame:
    """Ads pipeline over documents: the remapped training and test rows, told apart by `split`."""
    made = _ads(spark, d)
    return made.train.withColumn("split", F.lit("train")).unionByName(made.test.withColumn("split", F.lit("test")))


@query
def ads_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ads pipeline over documents: each training token with its count."""
    return _ads(spark, d).counts


@query
def ads_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Ads pipeline over documents: how many training tokens have which count."""
    return _ads(spark, d).histogram


@query
def ads_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Ads pipeline over documents: the frequent training tokens with their indices."""
    return _ads(spark, d).dictionary
