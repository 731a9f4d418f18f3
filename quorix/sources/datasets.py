"""Data sets put together from several parsers and operators: what a training run reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.functions.exprs import day_number
from quorix.operators.counts import weighted_document_frequency, with_time_frames
from quorix.operators.partition import bernoulli, dense_index, hash_block
from quorix.sources import readers, text


def kept_features(vectors: DataFrame, threshold: int) -> DataFrame:
    """(feature, index): features whose weighted document frequency reaches the threshold, numbered from 1; 0 stays the intercept."""
    pairs = text.explode_vectors(vectors).where("feature <> 0").select("row_id", "label", "feature").distinct()
    kept = dense_index(weighted_document_frequency(pairs, threshold), "feature")
    return kept.select("feature", (F.col("index") + 1).cast("int").alias("index")).unionByName(vectors.sparkSession.createDataFrame([(0, 0)], "feature int, index int"))


def renumber(vectors: DataFrame, kept: DataFrame) -> DataFrame:
    """Vectors (row_id, label, idx, val) with the kept features only, under their new numbers.

    row_id must be unique. A row without kept features has empty arrays; binary vectors (null val) stay binary.
    """
    found = text.keep_features(text.explode_vectors(vectors), kept)
    rows = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("e"))
    ids, values = F.coalesce(F.col("e.feature"), F.array().cast("array<int>")), F.coalesce(F.col("e.value"), F.array().cast("array<double>"))
    return vectors.select("row_id", "label", F.col("val").isNull().alias("binary")).join(rows, "row_id", "left").select("row_id", "label", ids.alias("idx"), F.when(~F.col("binary"), values).alias("val"))


def lr_dataset(vectors: DataFrame, *, threshold: int = 0, fraction: float = 1.0, blocks: int | None = None, kept: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Logistic data (row_id, label, idx, val[, block]) as a run uses them: a Bernoulli sample, the features that reach
    the threshold (or those of `kept`, for validation data), and a pseudo-random block.
    """
    picked = vectors if fraction >= 1 else bernoulli(vectors, fraction, "row_id", seed)
    if kept is None and threshold > 0:
        kept = kept_features(picked, threshold)
    if kept is not None:
        picked = renumber(picked, kept)
    return picked if blocks is None else picked.withColumn("block", hash_block(blocks, "row_id", seed=seed))


def read_lr(spark: SparkSession, path: str, binary: bool = False, records: bool = False) -> DataFrame:
    """(row_id, label, idx, val) of LibSVM text, or of a Parquet table of int arrays with the label last (`records`)."""
    row = F.monotonically_increasing_id().alias("row_id")
    if records:
        return text.int_records(spark.read.parquet(path).select(row, "features"))
    return text.libsvm(readers.read_lines(spark, path).select(row, "value"), binary=binary)


def ctr_test_pairs(features: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Test log rows with their labels: rows of both tables with the same id; ids in one table only are left out.

    Columns of `labels` that `features` has, too, are taken from `labels`.
    """
    own = [c for c in features.columns if c not in labels.columns or c == key]
    return features.select(*own).join(labels, key)


def read_ctr_test(spark: SparkSession, features: str, labels: str) -> DataFrame:
    """ctr_test_pairs of `id <tab> (unused) <tab> 9 integers` and `id <tab> click,impression,...` lines."""
    names = ("id", "ad", "advertiser", "depth", "position", "query", "keyword", "title", "description", "user")
    rows = text.int_table(readers.read_lines(spark, features), names, drop=(1,))
    p = F.split(F.col(text.LINE), "\t")
    q = F.split(p[1], ",")
    known = readers.read_lines(spark, labels).where(F.size(p) == 2).select(p[0].try_cast("int").alias("id"), q[0].try_cast("int").alias("clicks"), F.get(q, F.lit(1)).try_cast("int").alias("impressions")).dropna()
    return ctr_test_pairs(rows, known)


def framed_tensor(ratings: DataFrame, bucket: Column, frames: int, mean: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(i, j, k, value) of ratings with a time, k a frame of about equal mass."""
    framed = with_time_frames(ratings, bucket, frames).where(F.col("frame").isNotNull())
    return framed.select(F.col("row").alias("i"), F.col("col").alias("j"), F.col("frame").alias("k"), ((F.col("value") - mean) / scale).alias("value"))


def netflix_tensor(lines: DataFrame, frames: int, interval: int = 1, mean: float = 0.0, scale: float = 1.0, probe: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(train, test) tensors of files with `movie:` headers; the frames are those of all ratings, `probe` (row, col) is the test set."""
    ratings = text.netflix(lines)
    named = with_time_frames(ratings, day_number(F.col("date"), interval), frames).where(F.col("frame").isNotNull())

    def cells(df: DataFrame) -> DataFrame:
        return df.select(F.col("row").alias("i"), F.col("col").alias("j"), F.col("frame").alias("k"), ((F.col("value") - mean) / scale).alias("value"))

    if probe is None:
        return cells(named), None
    train, test = text.probe_split(named, probe)
    return cells(train), cells(test)
