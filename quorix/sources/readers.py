"""Readers with an explicit format argument, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorix.sources import text


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): non-empty lines with their order inside each file, for formats with header lines.

    line_no is a struct (block, pos): the place of the piece of the file that a task reads, and a number that rises
    within the piece. Files are split as usual, so their size doesn't matter.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("line_no"), "value").where(F.col("value") != "")


def read_ratings(spark: SparkSession, path: str, format: str = "parquet", sep: str = ",", mean: float = 0.0, scale: float = 1.0) -> DataFrame:  # noqa: A002
    """(row, col, value) from parquet, delimited, adjacency, movielens or blocked input."""
    if format == "parquet":
        df = spark.read.parquet(path)
    elif format == "delimited":
        return text.delimited(read_lines(spark, path), ("row", "col"), sep, mean, scale)
    elif format == "adjacency":
        return text.adjacency(read_lines(spark, path), ("row", "col"), mean, scale)
    elif format == "movielens":
        df = text.movielens(read_lines(spark, path))
    elif format == "blocked":
        df = unblock(spark.read.parquet(path))
    else:
        raise ValueError(f"unknown format {format!r}")
    df = df.select("row", "col", F.col("value").cast("double").alias("value"))
    return df if mean == 0.0 and scale == 1.0 else df.withColumn("value", (F.col("value") - mean) / scale)


def read_tensor(spark: SparkSession, path: str, format: str = "parquet", sep: str = ",", mean: float = 0.0, scale: float = 1.0) -> DataFrame:  # noqa: A002
    """(i, j, k, value) from parquet, delimited or adjacency input."""
    if format == "parquet":
        return spark.read.parquet(path).select("i", "j", "k", ((F.col("value").cast("double") - mean) / scale).alias("value"))
    if format == "delimited":
        return text.delimited(read_lines(spark, path), ("i", "j", "k"), sep, mean, scale)
    if format == "adjacency":
        return text.adjacency(read_lines(spark, path), ("i", "j", "k"), mean, scale)
    raise ValueError(f"unknown format {format!r}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per line of all files; hidden checksum files are skipped by Spark itself, empty documents here."""
    return text.documents(read_lines(spark, path)).where(F.size("words") > 0)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word_id, word): one word per line, the line number inside its file is the id; blank lines count but give no word."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("word"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece of a file
    pieces = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("pos"))
    return lines.withColumn("rank", rank).join(pieces, ["file", "block"]).where(F.col("word") != "").select((F.col("start") + F.col("rank") - 1).cast("int").alias("word_id"), "word")


def unblock(blocks: DataFrame) -> DataFrame:
    """(rb, cb, row, col, value) of blocks with parallel arrays rows, cols, vals."""
    return blocks.select("rb", "cb", F.explode(F.arrays_zip("rows", "cols", "vals")).alias("e")).select(
        "rb", "cb", F.col("e.rows").alias("row"), F.col("e.cols").alias("col"), F.col("e.vals").alias("value")
    )


# --- sinks ------------------------------------------------------------------------------------------


def write_ratings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_tensor(df: DataFrame, path: str) -> None:
    """Tensor cells (i, j, k, value) as Parquet."""
    df.select("i", "j", "k", "value").write.mode("overwrite").parquet(path)


def write_records(features: DataFrame, path: str) -> None:
    """Int-array records (features, the label last) as Parquet; read back with int_records."""
    features.select("features").write.mode("overwrite").parquet(path)


def write_top_words(top: DataFrame, path: str, dictionary: DataFrame | None = None) -> None:
    """One text line per topic: its words (or their ids), best first."""
    named = top if dictionary is None else top.join(dictionary.select(F.col("word_id").alias("word"), F.col("word").alias("name")), "word", "left")
    text_of = F.col("word").cast("string") if dictionary is None else F.coalesce("name", F.col("word").cast("string"))
    line = named.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", text_of.alias("w")))).alias("l")).orderBy("topic")
    line.select(F.concat_ws(" ", F.concat(F.col("topic").cast("string"), F.lit(":")), F.col("l.w")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_blocks(ratings: DataFrame, path: str, files: int) -> None:
    """Ratings with block columns, one folder per block, coalesced to `files` write tasks."""
    ratings.repartition(files, "rb", "cb").write.mode("overwrite").partitionBy("rb", "cb").parquet(path)


def write_factors(factors: DataFrame, path: str) -> None:
    """(side, block, id, f[, prec]) as Parquet, one folder per side."""
    factors.write.mode("overwrite").partitionBy("side").parquet(path)


def write_labelled_lines(df: DataFrame, path: str) -> None:
    """`label id id ...` text lines of (label, idx); rows without label are left out."""
    line = F.concat_ws(" ", F.col("label").cast("string"), F.array_join("idx", " "))
    df.where(F.col("label").isNotNull()).select(line.alias("value")).write.mode("overwrite").text(path)


def write_split(docs: DataFrame, path: str, train: float = 0.9, key: str = "doc") -> None:
    """Train and validation folders of document lines, split by a hash of the key."""
    from quorix.operators.partition import hash_split

    for name, part in zip(("train", "validate"), hash_split(docs, key, train)):
        part.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def write_frequencies(counts: DataFrame, path: str) -> None:
    """Token counts, most frequent first, and the histogram of counts, as CSV."""
    counts.orderBy(F.desc("n"), "token").write.mode("overwrite").csv(f"{path}/frequencies", header=True)
    counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).orderBy("n").write.mode("overwrite").csv(f"{path}/histogram", header=True)


def write_history(history: DataFrame, path: str) -> None:
    """Metrics (iteration, metric, value) as JSON lines."""
    history.write.mode("overwrite").json(path)


def write_rolling(df: DataFrame, path: str, lines_per_file: int) -> None:
    """Text lines in files of at most `lines_per_file` lines."""
    df.write.mode("overwrite").option("maxRecordsPerFile", lines_per_file).text(path)
