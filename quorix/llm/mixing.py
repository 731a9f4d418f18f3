"""Mixing sources to target shares of the total size.

Documents of each source are ordered by a hash-random key, so the cut is a random sample of the source
that doesn't depend on partitioning. The key range is cut into buckets; the token sums of the buckets (a
table of sources x buckets rows) give every bucket's offset, and a window inside each bucket completes
the prefix sum, so no task sorts a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorix.session import snapshot

#: Fewest and most buckets of the random key per source, and the documents that a bucket of a table with one source aims at.
LEAST_BUCKETS = 1024
MOST_BUCKETS = 1 << 22
BUCKET_DOCS = 1 << 16


@dataclass(frozen=True)
class Mix:
    """documents: (doc_id, source, n_tokens, copies) of the chosen documents; report: one row per target source."""

    documents: DataFrame
    report: DataFrame


def mix_sources(sized: DataFrame, targets: DataFrame, *, seed: int = 42, buckets: int | None = None, checkpoint: bool = True) -> Mix:
    """Choose documents so that each source gets target_share of the whole.

    `sized` has doc_id, source, n_tokens; `targets` has source, target_share, max_repeats (a small
    table: one row per source). The whole is the size of all documents whose source is a target. A
    source's budget is target_share x whole; it is taken as full passes over the source plus a last
    partial pass that ends at the last document that still fits. A source whose size times max_repeats
    is below its budget is used max_repeats times and marked `short`.

    Defined cases: documents with null source, of a source without target or with no tokens are never
    chosen; null or negative shares count as 0, null repeats as 1, repeats below 0 as 0; a source listed
    twice gets the sum of its shares and the largest repeats; a target without documents is reported with
    zeros and is short if its budget is above 0.
    """
    t = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            F.sum(F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))).alias("target_share"),
            F.max(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0))).alias("max_repeats"),
        )
    )
    if buckets is None:
        # windows hold about BUCKET_DOCS documents however large a source grows
        buckets, n = LEAST_BUCKETS, sized.count()
        while buckets < MOST_BUCKETS and buckets * BUCKET_DOCS < n:
            buckets *= 2
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = sized.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select(
        "doc_id",
        "source",
        "n_tokens",
        key.alias("key"),
        # ranges of the key: buckets in order are the key in order, whatever their number
        F.floor((F.shiftright(key, 40) + F.lit(1 << 23)) * F.lit(buckets) / F.lit(1 << 24)).cast("int").alias("bucket"),
    )
    docs = docs.join(F.broadcast(t.select("source")), "source", "left_semi")
    if checkpoint:
        docs = snapshot(docs)
    # sources x buckets rows from here on
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    own = sums.groupBy("source").agg(F.sum("tokens").alias("own"), F.sum("n_docs").alias("n_docs"))
    whole = own.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("whole"))
    plan = (
        t.join(own, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("own", F.lit(0)).alias("own"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
            "whole",
            (F.col("target_share") * F.col("whole")).alias("budget"),
        )
        .withColumn("short", F.col("own") * F.col("max_repeats") < F.col("budget"))
        .withColumn("full", F.when(F.col("short"), F.col("max_repeats")).when(F.col("own") > 0, F.floor(F.col("budget") / F.col("own"))).otherwise(0).cast("int"))
        .withColumn("rest", F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("budget") - F.col("full") * F.col("own")))
    )
    offsets = sums.select(
        "source",
        "bucket",
        (F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("start"),
    ).join(F.broadcast(plan.select("source", "full", "rest")), "source")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    chosen = (
        docs.join(offsets, ["source", "bucket"])
        .withColumn("upto", F.col("start") + F.sum("n_tokens").over(inside))
        .withColumn("copies", F.col("full") + (F.col("upto") <= F.col("rest")).cast("int"))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    if checkpoint:
        chosen = snapshot(chosen)
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.sum("copies").alias("n_used"))
    made = used.agg(F.sum("used").alias("made"))
    report = (
        plan.join(used, "source", "left")
        .crossJoin(F.broadcast(made))  # one row
        .select(
            "source",
            "target_share",
            "max_repeats",
            "n_docs",
            F.col("own").alias("own_tokens"),
            "budget",
            F.coalesce("n_used", F.lit(0)).alias("docs_used"),
            F.coalesce("used", F.lit(0)).alias("tokens_used"),
            (F.coalesce("used", F.lit(0)) / F.col("made")).alias("actual_share"),
            "short",
        )
    )
    return Mix(chosen, report)
