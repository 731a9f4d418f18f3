"""Ads logs: token statistics, dictionary, and remapped train and test lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix.operators.counts import count_histogram, token_counts
from quorix.operators.partition import dense_index


@dataclass(frozen=True)
class AdsTables:
    counts: DataFrame
    histogram: DataFrame
    dictionary: DataFrame
    train: DataFrame
    test: DataFrame


def remap(ads: DataFrame, dictionary: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id, label, idx): known tokens as sorted distinct ids; rows without known tokens keep an empty array."""
    known = ads.select(key, F.explode("tokens").alias("token")).join(dictionary, "token").groupBy(key).agg(F.array_sort(F.collect_set("index")).alias("idx"))
    return ads.select(key, "label").join(known, key, "left").select(key, "label", F.coalesce("idx", F.array().cast("array<bigint>")).alias("idx"))


def build(train: DataFrame, test: DataFrame, above: int) -> AdsTables:
    """All tables from parsed (row_id, label, tokens) rows; the dictionary holds tokens above a count, in token order."""
    counts = token_counts(train.select(F.explode("tokens").alias("token")))
    dictionary = dense_index(counts.where(F.col("n") > above), "token")
    return AdsTables(counts, count_histogram(counts), dictionary, remap(train, dictionary), remap(test, dictionary))
