"""Bit filters made and asked in SQL: rows whose key is surely in no set are dropped without a join.

A filter is one row with an array of 64-bit words; it is broadcast and asked inside the code that Spark generates.
It only lets too many rows through, never too few; whoever needs exact rows joins what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits per key, and the most words: a filter takes 16 MB at most. Beyond 8 million keys it is fuller and lets more rows through.
BITS_PER_KEY = 16
MOST_WORDS = 1 << 21


@dataclass(frozen=True)
class BitFilter:
    """bits: one row, the array of words."""

    bits: DataFrame
    words: int

    @staticmethod
    def of(keys: DataFrame, expected: int) -> BitFilter:
        """The filter of the non-null values of the only column of `keys`, a bigint; `expected` is about their number."""
        words = 1 << 10
        while words < MOST_WORDS and words * 64 < expected * BITS_PER_KEY:
            words *= 2
        spot = f"pmod(key, {words * 64}L)"
        bit = f"shiftleft(1L, CAST({spot} % 64 AS INT)) AS bit"
        set_bits = keys.toDF("key").where("key IS NOT NULL").selectExpr(f"CAST({spot} DIV 64 AS INT) AS at", bit).groupBy("at").agg(F.bit_or("bit").alias("bits"))
        every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("at")).join(set_bits, "at", "left")
        row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda e: e["bits"]).alias("__bits"))
        return BitFilter(row, words)

    def test(self, key: str, bits: str = "__bits") -> str:
        """SQL: whether the key may be in the set, beside the column `bits`."""
        spot = f"pmod({key}, {self.words * 64}L)"
        return f"bit_get(get({bits}, CAST({spot} DIV 64 AS INT)), CAST({spot} % 64 AS INT)) = 1"

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(rows whose key may be in the set, rows whose key isn't); null keys are in the second."""
        asked = df.crossJoin(F.broadcast(self.bits))
        hit = F.coalesce(F.expr(self.test(key)), F.lit(False))
        return asked.where(hit).drop("__bits"), asked.where(~hit).drop("__bits")
