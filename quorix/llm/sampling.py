"""A sample of rating cells that is reproducible and only ever grows with the collection.

Consistent weighted Poisson sampling: a cell (row_idx, col_idx) is selected when the hash of its
identifier, read as a number in [0, 1), lies below weight x constant. The weight is the running maximum
over batches of the cell's number of Records in one batch, so it never falls when batches are added and a
selected cell stays selected. A cell comes with all its Records or with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorix.session import kept, snapshot

#: Inclusion probability per unit of weight.
RATE = 0.05
#: Hex digits of the MD5 digest that form the hash: 52 bits are exact in a double.
_DIGITS = 13
#: A cell with at least this share of all Records is hot: 1 / HOT_SHARE cells at most, whatever the table.
HOT_SHARE = 1e-4
#: The Records of a hot cell are joined in so many tasks.
SALTS = 64
#: Slots of the table of largest weights: a fixed 4 MB. More cells per slot let more Records through, never fewer.
SLOTS = 1 << 20


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the columns' values alone; the same in every engine, run and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def batch_weights(records: DataFrame, row: str = "row_idx", col: str = "col_idx", batch: str = "batch_no") -> DataFrame:
    """(row_idx, col_idx, weight, records) of the batches in `records`: the most Records a cell has in one batch, and in all.

    Records with a null row or column belong to no cell; a null batch counts as a batch of its own. Both
    group-bys aggregate before their shuffle, so hot rows, columns or cells are no hot tasks.
    """
    return (
        records.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(F.col(row).alias("row_idx"), F.col(col).alias("col_idx"), F.col(batch).alias("batch_no"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("row_idx", "col_idx")
        .agg(F.max("n").alias("weight"), F.sum("n").alias("records"))
    )


def advance(state: DataFrame, new_batches: DataFrame) -> DataFrame:
    """The weights after further whole batches: the running maximum of stored and new weights, and all Records."""
    both = state.select("row_idx", "col_idx", "weight", "records").unionByName(batch_weights(new_batches))
    return both.groupBy("row_idx", "col_idx").agg(F.max("weight").alias("weight"), F.sum("records").alias("records"))


def stored_weights(records: DataFrame, batch: str = "batch_no") -> DataFrame:
    """batch_weights built as the collection grows: batch after batch, each read once and added to the stored weights.

    The batches come in their order, those of unknown number last. The state is a table in the shared folder;
    a loop step keeps only the newest. An empty table has no cells.
    """
    numbers = [r[0] for r in records.select(batch).distinct().collect()]  # one row per delivery
    state = None
    for b in sorted(numbers, key=lambda x: (x is None, x)):
        new = records.where(F.col(batch).eqNullSafe(F.lit(b)))
        state = snapshot(batch_weights(new, batch=batch) if state is None else advance(state, new), replaces=state)
    return batch_weights(records, batch=batch) if state is None else state


def selected_cells(weights: DataFrame, rate: float = RATE, seed: int = 0) -> DataFrame:
    """(row_idx, col_idx, weight, probability) of the selected cells; 1/probability is the Horvitz-Thompson weight."""
    return _selected(weights, rate, seed).drop("records")


def _selected(weights: DataFrame, rate: float, seed: int) -> DataFrame:
    p = F.least(F.lit(1.0), F.col("weight") * F.lit(rate))
    chosen = weights.where(unit_hash(F.col("row_idx"), F.col("col_idx"), seed=seed) < F.col("weight") * F.lit(rate))
    return chosen.select("row_idx", "col_idx", "weight", "records", p.alias("probability"))


def _slot(row: Column, col: Column) -> Column:
    return F.pmod(F.xxhash64(row, col), F.lit(SLOTS)).cast("int")


def slot_weights(cells: DataFrame) -> DataFrame:
    """One row, tops: the largest selected weight of each hash slot, 0 where none is."""
    tops = cells.groupBy(_slot(F.col("row_idx"), F.col("col_idx")).alias("slot")).agg(F.max("weight").cast("int").alias("top"))
    full = cells.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(tops, "slot", "left")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("top", F.lit(0)).alias("top")))), lambda e: e["top"]).alias("__tops"))


def sample_records(records: DataFrame, weights: DataFrame, rate: float = RATE, seed: int = 0) -> DataFrame:
    """All Records of the selected cells, with the cell's inclusion probability as `sample_probability`.

    Most rows need no join: a Record whose hash is above rate x (the largest selected weight of its hash
    slot) can't be selected, and is dropped in the scan. A hot cell's Records are joined in SALTS tasks.
    Repeated Records all come out; a column of the name sample_probability is replaced; an empty table gives none.
    """
    cells = kept(_selected(weights, rate, seed))  # read three times below
    whole = records.agg(F.count(F.lit(1)).alias("whole"))  # one row
    # at most 1 / HOT_SHARE rows, since their Records add up to all at most
    hot = cells.crossJoin(F.broadcast(whole)).where(F.col("records") >= F.col("whole") * F.lit(HOT_SHARE)).select(F.col("row_idx").alias("__r"), F.col("col_idx").alias("__c"), F.lit(SALTS).alias("__salts"))
    hot = F.broadcast(hot)
    here = (F.col("row_idx") == F.col("__r")) & (F.col("col_idx") == F.col("__c"))
    salted = cells.join(hot, here, "left").select(
        F.col("row_idx").alias("__row"), F.col("col_idx").alias("__col"), F.col("probability").alias("sample_probability"), F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt")
    )
    rows = records.drop("sample_probability").where(F.col("row_idx").isNotNull() & F.col("col_idx").isNotNull())
    near = rows.crossJoin(F.broadcast(slot_weights(cells)))
    top = F.get(F.col("__tops"), _slot(F.col("row_idx"), F.col("col_idx")))
    near = near.where((top > 0) & (unit_hash(F.col("row_idx"), F.col("col_idx"), seed=seed) < top * F.lit(rate))).drop("__tops")
    spread = near.join(hot, here, "left").withColumn("__at", F.pmod(F.spark_partition_id() + F.hash(*rows.columns), F.coalesce("__salts", F.lit(1)))).drop("__r", "__c", "__salts")
    met = (F.col("row_idx") == F.col("__row")) & (F.col("col_idx") == F.col("__col")) & (F.col("__at") == F.col("__salt"))
    return spread.join(salted, met).drop("__row", "__col", "__salt", "__at")
