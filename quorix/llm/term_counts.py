"""Entry and record counts of every term of blocked sparse matrices, with a mark on useless terms.

Heavy-light aggregation. A first pass finds the terms that take a large share of some batch of blocks
(there can only be a bounded number of them). In the second pass those heavy terms are counted into
exact arrays, one slot per term; only the entries of the light terms are shuffled by term. A record's
cells may lie in several blocks, so heavy terms are first merged per record as bit sets. The two tables
of counts are disjoint and are unioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix.session import snapshot

#: A term is a heavy candidate if it takes this share of one batch's entries; at most MOST_HEAVY are kept
#: (a switch between two exact ways of counting: the others are counted as light terms).
HEAVY_SHARE = 0.002
MOST_HEAVY = 512
#: Marks: rare up to so many records, common from this share of all records on.
RARE_RECORDS = 3
COMMON_SHARE = 0.2

_COLUMNS = ("row_ptr", "col_idx", "row_map", "col_map")


def _slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, flat values as int64 with null as -1) of an int list column; null lists are empty."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    flat = np.asarray(values.fill_null(-1) if values.null_count else values).astype(np.int64)
    starts, ends = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        empty = np.asarray(column.is_null())
        ends[empty] = starts[empty]
    return starts, ends, flat


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(records, terms) of the stored entries of each block; malformed or missing parts give no entries.

    Ids are non-negative; a null or negative id belongs to no record or term.
    """
    parts = [_slices(batch.column(i)) for i in range(4)]
    for i in range(batch.num_rows):
        ptr, cols, row_map, col_map = (flat[a[i] : b[i]] for a, b, flat in parts)
        rows = min(len(ptr) - 1, len(row_map))
        if rows < 1 or not len(cols) or not len(col_map):
            continue
        ptr = np.clip(ptr[: rows + 1], 0, len(cols))
        counts = np.maximum(np.diff(ptr), 0)
        total = int(counts.sum())
        local = np.repeat(np.arange(rows), counts)
        # position of each entry: its row's start plus its rank in the row
        spot = np.repeat(ptr[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        c = cols[spot]
        keep = (c >= 0) & (c < len(col_map))
        records, terms = row_map[local[keep]], col_map[c[keep]]
        keep = (records >= 0) & (terms >= 0)
        yield records[keep], terms[keep]


def _gathered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = list(_entries(batch))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def once_delivered(blocks: DataFrame) -> DataFrame:
    """Blocks without repeated deliveries: equal content of all structural columns is one block.

    Only a 64-bit pair of hashes is grouped; nothing is dropped on a key alone, so two different blocks
    of the same (rb, cb) both stay.
    """
    parts = ["rb", "cb", "num_rows", "num_cols", *_COLUMNS, *(["value_r"] if "value_r" in blocks.columns else [])]
    marked = blocks.select(*_COLUMNS, F.xxhash64(*parts).alias("__h1"), F.hash(*parts).alias("__h2"))
    return marked.dropDuplicates(["__h1", "__h2"]).select(*_COLUMNS)


def heavy_terms(blocks: DataFrame, share: float = HEAVY_SHARE, most: int = MOST_HEAVY) -> list[int]:
    """At most `most` terms that take a share of at least `share` of the entries of some batch of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, terms = _gathered(batch)
            if len(terms):
                values, n = np.unique(terms, return_counts=True)
                big = n >= max(2, share * len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(values[big]), pa.array(n[big])], names=["term_id", "n"])

    found = blocks.select(*_COLUMNS).mapInArrow(run, "term_id bigint, n bigint").groupBy("term_id").agg(F.sum("n").alias("n"))
    return [r["term_id"] for r in found.orderBy(F.desc("n"), "term_id").limit(most).collect()]


def count_terms(blocks: DataFrame, share: float = HEAVY_SHARE, most: int = MOST_HEAVY) -> DataFrame:
    """(term_id, n_entries, n_records) of every term that has an entry.

    n_entries counts stored cells (a cell stored twice counts twice, a block delivered twice once);
    n_records counts distinct records. Entries with col_idx -1, null or out of range, and rows or columns
    without an id, are ignored; null arrays are an empty block; an empty table gives no terms.
    """
    # repeated deliveries don't matter here: heavy terms only choose between two exact ways of counting
    heavy = np.array(sorted(heavy_terms(blocks, share, most)), np.int64)
    width = max(1, (len(heavy) + 7) // 8)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Light: (record and term as one number, n). Heavy: (record, bit set), and (-1 - term, n) for its entries."""
        for batch in batches:
            records, terms = _gathered(batch)
            if not len(terms):
                continue
            slot = np.searchsorted(heavy, terms) if len(heavy) else np.zeros(len(terms), np.int64)
            is_heavy = (slot < len(heavy)) & (heavy[np.minimum(slot, len(heavy) - 1)] == terms) if len(heavy) else np.zeros(len(terms), bool)
            # both ids are 31-bit: one sortable number per pair
            light = records[~is_heavy] << 32 | terms[~is_heavy]
            light.sort()
            first = np.nonzero(np.diff(light, prepend=-1))[0]
            yield _rows(light[first], np.diff(np.append(first, len(light))), None)
            if is_heavy.any():
                entries = np.bincount(slot[is_heavy], minlength=len(heavy))
                used = np.nonzero(entries)[0]
                yield _rows(-1 - heavy[used], entries[used], None)
                ids, at = np.unique(records[is_heavy], return_inverse=True)
                bits = np.zeros((len(ids), width * 8), np.uint8)
                bits[at, slot[is_heavy]] = 1
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(ids), [None, pa.py_buffer(np.packbits(bits, axis=1).tobytes())])
                yield _rows(ids, None, packed.cast(pa.binary()))

    # read three times below: decode the blocks only once
    parts = snapshot(once_delivered(blocks).mapInArrow(split, "key bigint, n bigint, bits binary"))
    light = (
        parts.where("key >= 0 and bits is null")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("term_id"))
        .agg(F.sum("n").alias("n_entries"), F.count(F.lit(1)).alias("n_records"))
    )
    if not len(heavy):
        return light

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counter array over the records of this partition; rows come sorted by record."""
        counters = np.zeros(len(heavy), np.int64)
        last, held = None, np.zeros(width, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), width)
            first = np.nonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[0]
            merged = np.bitwise_or.reduceat(rows, first, axis=0)
            if last is not None and ids[0] == last:
                merged[0] |= held
            elif last is not None:
                counters += np.unpackbits(held)[: len(heavy)]
            last, held = ids[-1], merged[-1].copy()
            if len(merged) > 1:
                counters += np.unpackbits(merged[:-1], axis=1).sum(0, dtype=np.int64)[: len(heavy)]
        if last is not None:
            counters += np.unpackbits(held)[: len(heavy)]
        yield pa.RecordBatch.from_arrays([pa.array(heavy), pa.array(counters)], names=["term_id", "n"])

    per_record = parts.where("bits is not null").select("key", "bits").repartition("key").sortWithinPartitions("key")
    holders = per_record.mapInArrow(merge, "term_id bigint, n bigint").groupBy("term_id").agg(F.sum("n").alias("n_records"))
    entries = parts.where("key < 0").groupBy((-1 - F.col("key")).alias("term_id")).agg(F.sum("n").alias("n_entries"))
    return light.unionByName(entries.join(holders, "term_id").select("term_id", "n_entries", "n_records"))


def _rows(keys: np.ndarray, n: np.ndarray | None, bits: pa.Array | None) -> pa.RecordBatch:
    size = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.nulls(size, pa.int64()) if n is None else pa.array(n, pa.int64()), pa.nulls(size, pa.binary()) if bits is None else bits], names=["key", "n", "bits"]
    )


def count_records(blocks: DataFrame) -> DataFrame:
    """One row, n_all: the distinct non-null record ids of all row maps, records without entries included."""
    ids = blocks.select(F.explode("row_map").alias("record")).where("record is not null").distinct()
    return ids.agg(F.count(F.lit(1)).alias("n_all"))


def mark_terms(blocks: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """count_terms with `mark`: 'rare' (at most `rare` records), 'common' (at least the share `common` of all
    distinct records), else null. A term that is both, in a tiny collection, is rare."""
    whole = F.broadcast(count_records(blocks))  # one row
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") >= F.lit(common) * F.col("n_all"), "common")
    return count_terms(blocks).crossJoin(whole).select(F.col("term_id").cast("int").alias("term_id"), "n_entries", "n_records", mark.alias("mark"))
