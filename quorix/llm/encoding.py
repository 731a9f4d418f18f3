"""Encoding a whole corpus with content-defined chunk reuse.

Texts are cut where a rolling hash over the last 16 bytes meets a condition, so equal passages are cut
alike in whatever document they stand. A first pass only hashes the chunks and finds those that occur more
than once. Texts that share no chunk are encoded where they lie; of the others each distinct chunk is encoded
once per (chunk, salt), its ids go to every place it stands at, and the joins between chunks are verified
and, where the tokens around a join could differ from those of the whole text, repaired by re-encoding a
window that widens until both sides agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix.llm.bitfilter import BitFilter
from quorix.llm.tokenizers import ByteBpe, byte_bpe
from quorix.session import snapshot

#: One whitespace position in so many is a cut (a power of two): chunks of some 2 kB of prose or code.
CUT_ONE_IN = 256
#: A chunk that is at least this share of one batch's chunk references is spread over SALTS tasks.
HOT_SHARE = 0.01
SALTS = 64
#: Output batches are handed on when they hold so many ids.
FLUSH_IDS = 1 << 20

_WINDOW_LOG2 = 4
_MIX = np.uint32(2654435761)  # odd multiplier (golden ratio times 2**32)
_BYTE_HASH = ((np.arange(256, dtype=np.uint64) + 1) * 0x9E3779B97F4A7C15 >> np.uint64(29)).astype(np.uint32)
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[33:127] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


def cut_points(data: np.ndarray, one_in: int = CUT_ONE_IN) -> np.ndarray:
    """Positions p so that a chunk ends before p: content-defined, between a printable ASCII byte and white space.

    In front of such white space the pre-tokeniser always starts a new piece, and nothing in front of
    it depends on what follows, so a cut there never changes an id.
    """
    n = len(data)
    if n < 2:
        return np.empty(0, np.int64)
    spots = np.nonzero(_PRINTABLE[data[:-1]] & _SPACE[data[1:]])[0]
    spots = spots[spots >= (1 << _WINDOW_LOG2) - 1]
    if not len(spots):
        return np.empty(0, np.int64)
    # rolling hash of the 16 bytes that end at each spot
    h = np.zeros(len(spots), np.uint32)
    with np.errstate(over="ignore"):
        for back in range((1 << _WINDOW_LOG2) - 1, -1, -1):
            h = h * _MIX + _BYTE_HASH[data[spots - back]]
        h ^= h >> np.uint32(15)
        h *= _MIX
    return spots[(h >> np.uint32(8)) % np.uint32(one_in) == 0] + 1


def _safe(bpe: ByteBpe, left: int, right: int) -> bool:
    """Whether a join between these two tokens is one that cut_points would choose."""
    a, b = bpe.bytes_of[left], bpe.bytes_of[right]
    return bool(a) and bool(b) and bool(_PRINTABLE[a[-1]]) and bool(_SPACE[b[0]])


def join_ids(bpe: ByteBpe, parts: list[np.ndarray]) -> np.ndarray:
    """The ids of the concatenated texts of `parts`, of which each was encoded for itself.

    At a join that isn't provably neutral, the window between the nearest neutral joins on both sides is
    encoded anew; the ids outside it are then exactly those of the whole text.
    """
    out: list[np.ndarray] = []
    for part in parts:
        if not len(part):
            continue
        if out and not _safe(bpe, int(out[-1][-1]), int(part[0])):
            left = out[-1] if len(out) == 1 else np.concatenate(out)
            i = len(left) - 1
            while i > 0 and not _safe(bpe, int(left[i - 1]), int(left[i])):
                i -= 1
            j = 1
            while j < len(part) and not _safe(bpe, int(part[j - 1]), int(part[j])):
                j += 1
            window = b"".join(bpe.bytes_of[int(t)] for t in (*left[i:], *part[:j]))
            out = [left[:i], bpe.encode_bytes(window), part[j:]]
            out = [x for x in out if len(x)]
        else:
            out.append(part)
    return np.concatenate(out) if out else np.empty(0, bpe.dtype)


_CHUNKS = pa.schema(
    [
        ("chunk", pa.binary()),
        ("salt", pa.int32()),
        ("text", pa.binary()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())]))),
    ]
)
_CHUNKS_DDL = "chunk binary, salt int, text binary, docs array<struct<doc_id: bigint, mark: bigint, pos: int>>"
_PIECES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32()), ("ids", pa.binary())])
_PIECES_DDL = "doc_id bigint, mark bigint, pos int, ids binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_IDS_DDL = "doc_id bigint, ids array<int>"


def _text_bytes(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text of an Arrow column, null as empty, without decoding."""
    if column.null_count:
        column = column.fill_null("")
    if column.type == pa.large_string() or column.type == pa.large_binary():
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield view[a:b]


def _chunk_batches(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    for batch in batches:
        where: dict[bytes, list[tuple[int | None, int, int]]] = {}
        texts: dict[bytes, bytes] = {}
        for doc_id, raw in zip(batch.column(0).to_pylist(), _text_bytes(batch.column(1))):
            data = np.frombuffer(raw, np.uint8)
            mark = xxh3_64_intdigest(raw) - (1 << 63)
            cuts = [0, *cut_points(data, one_in).tolist(), len(data)]
            for pos, (a, b) in enumerate(zip(cuts, cuts[1:])):
                piece = raw[a:b]
                key = xxh3_128_digest(piece)
                if key not in where:
                    where[key], texts[key] = [], bytes(piece)
                where[key].append((doc_id, mark, pos))
        if not where:
            continue
        hot = max(8, HOT_SHARE * sum(map(len, where.values())))
        keys = list(where)
        # the salt of a hot chunk follows the batch's content: the same after a retry
        spread = (xxh3_64_intdigest(keys[0]) + xxh3_64_intdigest(keys[-1])) % SALTS
        places = [where[k] for k in keys]
        flat = [p for ps in places for p in ps]
        docs = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, places)]), pa.int32()),
            pa.StructArray.from_arrays(
                [
                    pa.array([p[0] for p in flat], pa.int64()),
                    pa.array([p[1] for p in flat], pa.int64()),
                    pa.array([p[2] for p in flat], pa.int32()),
                ],
                fields=list(_CHUNKS.field("docs").type.value_type),
            ),
        )
        salts = pa.array([spread if len(p) >= hot else 0 for p in places], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), salts, pa.array([texts[k] for k in keys], pa.binary()), docs], schema=_CHUNKS
        )


def _hash_batches(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    """(chunk, whole): the hash of each chunk of each text, with the text's."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        chunks, counts = [], []
        for raw in _text_bytes(batch.column(1)):
            cuts = [0, *cut_points(np.frombuffer(raw, np.uint8), one_in).tolist(), len(raw)]
            chunks += [xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(cuts, cuts[1:])]
            counts.append(len(cuts) - 1)
        whole = np.repeat(batch.column(0).to_numpy(), counts)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(whole, pa.int64())], names=["chunk", "whole"])


def _whole_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of texts that share nothing with others."""
    bpe = byte_bpe(name, folder)
    for batch in batches:
        at, ids, held = 0, [], 0
        for i, raw in enumerate(_text_bytes(batch.column(1))):
            ids.append(bpe.encode_bytes(bytes(raw)))
            held += len(ids[-1])
            if held > FLUSH_IDS:
                yield _id_rows(batch.column(0)[at : i + 1], ids)
                at, ids, held = i + 1, [], 0
        if ids:
            yield _id_rows(batch.column(0)[at:], ids)


def _id_rows(docs: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(ids).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([docs, lists], schema=_IDS)


def _encode_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(name, folder)
    last, ids = None, b""
    for batch in batches:
        columns: tuple[list, list, list, list] = ([], [], [], [])
        held = 0
        docs = batch.column(3)
        for i in range(batch.num_rows):
            key = batch.column(0)[i].as_py()
            if key != last:
                last, ids = key, bpe.encode_bytes(batch.column(2)[i].as_py()).tobytes()
            for p in docs[i].as_py():
                for c, x in zip(columns, (p["doc_id"], p["mark"], p["pos"], ids)):
                    c.append(x)
                held += len(ids)
                if held > FLUSH_IDS * 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)
                    columns, held = ([], [], [], []), 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


def _join_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(name, folder)
    done_docs: list[int | None] = []
    done_ids: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, done_ids)])
        flat = np.concatenate(done_ids).astype(np.int32) if done_ids else np.empty(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        out = pa.RecordBatch.from_arrays([pa.array(done_docs, pa.int64()), ids], schema=_IDS)
        done_docs.clear()
        done_ids.clear()
        return out

    current: tuple | None = None
    parts: list[np.ndarray] = []
    copies, last_pos, held = 0, -1, 0

    def close() -> int:
        if current is None:
            return 0
        ids = join_ids(bpe, parts)
        for _ in range(copies):
            done_docs.append(current[0])
            done_ids.append(ids)
        return copies * (len(ids) + 1)

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(4)]
        for doc_id, mark, pos, raw in zip(*cols):
            if (doc_id, mark) != current:
                held += close()
                current, parts, copies, last_pos = (doc_id, mark), [], 0, -1
                if held > FLUSH_IDS:
                    yield flush()
                    held = 0
            if pos != last_pos:
                parts.append(np.frombuffer(raw, bpe.dtype))
                last_pos = pos
            if pos == 0:
                copies += 1
    close()
    if done_docs:
        yield flush()


def encode_corpus(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    name: str = "byte_bpe_50k",
    folder: str | None = None,
    one_in: int = CUT_ONE_IN,
) -> DataFrame:
    """(doc_id, ids): one row per row of `df`, the ids of its text without special tokens.

    Defined cases: null and empty texts have the empty list; strings that look like special tokens are
    ordinary text; a null doc_id stays null; rows delivered twice come out twice; further columns of `df`
    are ignored, whatever their names. The result doesn't depend on partitioning.
    """
    picked = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("whole"))
    again, once = _sharing(picked, one_in)
    alone = once.select("doc_id", "text").mapInArrow(lambda b: _whole_batches(b, name, folder), _IDS_DDL)
    chunks = again.select("doc_id", "text").mapInArrow(lambda b: _chunk_batches(b, one_in), _CHUNKS_DDL)
    pieces = (
        chunks.repartition("chunk", "salt")
        .sortWithinPartitions("chunk")
        .mapInArrow(lambda b: _encode_batches(b, name, folder), _PIECES_DDL)
    )
    joined = (
        pieces.repartition("doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark", "pos")
        .mapInArrow(lambda b: _join_batches(b, name, folder), _IDS_DDL)
    )
    return alone.unionByName(joined)


def _sharing(picked: DataFrame, one_in: int) -> tuple[DataFrame, DataFrame]:
    """(texts that share a chunk with another text or hold one twice, the others), of (doc_id, text, whole).

    Only hashes are shuffled. The filters may take a text for a sharing one, which changes its way and not its ids.
    """
    hashes = snapshot(picked.where(F.length("text") > 0).select("whole", "text").mapInArrow(lambda b: _hash_batches(b, one_in), "chunk bigint, whole bigint"))
    n = hashes.count()
    shared = hashes.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk")
    found = BitFilter.of(shared, n // 2).split(hashes, "chunk")[0].select("whole").distinct()
    # written, since the first filter would be asked again for each of both parts
    return BitFilter.of(snapshot(found), n).split(picked, "whole")


def chunk_reuse(df: DataFrame, text: str = "text", one_in: int = CUT_ONE_IN) -> DataFrame:
    """One row (texts, sharing_texts, chunks, distinct_chunks): how much of a corpus chunk reuse can save."""
    picked = df.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("whole")).where(F.length("text") > 0)
    hashes = snapshot(picked.select("whole", "text").mapInArrow(lambda b: _hash_batches(b, one_in), "chunk bigint, whole bigint"))
    per = hashes.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    again = hashes.join(per.where("n > 1"), "chunk", "left_semi").agg(F.count_distinct("whole").alias("sharing_texts"))
    counts = per.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"))
    return picked.agg(F.count(F.lit(1)).alias("texts")).crossJoin(again).crossJoin(counts)  # one row each


def token_counts(df: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, into: str = "n_tokens") -> DataFrame:
    """`df` without its text, with the number of ids of the text; no shuffle. Null and empty texts count 0."""
    keep = [c for c in df.columns if c not in (text, into)]
    schema = df.select(*keep, F.lit(0).cast("int").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(name, folder)
        for batch in batches:
            seen: dict[str, int] = {}
            counts = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if not t:
                    counts.append(0)
                    continue
                if t not in seen:
                    seen[t] = len(bpe.encoding.encode_ordinary(t))
                counts.append(seen[t])
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(len(names))), pa.array(counts, pa.int32())], names=[*names, into])

    return df.select(*keep, text).mapInArrow(run, schema)
