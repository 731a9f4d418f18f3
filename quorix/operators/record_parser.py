"""Raw rating lines to typed records, with the rejected lines and the reason beside them.

Lines of the delimited feeds run through a quote-aware finite-state tokenizer. Its transitions are
computed for every start state over fixed-size chunks of all lines of an Arrow batch at once, the
chunks' transition maps are composed along each line, and a second sweep with the then known start
states marks the separators. Fields are spans of one buffer; they are trimmed, checked and typed as whole
columns. No step loops over lines or over the bytes of a line in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Result columns. `reason` null: a valid record. `offset`: byte of the line where the fault lies.
PARSED_SCHEMA = (
    "line_id bigint, feed string, ordinal int, row_idx int, col_idx int, value float, ts int, note string,"
    " reason string, offset int"
)
REASONS = ("feed", "quoting", "column_count", "row_idx", "col_idx", "value", "ts")

_ARROW = pa.schema(
    [
        ("line_id", pa.int64()),
        ("feed", pa.string()),
        ("ordinal", pa.int32()),
        ("row_idx", pa.int32()),
        ("col_idx", pa.int32()),
        ("value", pa.float32()),
        ("ts", pa.int32()),
        ("note", pa.string()),
        ("reason", pa.string()),
        ("offset", pa.int32()),
    ]
)

# States of the tokenizer: at the start of a field, in an unquoted field, in a quoted field, after a
# quote inside a quoted field, broken.
START, PLAIN, QUOTED, CLOSING, BROKEN = range(5)
# Byte classes: other, double quote, comma.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord('"')] = 1
_CLASS[ord(",")] = 2
_STEP = np.empty((5, 3), np.uint8)
_STEP[START] = (PLAIN, QUOTED, START)
_STEP[PLAIN] = (PLAIN, BROKEN, START)
_STEP[QUOTED] = (QUOTED, CLOSING, QUOTED)
_STEP[CLOSING] = (BROKEN, QUOTED, START)
_STEP[BROKEN] = (BROKEN, BROKEN, BROKEN)

# A value as a regular expression; Arrow runs it in linear time.
_VALUE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_MAX_INDEX = 2147483647
#: Bytes of a chunk; a longer line has several, whose transitions are composed.
CHUNK = 16


def tokenize(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States before each byte of many records held in one buffer.

    Returns (state before each byte of `data`, state after each record, first broken byte of each
    record or -1). Records are cut into chunks; `chunk` changes the work, never the result.
    """
    n = len(starts)
    before = np.zeros(len(data), np.uint8)
    final = np.full(n, START, np.uint8)
    fault = np.full(n, -1, np.int64)
    length = ends - starts
    pieces = np.maximum((length + chunk - 1) // chunk, 0)
    total = int(pieces.sum())
    if not total:
        return before, final, fault
    owner = np.repeat(np.arange(n), pieces)
    rank = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[owner] + rank * chunk
    size = np.minimum(chunk, ends[owner] - at)
    order = np.argsort(-size, kind="stable")
    sorted_size = size[order]
    cls = _CLASS[data]
    # The transition map of each chunk that another one follows, for all start states at once.
    maps = np.tile(np.arange(5, dtype=np.uint8), (total, 1))
    full = np.nonzero(rank < pieces[owner] - 1)[0]  # all of them have `chunk` bytes
    for j in range(chunk if len(full) else 0):
        maps[full] = _STEP[maps[full], cls[at[full] + j][:, None]]
    # Composition along each record gives the state in which each chunk starts.
    begin = np.full(total, START, np.uint8)
    for r in range(1, int(pieces.max())):
        here = np.nonzero(rank == r)[0]
        begin[here] = maps[here - 1, begin[here - 1]]
    state = begin.copy()
    for j in range(int(sorted_size[0])):
        live = order[: np.searchsorted(-sorted_size, -j, side="left")]
        p = at[live] + j
        before[p] = state[live]
        after = _STEP[state[live], cls[p]]
        fresh = live[(after == BROKEN) & (state[live] != BROKEN)]
        fault[owner[fresh]] = at[fresh] + j
        state[live] = after
    last = np.nonzero(rank == pieces[owner] - 1)[0]
    final[owner[last]] = state[last]
    return before, final, fault


class _Text:
    """A buffer of bytes with what any span of it needs to be judged without a loop."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        blank = (data == 32) | (data == 13)
        self.inked = np.nonzero(~blank)[0]
        self.digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        self.not_zero = np.nonzero(data != 48)[0]

    def trim(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans without spaces and carriage returns around them."""
        first = np.append(self.inked, len(self.data))[np.searchsorted(self.inked, starts)]
        starts = np.minimum(first, ends)
        return starts, self.end(starts, ends)

    def end(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ends of the spans without spaces and carriage returns in front of them."""
        return np.maximum(np.append(-1, self.inked)[np.searchsorted(self.inked, ends)] + 1, starts)

    def index(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, whether it is one): ASCII digits with a number up to _MAX_INDEX."""
        good = (ends > starts) & (self.digits[ends] - self.digits[starts] == ends - starts)
        at = np.minimum(np.append(self.not_zero, len(self.data))[np.searchsorted(self.not_zero, starts)], ends)
        good &= ends - at <= 10
        number = np.zeros(len(starts), np.int64)
        for j in range(10):
            live = np.nonzero(good & (at + j < ends))[0]
            number[live] = number[live] * 10 + (self.data[at[live] + j] - 48)
        good &= number <= _MAX_INDEX
        return np.where(good, number, 0), good

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of rising spans that don't overlap, as an Arrow array over this buffer."""
        if not len(starts):
            return pa.array([], pa.binary())
        # fields alternate with what lies between them
        edges = np.stack([starts, ends], 1).ravel().astype(np.int32)
        both = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(self.data)])
        return both.take(pa.array(np.arange(0, len(edges) - 1, 2)))


def _numbers(fields: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(float32 value, whether it is one) of byte strings."""
    good = np.array(pc.match_substring_regex(fields, _VALUE).fill_null(False), bool)
    value = np.zeros(len(fields), np.float32)
    with np.errstate(over="ignore"):
        value[good] = np.array([float(x) for x in fields.filter(pa.array(good)).to_pylist()], np.float64).astype(np.float32)
    good &= np.isfinite(value)
    return np.where(good, value, 0), good


def _rows(ids: pa.Array, feeds: pa.Array, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Result rows; columns that are not given are null."""
    out = {"line_id": ids, "feed": feeds, **columns}
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out and isinstance(out[f.name], np.ndarray) else out.get(f.name, pa.nulls(len(ids), f.type)).cast(f.type) for f in _ARROW], schema=_ARROW)


class _Lines:
    """The lines of one feed in one buffer, with the first reason that applies to each."""

    def __init__(self, ids: pa.Array, feeds: pa.Array, lines: pa.Array) -> None:
        self.ids, self.feeds = ids, feeds
        _, offsets, data = lines.buffers()
        edges = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        self.text = _Text(np.frombuffer(data, np.uint8)[: edges[-1]] if data is not None else np.empty(0, np.uint8))
        self.starts = edges[:-1]
        self.ends = self.text.end(self.starts, edges[1:])
        self.reason = np.full(len(lines), -1)
        self.offset = np.zeros(len(lines), np.int64)
        self.reject(self.ends == self.starts, "column_count", self.starts)

    def reject(self, which: np.ndarray, reason: str, at: np.ndarray) -> None:
        """Lines of the mask that have no reason yet, with the place of the fault in the buffer."""
        new = which & (self.reason < 0)
        self.reason[new] = REASONS.index(reason)
        self.offset[new] = (at - self.starts)[new]

    def open(self) -> np.ndarray:
        return np.nonzero(self.reason < 0)[0]

    def rejected(self) -> pa.RecordBatch:
        bad = np.nonzero(self.reason >= 0)[0]
        at = pa.array(bad)
        return _rows(self.ids.take(at), self.feeds.take(at), ordinal=np.zeros(len(bad), np.int32), reason=pa.array(np.array(REASONS, object)[self.reason[bad]], pa.string()), offset=self.offset[bad].astype(np.int32))

    def fields(self, separators: np.ndarray, width: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines, starts, ends) of the open lines' fields, one column per field; lines with another number of fields are rejected."""
        lo, hi = np.searchsorted(separators, self.starts), np.searchsorted(separators, self.ends)
        self.reject(hi - lo + 1 != want, "column_count", self.ends)
        rows = self.open()
        n = int(want[rows[0]]) if len(rows) else 1
        cuts = separators[lo[rows][:, None] + np.arange(n - 1)] if n > 1 and len(rows) else np.empty((len(rows), n - 1), np.int64)
        return rows, np.concatenate([self.starts[rows][:, None], cuts + width], 1), np.concatenate([cuts, self.ends[rows][:, None]], 1)


def _typed(lines: _Lines, rows: np.ndarray, at: np.ndarray, columns: list[tuple[str, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rejects lines by the first column that holds no number; gives the rows that stay."""
    for k, (reason, _, good) in enumerate(columns):
        bad, where = np.zeros(len(lines.reason), bool), lines.starts.copy()
        bad[rows], where[rows] = ~good, at[:, k]
        lines.reject(bad, reason, where)
    return np.nonzero(lines.reason[rows] < 0)[0]


def _delimited(lines: _Lines, chunk: int, width: int) -> list[pa.RecordBatch]:
    """Lines of a feed with commas and quotes: `triple` (3 fields) or `noted` (4)."""
    text = lines.text
    before, final, fault = tokenize(text.data, lines.starts, lines.ends, chunk)
    lines.reject((final == BROKEN) | (final == QUOTED), "quoting", np.where(fault >= 0, fault, lines.ends))
    commas = np.nonzero((text.data == ord(",")) & (before != QUOTED) & (before != BROKEN))[0]
    rows, a, b = lines.fields(commas, 1, np.full(len(lines.reason), width))
    if not len(rows):
        return [lines.rejected()]
    quoted = (b > a) & (text.data[np.minimum(a, len(text.data) - 1)] == ord('"'))
    starts, ends = text.trim(a.ravel(), b.ravel())
    starts = np.where(quoted, a + 1, starts.reshape(a.shape))
    ends = np.where(quoted, b - 1, ends.reshape(a.shape))

    def column(k: int) -> pa.Array:
        raw = text.spans(starts[:, k], ends[:, k])
        return pc.if_else(pa.array(quoted[:, k]), pc.replace_substring(raw, b'""', b'"'), raw) if quoted[:, k].any() else raw

    # doubled quotes make no number, so the raw bytes may be judged
    value, is_value = _numbers(column(2))
    numbers = [("row_idx", *text.index(starts[:, 0], ends[:, 0])), ("col_idx", *text.index(starts[:, 1], ends[:, 1])), ("value", value, is_value)]
    kept = _typed(lines, rows, a, numbers)
    at = pa.array(rows[kept])
    note = {"note": column(3).take(pa.array(kept)).cast(pa.string())} if width == 4 else {}
    good = _rows(lines.ids.take(at), lines.feeds.take(at), ordinal=np.zeros(len(kept), np.int32), **{n: x[kept] for n, x, _ in numbers}, **note)
    return [good, lines.rejected()]


def _movielens(lines: _Lines) -> list[pa.RecordBatch]:
    text = lines.text
    colon = text.data == ord(":")
    # of a run of colons, pairs are taken from its start
    spots = np.nonzero(colon)[0]
    first = np.nonzero(np.diff(spots, prepend=-2) > 1)[0]
    in_run = np.arange(len(spots)) - np.repeat(first, np.diff(np.append(first, len(spots))))
    # a separator lies inside one line: neither a run nor a pair goes on in the next one
    line = np.searchsorted(lines.starts, spots, side="right") - 1
    begun = np.maximum(spots - in_run, lines.starts[line]) if len(spots) else spots
    pairs = spots[((spots - begun) % 2 == 0) & np.isin(spots + 1, spots) & (spots + 1 < lines.ends[line])] if len(spots) else spots
    rows, a, b = lines.fields(pairs, 2, np.full(len(lines.reason), 4))
    if not len(rows):
        return [lines.rejected()]
    starts, ends = (x.reshape(a.shape) for x in text.trim(a.ravel(), b.ravel()))
    value, is_value = _numbers(text.spans(starts[:, 2], ends[:, 2]))
    numbers = [("row_idx", *text.index(starts[:, 0], ends[:, 0])), ("col_idx", *text.index(starts[:, 1], ends[:, 1])), ("value", value, is_value), ("ts", *text.index(starts[:, 3], ends[:, 3]))]
    kept = _typed(lines, rows, a, numbers)
    at = pa.array(rows[kept])
    return [_rows(lines.ids.take(at), lines.feeds.take(at), ordinal=np.zeros(len(kept), np.int32), **{n: x[kept] for n, x, _ in numbers}), lines.rejected()]


def _adjacency(lines: _Lines) -> list[pa.RecordBatch]:
    text = lines.text
    tabs = np.nonzero(text.data == 9)[0]
    lo, hi = np.searchsorted(tabs, lines.starts), np.searchsorted(tabs, lines.ends)
    first = np.append(tabs, len(text.data))[lo]
    lines.reject(hi - lo != 1, "column_count", np.minimum(first, lines.ends))
    rows = lines.open()
    if not len(rows):
        return [lines.rejected()]
    # pairs: spans between spaces, trimmed, without the empty ones
    spaces = np.nonzero(text.data == 32)[0]
    body, stop = first[rows] + 1, lines.ends[rows]
    s_lo, s_hi = np.searchsorted(spaces, body), np.searchsorted(spaces, stop)
    n = s_hi - s_lo + 1
    owner = np.repeat(np.arange(len(rows)), n)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    padded = np.append(spaces, len(text.data))
    raw_a = np.where(rank == 0, body[owner], padded[np.minimum(s_lo[owner] + rank - 1, len(spaces))] + 1)
    raw_b = np.where(rank == n[owner] - 1, stop[owner], padded[np.minimum(s_lo[owner] + rank, len(spaces))])
    a, b = text.trim(raw_a, raw_b)
    some = b > a
    owner, raw_a, a, b = owner[some], raw_a[some], a[some], b[some]
    colons = np.nonzero(text.data == ord(":"))[0]
    c_lo, c_hi = np.searchsorted(colons, a), np.searchsorted(colons, b)

    def reject_first(bad: np.ndarray, reason: str, at: np.ndarray) -> None:
        """The first bad pair of a line gives the place."""
        spots = np.nonzero(bad)[0]
        who, at_first = np.unique(owner[spots], return_index=True)
        mask, where = np.zeros(len(lines.reason), bool), lines.starts.copy()
        mask[rows[who]], where[rows[who]] = True, at[spots[at_first]]
        lines.reject(mask, reason, where)

    reject_first(c_hi - c_lo != 1, "column_count", raw_a)
    none = np.ones(len(rows), bool)
    none[owner] = False
    empty = np.zeros(len(lines.reason), bool)
    empty[rows[none]] = True
    lines.reject(empty, "column_count", lines.ends)
    row, is_row = text.index(*text.trim(lines.starts[rows], first[rows]))
    bad = np.zeros(len(lines.reason), bool)
    bad[rows[~is_row]] = True
    lines.reject(bad, "row_idx", lines.starts)
    alive = lines.reason[rows][owner] < 0
    owner, raw_a, a, b = owner[alive], raw_a[alive], a[alive], b[alive]
    colon = colons[c_lo[alive]] if alive.any() else np.empty(0, np.int64)
    col, is_col = text.index(a, colon)
    reject_first(~is_col, "col_idx", raw_a)
    value, is_value = _numbers(text.spans(colon + 1, b))
    reject_first(~is_value, "value", colon + 1)
    kept = np.nonzero(lines.reason[rows][owner] < 0)[0]
    who = owner[kept]
    new = np.nonzero(np.diff(who, prepend=-1))[0]
    ordinal = np.arange(len(who)) - np.repeat(new, np.diff(np.append(new, len(who))))
    at = pa.array(rows[who])
    return [_rows(lines.ids.take(at), lines.feeds.take(at), ordinal=ordinal.astype(np.int32), row_idx=row[who], col_idx=col[kept], value=value[kept]), lines.rejected()]


#: Readers of the feeds.
_FEEDS = {"triple": lambda x, chunk: _delimited(x, chunk, 3), "noted": lambda x, chunk: _delimited(x, chunk, 4), "movielens": lambda x, _: _movielens(x), "adjacency": lambda x, _: _adjacency(x)}


def parse_arrays(ids: pa.Array, feeds: pa.Array, lines: pa.Array, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parse parallel arrays of lines, feed by feed; see parse_lines."""
    lines = lines.fill_null("" if pa.types.is_string(lines.type) else b"").cast(pa.binary())
    known = pc.is_in(feeds, value_set=pa.array(list(_FEEDS), pa.string()))
    other = pc.invert(known)
    if pc.any(other).as_py():
        ids_of, feeds_of = ids.filter(other), feeds.filter(other)
        n = len(ids_of)
        yield _rows(ids_of, feeds_of, ordinal=np.zeros(n, np.int32), reason=pa.array(["feed"] * n, pa.string()), offset=np.zeros(n, np.int32))
    for feed, parse in _FEEDS.items():
        mine = pc.equal(feeds, feed).fill_null(False)
        if pc.any(mine).as_py():
            yield from parse(_Lines(ids.filter(mine), feeds.filter(mine), lines.filter(mine)), chunk)


def parse_batch(line_ids: list[int | None], feeds: list[str | None], lines: list[str | None], chunk: int = CHUNK) -> pa.RecordBatch:
    """Parse parallel lists of lines; see parse_lines."""
    raw = pa.array([(x or "").encode("utf-8", "surrogatepass") for x in lines], pa.binary())
    parts = list(parse_arrays(pa.array(line_ids, pa.int64()), pa.array(feeds, pa.string()), raw, chunk))
    return pa.Table.from_batches(parts, _ARROW).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else pa.RecordBatch.from_pylist([], _ARROW)


def parse_lines(df: DataFrame, line_id: str = "line_id", feed: str = "feed", line: str = "line", chunk: int = CHUNK) -> DataFrame:
    """Typed records and rejected lines of a table of raw lines, in one pass without a shuffle.

    A valid line gives one row (adjacency: one row per pair, numbered by `ordinal`) with `reason` null;
    a broken line gives exactly one row with the first reason that applies and the byte offset of the
    fault. Defined cases: a null, empty or blank line is `column_count`; a null or unknown feed is
    `feed`; a null line_id is kept as null; lines delivered twice are parsed twice; further columns of
    `df` are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from parse_arrays(b.column(0), b.column(1), b.column(2), chunk)

    picked = df.select(F.col(line_id).cast("bigint").alias("line_id"), F.col(feed).alias("feed"), F.col(line).alias("line"))
    return picked.mapInArrow(run, PARSED_SCHEMA)


def records(parsed: DataFrame) -> DataFrame:
    """The valid records of parse_lines."""
    return parsed.where(F.col("reason").isNull()).drop("reason", "offset")


def rejects(parsed: DataFrame) -> DataFrame:
    """The rejected lines of parse_lines with reason and offset."""
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "feed", "reason", "offset")
