"""The most similar vectors of every vector: block matrix join on int8 codes with error bounds.

Vectors are normalised and quantised to int8 with one scale each, and the exact length of the
quantisation error is kept. Cells around centroids (fitted on a bounded sample) hold the vectors; a
vector is compared with its own cell and the next nearest ones. How many is measured before: some vectors
are compared with all, and as many cells are taken as their true neighbours need for the recall that is
asked for. Inside a cell, tiles of integer products give each pair's cosine with a proven error bound; pairs whose upper bound reaches the threshold and the
k-th best lower bound survive (heaps of the k best per vector, in both directions where all rows ask), are
recomputed from the float vectors and merged per vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorix.session import cut, snapshot

#: Vectors per cell that the number of centroids aims at, and the most centroids.
CELL_ROWS = 512
MOST_CELLS = 16384
#: Vectors of the sample per centroid: the sample is at most SAMPLE_PER_CELL * MOST_CELLS vectors per side.
SAMPLE_PER_CELL = 8
#: Fewest cells a vector is compared with.
PROBES = 4
#: Share of the true neighbours that the cells must reach, for the nearest ones and for pairs above a threshold.
RECALL = 0.95
PAIR_RECALL = 0.999
#: Vectors per side whose true neighbours are found by brute force to measure that share, and the fewest pairs to judge by.
ASKERS = 1024
LEAST_PAIRS = 50
#: Rows of a tile; larger cells are cut into a grid of tiles.
TILE_ROWS = 4096
#: So many times as many asking rows are held by a tile.
ASKS_PER_ROW = 8
#: Surviving pairs up to this number are broadcast to fetch their float vectors; more are joined by shuffle.
BROADCAST_PAIRS = 300_000

_CODED = "side string, id int, cell int, tb int, tq int, role int, code binary, scale float, err float"
_PAIRS = "side string, id int, nbr int, lower float, upper float"


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Float32 unit vectors of the usable rows of a list column, and their positions.

    Usable: not null, of length `dim`, without null, NaN or infinite elements, not all zero.
    """
    n = len(column)
    if not n:
        return np.empty((0, dim), np.float32), np.empty(0, np.int64)
    lengths = np.array(column.value_lengths().fill_null(-1))
    rows = np.nonzero(lengths == dim)[0]
    if not len(rows):
        return np.empty((0, dim), np.float32), rows
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = np.asarray(flat.fill_null(np.nan)).reshape(len(rows), dim)
    peak = np.abs(x).max(1)  # NaN stays NaN and is dropped
    good = np.isfinite(peak) & (peak > 0)
    x, rows, peak = x[good], rows[good], peak[good]
    x = x / peak[:, None]  # no overflow or underflow in the norm
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x.astype(np.float32), rows


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the length of each row's quantisation error (rounded up)."""
    scale = (np.abs(x).max(1) / np.float32(127)).astype(np.float32)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.linalg.norm(x.astype(np.float64) - code * scale[:, None].astype(np.float64), axis=1)
    return code, scale, (err + 1e-6).astype(np.float32)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 3, seed: int = 0) -> np.ndarray:
    """Spherical k-means on the driver's bounded sample. Fewer than `cells` rows: the rows themselves."""
    rng = np.random.default_rng(seed)
    if len(sample) <= cells:
        return sample.copy()
    centre = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, centre, 1)[:, 0]
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        length = np.linalg.norm(total, axis=1)
        centre = np.where(length[:, None] > 1e-9, total / np.maximum(length, 1e-9)[:, None], centre).astype(np.float32)
    return centre


def nearest_cells(x: np.ndarray, centre: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` centroids with the largest cosine, nearest first, row block by row block."""
    probes = min(probes, len(centre))
    out = np.empty((len(x), probes), np.int32)
    for a in range(0, len(x), 2048):
        s = x[a : a + 2048] @ centre.T
        top = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.tile(np.arange(probes), (len(s), 1))
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[a : a + 2048] = np.take_along_axis(top, order, 1)
    return out


@dataclass(frozen=True)
class _Cells:
    """Centroids of one side, how many a vector meets and, per cell, the numbers of tiles its base and asking rows are cut into."""

    centre: np.ndarray | None
    tiles: np.ndarray
    ask_tiles: np.ndarray
    probes: int = 1


def _plan_cells(sample: np.ndarray, n_rows: int, exhaustive: bool, seed: int) -> _Cells:
    if exhaustive or not len(sample):
        # blocks instead of cells: every query meets every block
        return _Cells(None, np.array([max(1, -(-n_rows // TILE_ROWS))]), np.array([1]))
    cells = int(min(MOST_CELLS, max(1, -(-n_rows // CELL_ROWS))))
    centre = fit_centroids(sample, cells, seed=seed)
    share = np.bincount(nearest_cells(sample, centre, 1)[:, 0], minlength=len(centre)) / len(sample)
    tiles = np.maximum(1, np.ceil(share * n_rows / TILE_ROWS)).astype(np.int64)
    return _Cells(centre, tiles, tiles)


def _with_probes(plan: _Cells, probes: int, sample: np.ndarray, n_rows: int) -> _Cells:
    """The plan with a number of probes, and so many asking tiles as the sample's probes let expect."""
    if plan.centre is None:
        return plan
    probes = min(probes, len(plan.centre))
    met = np.bincount(nearest_cells(sample, plan.centre, probes).ravel(), minlength=len(plan.centre)) / len(sample)
    asks = np.ceil(met * n_rows / (TILE_ROWS * ASKS_PER_ROW)).astype(np.int64)
    return replace(plan, probes=probes, ask_tiles=np.maximum(plan.tiles, asks))


_TRUE = "side string, id int, nbr int, cos float, ahead int, back int"


def _cell_rank(x: np.ndarray, centre: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """For each row, how many centroids are nearer than the one of `cell`."""
    out = np.empty(len(x), np.int32)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ centre.T
        out[a : a + 1024] = (s > np.take_along_axis(s, cell[a : a + 1024, None], 1)).sum(1)
    return out


def _true_neighbours(batches: Iterator[pa.RecordBatch], plans: dict[str, _Cells], askers: dict[str, tuple[np.ndarray, np.ndarray]], k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Each asker's k nearest rows of this partition, with the rank of the cells: theirs for the asker, the asker's for them."""
    best = {}
    for batch in batches:
        sides = np.array(batch.column(0).to_pylist(), object)
        for side, (q_ids, q) in askers.items():
            mine = np.nonzero(sides == side)[0]
            x, at = unit_rows(batch.column(2).take(pa.array(mine)), dim)
            if not len(x):
                continue
            ids = batch.column(1).take(pa.array(mine[at])).to_numpy()
            s = q @ x.T
            s[q_ids[:, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(q), 1))
            cos, nbr, vec = np.take_along_axis(s, top, 1), ids[top], x[top]
            if side in best:
                cos, nbr, vec = (np.concatenate([a, b], axis=1) for a, b in zip(best[side], (cos, nbr, vec)))
                top = np.argsort(-cos, axis=1)[:, :k]
                cos, nbr, vec = np.take_along_axis(cos, top, 1), np.take_along_axis(nbr, top, 1), np.take_along_axis(vec, top[:, :, None], 1)
            best[side] = cos, nbr, vec
    for side, (cos, nbr, vec) in best.items():
        q_ids, q = askers[side]
        centre = plans[side].centre
        i, j = np.nonzero(np.isfinite(cos))
        y = vec[i, j]
        ahead = _cell_rank(q[i], centre, nearest_cells(y, centre, 1)[:, 0])
        back = _cell_rank(y, centre, nearest_cells(q, centre, 1)[i, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([side] * len(i), pa.string()), pa.array(q_ids[i].astype(np.int32)), pa.array(nbr[i, j].astype(np.int32)), pa.array(cos[i, j].astype(np.float32)), pa.array(ahead), pa.array(back)],
            names=["side", "id", "nbr", "cos", "ahead", "back"],
        )


def probes_needed(cos: np.ndarray, rank: np.ndarray, min_cos: float, recall: float) -> int:
    """Fewest probes that reach `recall` of the pairs above the threshold; of the most similar ones if these are few."""
    order = np.argsort(-cos, kind="stable")
    rank = np.sort(rank[order[: max(LEAST_PAIRS, int((cos >= min_cos).sum()))]])
    return max(PROBES, int(rank[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1) if len(rank) else PROBES


def measured_probes(rows: DataFrame, plans: dict[str, _Cells], sizes: dict[str, int], k: int, min_cos: float, recall: float, dim: int, mutual: bool, seed: int) -> dict[str, int]:
    """Per side, the cells a vector must meet, measured on the true neighbours of at most ASKERS vectors in one pass over the rows."""
    askers = {}
    for side, plan in plans.items():
        if plan.centre is None or len(plan.centre) <= PROBES:
            continue
        of_side = rows.where((F.col("side") == side) & F.col("asks"))
        n = sizes[side] if mutual else of_side.count()
        share = min(1.0, ASKERS * 1.5 / max(n, 1))
        # another hash than the sample's: centroids fit the vectors they were made of too well
        picked = of_side.where(F.pmod(F.xxhash64(F.lit(seed + 1), "id", F.lit("ask")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("id", "f").limit(ASKERS).toArrow()
        x, at = unit_rows(picked["f"].combine_chunks(), dim)
        if len(x):
            askers[side] = picked["id"].combine_chunks().to_numpy()[at], x
    if not askers:
        return {}
    near = rows.select("side", "id", "f").mapInArrow(lambda b: _true_neighbours(b, plans, askers, k, dim), _TRUE)
    near = near.groupBy("side", "id", "nbr").agg(F.max("cos").alias("cos"), F.min("ahead").alias("ahead"), F.min("back").alias("back"))
    first = F.row_number().over(Window.partitionBy("side", "id").orderBy(F.desc("cos"), "nbr"))
    found = near.withColumn("r", first).where(F.col("r") <= k).drop("r").toPandas()
    out = {}
    for side, g in found.groupby("side"):
        rank = np.minimum(g["ahead"], g["back"]) if mutual else g["ahead"]
        out[side] = probes_needed(g["cos"].to_numpy(), rank.to_numpy(), min_cos, recall)
    return out


def _mix(ids: np.ndarray, salt: int) -> np.ndarray:
    h = (ids.astype(np.int64).astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


def _assign(batches: Iterator[pa.RecordBatch], plans: dict[str, _Cells], dim: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("side", pa.string()), ("id", pa.int32()), ("cell", pa.int32()), ("tb", pa.int32()), ("tq", pa.int32()), ("role", pa.int32()), ("code", pa.binary()), ("scale", pa.float32()), ("err", pa.float32())]
    )
    for batch in batches:
        sides = np.array(batch.column(0).to_pylist(), object)
        ids_all, asks_all = batch.column(1), np.array(batch.column(3).to_pylist(), bool)
        for side, plan in plans.items():
            mine = np.nonzero(sides == side)[0]
            x, at = unit_rows(batch.column(2).take(pa.array(mine)), dim)
            if not len(x):
                continue
            at = mine[at]
            ids = ids_all.take(pa.array(at)).to_numpy()
            asks = asks_all[at]
            code, scale, err = quantise(x)
            home = np.zeros((len(x), 1), np.int32) if plan.centre is None else nearest_cells(x, plan.centre, plan.probes)
            pick, cell, tb, tq, role = [], [], [], [], []
            for rank in range(home.shape[1]):
                tiles, q_tiles = plan.tiles[home[:, rank]], plan.ask_tiles[home[:, rank]]
                one = (tiles == 1) & (q_tiles == 1)
                base = rank == 0
                # small cells: one row that is base, query or both
                sel = np.nonzero(one & (base | asks))[0]
                pick.append(sel)
                cell.append(home[sel, rank])
                tb.append(np.zeros(len(sel), np.int64))
                tq.append(np.zeros(len(sel), np.int64))
                role.append(base * 1 + asks[sel] * (6 if base else 2))
                # large cells: a grid of tiles; a base row meets all query tiles of its base tile and vice versa
                many = np.nonzero(~one)[0]
                if base and len(many):
                    sel = np.repeat(many, q_tiles[many])
                    pick.append(sel)
                    cell.append(home[sel, rank])
                    tb.append(_mix(ids[sel], 1) % tiles[sel])
                    tq.append(_ranks(q_tiles[many]))
                    role.append(np.full(len(sel), 1))
                many = many[asks[many]]
                if len(many):
                    sel = np.repeat(many, tiles[many])
                    pick.append(sel)
                    cell.append(home[sel, rank])
                    tb.append(_ranks(tiles[many]))
                    tq.append(_mix(ids[sel], 2) % q_tiles[sel])
                    role.append(np.full(len(sel), 6 if base else 2))
            p = np.concatenate(pick)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(x), [None, pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([side] * len(p), pa.string()),
                    pa.array(ids[p].astype(np.int32)),
                    pa.array(np.concatenate(cell).astype(np.int32)),
                    pa.array(np.concatenate(tb).astype(np.int32)),
                    pa.array(np.concatenate(tq).astype(np.int32)),
                    pa.array(np.concatenate(role).astype(np.int32)),
                    raw.take(pa.array(p)).cast(pa.binary()),
                    pa.array(scale[p]),
                    pa.array(err[p]),
                ],
                schema=schema,
            )


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of `counts`, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def bounds(q: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of two sets of codes with scales and errors.

    The product of int8 codes is exact in float32 (48 * 127**2 < 2**24). With unit vectors the error of
    the rebuilt cosine is at most e_q + e_b + e_q * e_b.
    """
    s = q[0].astype(np.float32) @ b[0].astype(np.float32).T
    s *= q[1][:, None]
    s *= b[1][None, :]
    bound = q[2][:, None] + b[2][None, :] * (1 + q[2][:, None]) + np.float32(1e-6)
    return s - bound, s + bound


def best_lower(lower: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Each row's k best lower bounds in no order, over ids and not over rows: an id's rows would fill the places of others."""
    order = np.argsort(ids, kind="stable")
    starts = np.nonzero(np.diff(ids[order], prepend=ids[order][:1] - 1))[0]
    per_id = lower if len(starts) == len(ids) else np.maximum.reduceat(lower[:, order], starts, axis=1)
    n = per_id.shape[1]
    if n < k:
        return np.concatenate([per_id, np.full((len(per_id), k - n), -np.inf, np.float32)], axis=1)
    return np.partition(per_id, n - k, axis=1)[:, n - k :]


def _floors(lower: np.ndarray, hits: np.ndarray, ids: np.ndarray, k: int, min_cos: float) -> np.ndarray:
    """What a row's upper bounds must reach: the threshold and, where more than k reach it, the k-th best lower bound."""
    floor = np.full(len(lower), min_cos, np.float32)
    crowded = np.nonzero(hits.sum(1) > k)[0]
    if len(crowded):
        floor[crowded] = np.maximum(floor[crowded], best_lower(lower[crowded], ids, k).min(1))
    return floor


def tile_pairs(
    q_ids: np.ndarray, q: tuple[np.ndarray, np.ndarray, np.ndarray], b_ids: np.ndarray, b: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, min_cos: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Surviving (query row, base row, lower, upper) of one tile."""
    lower, upper = bounds(q, b)
    lower[q_ids[:, None] == b_ids[None, :]] = -np.inf
    hits = (upper >= min_cos) & np.isfinite(lower)
    i, j = np.nonzero(hits & (upper >= _floors(lower, hits, b_ids, k, min_cos)[:, None]))
    return i, j, lower[i, j], upper[i, j]


class _Heaps:
    """The k best lower bounds of each base row over all asking rows of a tile that visit its cell.

    A vector that many others find near would otherwise answer each of them. Slices come one after the
    other, each with all rows of its ids; what later slices make hopeless is dropped at the end.
    """

    def __init__(self, n: int, k: int, min_cos: float) -> None:
        self.best, self.k, self.min_cos = np.full((n, k), -np.inf, np.float32), k, min_cos
        self.kept: list[tuple[np.ndarray, ...]] = []

    def add(self, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray) -> None:
        hits = (upper >= self.min_cos) & np.isfinite(lower)
        met = np.nonzero(hits.any(0))[0]
        if not len(met):
            return
        low, up, hits = lower[:, met].T, upper[:, met].T, hits[:, met].T
        both = np.concatenate([self.best[met], best_lower(low, ids, self.k)], axis=1)
        self.best[met] = np.partition(both, self.k, axis=1)[:, self.k :]
        j, i = np.nonzero(hits & (up >= self.best[met].min(1)[:, None]))
        self.kept.append((met[j], ids[i], low[j, i], up[j, i]))

    def pairs(self) -> tuple[np.ndarray, ...]:
        """(base row, id of the asking row, lower, upper)"""
        if not self.kept:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.float32)
        row, ids, low, up = (np.concatenate(x) for x in zip(*self.kept))
        good = up >= self.best.min(1)[row]
        return row[good], ids[good], low[good], up[good]


def _slices(ids: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of about `size` rows of sorted ids; the rows of an id stay together."""
    a = 0
    while a < len(ids):
        b = len(ids) if a + size >= len(ids) else int(np.searchsorted(ids, ids[a + size]))
        b = b if b > a else int(np.searchsorted(ids, ids[a], side="right"))
        yield slice(a, b)
        a = b


def _compare(k: int, min_cos: float, dim: int, mutual: bool):  # noqa: ANN202
    schema = pa.schema([("side", pa.string()), ("id", pa.int32()), ("nbr", pa.int32()), ("lower", pa.float32()), ("upper", pa.float32())])

    def run(group: pa.Table) -> pa.Table:
        ids, role = group["id"].to_numpy(), group["role"].to_numpy()
        code = np.frombuffer(b"".join(group["code"].to_pylist()), np.int8).reshape(len(ids), dim)
        parts = (code, group["scale"].to_numpy(), group["err"].to_numpy())
        base, ask = np.nonzero(role & 1)[0], np.nonzero(role & 2)[0]
        ask = ask[np.argsort(ids[ask], kind="stable")]
        out, of_base = [], tuple(p[base] for p in parts)
        heaps = _Heaps(len(base), k, min_cos)
        for at in _slices(ids[ask], 1024) if len(base) else ():
            rows = ask[at]
            lower, upper = bounds(tuple(p[rows] for p in parts), of_base)
            lower[ids[rows][:, None] == ids[base][None, :]] = -np.inf
            hits = (upper >= min_cos) & np.isfinite(lower)
            i, j = np.nonzero(hits & (upper >= _floors(lower, hits, ids[base], k, min_cos)[:, None]))
            out.append((ids[rows][i], ids[base][j], lower[i, j], upper[i, j]))
            # rows at home in this cell are base rows, too, and ask for themselves
            visits = np.nonzero(role[rows] & 4 == 0)[0]
            if mutual and len(visits):
                heaps.add(lower[visits], upper[visits], ids[rows[visits]])
        row, other, low, up = heaps.pairs()
        out.append((ids[base][row], other, low, up))
        a, n, lo, up = (np.concatenate(x) for x in zip(*out))
        side = group["side"][0].as_py() if len(ids) else ""
        return pa.Table.from_arrays([pa.array([side] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(n, pa.int32()), pa.array(lo, pa.float32()), pa.array(up, pa.float32())], schema=schema)

    return run


def similar_vectors(
    df: DataFrame,
    *,
    k: int = 10,
    min_cos: float = -1.0,
    asks: Column | None = None,
    dim: int = 48,
    probes: int | None = None,
    recall: float = RECALL,
    exhaustive: bool = False,
    side: str = "side",
    id_: str = "id",
    vector: str = "f",
    seed: int = 0,
) -> DataFrame:
    """(side, id, nbr, cos, rank): for each asking vector its k most similar others of the same side.

    `asks` restricts the asking rows (default: all); all rows can be found. With `exhaustive` every
    asking vector meets every block of the side (exact); otherwise its `probes` nearest cells (default: as many
    as `recall` of the true neighbours at `min_cos` or more need, measured on this table and never below PROBES).
    Defined cases: unusable vectors (see unit_rows) and null ids or sides neither ask nor are found; an id
    delivered again is one id, and with several different vectors its similarity is the largest of them;
    ties of the cosine go to the smaller id; an empty table gives no rows; extra columns are ignored.
    """
    ask = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = df.where(F.col(side).isNotNull() & F.col(id_).isNotNull()).select(
        F.col(side).alias("side"), F.col(id_).cast("int").alias("id"), F.col(vector).cast("array<float>").alias("f"), ask.alias("asks")
    )
    # an id delivered again with the same vector is one row; written once, since it is read several times
    rows = snapshot(rows.groupBy("side", "id", "f").agg(F.max("asks").alias("asks")))
    sizes = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    plans, samples = {}, {}
    for s, n in sizes.items():
        want = min(MOST_CELLS, -(-n // CELL_ROWS)) * SAMPLE_PER_CELL
        sample = np.empty((0, dim), np.float32)
        if not exhaustive:
            # a bounded sample: the vectors with the smallest hash of their id
            share = min(1.0, want * 1.2 / n)
            picked = rows.where((F.col("side") == s) & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))).select("f").limit(2 * want + 64).toArrow()
            sample = unit_rows(picked["f"].combine_chunks(), dim)[0] if picked.num_rows else sample
        plans[s], samples[s] = _plan_cells(sample, n, exhaustive, seed), sample
    mutual = asks is None and not exhaustive
    need = {} if exhaustive or probes else measured_probes(rows, plans, sizes, k, min_cos, recall, dim, mutual, seed)
    plans = {s: _with_probes(plan, probes or need.get(s, PROBES), samples[s], sizes[s]) for s, plan in plans.items()}
    coded = rows.mapInArrow(lambda b: _assign(b, plans, dim), _CODED)
    found = (
        coded.groupBy("side", "cell", "tb", "tq")
        .applyInArrow(_compare(k, min_cos, dim, mutual), _PAIRS)
        .groupBy("side", "id", "nbr")
        .agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    )
    # over all tiles, a pair must also reach the k-th best lower bound of its vector
    best = Window.partitionBy("side", "id").orderBy(F.desc("lower"))
    ranked = found.withColumn("r", F.row_number().over(best)).withColumn("kth", F.min(F.when(F.col("r") == k, F.col("lower"))).over(Window.partitionBy("side", "id")))
    pairs = cut(ranked.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("side", "id", "nbr"))
    small = pairs.count() <= BROADCAST_PAIRS
    hint = F.broadcast if small else (lambda x: x)
    floats = rows.select("side", "id", "f")
    left = floats.join(hint(pairs), ["side", "id"]).select("side", "id", "nbr", F.col("f").alias("fa"))
    right = floats.withColumnRenamed("id", "nbr").join(hint(pairs), ["side", "nbr"]).select("side", "id", "nbr", F.col("f").alias("fb"))
    exact = (
        left.join(right, ["side", "id", "nbr"])
        .select("side", "id", "nbr", cosine(F.col("fa"), F.col("fb")).alias("cos"))
        .groupBy("side", "id", "nbr")
        .agg(F.max("cos").alias("cos"))
        .where(F.col("cos") >= min_cos)
    )
    rank = F.row_number().over(Window.partitionBy("side", "id").orderBy(F.desc("cos"), "nbr"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; null if one of them is unusable."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(~F.isnan(value), value)


def similar_pairs(df: DataFrame, min_cos: float = 0.95, k: int = 10, **options: object) -> DataFrame:
    """(side, id_a, id_b): pairs with id_a < id_b of which one is among the k most similar of the other."""
    near = similar_vectors(df, k=k, min_cos=min_cos, **{"recall": PAIR_RECALL, **options})
    return near.select("side", F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
