"""Local compressed structures of one block, built in numpy inside a grouped function."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SparseBlock:
    """CSR and CSC of one block. `row_map` and `col_map` take dense local to sorted global ids."""

    row_map: np.ndarray
    col_map: np.ndarray
    row_ptr: np.ndarray
    col_idx: np.ndarray
    value_r: np.ndarray
    col_ptr: np.ndarray
    row_idx: np.ndarray
    value_c: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The local row of each entry in CSR order."""
        return np.repeat(np.arange(len(self.row_map)), np.diff(self.row_ptr))


def build_block(rows: np.ndarray, cols: np.ndarray, values: np.ndarray | None = None) -> SparseBlock:
    """From coordinates in any order; `values` None is a binary block. Duplicate cells stay apart."""
    values = np.ones(len(rows)) if values is None else np.asarray(values, np.float64)
    row_map, r = np.unique(rows, return_inverse=True)
    col_map, c = np.unique(cols, return_inverse=True)
    by_row, by_col = np.lexsort((c, r)), np.lexsort((r, c))
    return SparseBlock(row_map, col_map, _pointers(r, len(row_map)), c[by_row], values[by_row], _pointers(c, len(col_map)), r[by_col], values[by_col])


def _pointers(local: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(local, minlength=n))]).astype(np.int64)


def feature_major(vectors: list[tuple[np.ndarray, np.ndarray | None]]) -> SparseBlock:
    """Rows are features, columns the examples in their order."""
    sizes = [len(i) for i, _ in vectors]
    examples = np.repeat(np.arange(len(vectors)), sizes)
    features = np.concatenate([np.asarray(i, np.int64) for i, _ in vectors]) if vectors else np.empty(0, np.int64)
    values = np.concatenate([np.ones(n) if v is None else np.asarray(v, np.float64) for (_, v), n in zip(vectors, sizes)]) if vectors else np.empty(0)
    block = build_block(features, examples, values)
    # examples without features keep their place
    return SparseBlock(block.row_map, np.arange(len(vectors)), block.row_ptr, block.col_map[block.col_idx] if len(block.col_idx) else block.col_idx, block.value_r, _pointers(examples, len(vectors)), block.row_idx, block.value_c)


def squared_error(block: SparseBlock, row_factors: np.ndarray, col_factors: np.ndarray) -> float:
    """Sum of squared residuals for factors of shape (n, K); nothing is overwritten."""
    pred = np.einsum("nk,nk->n", row_factors[block.rows], col_factors[block.col_idx])
    return float(((block.value_r - pred) ** 2).sum())


@dataclass(frozen=True)
class SparseCube:
    """Sorted coordinates of a three-way block with prefix offsets of the first and inverted lists of the others."""

    maps: tuple[np.ndarray, np.ndarray, np.ndarray]
    coords: np.ndarray
    values: np.ndarray
    ptr1: np.ndarray
    inverted: tuple[list[np.ndarray], list[np.ndarray]]


def build_cube(i: np.ndarray, j: np.ndarray, k: np.ndarray, values: np.ndarray) -> SparseCube:
    maps, local = zip(*(np.unique(x, return_inverse=True) for x in (i, j, k)))
    order = np.lexsort((local[2], local[1], local[0]))
    coords = np.stack(local, 1)[order]

    def lists(d: int) -> list[np.ndarray]:
        by = np.argsort(coords[:, d], kind="stable")
        return np.split(by, np.cumsum(np.bincount(coords[:, d], minlength=len(maps[d])))[:-1])

    return SparseCube(tuple(maps), coords, np.asarray(values, np.float64)[order], _pointers(coords[:, 0], len(maps[0])), (lists(1), lists(2)))


def cube_squared_error(cube: SparseCube, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    x = cube.coords
    return float(((cube.values - (a[x[:, 0]] * b[x[:, 1]] * c[x[:, 2]]).sum(1)) ** 2).sum())


def id_position(sorted_ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted id in a sorted array, -1 where it is missing."""
    at = np.searchsorted(sorted_ids, wanted)
    at[at == len(sorted_ids)] = 0
    return np.where(sorted_ids[at] == wanted, at, -1) if len(sorted_ids) else np.full(len(wanted), -1)


def gather_factors(local_ids: np.ndarray, global_ids: np.ndarray, factors: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Rows of the global factors for the local ids; missing ids get `fill` everywhere, at the end as well."""
    at = id_position(global_ids, local_ids)
    out = np.full((len(local_ids), factors.shape[1]), fill)
    out[at >= 0] = factors[at[at >= 0]]
    return out


def jagged_rows(rows: np.ndarray, cols: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(row ids, column ids per row, values per row), rows and columns rising: rows of any length without shared arrays."""
    b = build_block(rows, cols, values)
    cut = b.row_ptr[1:-1]
    return b.row_map, np.split(b.col_map[b.col_idx] if len(b.col_idx) else b.col_idx, cut), np.split(b.value_r, cut)


def column_view(block: SparseBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column id, row id, value) of the entries column by column."""
    return np.repeat(block.col_map, np.diff(block.col_ptr)), block.row_map[block.row_idx] if len(block.row_idx) else block.row_idx, block.value_c
