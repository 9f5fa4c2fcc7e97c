"""Sparse matrices by rows in numpy arrays, and their product row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EXPANDED = 1 << 22  # terms of a product that are held at once


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def bounds_of(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


@dataclass
class Csr:
    """Row r has `values` in `columns`, at places bounds[r] to bounds[r + 1]; columns ascend in a row."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        return Csr(
            bounds_of(np.bincount(self.columns, minlength=self.width)),
            self.row_of_entry()[order],
            self.values[order],
            self.rows,
        )


def from_entries(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, width: int) -> Csr:
    """The matrix with the sums of the values given for each place."""
    key = rows * width + columns
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    summed = np.add.reduceat(values, first) if len(first) else values
    key = key[first]
    return Csr(bounds_of(np.bincount(key // max(width, 1), minlength=n_rows)), key % max(width, 1), summed, width)


def product(a: Csr, b: Csr) -> Csr:
    """a · b: row r is the sum of the rows of b that row r of a names, times its values there.

    Rows are taken in runs with at most EXPANDED terms (a longer row comes alone).
    """
    sizes = np.diff(b.bounds)[a.columns]
    terms = bounds_of(sizes)[a.bounds]
    found, row = [], 0
    while row < a.rows:
        end = max(row + 1, int(np.searchsorted(terms, terms[row] + EXPANDED, side="right")) - 1)
        held = slice(a.bounds[row], a.bounds[end])
        at = ragged(b.bounds[a.columns[held]], sizes[held])
        owner = np.repeat(np.repeat(np.arange(end - row), np.diff(a.bounds[row : end + 1])), sizes[held])
        values = np.repeat(a.values[held], sizes[held]) * b.values[at]
        found.append(from_entries(owner, b.columns[at], values, end - row, b.width))
        row = end
    if not found:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), b.width)
    return Csr(
        bounds_of(np.concatenate([np.diff(m.bounds) for m in found])),
        np.concatenate([m.columns for m in found]),
        np.concatenate([m.values for m in found]),
        b.width,
    )
