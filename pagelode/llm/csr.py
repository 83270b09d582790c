"""Sparse matrices by rows, multiplied row by row (Gustavson)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Csr(NamedTuple):
    """Row ``i`` has the columns ``indices[indptr[i]:indptr[i + 1]]`` with the values ``data`` there."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        """The row of each stored value."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + lengths[i] - 1``, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def tiles(lengths: np.ndarray) -> Csr:
    """Rows that tile the columns: row ``i`` has ones in the next ``lengths[i]`` columns."""
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    size = int(indptr[-1])
    return Csr(indptr, np.arange(size), np.ones(size, np.int64), size)


def transpose(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))]).astype(np.int64)
    return Csr(indptr, m.row_of()[order], m.data[order], m.rows)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Terms of each row of ``a @ b`` before equal columns are added: the symbolic phase, nothing is built."""
    terms = np.concatenate([[0], np.cumsum(b.indptr[a.indices + 1] - b.indptr[a.indices])])
    return terms[a.indptr[1:]] - terms[a.indptr[:-1]]


def product(a: Csr, b: Csr) -> Csr:
    """``a @ b``: row ``i`` is the sum of the rows ``k`` of ``b``, weighed by ``a[i, k]``; columns in order."""
    starts, lengths = b.indptr[a.indices], b.indptr[a.indices + 1] - b.indptr[a.indices]
    taken = ranges(starts, lengths)
    cell = np.repeat(a.row_of(), lengths) * b.columns + b.indices[taken]
    value = np.repeat(a.data, lengths) * b.data[taken]
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    row = cell[first] // max(b.columns, 1)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=a.rows))]).astype(np.int64)
    return Csr(indptr, cell[first] % max(b.columns, 1), np.add.reduceat(value, first) if len(first) else value, b.columns)
