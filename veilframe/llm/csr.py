"""Compressed sparse rows, built by hand, and Gustavson's row product over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from veilframe.llm.flat import stretches

STRIP_WORK = 1 << 21


@dataclass
class Csr:
    """Row k has the entries ``columns[begins[k]:begins[k + 1]]`` with their ``values``."""

    begins: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.begins) - 1

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.begins))


def incidence(begins: np.ndarray, columns: np.ndarray, width: int) -> Csr:
    """A matrix of ones, which take no space."""
    return Csr(begins, columns, np.broadcast_to(np.int64(1), len(columns)), width)


def combined(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in row and column order, those of one place added up."""
    if not len(rows):
        return rows, columns, values
    key = rows * width + columns
    if np.any(key[1:] <= key[:-1]):
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, values = key[first], np.add.reduceat(values, first)
    return key // width, key % width, values


def from_entries(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int) -> Csr:
    rows, columns, values = combined(rows, columns, values, width)
    return Csr(np.searchsorted(rows, np.arange(height + 1)), columns, values, width)


def product(a: Csr, b: Csr, strip_work: int = STRIP_WORK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries of ``a b``, strip by strip of rows, each strip combined.

    Row i of the product is the sum of b's rows at i's entries.  A strip has as many rows as make about
    ``strip_work`` single products, one row at least, so the space needed is bounded by that and the longest row.
    """
    lengths = np.diff(b.begins)[a.columns]
    work = np.concatenate([[0], np.cumsum(lengths)])[a.begins]
    numbers = a.row_numbers()
    row = 0
    while row < a.rows:
        after = max(row + 1, int(np.searchsorted(work, work[row] + strip_work, "right")) - 1)
        entries = slice(int(a.begins[row]), int(a.begins[after]))
        places = stretches(b.begins[a.columns[entries]], lengths[entries])
        yield combined(
            np.repeat(numbers[entries], lengths[entries]), b.columns[places],
            np.repeat(a.values[entries], lengths[entries]) * b.values[places], b.width)
        row = after


def times_vector(a: Csr, vector: np.ndarray) -> np.ndarray:
    """``a`` times a vector of whole numbers, exactly."""
    total = np.concatenate([[0], np.cumsum(a.values * vector[a.columns])])
    return np.diff(total[a.begins])
