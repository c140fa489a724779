"""Sparse vectors compared as blocks of matrices: what a task does with the hosts of two blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TILE = 1024
PRODUCTS = 1 << 22  # of single weights, at a time


def links(vectors: pa.ChunkedArray, q: np.ndarray, n: int, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): numbers of vectors that share a signature and whose squared distance is at most ``most``.

    The first n vectors are compared with the others or, where there are no others, with each
    other; each pair is met once. vectors: lists of (s, w); q: squared lengths. Signatures that many have on
    both sides are columns of matrices, the weights of others are multiplied one by one.
    """
    lists = vectors.combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    s, w = (lists.flatten().field(k).to_numpy() for k in (0, 1))
    s, column = np.unique(s, return_inverse=True)
    same = n == len(lists)
    m = n if same else len(lists) - n
    counts = [np.bincount(column[side], minlength=len(s)) for side in (row < n, (row < n) if same else row >= n)]
    dense = counts[0] * counts[1] * 64 > n * m
    held = dense[column]
    place = np.cumsum(dense) - 1
    matrix = np.zeros((len(lists), int(dense.sum()) + 2))
    matrix[row[held], place[column[held]]] = w[held]
    thin = ~held & ((counts[0] > 1) if same else (counts[0] > 0) & (counts[1] > 0))[column]
    order = np.flatnonzero(thin)
    order = order[np.argsort(column[order], kind="stable")]
    row, column, w = row[order], column[order], w[order]
    # the last two columns make each product less half of both squared lengths
    left, right = matrix[:n], (matrix if same else matrix[n:]).copy()
    left[:, -2], left[:, -1], right[:, -2], right[:, -1] = -q[:n] / 2, 1, 1, -q[-m:] / 2

    def tile(first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = np.flatnonzero((row >= first) & (row < min(first + TILE, end)))
        return column[mine], row[mine] - first, w[mine]

    base = 0 if same else n
    rights = {j: tile(base + j, base + m) for j in range(0, m, TILE)}
    for i in range(0, n, TILE):
        one = tile(i, n)
        for j in range(i if same else 0, m, TILE):
            product = left[i : i + TILE] @ right[j : j + TILE].T
            _add_thin(product, one, rights[j])
            hit = product >= -most / 2
            if q[:n][i : i + TILE].min() + q[-m:][j : j + TILE].min() <= most:  # so short that they are near without a common signature
                shared = (left[i : i + TILE, :-2] != 0).astype(float) @ (right[j : j + TILE, :-2] != 0).T.astype(float)
                _add_thin(shared, (*one[:2], np.ones(len(one[0]))), (*rights[j][:2], np.ones(len(rights[j][0]))))
                hit &= shared > 0
            if same and i == j:
                hit = np.triu(hit, 1)
            x, y = np.divmod(np.flatnonzero(hit), hit.shape[1])
            if len(x):
                yield x + i, y + j + base


def _add_thin(product: np.ndarray, left: tuple, right: tuple) -> None:
    """Add the products of single weights; left and right: columns in order, rows, weights."""
    low, high = (np.searchsorted(right[0], left[0], side) for side in ("left", "right"))
    n = high - low
    ends = np.cumsum(n)
    start = 0
    while start < len(n) and ends[-1]:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + PRODUCTS, "right")))
        k = np.repeat(np.arange(start, end), n[start:end])
        at = np.arange(len(k)) - (ends[k] - n[k] - base) + low[k]
        np.add.at(product.reshape(-1), left[1][k] * product.shape[1] + right[1][at], left[2][k] * right[2][at])
        start = end


def sums(x: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(x, weights=weights, minlength=n).astype(np.int64)


def merge(lead: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the groups of each x and y; lead names the smallest member of each one's group."""
    while True:
        a, b = lead[x], lead[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(lead, np.maximum(a, b), np.minimum(a, b))
        while (lead[lead] != lead).any():
            lead[:] = lead[lead]
