"""Strassen's product of int64 matrices: seven products of quarters instead of eight, with exact integer additions."""

from __future__ import annotations

import numpy as np

#: A side at which a product is done directly.
LEAF = 16


def _even(m: np.ndarray) -> np.ndarray:
    """The matrix with a row and a column of zeros where its sides are odd."""
    down, right = m.shape[0] % 2, m.shape[1] % 2
    return np.pad(m, ((0, down), (0, right))) if down or right else m


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a times b. Sums of quarters may wrap around at 64 bits without harm: where the result fits in int64, it is exact."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    out = np.zeros((2 * i, 2 * k), np.int64)
    c11, c12, c21, c22 = out[:i, :k], out[:i, k:], out[i:, :k], out[i:, k:]
    for left, right, places in (
        (a11 + a22, b11 + b22, ((c11, 1), (c22, 1))),
        (a21 + a22, b11, ((c21, 1), (c22, -1))),
        (a11, b12 - b22, ((c12, 1), (c22, 1))),
        (a22, b21 - b11, ((c11, 1), (c21, 1))),
        (a11 + a12, b22, ((c11, -1), (c12, 1))),
        (a21 - a11, b11 + b12, ((c22, 1),)),
        (a12 - a22, b21 + b22, ((c11, 1),)),
    ):
        part = product(left, right, leaf)
        for quarter, sign in places:
            quarter += part if sign > 0 else -part
    return out[:rows, :columns]
