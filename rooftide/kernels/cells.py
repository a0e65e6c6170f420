"""Cells of triangles, as the SQL of ``plans.surfaces.ROOF_CELLS`` defines them."""

from __future__ import annotations

import numpy as np


def ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from each ``low`` to its ``high``, and which of these each belongs to."""
    n = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n)[of] + low[of], of


def highest(t: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column, row and greatest height of the cells of triangles ``t`` (n, 3, 3), by owner, column and row, and each cell's owner.

    A row's crossings are cut to whole columns, taken two and two, and both ends are filled.
    """
    of, row, ix = [], [], []
    for k in range(3):
        (ax, ay), (bx, by) = t[:, k, :2].T, t[:, (k + 1) % 3, :2].T
        r, i = ragged(np.floor(np.minimum(ay, by)).astype(np.int64), np.ceil(np.maximum(ay, by)).astype(np.int64))
        met = ((by[i] < r) & (ay[i] >= r)) | ((ay[i] < r) & (by[i] >= r))
        r, i = r[met], i[met]
        of.append(i)
        row.append(r)
        ix.append(np.floor(bx[i] + (r - by[i]) / (ay[i] - by[i]) * (ax[i] - bx[i])).astype(np.int64))
    of, row, ix = map(np.concatenate, (of, row, ix))
    order = np.lexsort((ix, row, of))
    of, row, ix = of[order], row[order], ix[order]
    # a triangle's row is crossed twice, or not at all
    of, row, low, high = of[::2], row[::2], ix[::2], ix[1::2]
    col, span = ragged(low, high)
    of, row = of[span], row[span]
    (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = (t[of, k].T for k in range(3))
    x, y = col + 0.5, row + 0.5
    z = z0 + ((z1 - z0) * ((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0)) + (z2 - z0) * ((x1 - x0) * (y - y0) - (x - x0) * (y1 - y0))) / ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))
    own = owner[of]
    order = np.lexsort((z, row, col, own))
    own, col, row, z = own[order], col[order], row[order], z[order]
    last = np.append((own[1:] != own[:-1]) | (col[1:] != col[:-1]) | (row[1:] != row[:-1]), True) if len(own) else np.zeros(0, bool)
    return np.column_stack([col, row, z])[last], own[last]
