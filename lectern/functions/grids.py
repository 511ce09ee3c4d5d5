"""Numpy twins of the frame metrics in ``frames``, for folds that see one pair of grids at a time.

Grids are flat float64 arrays, row by row. Sums of whole luma values are exact, so both forms give the same doubles.
"""

from __future__ import annotations

import numpy as np

from .frames import C1, C2, CELL_CHANGE, EDGE_STEP, PIXEL_CHANGE


def _moments(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float, float]:
    """Means, covariance and variances."""
    n = len(a)
    ma, mb = a.sum() / n, b.sum() / n
    return ma, mb, (a * b).sum() / n - ma * mb, (a * a).sum() / n - ma * ma, (b * b).sum() / n - mb * mb


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    ma, mb, cov, va, vb = _moments(a, b)
    return (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def pixel_corr(a: np.ndarray, b: np.ndarray) -> float | None:
    """None for a flat grid."""
    _, _, cov, va, vb = _moments(a, b)
    spread = np.sqrt(va * vb)
    return cov / spread if spread else None


def mse_similarity(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - ((a - b) * (a - b)).sum() / len(a) / 65025.0


def mean_abs_diff(a: np.ndarray, b: np.ndarray) -> float:
    return np.abs(a - b).sum() / len(a)


def _edges(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    g = grid.reshape(height, width)
    across = np.abs(np.diff(g, axis=1, append=g[:, -1:]))
    down = np.abs(np.diff(g, axis=0, append=g[-1:]))
    return across + down > EDGE_STEP


def edge_change(a: np.ndarray, b: np.ndarray, width: int = 8, height: int = 8) -> float:
    return float((_edges(a, width, height) != _edges(b, width, height)).sum()) / len(a)


def changed_cells(a: np.ndarray, b: np.ndarray, width: int = 8, height: int = 8) -> int:
    """How many of 3x3 cells (their sides are the floors of a third) changed."""
    w, h = width // 3, height // 3
    moved = (np.abs(a - b) > PIXEL_CHANGE).reshape(height, width)[: 3 * h, : 3 * w]
    return int((moved.reshape(3, h, 3, w).sum(axis=(1, 3)) / (w * h) > CELL_CHANGE).sum())
