"""Metrics over windows of grids of any size, vectorised over Arrow batches: structural similarity over sliding windows,
opening and closing of change masks, connected regions and edges with two thresholds.

Grids are flat rows of ``width * height`` values. The functions on arrays take ``(n, height, width)``; the functions on
columns (``*_of``) make Arrow functions that see a batch at a time. Null grids, and grids of another size, give null.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import C1, C2, LEAST_CHANGE, MOST_CHANGE, PIXEL_CHANGE

#: Sides of the sliding window and of the opening; gradient of edges, and the one that starts an edge; width of the line
#: that text regions are looked for with, its contrast, and pixels of a region that counts.
WINDOW, KERNEL = 7, 5
EDGE_LOW, EDGE_HIGH = 50.0, 150.0
TEXT_WIDTH, TEXT_CONTRAST, TEXT_AREA = 10, 30.0, 100
#: Values of a slice of a batch.
_SLICE = 1 << 20


def shape_of(size: int, shape: tuple[int, int] | None) -> tuple[int, int]:
    """Width and height; without them a grid is square."""
    width, height = shape or (isqrt(size), isqrt(size))
    if width * height != size:
        raise ValueError(f"a grid of {size} values is not {width} wide and {height} high; give its shape")
    return width, height


def _box_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sums of all size x size windows that lie within, from a summed-area table."""
    table = np.zeros((x.shape[0], x.shape[1] + 1, x.shape[2] + 1))
    np.cumsum(np.cumsum(x, axis=1), axis=2, out=table[:, 1:, 1:])
    return table[:, size:, size:] - table[:, :-size, size:] - table[:, size:, :-size] + table[:, :-size, :-size]


def window_ssim(a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean structural similarity of all windows within the grid, with sample covariance. A grid smaller than the window is one window."""
    size = min(window, a.shape[1], a.shape[2])
    n = size * size
    ma, mb = _box_sums(a, size) / n, _box_sums(b, size) / n
    sample = n / max(1, n - 1)
    va = (_box_sums(a * a, size) / n - ma * ma) * sample
    vb = (_box_sums(b * b, size) / n - mb * mb) * sample
    cov = (_box_sums(a * b, size) / n - ma * mb) * sample
    score = (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
    return score.mean(axis=(1, 2))


def _running(x: np.ndarray, size: int, axis: int, op, before: int) -> np.ndarray:
    """Maximum or minimum of ``size`` neighbours from ``before`` ahead on, those within the grid, by doubling widths."""
    fill = -np.inf if op is np.maximum else np.inf
    pad = [(0, 0)] * x.ndim
    pad[axis] = (before, size - 1 - before)
    out = np.pad(x.astype(float), pad, constant_values=fill)
    width, length = 1, x.shape[axis]
    cut = lambda y, start, n: np.take(y, range(start, start + n), axis=axis)
    while width < size:
        step = min(width, size - width)
        n = out.shape[axis] - step
        out = op(cut(out, 0, n), cut(out, step, n))
        width += step
    return cut(out, 0, length)


def dilate(x: np.ndarray, width: int = KERNEL, height: int = KERNEL) -> np.ndarray:
    return _running(_running(x, width, 2, np.maximum, width // 2), height, 1, np.maximum, height // 2)


def erode(x: np.ndarray, width: int = KERNEL, height: int = KERNEL) -> np.ndarray:
    return _running(_running(x, width, 2, np.minimum, width // 2), height, 1, np.minimum, height // 2)


def opened_change(a: np.ndarray, b: np.ndarray, kernel: int = KERNEL) -> np.ndarray:
    """Share of pixels that differ by more than ``PIXEL_CHANGE``, after closing and then opening their mask."""
    mask = (np.abs(a - b) > PIXEL_CHANGE).astype(float)
    closed = erode(dilate(mask, kernel, kernel), kernel, kernel)
    return dilate(erode(closed, kernel, kernel), kernel, kernel).mean(axis=(1, 2))


def labels(mask: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of the regions of one mask, 0 elsewhere; pixels touch also at corners. Two passes: runs of a row
    join the runs above that they touch (union-find), then every run takes its root's number."""
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    rows, starts = np.nonzero(step == 1)
    _, ends = np.nonzero(step == -1)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(height + 1)).tolist()
    begin, end = starts.tolist(), ends.tolist()
    for y in range(1, height):
        i, above = first[y], first[y - 1]
        while i < first[y + 1] and above < first[y]:
            if begin[i] <= end[above] and begin[above] <= end[i]:
                x, z = root(i), root(above)
                parent[max(x, z)] = min(x, z)
            if end[i] < end[above]:
                i += 1
            else:
                above += 1
    roots = np.array([root(i) for i in range(len(rows))], np.int64)
    _, number = np.unique(roots, return_inverse=True)
    out = np.zeros((height, width), np.int64)
    for y, a, z, n in zip(rows.tolist(), begin, end, number.tolist()):
        out[y, a:z] = n + 1
    return out


def regions(mask: np.ndarray, least: int = 0) -> int:
    """Regions of more than ``least`` pixels."""
    return int((np.bincount(labels(mask).ravel())[1:] > least).sum())


def _neighbours(g: np.ndarray) -> np.ndarray:
    """The grids with a border that repeats the outermost values."""
    return np.pad(g, [(0, 0), (1, 1), (1, 1)], mode="edge")


def edges(g: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Masks of edges: pixels whose gradient (3x3, both directions added up) is over ``low``, in regions that reach over ``high`` somewhere."""
    p = _neighbours(g)
    across = (p[:, :-2, 2:] + 2 * p[:, 1:-1, 2:] + p[:, 2:, 2:]) - (p[:, :-2, :-2] + 2 * p[:, 1:-1, :-2] + p[:, 2:, :-2])
    down = (p[:, 2:, :-2] + 2 * p[:, 2:, 1:-1] + p[:, 2:, 2:]) - (p[:, :-2, :-2] + 2 * p[:, :-2, 1:-1] + p[:, :-2, 2:])
    slope = np.abs(across) + np.abs(down)
    out = np.zeros(g.shape, bool)
    for k, own in enumerate(slope):
        number = labels(own > low)
        reached = np.unique(number[own > high])
        out[k] = np.isin(number, reached[reached > 0])
    return out


def text_regions(g: np.ndarray, area: int = TEXT_AREA) -> np.ndarray:
    """How many regions of each grid have contrast along a horizontal line and more than ``area`` pixels. Regions are counted
    by their pixels, and those inside another one too."""
    contrast = dilate(g, TEXT_WIDTH, 1) - erode(g, TEXT_WIDTH, 1) > TEXT_CONTRAST
    return np.array([regions(m, area) for m in contrast], np.int64)


def edge_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One less the share of pixels that are an edge in one grid only."""
    return 1 - (edges(a) != edges(b)).mean(axis=(1, 2))


def _over_batches(f, result: pa.DataType, shape: tuple[int, int] | None, *grids: Column) -> Column:
    """An Arrow function of grid columns; ``f`` takes arrays of equal shape and gives a value for each grid."""

    def run(*columns: pa.Array) -> pa.Array:
        lists = [c.cast(pa.list_(pa.float64())) for c in columns]
        lengths = np.stack([np.where(c.is_valid(), pa.compute.fill_null(pa.compute.list_value_length(c), -1), -1) for c in lists]).astype(np.int64)
        out: list = [None] * len(lists[0])
        for size in np.unique(lengths[0][lengths[0] > 0]).tolist():
            if shape and shape[0] * shape[1] != size or not shape and isqrt(size) ** 2 != size:
                continue
            width, height = shape_of(size, shape)
            rows = np.flatnonzero((lengths == size).all(axis=0))
            for at in range(0, len(rows), max(1, _SLICE // size)):
                own = rows[at : at + max(1, _SLICE // size)]
                values = [c.take(pa.array(own)).flatten() for c in lists]
                whole = np.ones(len(own), bool)
                for v in values:
                    whole &= ~np.isnan(v.to_numpy(zero_copy_only=False).reshape(len(own), -1)).any(axis=1)
                found = f(*[v.to_numpy(zero_copy_only=False).reshape(len(own), height, width) for v in values])
                for i, x, ok in zip(own.tolist(), found.tolist(), whole.tolist()):
                    out[i] = x if ok else None
        return pa.array(out, result)

    # the types of the arguments say that it is an Arrow function
    if len(grids) == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        return F.arrow_udf(one, "long" if pa.types.is_integer(result) else "double")(*grids)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return F.arrow_udf(two, "long" if pa.types.is_integer(result) else "double")(*grids)


def window_ssim_of(a: Column, b: Column, shape: tuple[int, int] | None = None, window: int = WINDOW) -> Column:
    """Structural similarity of two grid columns over sliding windows."""
    return _over_batches(lambda x, y: window_ssim(x, y, window), pa.float64(), shape, a, b)


def opened_change_of(a: Column, b: Column, shape: tuple[int, int] | None = None, kernel: int = KERNEL) -> Column:
    """Changed share of two grid columns, after closing and opening."""
    return _over_batches(lambda x, y: opened_change(x, y, kernel), pa.float64(), shape, a, b)


def has_opened_change(a: Column, b: Column, shape: tuple[int, int] | None = None, kernel: int = KERNEL) -> Column:
    ratio = opened_change_of(a, b, shape, kernel)
    return (ratio > LEAST_CHANGE) & (ratio < MOST_CHANGE)


def text_regions_of(grid: Column, shape: tuple[int, int] | None = None, area: int = TEXT_AREA) -> Column:
    return _over_batches(lambda x: text_regions(x, area), pa.int64(), shape, grid)


def edge_similarity_of(a: Column, b: Column, shape: tuple[int, int] | None = None) -> Column:
    """Likeness of the edges (two thresholds) of two grid columns."""
    return _over_batches(edge_similarity, pa.float64(), shape, a, b)
