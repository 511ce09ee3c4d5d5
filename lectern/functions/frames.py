"""Frame metrics as column functions over row-major grids (``ARRAY<DOUBLE>``); all run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixel difference that counts as a change, bounds of a partial change, and change of a grid cell.
PIXEL_CHANGE, LEAST_CHANGE, MOST_CHANGE, CELL_CHANGE = 30, 0.02, 0.3, 0.01
EDGE_STEP = 100.0
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def dct_basis(n: int = 8) -> list[float]:
    """Rows of the orthonormal DCT-II matrix, rounded so that all engines see the same constants."""
    return [round(math.sqrt((1 if u == 0 else 2) / n) * math.cos(math.pi * (2 * x + 1) * u / (2 * n)), 12) for u in range(n) for x in range(n)]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _index(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _pick(grid: Column, places: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.get(grid, i))


def dct8(grid: Column) -> Column:
    """2-D DCT of an 8x8 grid, 64 coefficients rounded to nine places."""
    basis = F.array(*map(F.lit, dct_basis()))
    row = lambda i: F.floor(i / 8).cast("int") * 8

    def half(g: Column) -> Column:
        return F.transform(_index(64), lambda i: F.aggregate(_index(8), F.lit(0.0), lambda acc, k: acc + F.get(basis, row(i) + k) * F.get(g, k * 8 + i % 8)))

    def whole(h: Column) -> Column:
        return F.transform(_index(64), lambda i: F.round(F.aggregate(_index(8), F.lit(0.0), lambda acc, k: acc + F.get(h, row(i) + k) * F.get(basis, (i % 8) * 8 + k)), 9))

    return let(let(grid, half), whole)


def dct_bits(coefficients: Column) -> Column:
    """'0'/'1' text of 64 coefficients: above the mean of those beyond the first row and column."""

    def bits(c: Column) -> Column:
        inner = F.round(_sum(_pick(c, [u * 8 + v for u in range(1, 8) for v in range(1, 8)])) / 49, 9)
        return let(inner, lambda mean: F.array_join(F.transform(c, lambda x: F.when(x > mean, "1").otherwise("0")), ""))

    return let(coefficients, bits)


def phash_bits(grid: Column) -> Column:
    return dct_bits(dct8(grid))


def bits_to_long(bits: Column) -> Column:
    """64 characters of 0 and 1, most significant first, as a signed BIGINT."""

    def value(text: Column) -> Column:
        digits = F.transform(_index(64), lambda i: F.substring(text, i + 1, F.lit(1)).cast("long"))
        return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))

    return let(bits, value)


def phash8(grid: Column) -> Column:
    """Perceptual hash of an 8x8 grid."""
    return bits_to_long(phash_bits(grid))


def phash32_bits(grid: Column) -> Column:
    """'0'/'1' text of the 8x8 lowest frequencies of a 32x32 grid: above the mean of all but the first."""
    basis = F.array(*map(F.lit, dct_basis(32)[: 8 * 32]))

    def half(g: Column) -> Column:  # 8 rows of 32
        return F.transform(_index(256), lambda i: F.aggregate(_index(32), F.lit(0.0), lambda acc, k: acc + F.get(basis, F.floor(i / 32).cast("int") * 32 + k) * F.get(g, k * 32 + i % 32)))

    def low(h: Column) -> Column:
        return F.transform(_index(64), lambda i: F.round(F.aggregate(_index(32), F.lit(0.0), lambda acc, k: acc + F.get(h, F.floor(i / 8).cast("int") * 32 + k) * F.get(basis, (i % 8) * 32 + k)), 9))

    def bits(c: Column) -> Column:
        mean = F.round((_sum(c) - F.get(c, F.lit(0))) / 63, 9)
        return let(mean, lambda m: F.array_join(F.transform(c, lambda x: F.when(x > m, "1").otherwise("0")), ""))

    return let(let(let(grid, half), low), bits)


def resize_area(grid: Column, width: Column, height: Column, out_width: int, out_height: int) -> Column:
    """Area-mean grid of a smaller size; the source is cut at the floors of equal parts."""
    w, h = width.cast("int"), height.cast("int")
    edge = lambda k, n, size: F.floor(k * size / n).cast("int")

    def cell(g: Column, i: Column) -> Column:
        row, column = F.floor(i / out_width).cast("int"), (i % out_width).cast("int")
        top, bottom = edge(row, out_height, h), F.greatest(edge(row + 1, out_height, h), edge(row, out_height, h) + 1)
        left, right = edge(column, out_width, w), F.greatest(edge(column + 1, out_width, w), edge(column, out_width, w) + 1)
        total = F.aggregate(F.sequence(top, bottom - 1), F.lit(0.0), lambda acc, y: acc + F.aggregate(F.slice(g, y * w + left + 1, right - left), F.lit(0.0), lambda s, x: s + x))
        return total / ((bottom - top) * (right - left))

    return let(grid, lambda g: F.transform(_index(out_width * out_height), lambda i: cell(g, i)))


def dhash_bits(grid: Column, width: int = 8, height: int = 8) -> Column:
    """Row-major bits: right neighbour brighter; ``(width - 1) * height`` of them."""
    left = [r * width + c for r in range(height) for c in range(width - 1)]
    pairs = F.zip_with(_pick(grid, left), _pick(grid, [i + 1 for i in left]), lambda a, b: F.when(b > a, "1").otherwise("0"))
    return F.array_join(pairs, "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64.0


def _matches(a: Column, b: Column) -> Column:
    """Sum over all values of a of their number in b: the dot product of both histograms."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.size(F.filter(b, lambda y: y == x)))


def histogram_corr(a: Column, b: Column, bins: int = 256) -> Column:
    """Pearson correlation of the luma histograms."""
    flat = F.size(a) * F.size(b) / float(bins)
    own = lambda x: _matches(x, x) - F.size(x) * F.size(x) / float(bins)
    return F.try_divide(_matches(a, b) - flat, F.sqrt(own(a) * own(b)))


def _pairs(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, f))


def mse_similarity(a: Column, b: Column) -> Column:
    """1 - mean squared difference over 255 squared, with signed differences."""
    return 1 - _pairs(a, b, lambda x, y: (x - y) * (x - y)) / F.size(a) / 65025.0


def mean_abs_diff(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y)) / F.size(a)


def changed_ratio(a: Column, b: Column) -> Column:
    """Share of pixels that differ by more than ``PIXEL_CHANGE``."""
    return _pairs(a, b, lambda x, y: (F.abs(x - y) > PIXEL_CHANGE).cast("double")) / F.size(a)


def has_change(a: Column, b: Column) -> Column:
    ratio = changed_ratio(a, b)
    return (ratio > LEAST_CHANGE) & (ratio < MOST_CHANGE)


def grid_cells(a: Column, b: Column, width: int = 8, height: int = 8) -> Column:
    """Changed share of each of 3x3 cells (their sides are the floors of a third)."""
    w, h = width // 3, height // 3
    moved = F.zip_with(a, b, lambda x, y: (F.abs(x - y) > PIXEL_CHANGE).cast("double"))
    cells = [[(i * h + r) * width + j * w + c for r in range(h) for c in range(w)] for i in range(3) for j in range(3)]
    return F.array(*[_sum(_pick(moved, cell)) / (w * h) for cell in cells])


def grid_change(a: Column, b: Column, width: int = 8, height: int = 8, cells: int = 4) -> Column:
    """Struct of is_animation (one to ``cells`` cells changed) and the mean change of the cells."""
    shares = grid_cells(a, b, width, height)
    many = F.size(F.filter(shares, lambda c: c > CELL_CHANGE))
    return F.struct(many.between(1, cells).alias("is_animation"), (_sum(shares) / 9).alias("avg_change"))


def pixel_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of two frames."""
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    cov = _pairs(a, b, lambda x, y: x * y) / n - ma * mb
    va, vb = _pairs(a, a, lambda x, y: x * y) / n - ma * ma, _pairs(b, b, lambda x, y: x * y) / n - mb * mb
    return F.try_divide(cov, F.sqrt(va * vb))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of one tile (the whole grid)."""
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    cov = _pairs(a, b, lambda x, y: x * y) / n - ma * mb
    va, vb = _pairs(a, a, lambda x, y: x * y) / n - ma * ma, _pairs(b, b, lambda x, y: x * y) / n - mb * mb
    return (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def tiled_ssim(a: Column, b: Column, width: int, height: int, tile: int) -> Column:
    """Mean structural similarity of non-overlapping tiles; rests at the right and lower side are left out."""
    tiles = [[(r + y) * width + c + x for y in range(tile) for x in range(tile)] for r in range(0, height - tile + 1, tile) for c in range(0, width - tile + 1, tile)]
    return _sum(F.array(*[ssim(_pick(a, t), _pick(b, t)) for t in tiles])) / len(tiles)


def edge_map(grid: Column, width: int = 8, height: int = 8, step: float = EDGE_STEP) -> Column:
    """1 where the horizontal and vertical steps to the next pixels add up to more than ``step``."""
    right = [r * width + min(c + 1, width - 1) for r in range(height) for c in range(width)]
    below = [min(r + 1, height - 1) * width + c for r in range(height) for c in range(width)]
    across = F.zip_with(grid, _pick(grid, right), lambda x, y: F.abs(y - x))
    down = F.zip_with(grid, _pick(grid, below), lambda x, y: F.abs(y - x))
    return F.zip_with(across, down, lambda x, y: (x + y > step).cast("double"))


def edge_change(a: Column, b: Column, width: int = 8, height: int = 8) -> Column:
    """Share of cells whose edge bit differs."""
    return _pairs(edge_map(a, width, height), edge_map(b, width, height), lambda x, y: F.abs(x - y)) / F.size(a)


def sharpness(grid: Column, width: int = 8, height: int = 8) -> Column:
    """Variance of the 4-neighbour Laplacian; the border mirrors without repeating the edge."""
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    sides = [[mirror(r + dr, height) * width + mirror(c + dc, width) for r in range(height) for c in range(width)] for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    around = [_pick(grid, s) for s in sides]
    total = F.zip_with(F.zip_with(around[0], around[1], lambda x, y: x + y), F.zip_with(around[2], around[3], lambda x, y: x + y), lambda x, y: x + y)
    laplacian = F.zip_with(total, grid, lambda s, x: s - 4 * x)
    n = F.size(grid)
    mean = _sum(laplacian) / n
    return _sum(F.transform(laplacian, lambda x: x * x)) / n - mean * mean


def thumb_fingerprint(grid: Column) -> Column:
    """md5 of the quantised grid: equal for exact copies only."""
    return F.md5(F.array_join(F.transform(grid, lambda x: x.cast("int").cast("string")), ",").cast("binary"))
