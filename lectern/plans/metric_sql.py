"""DuckDB texts of the frame metrics and of folds, for the queries' SQL."""

from __future__ import annotations

from ..functions import frames as M


def total(body: str, n: int = 64) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {body}))"


def mse(a: str, b: str) -> str:
    return f"(1 - {total(f'({a}[i] - {b}[i]) * ({a}[i] - {b}[i])')} / 64 / 65025.0)"


def mad(a: str, b: str) -> str:
    return f"({total(f'abs({a}[i] - {b}[i])')} / 64)"


def changed(a: str, b: str) -> str:
    return f"({total(f'CASE WHEN abs({a}[i] - {b}[i]) > {M.PIXEL_CHANGE} THEN 1.0::DOUBLE ELSE 0.0 END')} / 64)"


def has_change(a: str, b: str) -> str:
    return f"({changed(a, b)} > {M.LEAST_CHANGE} AND {changed(a, b)} < {M.MOST_CHANGE})"


def cell(a: str, b: str, k: str) -> str:
    """Changed share of grid cell ``k`` (0..8) of 2x2 pixels."""
    at = f"((({k} // 3) * 2 + (p // 2)) * 8 + ({k} % 3) * 2 + p % 2 + 1)"
    return f"(list_sum(list_transform(range(0, 4), lambda p: CASE WHEN abs({a}[{at}] - {b}[{at}]) > {M.PIXEL_CHANGE} THEN 1.0::DOUBLE ELSE 0.0 END)) / 4)"


def is_animation(a: str, b: str, cells: int = 4) -> str:
    return f"(len(list_filter(range(0, 9), lambda k: {cell(a, b, 'k')} > {M.CELL_CHANGE})) BETWEEN 1 AND {cells})"


def corr(a: str, b: str) -> str:
    ma, mb = f"({total(f'{a}[i]')} / 64)", f"({total(f'{b}[i]')} / 64)"
    cov = f"({total(f'{a}[i] * {b}[i]')} / 64 - {ma} * {mb})"
    va, vb = (f"({total(f'{x}[i] * {x}[i]')} / 64 - {m} * {m})" for x, m in ((a, ma), (b, mb)))
    return f"({cov} / nullif(sqrt({va} * {vb}), 0))"


def ssim(a: str, b: str) -> str:
    ma, mb = f"({total(f'{a}[i]')} / 64)", f"({total(f'{b}[i]')} / 64)"
    cov = f"({total(f'{a}[i] * {b}[i]')} / 64 - {ma} * {mb})"
    va, vb = (f"({total(f'{x}[i] * {x}[i]')} / 64 - {m} * {m})" for x, m in ((a, ma), (b, mb)))
    return f"((2 * {ma} * {mb} + {M.C1!r}) * (2 * {cov} + {M.C2!r}) / (({ma} * {ma} + {mb} * {mb} + {M.C1!r}) * ({va} + {vb} + {M.C2!r})))"


def edge(a: str, i: str) -> str:
    """Edge bit of pixel ``i`` (1..64)."""
    right = f"{a}[CASE WHEN ({i} - 1) % 8 = 7 THEN {i} ELSE {i} + 1 END]"
    below = f"{a}[CASE WHEN {i} > 56 THEN {i} ELSE {i} + 8 END]"
    return f"(abs({right} - {a}[{i}]) + abs({below} - {a}[{i}]) > {M.EDGE_STEP})"


def edge_change(a: str, b: str) -> str:
    return f"({total(f'CASE WHEN {edge(a, 'i')} <> {edge(b, 'i')} THEN 1.0::DOUBLE ELSE 0.0 END')} / 64)"


def histogram_corr(a: str, b: str) -> str:
    def dot(x: str, y: str) -> str:
        return f"({total(f'len(list_filter({y}, lambda v: v = {x}[i]))')} - 16.0::DOUBLE)"

    return f"({dot(a, b)} / nullif(sqrt({dot(a, a)} * {dot(b, b)}), 0))"


def hamming(a: str, b: str) -> str:
    return f"bit_count(xor({a}::BIT, {b}::BIT))"


def fold(source: str, key: str, order: str, columns: dict[str, str], accept: str) -> str:
    """Subquery (key, order): rows that ``accept`` takes; in it ``L`` is the last accepted row, ``X`` the row, ``acc``
    all accepted ones (the first element is a blank with order -1)."""
    item = ", ".join(f"{c}: {c}" for c in columns)
    blank = ", ".join(f"{c}: NULL::{t}" for c, t in columns.items())
    body = accept.replace("L.", "acc[-1].").replace("X.", "x[1].")
    return f"""(SELECT {key}, unnest(list_transform(list_filter(kept, lambda k: k.{order} >= 0), lambda k: k.{order})) AS {order} FROM (
      SELECT {key}, list_reduce(list_concat([[{{{order}: (-1)::BIGINT, {blank}}}]], items), lambda acc, x: CASE WHEN {body} THEN list_concat(acc, x) ELSE acc END) AS kept
      FROM (SELECT {key}, list([{{{order}: {order}::BIGINT, {item}}}] ORDER BY {order}) AS items FROM {source} GROUP BY {key})))"""
