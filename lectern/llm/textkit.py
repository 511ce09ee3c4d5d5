"""Vectorised word tables over byte strings, used inside Arrow batches.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which is what ``bytes.split()`` yields.
Everything works on slabs of bounded size, so memory follows the slab and the longest single text only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLAB = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def slabs(texts: list[bytes], limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("p", ())) <= n:
        size = max(n + 1, SLAB + 4096)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, U64)
            out[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(out, out=out)
            _powers[key] = out
    return _powers["p"], _powers["i"]


class Words:
    """Words of some joined texts: byte spans, the text each belongs to, and 64-bit hashes of any span."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))
        gap = _SPACE[self.bytes]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_at)
        self._sums: np.ndarray | None = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.bytes)
        p, inverse = powers(n)
        if self._sums is None:
            self._sums = np.zeros(n + 1, U64)
            np.cumsum((self.bytes.astype(U64) + U64(1)) * p[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(U64))


def pieces(text: bytes, limit: int = SLAB) -> Iterator[bytes]:
    """Cut a long text at white space, near ``limit``; words stay whole."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(s, at, at + limit) for s in (b" ", b"\n", b"\t"))
        if cut <= at:
            cut = min((c for s in (b" ", b"\n", b"\t") if (c := text.find(s, at + limit)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slab: index of its first text, word hashes, and where each text's words begin (one more at the end)."""
    for lo, hi in slabs(texts):
        parts = list(pieces(texts[lo])) if hi == lo + 1 and len(texts[lo]) > 2 * SLAB else None
        if parts:
            found = []
            for part in parts:
                words = Words([part])
                found.append(words.hashes(words.start, words.end))
            hashes = np.concatenate(found)
            yield lo, hashes, np.array([0, len(hashes)])
        else:
            words = Words(texts[lo:hi])
            yield lo, words.hashes(words.start, words.end), words.first


def shingle_sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) for every text, lower-cased A-Z; fewer words make one shingle."""
    odd = np.array([pow(_BASE, k + 2, 1 << 64) | 1 for k in range(size)], U64)
    for lo, hashes, first in word_hashes([t.lower() for t in texts]):
        n = len(hashes)
        window = np.zeros(max(0, n - size + 1), U64)
        for k in range(size):
            window += hashes[k : k + len(window)] * odd[k]
        window = mix(window)
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                own = np.sort(window[a : b - size + 1])
                yield lo + i, own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                yield lo + i, mix(np.array([(hashes[a:b] * odd[: b - a]).sum() + U64(b - a)], U64))
            else:
                yield lo + i, np.zeros(0, U64)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Pack tuples into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
