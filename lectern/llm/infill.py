"""Fill-in-the-middle: documents cut at two hashed places, by content-defined chunks with remembered summaries.

A rolling hash cuts the bytes of a text into chunks, at places that depend on the bytes around them alone, so passages that
documents share give equal chunks. Of each chunk a bounded cache, keyed by the chunk's own bytes, remembers a boundary
summary: its code points, whether it holds a marker, and the bytes at its ends with which a marker could go on in the next
chunk. Summaries add up; the running counts say in which chunk a cut falls, and only that chunk is looked at again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slabs, texts_of

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents that can be cut, so many are; of 100 cut ones, so many put the suffix first.
RATE, SUFFIX_FIRST, SEED = 90, 20, 1
WINDOW, LEAST, MOST, MASK = 32, 64, 8192, np.uint32((1 << 10) - 1)
#: Bytes of chunks that a task remembers.
CACHE_BYTES = 32 << 20
_MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_REACH = max(map(len, _MARKERS)) - 1
_CONTINUATION = bytes(range(0x80, 0xC0))
#: A random 32-bit value for each byte, from a rule.
_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


class Summary(NamedTuple):
    """What a stretch of bytes adds: code points that begin in it, a marker inside, and its first and last bytes."""

    points: int
    marked: bool
    head: bytes
    tail: bytes

    def then(self, other: Summary) -> Summary:
        """The summary of this stretch followed by another; associative."""
        seam = self.tail + other.head
        return Summary(self.points + other.points, self.marked or other.marked or _marked(seam), (self.head + other.head)[:_REACH], (self.tail + other.tail)[-_REACH:])


NOTHING = Summary(0, False, b"", b"")


def _marked(data: bytes) -> bool:
    return any(m in data for m in _MARKERS)


def summary(chunk: bytes) -> Summary:
    return Summary(len(chunk.translate(None, _CONTINUATION)), _marked(chunk), chunk[:_REACH], chunk[-_REACH:])


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes up to each place: windows of doubled width are two of the width before."""
    out, width = _GEAR[data], 1
    while width < WINDOW:
        out[width:] += out[:-width] << np.uint32(width)
        width *= 2
    return out


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Ends of each text's chunks: after a window whose hash has ten zero bits, at least LEAST and at most MOST bytes long."""
    cuts = np.flatnonzero((rolling(np.frombuffer(b"".join(texts), np.uint8)) & MASK) == 0) + 1
    out, at = [], 0
    for text in texts:
        last, ends = 0, []
        for cut in [*(cuts[np.searchsorted(cuts, at + LEAST) : np.searchsorted(cuts, at + len(text))] - at).tolist(), len(text)]:
            while cut - last > MOST:
                last += MOST
                ends.append(last)
            if cut - last >= LEAST or cut == len(text) > last:
                ends.append(cut)
                last = cut
        out.append(ends)
        at += len(text)
    return out


class Memo:
    """Summaries by chunk, looked up by the chunk's bytes, so equal hashes of different chunks cannot be confused."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.size, self.hits = limit, {}, 0, 0

    def __call__(self, chunk: bytes) -> Summary:
        found = self.held.pop(chunk, None)
        if found is None:
            found = summary(chunk)
            self.size += len(chunk)
            while self.size > self.limit and self.held:
                oldest = next(iter(self.held))
                self.size -= len(oldest)
                del self.held[oldest]
        else:
            self.hits += 1
        self.held[chunk] = found  # used last, dropped last
        return found


class Chunked:
    """A text as chunks with running counts of code points."""

    def __init__(self, text: bytes, ends: list[int], memo: Memo):
        self.text, self.edges = text, [0, *ends]
        parts = [memo(text[a:b]) for a, b in zip(self.edges, ends)]
        whole = NOTHING
        for part in parts:
            whole = whole.then(part)
        self.points, self.marked = whole.points, whole.marked
        self.before = [0, *accumulate(p.points for p in parts)]

    def place(self, n: int) -> int:
        """The byte at which the n-th code point (from 0) begins."""
        if n >= self.points:
            return len(self.text)
        k = bisect_right(self.before, n) - 1
        chunk = np.frombuffer(self.text, np.uint8, self.edges[k + 1] - self.edges[k], self.edges[k])
        return self.edges[k] + int(np.flatnonzero((chunk & 0xC0) != 0x80)[n - self.before[k]])


def transform(text: Chunked, doc_id: str, rate: int, suffix_first: int, seed: int) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and the output's bytes."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text.points or text.marked or h3 % 100 >= rate:
        return "plain", None, None, text.text
    a, b = sorted((h1 % (text.points + 1), h2 % (text.points + 1)))
    i, j = text.place(a), text.place(b)
    prefix, middle, suffix = text.text[:i], text.text[i:j], text.text[j:]
    p, s, m = _MARKERS
    if h4 % 100 < suffix_first:
        return "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document, for training on fill-in-the-middle.

    ``n`` are the text's code points. Prefix ends after the smaller and middle after the larger of two hashed counts of code
    points. Form ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` <S>suffix<P>prefix<M>middle. Texts that are empty or hold a
    marker, and a share of the others, stay as they are (``plain``; no counts). Null texts are empty. A null doc_id hashes as
    an empty string; repeated rows are cut alike. An empty table gives no rows; extra columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            texts, names = texts_of(batch.column(2)), batch.column(1).to_pylist()
            for lo, hi in slabs(texts):
                rows = []
                for k, ends in zip(range(lo, hi), chunk_ends(texts[lo:hi])):
                    text = Chunked(texts[k], ends, memo)
                    rows.append((text.points, *transform(text, names[k], rate, suffix_first, seed)))
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    return docs.select("doc_id", name, F.col("text").cast("string")).mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form, output):
    """The text of an output column, from it and its form. Cut texts hold no markers, so the markers part them."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(cut: DataFrame) -> DataFrame:
    """Digests of outputs and of the texts rebuilt from them in place of the texts."""
    form, output = F.col("form"), F.col("output")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(form, output), 256).alias("restored_sha256"))


SQL = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM drawn),
cut AS (SELECT *, substr(x, 1, a) AS p, substr(x, a + 1, b - a) AS m, substr(x, b + 1) AS s FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM cut
"""
