"""Token-ID output: texts become ids, overlong ones are split without loss, and best-fit-decreasing fills id matrices.

A task packs its own documents in pools of about ``POOL_TOKENS`` tokens. Segments go in by falling length, each into the
row with the least sufficient room; a segment tree over the possible rooms (0 to the row length) finds it. A packed row
is binary: ids as little-endian unsigned 32- or 16-bit integers, padded to the row length with the first id that the
vocabulary leaves free. Beside it stand the cumulative segment lengths and the positions at which position ids start anew,
and for each segment its document, a number of the document's row (repeated and null ids differ in it) and its offset there. ``write_matrices`` writes rows as files, each with an id matrix.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import batches_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The vocabulary's splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW_TOKENS = 2048
POOL_TOKENS = 1 << 20


class Rooms:
    """Segment tree over rooms 0..size: counts of open rows, and the least room of at least a given size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        heapq.heappush(self.rows.setdefault(room, []), row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row that still holds ``need``; that row leaves the tree."""
        node = need + self.leaves
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, heapq.heappop(self.rows[room])


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of segment numbers; equal lengths go in by number, equal rooms to the older row."""
    rooms, rows = Rooms(size), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = rooms.take(lengths[k])
        if found is None:
            found = size, len(rows)
            rows.append([])
        rows[found[1]].append(k)
        if found[0] > lengths[k]:
            rooms.add(found[0] - lengths[k], found[1])
    return rows


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids, for a file of ranks; texts are ordinary, special tokens in them are spelled out."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("lectern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        # a break between letter and space is one of the pattern's own, so long texts go in parts
        parts, at = [], 0
        while len(text) - at > 200_000:
            cut = next((i for i in range(at + 200_000, at + 100_000, -1) if text[i] == " " and text[i - 1].isalpha()), 0)
            if not cut:
                break
            parts.append(own.encode_ordinary(text[at:cut]))
            at = cut
        parts.append(own.encode_ordinary(text[at:]))
        return np.concatenate([np.asarray(p, np.uint32) for p in parts])

    encode.decode_bytes = own.decode_bytes
    encode.free_id = max(ranks.values(), default=-1) + 1
    return encode


_FIELDS = [
    ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_rows", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
    ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()),
]
SCHEMA = "pack_id long, n_tokens int, doc_ids array<long>, doc_rows array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"


def pack(docs: DataFrame, path: str = VOCABULARY, row_tokens: int = ROW_TOKENS, pool_tokens: int = POOL_TOKENS, width: int = 2) -> DataFrame:
    """Packed rows of the whole table; see the module. ``width`` is the bytes of an id (2 or 4).

    Raises ValueError if the vocabulary and the padding do not fit the width. Null and empty texts have no tokens and no segment. A null doc_id stays null in doc_ids. Repeated rows are packed
    each. An empty table gives no rows. A retried task packs alike: order and pools follow its input.
    """

    def rows_of(pool: list[tuple], serial: int, pad: int) -> Iterator[tuple]:
        partition = TaskContext.get().partitionId()
        for k, members in enumerate(best_fit_decreasing([len(s[3]) for s in pool], row_tokens)):
            ends = np.cumsum([len(pool[m][3]) for m in members])
            row = np.full(row_tokens, pad, f"<u{width}")
            row[: ends[-1]] = np.concatenate([pool[m][3] for m in members])
            edges = [0, *ends.tolist()]
            docs, numbers, offsets = ([pool[m][c] for m in members] for c in range(3))
            yield ((partition << 36) | (serial + k), edges[-1], docs, [(partition << 36) | n for n in numbers], offsets, edges, edges[:-1], row.tobytes())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        if encode.free_id >= 1 << 8 * width:
            raise ValueError(f"ids up to {encode.free_id} do not fit {width} bytes")

        def rows():
            pool, size, serial, number = [], 0, 0, 0
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py()) if text.is_valid else ()
                    number += 1
                    for at in range(0, len(ids), row_tokens):
                        pool.append((doc, number, at, ids[at : at + row_tokens].astype(f"<u{width}")))
                        size += len(pool[-1][3])
                        if size >= pool_tokens:
                            done = list(rows_of(pool, serial, encode.free_id))
                            yield from done
                            pool, size, serial = [], 0, serial + len(done)
            yield from rows_of(pool, serial, encode.free_id)

        yield from batches_of(rows(), pa.schema(_FIELDS), 256)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fill, SCHEMA)


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, ids) of every packed document row, whole again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("offset", pa.int64()), ("part", pa.list_(pa.int64()))])

        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    ids = np.frombuffer(r["ids"], f"<u{width}")
                    for d, n, o, a, b in zip(r["doc_ids"], r["doc_rows"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                        yield d, n, o, ids[a:b].tolist()

        yield from batches_of(rows(), schema, 256)

    parts = packed.mapInArrow(cut, "doc_id long, row long, offset long, part array<long>").groupBy("row")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])
    return parts.agg(F.max("doc_id").alias("doc_id"), F.flatten(ordered).alias("ids")).drop("row")


MATRIX_BYTES = 64 << 20
_MAGIC = b"IDMATRIX"


def matrix_file(rows: list[dict], row_tokens: int, width: int) -> bytes:
    """Magic, then as int64 the width, row length, rows and segments; the id matrix, padded to 8 bytes; per row its id and
    number of segments; per segment its end in the row, document (and whether it has one), document row and offset. Little-endian."""
    segments = [s for r in rows for s in zip(r["cu_seqlens"][1:], (d or 0 for d in r["doc_ids"]), (d is not None for d in r["doc_ids"]), r["doc_rows"], r["doc_offsets"])]
    matrix = b"".join(r["ids"] for r in rows)
    heads = np.array([width, row_tokens, len(rows), len(segments)], "<i8")
    by_row = np.array([(r["pack_id"], len(r["doc_ids"])) for r in rows], "<i8")
    return b"".join((_MAGIC, heads.tobytes(), matrix, bytes(-len(matrix) % 8), by_row.tobytes(), np.array(segments, "<i8").tobytes()))


def matrix_rows(data: bytes) -> Iterator[tuple]:
    """The packed rows of a file, as ``pack`` returns them."""
    if data[:8] != _MAGIC:
        raise ValueError("not a file of id matrices")
    width, row_tokens, n_rows, n_segments = np.frombuffer(data, "<i8", 4, 8).tolist()
    size = n_rows * row_tokens * width
    at = 40 + size + -size % 8
    by_row = np.frombuffer(data, "<i8", 2 * n_rows, at).reshape(n_rows, 2)
    segments = np.frombuffer(data, "<i8", 5 * n_segments, at + by_row.nbytes).reshape(n_segments, 5).tolist()
    done = 0
    for k, (pack_id, n) in enumerate(by_row.tolist()):
        own = segments[done : done + n]
        done += n
        edges = [0, *(s[0] for s in own)]
        ids = data[40 + k * row_tokens * width : 40 + (k + 1) * row_tokens * width]
        yield pack_id, edges[-1], [s[1] if s[2] else None for s in own], [s[3] for s in own], [s[4] for s in own], edges, edges[:-1], ids


def write_matrices(packed: DataFrame, path: str, row_tokens: int = ROW_TOKENS, width: int = 2, file_bytes: int = MATRIX_BYTES) -> None:
    """Write packed rows as files of about ``file_bytes``, readable by offset without Spark. A cast of bytes to a string
    changes nothing; the zero byte that the writer puts at the end lies behind all that the header counts."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, file_bytes // (row_tokens * width))

        def blobs():
            held = []
            for batch in batches:
                for row in batch.to_pylist():
                    held.append(row)
                    if len(held) == most:
                        yield (matrix_file(held, row_tokens, width),)
                        held = []
            if held:
                yield (matrix_file(held, row_tokens, width),)

        yield from batches_of(blobs(), pa.schema([("value", pa.binary())]), 1)

    values = packed.select(*[n for n, _ in _FIELDS]).mapInArrow(files, "value binary").select(F.col("value").cast("string"))
    values.write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\0").text(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The packed rows of all matrix files under a folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                yield from batches_of(matrix_rows(cell.as_py()), pa.schema(_FIELDS), 256)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, SCHEMA)
