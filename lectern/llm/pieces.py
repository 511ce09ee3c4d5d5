"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model at hand is of the BPE kind, so its pieces' scores are merge ranks, not log-probabilities: a best-score path
over them would not be the model's encoding. The scan therefore runs over the lattice of pieces with weight 0 between
neighbours that the model's merges leave apart (the encoding of the two joined is just these two) and minus infinity
otherwise. The one path of weight 0 through a text is the model's own encoding, so the ids equal the library's.

A document over ``GIANT`` characters is cut into chunks. The states of a boundary are the pieces that can lie over the
character before it. Each chunk yields the max-plus transfer matrix from its left to its right states; matrices are
combined associatively, first within blocks of ``BLOCK`` chunks, then over the blocks of a document (a string of 2 GB
has at most 2048). The scan fixes the state at every boundary, and chunks are backtraced independently. Between a
non-space and a space no piece can reach, so only the words at a chunk's edges need the lattice; the inner part is
encoded by the library, as is every document of one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage
from .textkit import batches_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 32_768
CHUNK = 4096
BLOCK = 256
#: Texts handed to the library at once.
LISTS = 64
SPACE = "▁"
NEVER = -np.inf


class Pieces:
    """The model's pieces with its merges: neighbour test, lattice, library encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.score = {p: self.library.get_score(i) for i, p in enumerate(names) if not special[i]}
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(names) if self.library.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self._apart: dict[tuple[str, str], bool] = {}
        spelled = [p.replace(SPACE, " ").encode() for p in names]
        for value, i in self.byte.items():
            spelled[i] = bytes([value])
        for i in range(n):
            if self.library.is_control(i):
                spelled[i] = b""
        self._flat = np.frombuffer(b"".join(spelled), np.uint8)
        self._size = np.array([len(x) for x in spelled], np.int64)
        self._at = np.cumsum(self._size) - self._size

    def merge(self, text: str) -> list[str]:
        """The merges of a short string: the best-scored neighbours first, the left ones on ties."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether the merges leave these neighbours as they are."""
        if left[-1] != SPACE and right[0] == SPACE:
            return True
        found = self._apart.get((left, right))
        if found is None:
            if len(self._apart) > 500_000:
                self._apart.clear()
            found = self._apart[left, right] = self.merge(left + right) == [left, right]
        return found

    def over(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that can lie over the character before ``at``; a character without piece stands alone."""
        found = [
            (a, z)
            for a in range(max(0, at - self.longest), at)
            for z in range(at, min(len(text), a + self.longest) + 1)
            if text[a:z] in self.ids or z == a + 1
        ]
        return [x for x in found if self.merge(text[x[0] : x[1]]) == [text[x[0] : x[1]]]]

    def forward(self, text: str, entries: list[tuple[int, int]], start: int, stop: int) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Lattice from entry pieces (or from ``start`` where there are none) up to ``stop``.

        end -> [(start of the piece, weights from each entry)]; pieces start before ``stop`` and may reach beyond it.
        """
        size = max(1, len(entries))
        ends: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (a, z) in enumerate(entries):
            weight = np.full(size, NEVER)
            weight[i] = 0.0
            ends.setdefault(z, []).append((a, weight))
        for a in range(start, stop):
            before = ends.get(a, [])
            root = not entries and a == start
            if not before and not root:
                continue
            for z in range(a + 1, min(len(text), a + self.longest) + 1):
                piece = text[a:z]
                if z > a + 1 and piece not in self.ids:
                    continue
                weight = np.zeros(size) if root else np.full(size, NEVER)
                for b, w in before:
                    if self.apart(text[b:a], piece):
                        weight = np.maximum(weight, w)
                if weight.max() == 0.0 and (z == a + 1 or self.merge(piece) == [piece]):
                    ends.setdefault(z, []).append((a, weight))
        return ends

    def ids_of(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])]

    def encode_inner(self, text: str) -> list[int]:
        """Ids of a marked text that starts with a space mark (the library puts one before)."""
        return self.library.encode(text[1:].replace(SPACE, " ")) if len(text) > 1 else self.ids_of(list(text))

    def decode(self, ids) -> bytes:
        """The text's bytes; the mark that encoding put before the text is taken off."""
        ids = np.asarray(ids, np.int64)
        size = self._size[ids]
        end = np.cumsum(size)
        if not len(ids):
            return b""
        out = self._flat[np.repeat(self._at[ids] - (end - size), size) + np.arange(end[-1])].tobytes()
        return out[1:] if out[:1] == b" " else out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (left[:, :, None] + right[None]).max(axis=1)


class Chunk:
    """A chunk with its surroundings: ``text[begin:stop]`` is its own; first and last chunks have one outer state."""

    def __init__(self, model: Pieces, text: str, begin: int, stop: int):
        self.model, self.text, self.begin, self.stop = model, text, begin, stop
        self.entries = model.over(text, begin) if begin else []
        self.last = stop == len(text)
        cuts = [i for i in self._edges() if i is not None]
        self.inner = (cuts[0], cuts[1]) if len(cuts) == 2 and cuts[0] < cuts[1] else None
        self.exits = [(a, z) for a, z in model.over(text, stop) if not self.last or z == stop]

    def _edges(self) -> tuple[int | None, int | None]:
        """First and last place in the chunk where a space mark follows another character; no piece crosses it."""
        t, lo, hi = self.text, max(1, self.begin), self.stop - 1
        first = next((i for i in range(lo, hi) if t[i] == SPACE != t[i - 1]), None)
        last = next((i for i in range(hi - 1, lo - 1, -1) if t[i] == SPACE != t[i - 1]), None)
        return (0 if not self.begin else first), last

    def _column(self, ends: dict, root: bool) -> np.ndarray:
        """Weights from each entry to each exit."""
        size = 1 if root else len(self.entries)
        out = np.full((size, len(self.exits)), NEVER)
        for j, (a, z) in enumerate(self.exits):
            for b, weight in ends.get(z, ()):
                if b == a:
                    out[:, j] = np.maximum(out[:, j], weight)
        return out

    def matrix(self) -> np.ndarray:
        model = self.model
        if not self.inner:
            return self._column(model.forward(self.text, self.entries, self.begin, self.stop), not self.entries)
        first, last = self.inner
        into = np.zeros((1, 1))
        if self.entries:
            ends = model.forward(self.text, self.entries, self.begin, first)
            into = np.max([w for _, w in ends.get(first, ())] or [np.full(len(self.entries), NEVER)], axis=0)[:, None]
        return product(into, self._column(model.forward(self.text, [], last, self.stop), True))

    def _path(self, ends: dict, z: int, a: int | None, entry: tuple[int, int] | None, start: int) -> list[str]:
        """Pieces back from the one that ends at ``z`` (starting at ``a``, if given) to the entry or to ``start``."""
        out: list[str] = []
        while True:
            options = [b for b, w in ends.get(z, ()) if w.max() == 0.0 and (a is None or b == a) and (not out or self.model.apart(self.text[b:z], out[-1]))]
            if entry is not None and z == entry[1] and entry[0] in options:
                return out[::-1]
            b = options[0]
            out.append(self.text[b:z])
            z, a = b, None
            if entry is None and z == start:
                return out[::-1]

    def backtrace(self, entry: int, leave: int) -> list[int]:
        """Ids of the pieces after the entry piece up to the exit piece, which starts in this chunk."""
        model = self.model
        own = self.entries[entry] if self.entries else None
        begin, stop = self.exits[leave]
        ids: list[int] = []
        at = self.begin
        if self.inner:
            first, last = self.inner
            if own:
                ids += model.ids_of(self._path(model.forward(self.text, [own], self.begin, first), first, None, own, first)) if own[1] < first else []
            ids += model.encode_inner(self.text[first:last])
            own, at = None, last
        ends = model.forward(self.text, [own] if own else [], at, self.stop)
        return ids + model.ids_of(self._path(ends, stop, begin, own, at))


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def _chunks(text: str, reach: int, size: int) -> Iterator[tuple[int, str, int, int]]:
    """(number, surroundings, begin, stop) of the chunks of a marked text."""
    n = -(-len(text) // size)
    for k in range(n):
        a, z = k * size, min(len(text), (k + 1) * size)
        left = max(0, a - 2 * reach)
        # the surroundings end beyond the last character that a piece over the boundary can reach
        yield k, text[left : z + 2 * reach if z < len(text) else z], a - left, z - left


def between(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at the boundaries after each matrix, from a known first to a known last state."""
    ahead = [np.where(np.arange(len(matrices[0])) == entry, 0.0, NEVER)]
    for m in matrices:
        ahead.append(product(ahead[-1][None], m)[0])
    back = np.where(np.arange(matrices[-1].shape[1]) == leave, 0.0, NEVER)
    out = []
    for k in range(len(matrices), 0, -1):
        out.append(int(np.argmax(ahead[k] + back)))
        back = product(matrices[k - 1], back[:, None])[:, 0]
    return out[::-1]


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, "<i4").tobytes() + m.astype("<f4").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    rows, columns = np.frombuffer(data, "<i4", 2)
    return np.frombuffer(data, "<f4", offset=8).reshape(rows, columns).astype(float)


def encode_giants(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(key, doc_id, n_chunks, SHA-256 of the text, parts of the ids as binary) of the rows of ``docs(doc_id, text)``, all by the scan."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("text", pa.string()), ("begin", pa.int32()), ("stop", pa.int32()), ("total", pa.int32()), ("sha", pa.string())])
        model, base = pieces(path), TaskContext.get().partitionId() << 36

        def rows():
            key = base
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    whole = marked(text.as_py())
                    sha = hashlib.sha256(text.as_buffer()).hexdigest()
                    for k, part, begin, stop in _chunks(whole, model.longest, chunk):
                        yield key, doc, k, part, begin, stop, -(-len(whole) // chunk), None if k else sha
                    key += 1

        yield from batches_of(rows(), schema, 128)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("chunk", pa.int32()), ("matrix", pa.binary())])
        for batch in batches:
            rows = (
                (r["key"], r["chunk"], _pack(Chunk(pieces(path), r["text"], r["begin"], r["stop"]).matrix()))
                for r in batch.select(["key", "chunk", "text", "begin", "stop"]).to_pylist()
            )
            yield from batches_of(rows, schema, 512)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("matrix", pa.binary())])
        for batch in batches:
            rows = []
            for key, number, parts in zip(*(c.to_pylist() for c in batch.columns)):
                whole = _unpack(parts[0]["matrix"])
                for p in parts[1:]:
                    whole = product(whole, _unpack(p["matrix"]))
                rows.append((key, number, _pack(whole)))
            yield from batches_of(rows, schema, 512)

    def over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32())])
        for batch in batches:
            rows = []
            for key, parts in zip(*(c.to_pylist() for c in batch.columns)):
                matrices = [_unpack(p["matrix"]) for p in parts]
                # the last block ends in the state that is reached; only one is
                reached = matrices[0]
                for m in matrices[1:]:
                    reached = product(reached, m)
                states = [0, *between(matrices, 0, int(np.argmax(reached[0])))]
                rows += [(key, p["block"], a, z) for p, a, z in zip(parts, states, states[1:])]
            yield from batches_of(rows, schema, 512)

    def in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("chunk", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32())])
        for batch in batches:
            rows = []
            for key, parts, entry, leave in zip(*(c.to_pylist() for c in batch.columns)):
                states = [entry, *between([_unpack(p["matrix"]) for p in parts], entry, leave)]
                rows += [(key, p["chunk"], a, z) for p, a, z in zip(parts, states, states[1:])]
            yield from batches_of(rows, schema, 512)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("total", pa.int32()), ("sha", pa.string()), ("chunk", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            rows = (
                (r["key"], r["doc_id"], r["total"], r["sha"], r["chunk"],
                 np.array(Chunk(pieces(path), r["text"], r["begin"], r["stop"]).backtrace(r["entry"], r["leave"]), "<u4").tobytes())
                for r in batch.to_pylist()
            )
            yield from batches_of(rows, schema, 128)

    parts = stage(docs.mapInArrow(cut, "key long, doc_id long, chunk int, text string, begin int, stop int, total int, sha string"), "chunks")
    spread = parts.repartition("key", "chunk")
    matrices = stage(spread.mapInArrow(transfer, "key long, chunk int, matrix binary"), "transfers")
    blocks = stage(
        matrices.groupBy("key", F.expr(f"chunk div {block}").cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts")),
        "blocks",
    )
    wholes = blocks.mapInArrow(combine, "key long, block int, matrix binary").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("parts"))
    outer = wholes.mapInArrow(over_blocks, "key long, block int, entry int, leave int")
    inner = blocks.join(outer, ["key", "block"]).select("key", "parts", "entry", "leave").mapInArrow(in_block, "key long, chunk int, entry int, leave int")
    traced = parts.join(inner, ["key", "chunk"]).select("key", "doc_id", "total", "sha", "chunk", "text", "begin", "stop", "entry", "leave")
    traced = traced.mapInArrow(trace, "key long, doc_id long, total int, sha string, chunk int, ids binary")
    whole = traced.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("total").alias("n_chunks"), F.max("sha").alias("sha"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts")
    )
    return whole.select("key", "doc_id", "n_chunks", "sha", F.transform("parts", lambda p: p["ids"]).alias("parts"))


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chunks, n_tokens, ids and round_trip (decoding the ids gives the text back) of every document.

    Null and empty texts have no ids, one chunk, and round-trip to the empty text. Repeated rows are encoded each; other
    columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = "struct<ids:array<int>,round_trip:boolean>"

    def result(encoded: list[np.ndarray], same: list[bool]) -> pa.Array:
        sizes = np.cumsum([0, *map(len, encoded)])
        flat = np.concatenate([e.astype(np.int32) for e in encoded]) if encoded else np.zeros(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], names=["ids", "round_trip"])

    @F.arrow_udf(kind)
    def plain(text: pa.Array) -> pa.Array:
        model, encoded, same = pieces(path), [], []
        for at in range(0, len(text), LISTS):  # lists of Python numbers are large; few are held at a time
            values = text.slice(at, LISTS).to_pylist()
            for value, ids in zip(values, model.library.encode(values, num_threads=1)):
                encoded.append(np.asarray(ids, np.int32))
                same.append(model.decode(encoded[-1]) == value.encode())
        return result(encoded, same)

    @F.arrow_udf(kind)
    def joined(parts: pa.Array, sha: pa.Array) -> pa.Array:
        model = pieces(path)
        encoded = [np.frombuffer(b"".join(p), "<u4") for p in parts.to_pylist()]
        return result(encoded, [hashlib.sha256(model.decode(e)).hexdigest() == h for e, h in zip(encoded, sha.to_pylist())])

    small = source.where(F.length("text") <= giant)
    done = small.select("doc_id", F.lit(1).alias("n_chunks"), plain("text").alias("e"))
    giants = encode_giants(source.where(F.length("text") > giant), path, chunk)
    long = giants.select("doc_id", "n_chunks", joined("parts", "sha").alias("e"))
    both = done.select("doc_id", "n_chunks", F.col("e.ids").alias("ids"), F.col("e.round_trip").alias("round_trip"))
    return both.unionByName(long.select("doc_id", "n_chunks", F.col("e.ids").alias("ids"), F.col("e.round_trip").alias("round_trip"))).select(
        "doc_id", "n_chunks", F.size("ids").alias("n_tokens"), "ids", "round_trip"
    )
