"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap verification.

The items are the indexed side; every training passage is a query. Items fall into classes by length (up to 64 words, 128,
256 and so on); a passage of a class is a window of twice that length, stepping half of it, so that some window holds any
copied item of the class whole, whatever other items there are. Impacts are BM25 scores over the item's score for itself,
so one threshold fits all items.

The index of a class is postings by term (item, impact), cut at the same item blocks for all terms, with the largest impact
of each term and of each of its blocks. A batch of passages walks it as block-max WAND does. The terms of a passage are
sorted by their largest impact; up to the pivot, where these add up to a share of the threshold, terms alone find nothing. Only
blocks that the terms from the pivot on reach are looked at: first with the block maxima of these terms and the sum of the
others, then with all block maxima; blocks whose bound stays below the threshold are skipped, the others are scored in
full. Bounds are never below the scores, so everything over the threshold is found. Each hit is verified: the words of
the item's question (all sentences but the last) and of its answer (the last) must recur in the passage: as runs, or in
order with few edits, for which a short part is widened to ``WIDE`` words, so that edits of a short answer hide no copy.

The index is broadcast, in shards of at most ``SHARD_BYTES`` of item text (an index takes about ten times that); a
benchmark that fits one shard, some hundred thousand items, is searched in one read of the corpus, a larger one in a read
for each shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage, with_row_key
from .textkit import U64, batches_of, mix, texts_of, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
RUN = 3
#: Least words of a part that is compared by edits; items of less than two runs are compared by runs alone.
WIDE = 12
BLOCK = 8
MIN_WINDOW = 64
SLOT_BITS = 18
#: Bytes of item texts in one shard.
SHARD_BYTES = 32 << 20
#: (passage, block) cells looked at together.
CELLS = 1 << 20
#: The terms before the pivot add up to less than this share of the threshold.
PIVOT = 0.3
#: Sums of bounds are compared with a margin for rounding.
_ROUNDING = 1e-5
_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def normal(text: bytes) -> bytes:
    """Lower-cased text without punctuation at word ends, so that formatting does not hide a copy."""
    if text.isascii():
        return text.lower().translate(_PLAIN)
    return _SPACELESS.sub(_pairs, text.decode("utf-8", "replace").lower()).encode().translate(_PLAIN)


_PLAIN = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


# Blocks of scripts that are written without spaces (Thai to Tibetan, Myanmar, Khmer, Kana, Han).
_SPACELESS = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def _pairs(run: re.Match) -> str:
    """A run of such characters as words: its pairs of neighbours."""
    text = run[0]
    return f" {' '.join(text[k : k + 2] for k in range(max(1, len(text) - 1)))} "


def parts_of(text: bytes, least: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of (question, answer): the last sentence is the answer, a single sentence is cut in the middle. Each
    part has at least ``least`` words, taken from its neighbour if need be."""
    whole = hashes_of(text)
    pieces = [p for p in _SENTENCE.split(text) if normal(p).strip()]
    answer = len(hashes_of(pieces[-1])) if len(pieces) > 1 else len(whole) // 2
    return whole[: max(len(whole) - answer, least)], whole[-max(answer, least) :]


def hashes_of(text: bytes) -> np.ndarray:
    return np.concatenate([h for _, h, _ in word_hashes([normal(text)])])


def runs(hashes: np.ndarray, n: int = RUN) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words."""
    if not 0 < n <= len(hashes):
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        out = out * U64(0x100000001B3) + hashes[k : k + len(out)]
    return np.unique(mix(out))


def in_order(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the words of a part that is left by the fewest word edits from some stretch of the passage; 0 for less
    than two runs of words and where too few of the words occur for ``OVERLAP``."""
    if len(part) < 2 * RUN or np.isin(part, passage).mean() < OVERLAP:
        return 0.0
    at = np.arange(len(passage) + 1)
    cost = np.zeros(len(passage) + 1, np.int64)
    for word in part:
        new = cost + 1
        np.minimum(new[1:], cost[:-1] + (passage != word), out=new[1:])
        cost = np.minimum.accumulate(new - at) + at
    return 1 - int(cost.min()) / len(part)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start..start+size-1 of all ranges in turn, and the number of the range of each."""
    owner = np.repeat(np.arange(len(size)), size)
    return start[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner], owner


class Postings:
    """Block-max index of the items of one length class: postings and blocks by term, as offsets into flat arrays."""

    def __init__(self, width: int, items: list[int], term: np.ndarray, item: np.ndarray, impact: np.ndarray, n_terms: int):
        """``items`` are numbers in the whole index; (term, item) pairs are distinct, ``item`` counts within this class."""
        self.width, self.items = width, np.array(items, np.int64)
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order].astype(np.int32), impact[order].astype(np.float32)
        block = self.item // BLOCK
        edge = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        #: blocks of term t are first[t]..first[t + 1] - 1; the postings of block k are at[k]..at[k + 1] - 1
        self.first = np.searchsorted(term[edge], np.arange(n_terms + 1)).astype(np.int64)
        self.at = np.append(edge, len(term)).astype(np.int64)
        self.block = block[edge].astype(np.int64)
        self.block_max = np.maximum.reduceat(self.impact, edge) if len(edge) else np.zeros(0, np.float32)
        self.n_blocks = int(self.block.max(initial=0)) + 1
        self.key = term[edge].astype(np.int64) * self.n_blocks + self.block
        self.term_max = np.zeros(n_terms, np.float32)
        np.maximum.at(self.term_max, term, self.impact)

    def bytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def search(self, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item, score) for all scores from the threshold on; (window, term) are sorted and distinct."""
        own = self.term_max[term] > 0
        window, term = window[own], term[own]
        if not len(window):
            return
        start = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        size = np.diff(np.append(start, len(window)))
        bound = np.add.reduceat(self.term_max[term].astype(np.float64), start)
        open_ = np.flatnonzero(bound >= THRESHOLD - _ROUNDING)
        # windows together as long as their cells are within the bound; one window is always taken
        cells = np.maximum(np.add.reduceat(self.first[term + 1] - self.first[term], start)[open_], self.n_blocks)
        group = np.cumsum(cells) // CELLS
        for part in np.split(open_, np.flatnonzero(np.diff(group)) + 1) if len(open_) else []:
            yield from self._walk(window[start[part]], start[part], size[part], term)

    def _walk(self, name: np.ndarray, start: np.ndarray, size: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        at, owner = _spread(start, size)
        held = term[at]
        best = self.term_max[held].astype(np.float64)
        order = np.lexsort((best, owner))
        held, best, owner = held[order], best[order], owner[order]
        total = np.cumsum(best)
        begin = np.cumsum(size) - size
        before = np.where(begin > 0, total[begin - 1], 0)
        essential = total - before[owner] >= PIVOT * THRESHOLD  # the pivot term and those after it
        rest = np.zeros(len(size))
        np.add.at(rest, owner[~essential], best[~essential])
        # block maxima of the essential terms, the others at their largest
        k, of = _spread(self.first[held[essential]], (self.first[held + 1] - self.first[held])[essential])
        cell = owner[essential][of] * self.n_blocks + self.block[k]
        bound = np.bincount(cell, self.block_max[k], len(size) * self.n_blocks).reshape(len(size), -1)
        live = np.flatnonzero((bound > 0) & (bound + rest[:, None] >= THRESHOLD - _ROUNDING))
        if not len(live):
            return
        # all terms with the maxima of the live blocks
        w = live // self.n_blocks
        at, cell_of = _spread(begin[w], size[w])
        place, found = self._find(held[at], (live % self.n_blocks)[cell_of])
        cell_of, place = cell_of[found], place[found]
        bound = np.bincount(cell_of, self.block_max[place], len(live))
        keep = bound[cell_of] >= THRESHOLD - _ROUNDING
        cell_of, place = cell_of[keep], place[keep]
        # full scores of what is left
        p, of = _spread(self.at[place], self.at[place + 1] - self.at[place])
        score = np.bincount(cell_of[of] * BLOCK + self.item[p] % BLOCK, self.impact[p], len(live) * BLOCK)
        for j in np.flatnonzero(score >= THRESHOLD):
            block = live[j // BLOCK] % self.n_blocks
            yield int(name[w[j // BLOCK]]), int(self.items[block * BLOCK + j % BLOCK]), float(score[j])

    def _find(self, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of (term, block) among all blocks, and which of them there are."""
        want = term.astype(np.int64) * self.n_blocks + block
        place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return place, self.key[place] == want


class Index:
    """The items of a shard: terms, postings by length class, and what verification needs."""

    def __init__(self, items: list[tuple[int, bytes]], idf: dict[int, float], mean_length: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        words = [hashes_of(t) for _, t in items]
        self.terms = np.unique(np.concatenate(words)) if words else np.zeros(0, U64)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w):
                classes.setdefault(max(MIN_WINDOW, 1 << (len(w) - 1).bit_length()), []).append(k)
        self.classes = []
        for width, members in sorted(classes.items()):
            rows = []
            for number, k in enumerate(members):
                own, tf = np.unique(words[k], return_counts=True)
                weight = np.array([idf.get(int(h), 0.0) for h in own.view(np.int64)])
                score = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[k]) / mean_length))
                if score.sum() > 0:
                    rows.append((np.searchsorted(self.terms, own), np.full(len(own), number), score / score.sum()))
            columns = [np.concatenate(c) for c in zip(*rows)] or [np.zeros(0, np.int64)] * 3
            self.classes.append(Postings(width, members, *columns, len(self.terms)))
        slots = (self.terms >> U64(64 - SLOT_BITS)).astype(np.int64)
        self.slot_term = np.zeros(1 << SLOT_BITS, np.int32)
        self.slot_term[slots] = np.arange(len(slots))
        self.crowded = np.bincount(slots, minlength=1 << SLOT_BITS) > 1
        self.run = [min(RUN, len(w)) for w in words]
        self.texts = [t for _, t in items]
        self._kept: dict[tuple[int, bool], tuple] = {}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of every word hash, -1 for words that no item has."""
        slots = (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_term[slots]
        shared = np.flatnonzero(self.crowded[slots])
        out[shared] = np.minimum(np.searchsorted(self.terms, hashes[shared]), len(self.terms) - 1)
        return np.where(self.terms[out] == hashes, out, -1)

    def _parts(self, k: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """Question and answer of an item: runs of words, or with ``wide`` the words themselves; kept once computed."""
        if (k, wide) not in self._kept:
            n = self.run[k]
            self._kept[k, wide] = parts_of(self.texts[k], WIDE) if wide else tuple(runs(p, n) for p in parts_of(self.texts[k]))
        return self._kept[k, wide]

    def __getstate__(self):
        return self.__dict__ | {"_kept": {}}

    def overlaps(self, k: int, passage: np.ndarray, seen: dict[int, np.ndarray]) -> tuple[float, float]:
        """Question and answer overlap of an item with a passage; ``seen`` keeps the passage's runs by length."""
        n = self.run[k]
        if n not in seen:
            seen[n] = runs(passage, n)
        q, a = (float(np.isin(p, seen[n]).mean()) for p in self._parts(k, False))
        if q < OVERLAP:
            q = max(q, in_order(self._parts(k, True)[0], passage))
        if q >= OVERLAP > a:
            a = max(a, in_order(self._parts(k, True)[1], passage))
        return q, a


def leaks_in(texts: list[bytes], index: Index) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item_id, score, question overlap, answer overlap) for every verified pair; the best passage of each counts."""
    for lo, hashes, first in word_hashes([normal(t) for t in texts]):
        if not len(hashes) or not len(index.terms):
            continue
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        term = index.numbers(hashes)
        known = np.flatnonzero(term >= 0)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for postings in index.classes:
            step, n = postings.width, len(index.terms)
            cells = np.diff(first) // step + 1
            cell_at = np.cumsum(cells) - cells
            own = known[postings.term_max[term[known]] > 0]
            cell = cell_at[text[own]] + (own - first[text[own]]) // step
            # a window is a cell and the next one of the same text
            key = np.unique(cell * n + term[own])
            owner = np.repeat(np.arange(len(cells)), cells)
            before = key - n
            same = (before >= 0) & (owner[np.maximum(before, 0) // n] == owner[key // n])
            key = np.unique(np.concatenate((key, before[same])))
            last, seen = None, {}
            for w, k, score in postings.search(key // n, key % n):
                t = int(owner[w])
                begin = first[t] + (w - cell_at[t]) * step
                last, seen = w, seen if w == last else {}
                q, a = index.overlaps(k, hashes[begin : min(begin + 2 * step, first[t + 1])], seen)
                if q >= OVERLAP and a >= OVERLAP:
                    item = int(index.ids[k])
                    best[t, item] = max(best.get((t, item), (0.0, 0.0, 0.0)), (score, q, a))
        for (t, item), found in sorted(best.items()):
            yield lo + t, item, *found


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds an item.

    Null and empty texts hold nothing; items without words or with a null id are never held. A pair is returned once per
    row, for the passage with the largest score; an overlap is the share of runs, or of words in order where the runs fall
    short. An item id with several texts is held with any of them, and repeated rows of an item count once. Other columns
    are ignored. Empty tables on either side give an empty result.
    """
    found = None
    for index in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((x, pa.float64()) for x in ("score", "question_overlap", "answer_overlap"))])
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield from batches_of(((ids[t], *rest) for t, *rest in leaks_in(texts_of(batch.column(1)), shared.value)), schema)

        one = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
        )
        found = one if found is None else found.union(one)
    return found


def _indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of the shards, one at a time; statistics are those of all items."""
    known = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    known = stage(known.groupBy("item_id", "text").count().drop("count"), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((h, len(w)) for t in texts_of(batch.column(1)) for w in [hashes_of(t)] for h in [np.unique(w).view(np.int64).tolist()])
            yield from batches_of(rows, pa.schema([("terms", pa.list_(pa.int64())), ("n", pa.int64())]))

    listed = stage(known.mapInArrow(terms, "terms array<long>, n long"), "terms")
    n_items, mean = listed.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    frequency = stage(listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequency")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    for s in range(shards):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s)
        own = sorted((r["item_id"], r["text"].encode()) for r in part.collect())
        ids = part.mapInArrow(terms, "terms array<long>, n long").select(F.explode("terms").alias("term")).distinct()
        idf = {r["term"]: float(np.log1p((n_items - r["df"] + 0.5) / (r["df"] + 0.5))) for r in frequency.join(ids, "term").collect()}
        yield Index([x for x in own if x[1].split()], idf, max(mean, 1.0))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; columns stay as they are."""
    column, out = with_row_key(docs, "_leaks"), docs
    for index in _indexes(items):
        holds = _holder(docs.sparkSession.sparkContext.broadcast(index))
        out = out.withColumn(column, holds(F.col("text").cast("string"))).where(~F.col(column)).select(*docs.columns)
    return out


def _holder(shared):
    """UDF that tells which texts hold an item of a broadcast index."""

    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        hit = {t for t, *_ in leaks_in(texts_of(text), shared.value)}
        return pa.array([i in hit for i in range(len(text))], pa.bool_())

    return holds
