"""Language identification with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge.

k(x, y) is the number of n-grams (2 to 4 bytes of the lower-cased UTF-8 text) that both texts hold, over the geometric
mean of their own numbers; n-grams are those of a vocabulary drawn from the training sample, the same share from each
language. Landmarks approximate the kernel (Nystroem), a ridge regression per language against the rest is fitted on the
mapped sample, and a batch of texts is scored by one product of its presence matrix with the folded weights.

Learning rows: text with a letter, non-null lang and crc32(doc_id as text) mod 4 other than 2. Of them at most
``PER_LANGUAGE`` documents per language, in order of a hash of doc_id, are used: this is the documented bound. Their whole
texts are read. N-grams are counted and the normal equations are summed on the executors; the driver sees the vocabulary
(``VOCABULARY`` n-grams a language), the landmarks and one square matrix per fitting task. No language is left out.
Scoring covers every whole text and sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded, stage
from .textkit import SLAB, U64, texts_of

PER_LANGUAGE = 400
LANDMARKS = 256
VOCABULARY = 1500
GRAMS = (2, 3, 4)
RIDGE = 1e-2
SHARPNESS = 6.0
FIT_TASKS = 16
_SCATTER = U64(0x9E3779B97F4A7C15)


def gram_codes(text: bytes) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a text, by n; a long text comes in overlapping parts."""
    longest = max(GRAMS)
    for at in range(0, max(1, len(text) - longest + 1), SLAB):
        a = np.frombuffer(text, np.uint8)[at : at + SLAB + longest - 1].astype(U64)
        code, n = a, 1
        for want in GRAMS:
            while n < want and len(code):
                code = (code[:-1] << U64(8)) | a[n:]
                n += 1
            yield code | U64(want << 40)


def gram_set(text: bytes) -> np.ndarray:
    """Sorted distinct codes of a text."""
    out = np.zeros(0, U64)
    for codes in gram_codes(text):
        out = np.union1d(out, codes)
    return out


def lowered(column) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts_of(column)]


class Vocabulary:
    """Columns of n-grams, found through a table of slots; of n-grams that share a slot the first stays."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(20, int(np.ceil(np.log2(max(len(codes), 1) * 64))))
        _, once = np.unique(self._slots(codes), return_index=True)
        self.codes = codes[np.sort(once)]

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _SCATTER) >> U64(64 - self.bits)

    def columns(self, text: bytes) -> np.ndarray:
        """Columns of the n-grams of a text, some of them more than once."""
        if not hasattr(self, "_code"):
            self._code = np.zeros(1 << self.bits, U64)
            self._column = np.zeros(1 << self.bits, np.int32)
            slots = self._slots(self.codes)
            self._code[slots], self._column[slots] = self.codes, np.arange(len(slots))
        found = [np.zeros(0, np.int32)]
        for codes in gram_codes(text):
            slots = self._slots(codes)
            found.append(self._column[slots[self._code[slots] == codes]])
        return np.concatenate(found)

    def presence(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.codes)), np.float32)
        for i, text in enumerate(texts):
            out[i, self.columns(text)] = 1
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def normed(presence: np.ndarray) -> np.ndarray:
    return presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))


def nystroem(marks: np.ndarray) -> np.ndarray:
    """The matrix that maps kernel values with the landmarks (normed rows) to features."""
    values, vectors = np.linalg.eigh(marks @ marks.T)
    kept = values > 1e-6 * max(values.max(initial=0), 1e-12)
    return vectors[:, kept] / np.sqrt(values[kept])


class Kernel:
    """The vocabulary and the weights folded over landmarks: ``VOCABULARY`` columns a language by languages."""

    def __init__(self, labels: list[str], vocabulary: Vocabulary, weights: np.ndarray):
        self.labels, self.vocabulary, self.weights = labels, vocabulary, weights.astype(np.float32)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        return normed(self.vocabulary.presence(texts)) @ self.weights

    def predict(self, texts: list[bytes], usable: list[bool]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, u in enumerate(usable) if u and self.labels]
        for at in range(0, len(known), 128):
            part = known[at : at + 128]
            margin = self.margins([texts[i] for i in part])
            chance = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)).astype(np.float64))
            chance /= chance.sum(axis=1, keepdims=True)
            for i, row in zip(part, chance):
                k = int(row.argmax())
                names[i], scores[i] = self.labels[k], float(row[k])
        return names, scores


def held_out(parts: int, part: int):
    """crc32(doc_id as text) mod ``parts`` is ``part``; a null doc_id is not held out (and never learned from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def has_letter(column):
    """A letter of any script (Unicode category L); false for null."""
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


def sample_of(docs: DataFrame) -> DataFrame:
    """(lang, rank, text): the distinct texts of the first ``PER_LANGUAGE`` documents of each language."""
    text = F.col("text").cast("string")
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out(4, 2) & has_letter(text))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
    order = F.xxhash64("doc_id")
    # hashes are even over their range: twice the documents wanted lie under this share of it, however often each recurs
    sizes = stage(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("size")), "sizes")
    low = rows.select("doc_id", "lang").join(bounded(sizes), "lang").where((order / 2.0**63 + 1) / 2 * F.col("size") <= 2 * PER_LANGUAGE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    chosen = stage(low.select("lang", "doc_id").distinct().withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE), "chosen")
    return stage(rows.join(bounded(chosen), ["lang", "doc_id"]).groupBy("lang", "text").agg(F.min("rank").alias("rank")), "sample")


def _vocabulary(sample: DataFrame) -> Vocabulary:
    """The n-grams that most texts of a language hold, ``VOCABULARY`` for each language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), lowered(batch.column(1))
            for lang in sorted(set(langs)):
                codes, n = np.unique(np.concatenate([gram_set(texts[i]) for i in np.flatnonzero(langs == lang)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counts.withColumn("k", best).where(F.col("k") <= VOCABULARY).groupBy("code").agg(F.min("k").alias("k")).orderBy("k", "code").select("code").collect()
    return Vocabulary(np.array([r[0] for r in rows], np.int64).view(U64))


def fit(docs: DataFrame) -> Kernel:
    spark = docs.sparkSession
    sample = sample_of(docs)
    sizes = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    labels = sorted(sizes)
    vocabulary = _vocabulary(sample)
    if not labels or not len(vocabulary.codes):
        return Kernel([], vocabulary, np.zeros((len(vocabulary.codes), 0)))
    words = spark.sparkContext.broadcast(vocabulary)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(words.value.columns(t)).tolist() for t in lowered(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.int32()))], names=["lang", "rank", "columns"])

    each = -(-LANDMARKS // len(labels))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))
    rows = sample.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "nth", "text").mapInArrow(columns, "lang string, nth int, columns array<int>").collect()
    marks = np.zeros((len(rows), len(vocabulary.codes)))
    for i, r in enumerate(sorted(rows, key=lambda r: (r[0], r[1]))):
        marks[i, r[2]] = 1
    marks = normed(marks)
    root = nystroem(marks)
    mapping = spark.sparkContext.broadcast((marks.T @ root).astype(np.float32))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: the weighted square matrix of features (lang null), and each language's sum of features."""
        square, by_lang = np.zeros((root.shape[1],) * 2), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), lowered(batch.column(1))
            for at in range(0, len(texts), 128):
                features = (normed(words.value.presence(texts[at : at + 128])) @ mapping.value).astype(np.float64)
                share = np.array([1.0 / sizes[x] for x in langs[at : at + 128]])
                square += (features * share[:, None]).T @ features
                for lang, f, w in zip(langs[at : at + 128], features, share):
                    by_lang[lang] = by_lang.get(lang, 0) + f * w
        cells = [square.tobytes(), *(v.tobytes() for v in by_lang.values())]
        yield pa.RecordBatch.from_arrays([pa.array([None, *by_lang], pa.string()), pa.array(cells, pa.binary())], names=["lang", "sums"])

    square, by_lang = np.zeros((root.shape[1],) * 2), np.zeros((len(labels), root.shape[1]))
    for lang, cell in sample.select("lang", "text").repartition(FIT_TASKS).mapInArrow(sums, "lang string, sums binary").collect():
        if lang is None:
            square += np.frombuffer(cell).reshape(square.shape)
        else:
            by_lang[labels.index(lang)] += np.frombuffer(cell)
    target = 2 * by_lang - by_lang.sum(axis=0)  # +1 for the language, -1 for the rest
    ridge = np.linalg.solve(square + RIDGE * len(labels) / sum(sizes.values()) * np.eye(len(square)), target.T)
    return Kernel(labels, vocabulary, marks.T @ (root @ ridge))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    A null text, or one without a letter, is ``und`` with score 0; so is all where nothing can be learned. Ties go to the
    language that sorts first. Repeated rows are predicted alike, and a repeated doc_id is one document of the sample;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array, usable: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(lowered(text), usable.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    text = F.col("text").cast("string")
    out = docs.select("doc_id", held_out(4, 2).alias("held_out"), predict(text, has_letter(text)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
