"""Importance resampling towards a target distribution: array-scored weights, then a distributed quickselect.

Features are runs of 1 to ``max_run`` consecutive words, hashed into buckets. One pass counts the buckets of the corpus and
of the target, which leaves one gain for each bucket: an array that scores all features of a slab of texts by a single
gather. A second pass sums the gains by document. The k best documents are those up to the k-th composite key (score
falling, doc_id rising, row); random pivot keys and exact three-way counts narrow the keys to it, a round reading only what
the round before left over. Winners alone are sorted, by range, and ranked by their range's offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stage, with_row_key
from .textkit import SLAB, pieces, slabs, texts_of

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Pivots of a round: a round leaves about this fraction of the keys.
PIVOTS = 31
#: Spans longer than this many bytes get their checksum one by one.
_WIDE = 64
# Word bytes are 0-9, a-z and everything beyond ASCII; the reversed polynomial of CRC-32.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_POLYNOMIAL = np.uint32(0xEDB88320)
_TABLE = reduce(lambda t, _: np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ _POLYNOMIAL, t >> np.uint32(1)), range(8), np.arange(256, dtype=np.uint32))


def span_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span of a byte array, all spans a byte further at a time."""
    width = np.minimum(end - start, _WIDE + 1).astype(np.uint8)
    order = np.argsort(width, kind="stable")[::-1]
    at, crc = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(order) - np.searchsorted(width[order][::-1], np.arange(_WIDE), side="right")
    for k in range(_WIDE):
        n = live[k]
        if not n:
            break
        now = crc[:n]
        crc[:n] = _TABLE[(now ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(width > _WIDE):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def _features(texts: list[bytes], max_run: int, buckets: int, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some joined texts, the text each belongs to, and the words of each text. Features that end
    within the first ``carried`` words (of a single text) were counted before."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = _WORD[data]
    text_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    owner = np.searchsorted(text_at, start, side="right") - 1
    if max_run > 1:  # words with one space between them
        keep = word.copy()
        keep[1:] |= word[:-1]
        place = np.cumsum(keep) - 1
        size = end - start
        data = np.where(word, data, np.uint8(32))[keep]
        start = place[start]
        end = start + size
    found, owners = [], []
    for run in range(1, max_run + 1):
        at = np.arange(max(0, carried - run + 1), len(start) - run + 1)
        at = at[owner[at] == owner[at + run - 1]] if len(at) else at
        found.append(span_checksums(data, start[at], end[at + run - 1]) % np.uint32(buckets))
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def feature_buckets(texts: list[bytes], max_run: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, buckets, texts counted from it, words by text) of each slab of texts; a long text comes in parts."""
    for lo, hi in slabs(texts):
        if hi > lo + 1 or len(texts[lo]) <= 2 * SLAB:
            yield lo, *_features([t.lower() for t in texts[lo:hi]], max_run, buckets)
            continue
        carry: list[bytes] = []
        for part in pieces(texts[lo]):
            part = b" ".join([*carry, part.lower()])
            found, owner, words = _features([part], max_run, buckets, len(carry))
            yield lo, found, owner, words - len(carry)
            if max_run > 1:
                last = np.frombuffer(part, np.uint8)
                carry = bytes(np.where(_WORD[last], last, np.uint8(32))).split()[1 - max_run :]


def _counter(max_run: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _, _ in feature_buckets(texts_of(batch.column(0)), max_run, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; tasks send sums, and the driver gets one row a bucket at most."""
    parts = texts.select(F.col("text").cast("string")).mapInArrow(_counter(max_run, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus frequency, both with one more feature in every bucket."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _scorer(gains: np.ndarray, max_run: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for lo, found, owner, words in feature_buckets(texts_of(batch.column(1)), max_run, len(gains)):
                hi = lo + len(words)
                sums[0, lo:hi] += words
                sums[1, lo:hi] += np.bincount(owner, minlength=len(words))
                # whole numbers below 2^53 are exact in doubles
                sums[2, lo:hi] += np.bincount(owner, gains[found], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return score


def weights(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document; ``target`` has the texts whose distribution is wanted."""
    gains = bucket_gains(bucket_counts(docs, max_run, buckets), bucket_counts(target, max_run, buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scorer(gains, max_run), f"doc_id {kind}, n_words long, n_features long, weight long")


def _literal(key: T.Row, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in kind])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> T.Row:
    """The k-th smallest value (from 1) of the struct column ``key``, whose values must differ."""
    kind = keys.schema["key"].dataType
    rounds = 0
    while True:
        rounds += 1
        chosen = [r["key"] for r in keys.orderBy(F.xxhash64("key", F.lit(rounds)), "key").limit(pivots).sort("key").collect()]
        array = F.array(*[_literal(p, kind) for p in chosen])
        place = F.size(F.filter(array, lambda p: p < F.col("key"))).alias("place")
        counts = {(r["place"], r["hit"]): r["n"] for r in keys.groupBy(place, F.array_contains(array, F.col("key")).alias("hit")).agg(F.count("*").alias("n")).collect()}
        for j in range(len(chosen) + 1):
            between, equal = counts.get((j, False), 0), counts.get((j, True), 0)
            if k <= between:
                break
            k -= between
            if k <= equal:
                return chosen[j]
            k -= equal
        else:
            raise ValueError("k is beyond the number of keys")
        low = F.col("key") > _literal(chosen[j - 1], kind) if j else F.lit(True)
        high = F.col("key") < _literal(chosen[j], kind) if j < len(chosen) else F.lit(True)
        keys = stage(keys.where(low & high), "keys")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in an order over the whole table, without a task that sees all rows: they are sorted by
    range, and numbered by the rows of the ranges before and their place in their own."""
    number = with_row_key(rows, "_number")
    # the upper bits are the range, the lower 33 the place in it
    held = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(number, 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).sort("part").collect()
    before = np.concatenate(([0], np.cumsum([r["n"] for r in sizes], dtype=np.int64))).tolist()
    # one entry for each range, of which there are as many as shuffle partitions at most
    offsets = F.from_json(F.lit("{" + ",".join(f'"{r["part"]}":{b}' for r, b in zip(sizes, before)) + "}"), "map<string,bigint>")
    place = F.element_at(offsets, part.cast("string")) + F.col(number).bitwiseAND((1 << 33) - 1) + 1
    return held.withColumn(name, place).drop(number)


def resample(
    docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank numbers the drawn ones from 1, for the others it is null.

    ``score`` is the weight plus Gumbel noise in thousandths, drawn from the hash of seed and doc_id; of the N documents with
    at least ``min_words`` words, floor(percent * N / 100) with the highest scores are drawn, ties to the smaller doc_id (null
    first), then to the row that was read first. Null and empty texts have no features, weight 0 and are never drawn if ``min_words`` is above 0. Repeated
    rows are drawn each; a null doc_id hashes as an empty string. An empty table gives no rows, and with an empty target all
    its buckets count as one feature. Extra columns are not looked at.
    """
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000.0 * F.log(-F.log(u)))
    scored = stage(weights(docs, target, max_run, buckets).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scores")
    key = F.struct((-F.col("score")).alias("score"), F.col("doc_id"), F.col("row")).alias("key")
    fit = F.col("n_words") >= min_words
    k = percent * scored.where(fit).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    keys = scored.where(fit).select(key)
    last = _literal(kth_key(keys, k), keys.schema["key"].dataType)
    won = fit & (key <= last)
    winners = ranked(scored.where(won).select(*columns, "row"), [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()], "rank")
    return scored.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(winners.select(*columns, "rank"))


SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS target, doc_id, coalesce(text, '') AS x FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
words AS (SELECT target, doc_id, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS (SELECT target, doc_id, unnest(w) AS f FROM words),
distinct_words AS (SELECT DISTINCT f FROM each),
coded AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(f)), 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM distinct_words, crc),
counts AS (SELECT bucket, count(*) FILTER (WHERE target = 0)::DOUBLE AS s, count(*) FILTER (WHERE target = 1)::DOUBLE AS t FROM each JOIN coded USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
weighed AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM each JOIN coded USING (f) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN drawn d ON d.doc_id = s.doc_id
"""
