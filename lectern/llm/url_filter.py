"""URL filtering with a sorted digest array: 64-bit xxhash keys, memory-mapped, probed by vectorised binary search.

An entry is a rule (it names a host with all its subdomains and a path prefix; key ``host/path``) or an unwanted host word
(key ``?word``, which no host/path can be). The file holds the sorted 64-bit hashes of all keys, and in the same order
the verdicts, the ends of the key strings and the strings. A url is looked up under each suffix of its host and each
prefix of its path whose length some rule has; where no rule fits, under the words of its host. Every hash that is found
is confirmed against the stored string, so a collision of hashes never decides.

The file is written to the shared folder, fetched by each executor once and mapped there, so its strings are neither sent
with tasks nor copied by workers. The driver builds it: bounded by the rules that a driver can hold (tens of millions).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_folder
from .textkit import slabs, texts_of

# The rules (verdict, host, path prefix) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Host words of unwanted sites. Where no rule fits, a host with a label that has one of them as a
# hyphen-separated part is blocked, and any other host is allowed.
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "warez", "xxx")


_VERDICTS = ("allow", "block")


class DigestArray:
    """Sorted digests and their strings over a buffer or a mapped file; zero-copy views of ``build``'s bytes."""

    def __init__(self, data: np.ndarray):
        n, lengths, text, self.labels = (int(x) for x in data[:32].view(np.int64))
        at = np.cumsum([32, 8 * n, 8 * n, 8 * lengths, 8 * ((n + 7) // 8)])
        self.keys, self.ends = data[at[0] : at[1]].view(np.uint64), data[at[1] : at[2]].view(np.int64)
        self.lengths = data[at[2] : at[3]].view(np.int64).tolist()
        self.blocks, self.text = data[at[3] : at[3] + n], data[at[4] : at[4] + text]

    def string(self, k: int) -> bytes:
        return self.text[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes()

    def verdict(self, k: int) -> str:
        return _VERDICTS[self.blocks[k]]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Entry number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not keys:
            return out
        row = np.arange(len(keys))
        probe = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.keys, probe)
        while True:  # equal hashes stand side by side; each is confirmed by its string
            live = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probe))
            live = live[out[row[live]] < 0]
            if not len(live):
                return out
            for k in live:
                if self.string(int(at[k])) == keys[row[k]]:
                    out[row[k]] = at[k]
            probe, at, row = probe[live], at[live] + 1, row[live]


def build(rules: Sequence[tuple[str, str, str]], unwanted: Sequence[str] = UNWANTED) -> bytes:
    """The file: header (with the most labels that a rule's host has), sorted digests, string ends, path lengths, verdicts and strings. Of rules with equal host and path
    the first counts."""
    entries = {f"?{w}".encode(): "block" for w in unwanted}
    entries |= {(h.lower() + p).encode(): v for v, h, p in reversed(list(rules))}
    listed = sorted((xxhash.xxh64_intdigest(k), k, _VERDICTS.index(v)) for k, v in entries.items())
    lengths = np.array(sorted({len(p) for _, _, p in rules}), np.int64)
    text = b"".join(k for _, k, _ in listed)
    blocks = bytes(v for *_, v in listed)
    parts = (
        np.array([len(listed), len(lengths), len(text), max((h.count(".") + 1 for _, h, _ in rules), default=0)], np.int64), np.array([h for h, *_ in listed], np.uint64),
        np.cumsum([len(k) for _, k, _ in listed], dtype=np.int64), lengths,
    )
    return b"".join(x.tobytes() for x in parts) + blocks + bytes(-len(blocks) % 8) + text


@cache
def mapped(name: str) -> DigestArray:
    return DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((c for c in map(rest.find, "/?#") if c >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((c for c in map(rest.find, "?#") if c >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:cut]


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(hosts: list[str], paths: list[str], array: DigestArray) -> list[tuple[str | None, str]]:
    """(rule, verdict) of each url: the longest rule that fits, else by its host's words."""
    row, tried = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        # no rule names more labels, so no longer suffix can be one's host
        labels = host.rsplit(".", array.labels)[-array.labels :] if array.labels else []
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for n in array.lengths:
                if n <= len(path):
                    row.append(i)
                    tried.append((suffix + path[:n]).encode())
    best = [-1] * len(hosts)
    size = [-1] * len(hosts)
    for i, key, k in zip(row, tried, array.find(tried).tolist()):
        if k >= 0 and len(key) > size[i]:
            best[i], size[i] = k, len(key)
    words = [(i, f"?{w}".encode()) for i, h in enumerate(hosts) if best[i] < 0 for w in set(h.replace("-", ".").split("."))]
    bad = {i for (i, _), k in zip(words, array.find([w for _, w in words]).tolist()) if k >= 0}
    return [(array.string(k).decode(), array.verdict(k)) if k >= 0 else (None, "block" if i in bad else "allow") for i, k in enumerate(best)]


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows are judged
    alike; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "url-rules")
    row = spark.createDataFrame([(bytearray(build(rules)),)], "value binary").select(F.col("value").cast("string"))
    row.coalesce(1).write.option("compression", "none").option("lineSep", "\0").text(folder)
    file = spark.read.format("binaryFile").load(folder).select("path").first()[0]
    spark.sparkContext.addFile(file)
    name = file.rsplit("/", 1)[-1]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = mapped(name)
        for batch in batches:
            # long urls come few at a time
            for lo, hi in slabs(texts_of(batch.column(1))):
                hosts, paths = map(list, zip(*map(split_url, batch.column(1)[lo:hi].to_pylist())))
                rule, verdict = zip(*judge(hosts, paths, array))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))],
                    names=[id_column, "host", "path", "rule", "verdict"],
                )

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, F.col(url_column).cast("string")).mapInArrow(
        judged, f"{id_column} {kind}, host string, path string, rule string, verdict string"
    )


#: DuckDB SQL for the registered query.
SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u
), r(verdict, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}
), m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(UNWANTED)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1
"""
