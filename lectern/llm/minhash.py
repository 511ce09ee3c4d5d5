"""MinHash near-duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, adaptive depth.

1. Every text becomes its set of 5-word shingles (64-bit hashes) and ``TREES * DEPTH`` MinHash values. Texts with equal
   sets collapse to the smallest doc_id before anything is compared.
2. Each tree orders the representatives by its own ``DEPTH`` values; the table is range-partitioned by that order, so a
   crowded region is cut over many tasks. Rows that share the first ``SHALLOW`` values are a region. In a region of up to
   ``BLOCK`` members all are neighbours. A crowded one goes deeper: it is cut where neighbours in the order have the
   shortest common prefixes, one value more at a time, until its parts fit; each region so gets its own depth. A part
   proposes a maximum spanning forest of estimated similarities, not its pairs.
3. Proposals are confirmed on the full sets and joined to components.
4. Whatever a forest left out is settled exactly, in regions that still hold several components. Sets whose similarity is
   at least t share one of the n - ceil(t n) + 1 first shingles of any common order; the order here puts the shingles
   that many members hold last, so shared boilerplate brings nobody together. Members none of whose first shingles
   stands in another component are done. Of the others, packs of full sets (bounded by bytes) are compared: those of a
   region with those that hold its minority components. Pairs inside one component need no comparison; no pair,
   partner or region is capped.

A pair of similarity 0.75 shares a region in at least one tree with probability 1 - (1 - 0.75^2)^14 > 0.99999, and its
estimate is at least ``LEAST_ESTIMATE`` with probability over 0.9999999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import stage, with_row_key
from .textkit import U64, batches_of, shingle_sets, texts_of

WORDS = 5
PERCENT = 75
TREES, DEPTH, SHALLOW = 14, 6, 2
BLOCK = 2048
#: Bytes of shingle sets in a pack, on average; one very long text is a pack of its own.
PACK_BYTES = 2 << 20
#: Estimates below this are not confirmed; it is over six standard deviations under 0.75 for TREES * DEPTH values.
LEAST_ESTIMATE = 0.45
#: Counters of shingles that many members hold.
BUCKET_BITS = 20
#: Row count up to which a table of ids is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * U64(2) + U64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a non-empty set of 64-bit hashes."""
    out = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, U64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        np.minimum(out, ((part ^ (part >> U64(29))) * _MULTIPLIERS).min(axis=0), out=out)
    return (out >> U64(32)).astype(np.uint32)


def _content(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one = int(shingles.sum(dtype=U64)) ^ len(shingles)
    two = int(((shingles >> U64(7)) * _MULTIPLIERS[0] ^ shingles).sum(dtype=U64))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (one, two))


_FEATURES = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()

        def rows():
            for i, s in shingle_sets(texts_of(batch.column(1)), WORDS):
                k1, k2 = _content(s)
                yield ids[i], k1, k2, len(s), signature(s).tobytes() if len(s) else None

        yield from batches_of(rows(), _FEATURES)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, content key (k1, k2), set size n and signature of every text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _features, "doc_id long, k1 long, k2 long, n long, sig binary"
    )


_ORDER = pa.schema([("tree", pa.int8()), ("prefix", pa.int64()), ("deep", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary(TREES * DEPTH))])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(m, TREES, DEPTH)
        sketch = pa.array([x.tobytes() for x in (sig & 255).astype(np.uint8).reshape(m, -1)], pa.binary())
        for t in range(TREES):
            own = sig[:, t]
            prefix = ((own[:, 0].astype(U64) << U64(32)) | own[:, 1]).view(np.int64)
            deep = np.ascontiguousarray((own[:, SHALLOW:] & 255).astype(np.uint8)).view(np.int32).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, t, np.int8)), pa.array(prefix), pa.array(deep), batch.column(0), batch.column(1), sketch],
                names=_ORDER.names,
            )


def similarity_forest(score: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest; scores of 0 are no edge."""
    n = len(score)
    if n == 2:
        return [(0, 1)] if score[0, 1] > 0 else []
    best, source, free = np.zeros(n, score.dtype), np.zeros(n, np.int64), np.ones(n, bool)
    out = []
    for _ in range(n):
        i = int(np.argmax(np.where(free, best, -1)))
        if best[i] > 0:
            out.append((int(source[i]), i))
        free[i] = False
        better = free & (score[i] > best)
        best[better], source[better] = score[i][better], i
    return out


def _scores(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Estimated similarity of all left with all right members; 0 where the set sizes or the estimate rule a link out."""
    out = np.empty((len(left), len(right)), np.float32)
    for i, row in enumerate(left):
        out[i] = (right == row).mean(axis=1, dtype=np.float32)
    small, large = np.minimum(n_left[:, None], n_right), np.maximum(n_left[:, None], n_right)
    out[(out < LEAST_ESTIMATE) | (100 * small < PERCENT * large)] = 0
    return out


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int8()), ("prefix", pa.int64()), ("rest", pa.bool_())])


def depth_parts(deep: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Parts (from, to) of at most ``most`` rows of a sorted region, by the values beyond those that all rows share.

    A part over the bound is cut where the next value changes, that is where common prefixes are shortest; small
    neighbours are joined again up to the bound. Rows that agree in all values are cut by position.
    """

    def cut(lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        if hi - lo <= most:
            return [(lo, hi)]
        if depth == deep.shape[1]:
            return [(x, min(x + most, hi)) for x in range(lo, hi, most)]
        edge = lo + 1 + np.flatnonzero(deep[lo + 1 : hi, depth] != deep[lo : hi - 1, depth])
        parts = [p for x, y in zip([lo, *edge], [*edge, hi]) for p in cut(int(x), int(y), depth + 1)]
        joined = parts[:1]
        for x, y in parts[1:]:
            if y - joined[-1][0] <= most:
                joined[-1] = joined[-1][0], y
            else:
                joined.append((x, y))
        return joined

    return cut(0, len(deep), 0)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> proposed pairs (rest false) and the members of regions that are not settled by them (rest true)."""

    def settle(tree, prefix, deep, ids, n, sketches, whole):
        for at, end in depth_parts(deep.astype(np.int32).view(np.uint8).reshape(len(ids), 4), BLOCK):
            part = slice(at, end)
            block = ids[part]
            if len(block) > 1:
                score = _scores(sketches[part], sketches[part], n[part], n[part])
                score[block[:, None] == block] = 0
                edges = similarity_forest(score)
                for i, j in edges:
                    yield int(block[i]), int(block[j]), tree, prefix, False
                if whole and len(ids) <= BLOCK:
                    if np.count_nonzero(score) > 2 * len(edges):
                        for i in np.flatnonzero(score.any(axis=1)):
                            yield int(block[i]), None, tree, prefix, True
                    continue
            for i in block:
                yield int(i), None, tree, prefix, True

    def rows():
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4)]
            new.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            tree, prefix = held[0], held[1]
            cut = np.flatnonzero((tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])) + 1
            if not len(cut):
                if len(tree) > 16 * BLOCK:  # a very crowded region goes on in parts, all of them settled later
                    yield from settle(int(tree[0]), int(prefix[0]), *held[2:], False)
                    held, first = [x[:0] for x in held], True
                continue
            for lo, hi in zip(np.concatenate(([0], cut[:-1])), cut):
                if hi - lo > 1 or first:
                    yield from settle(int(tree[lo]), int(prefix[lo]), *(x[lo:hi] for x in held[2:]), not first)
                first = False
            held = [x[cut[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield from settle(int(held[0][0]), int(held[1][0]), *held[2:], False)

    yield from batches_of(rows(), _FOUND)


_SETS = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()

        def rows():
            for i, s in shingle_sets(texts_of(batch.column(2)), WORDS):
                if len(s) and _content(s)[0] == keys[i]:
                    yield ids[i], keys[i], len(s), signature(s).tobytes(), s.tobytes()

        yield from batches_of(rows(), _SETS, 256)


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, for sorted distinct arrays."""
    small, large = (left, right) if len(left) < len(right) else (right, left)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= PERCENT * (len(small) + len(large) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            linked(np.frombuffer(x, U64), np.frombuffer(y, U64))
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of packs of one region -> links between different components, each pair in the first tree it shares."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def unpack(pack):
        sig = np.frombuffer(b"".join(x["sig"] for x in pack), np.uint32).reshape(len(pack), TREES, DEPTH)
        sets = [np.frombuffer(x["shingles"], U64) for x in pack]
        comp = np.array([x["comp"] for x in pack])
        return comp, sig, sets, np.array([len(s) for s in sets])

    def rows(batch):
        for tree, left, right in zip(*(batch.column(k).to_pylist() for k in range(3))):
            (c1, g1, s1, n1), (c2, g2, s2, n2) = unpack(left), unpack(right)
            low = [(g & 255).astype(np.uint8).reshape(len(g), -1) for g in (g1, g2)]
            score = _scores(*low, n1, n2)
            score[c1[:, None] == c2] = 0
            parent: dict[int, int] = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            i, j = np.nonzero(score)
            for k in np.argsort(-score[i, j], kind="stable"):
                x, y = int(i[k]), int(j[k])
                r, s = root(int(c1[x])), root(int(c2[y]))
                if r == s:
                    continue
                shared = (g1[x, :, :SHALLOW] == g2[y, :, :SHALLOW]).all(axis=1)
                if int(np.argmax(shared)) == tree and linked(s1[x], s2[y]):
                    parent[max(r, s)] = min(r, s)
                    yield int(c1[x]), int(c2[y])

    for batch in batches:
        yield from batches_of(rows(batch), schema)


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a staged table of ids only while its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def heavy_counts(sets: DataFrame) -> np.ndarray:
    """Counter by bucket of shingle hashes, as a power of two: 0 unless many more shingles fall there than on average."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount((np.frombuffer(cell.as_py(), U64) >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        for at in range(0, len(some), 65536):
            part = some[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], schema=schema)

    counts = stage(sets.select("shingles").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    mean = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >> BUCKET_BITS) + 1
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for bucket, n in counts.where(F.col("n") >= 8 * mean).collect():  # at most an eighth of the buckets
        out[bucket] = int(n).bit_length()
    return out


def first_shingles(shingles: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 shingles in the order (counter of the bucket, hash). Of two sets whose similarity is
    at least 0.75 each has a shingle among these that the other has among its own."""
    n = len(shingles)
    order = np.lexsort((shingles, heavy[(shingles >> U64(64 - BUCKET_BITS)).astype(np.int64)]))
    return shingles[order[: n - -(-PERCENT * n // 100) + 1]]


def _open_members(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id) of the members of which some first shingle is also one of a member of another component."""
    comps = members.select("id", "comp").distinct()
    held = stage(comps.join(sets.select("id", "shingles"), "id"), "member-sets")
    heavy = sets.sparkSession.sparkContext.broadcast(heavy_counts(held))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, comp, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = first_shingles(np.frombuffer(cell.as_py(), U64), heavy.value).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), id_)), pa.array(np.full(len(own), comp)), pa.array(own)], names=["id", "comp", "shingle"])

    listed = stage(held.mapInArrow(firsts, "id long, comp long, shingle long"), "first-shingles")
    shared = listed.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("shingle")
    return stage(listed.join(_bounded(stage(shared, "shared-shingles")), "shingle", "left_semi").select("id").distinct(), "open-members")


def _rest_links(rest: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that share a region, complete: (a, b) are labels."""
    placed = stage(
        rest.join(labels, rest.id == labels.node, "left").select("tree", "prefix", "id", F.coalesce("label", "id").alias("comp")), "placed"
    )

    def in_open_regions(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("tree", "prefix", "comp").agg(F.count("*").alias("n")).groupBy("tree", "prefix")
        regions = stage(sizes.agg(F.max_by("comp", "n").alias("major"), F.count("*").alias("comps")).where("comps > 1").drop("comps"), "regions")
        return stage(rows.join(regions, ["tree", "prefix"]), "members")

    open_ids = _open_members(in_open_regions(placed), sets)
    members = in_open_regions(placed.join(_bounded(open_ids), "id", "left_semi"))
    # members of the largest component are packed apart (negative numbers), so few packs meet all others
    sized = members.join(sets.select("id", "n"), "id").withColumn("minor", F.col("comp") != F.col("major"))
    room = sized.groupBy("tree", "prefix", "minor").agg(F.ceil(F.sum("n") * 8 / PACK_BYTES).alias("packs"))
    number = F.pmod(F.xxhash64("id"), F.col("packs"))
    numbered = sized.drop("n").join(stage(room, "rooms"), ["tree", "prefix", "minor"]).withColumn("part", F.when(F.col("minor"), number).otherwise(-1 - number))
    packs = stage(
        numbered.join(sets, "id").groupBy("tree", "prefix", "part", "minor")
        .agg(F.collect_list(F.struct("id", "comp", "sig", "shingles")).alias("pack")),
        "packs",
    )
    left = packs.select("tree", "prefix", F.col("part").alias("p"), F.col("minor").alias("minor_p"), F.col("pack").alias("left"))
    pairs = packs.where("minor").join(left, ["tree", "prefix"]).where("NOT minor_p OR p <= part")
    return stage(pairs.select("tree", "left", F.col("pack").alias("right")).mapInArrow(_settle, "a long, b long"), "rest")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept.

    ``docs`` needs doc_id and text; other columns are ignored. A null or wordless text has no shingle and is linked with
    nothing. A row with a null doc_id is not linked: its component_id is null and it is kept. Repeated rows share one
    result each. An empty table gives an empty result.
    """
    found = stage(features(docs), "features")
    named = found.where("n > 0 AND doc_id IS NOT NULL")
    reps = stage(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    mapped = stage(
        named.join(reps, ["k1", "k2"]).select("doc_id", "rep", "k1", "n", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "mapped"
    )
    order = mapped.where("sig IS NOT NULL").select(F.col("rep").alias("id"), "n", "sig").mapInArrow(
        _orders, "tree byte, prefix long, deep int, id long, n long, sketch binary"
    )
    proposals = stage(
        order.repartitionByRange("tree", "prefix", "deep", "id").sortWithinPartitions("tree", "prefix", "deep", "id")
        .mapInArrow(_regions, "a long, b long, tree byte, prefix long, rest boolean"),
        "proposals",
    )
    pairs = stage(proposals.where("NOT rest").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    rest = proposals.where("rest").select("tree", "prefix", F.col("a").alias("id")).distinct()
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(rest.select("id")).distinct()
    wanted = stage(wanted.join(mapped.where("sig IS NOT NULL").select("rep", "k1"), "rep").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    sets = stage(
        texts.join(_bounded(wanted), "rep").select("rep", "k1", "text")
        .mapInArrow(_sets, "id long, k1 long, n long, sig binary, shingles binary").dropDuplicates(["id"]).drop("k1"),
        "sets",
    )
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    links = stage(pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long"), "links")
    labels = components(links)
    more = components(_rest_links(rest, labels, sets))
    final = labels.join(more.withColumnRenamed("label", "top"), labels.label == more.node, "left")
    final = final.select(labels.node, F.coalesce("top", "label").alias("label"))
    final = stage(final.union(more.join(labels, "node", "left_anti").select("node", "label")), "final")
    reached = mapped.select("doc_id", "rep").distinct().join(final, F.col("rep") == final.node, "left")
    reached = stage(reached.groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("reach")), "reached")
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(reached, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("reach")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document is not its component's representative; columns stay as they are."""
    name = with_row_key(docs, "_gone")
    gone = stage(near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(_bounded(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti")
