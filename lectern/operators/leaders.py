"""Leader groups over ordered hashes, for sequences of any length.

A row leads if no earlier leader is near it: leaders are the independent set that a walk in order finds. A short sequence is
walked by one task. A long one is decided in rounds: the first undecided rows of the sequence (a bounded batch) are walked,
which settles them for good, as all before them are settled; then all later rows are compared with the new leaders at once,
block by block, and those near one leave. Blocks of rows against blocks of leaders also find each row's leader, so no task
sees a whole sequence, and all tasks together make the comparisons of the walk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage

#: Rows of a sequence that one task may walk; order numbers that share a block; undecided rows that a round walks.
LIMIT, BLOCK, BATCH = 1 << 16, 1 << 13, 1 << 15
#: Bytes of a slice of comparisons.
_SLICE = 1 << 24
_SALTS = 64


def most_distance(threshold: float, strict: bool) -> int:
    """The largest Hamming distance whose similarity is over (or, if not strict, at least) the threshold; -1 for none."""
    return max((d for d in range(65) if (1 - d / 64.0 > threshold if strict else 1 - d / 64.0 >= threshold)), default=-1)


def leader_groups(
    rows: DataFrame, policy: str, threshold: float, skip_threshold: float | None = None, key: str = "video_id", order: str = "frame_idx", hash_column: str = "phash",
    limit: int = LIMIT, block: int = BLOCK, batch: int = BATCH,
) -> DataFrame:
    """(key, order, group_id, subgroup_idx) of the rows of every sequence.

    first: join the first leader with similarity over the threshold (ids from 0). best: leave a row out if a kept hash is
    more than ``skip_threshold`` like it, else join the most similar leader of at least the threshold, the earliest on
    ties (ids from 1). Rows that join none lead a new group; so does a row without a hash, which is like none. Rows of
    equal order follow each other in any order. Sequences of more than ``limit`` rows are decided in rounds.
    """
    schema = T.StructType([rows.schema[key], T.StructField(order, T.LongType()), T.StructField("group_id", T.IntegerType()), T.StructField("subgroup_idx", T.IntegerType())])
    slim = rows.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(hash_column).alias("h"))
    long = stage(slim.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("k").alias("kk")), "long")
    if long.isEmpty():
        return _walked(slim, schema, policy, threshold, skip_threshold)
    short = slim.join(long, F.col("k").eqNullSafe(F.col("kk")), "left_anti")
    # joins find no null key, so keys are texts there
    rest = slim.join(long, F.col("k").eqNullSafe(F.col("kk")), "left_semi").withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit("")))
    apart = _in_rounds(rest, policy, threshold, skip_threshold, block, batch)
    apart = apart.withColumn("k", F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).cast(rows.schema[key].dataType))
    return _walked(short, schema, policy, threshold, skip_threshold).unionByName(apart.toDF(*schema.names))


def _walked(slim: DataFrame, schema: T.StructType, policy: str, threshold: float, skip_threshold: float | None) -> DataFrame:
    def fold(name: tuple, batch: pa.Table) -> pa.Table:
        order_of = batch.column("o").to_numpy()
        places = np.argsort(order_of, kind="stable")
        known = np.asarray(batch.column("h").is_valid())[places]
        hashes = batch.column("h").fill_null(0).to_numpy().view(np.uint64)[places]
        groups, subs = lead(hashes, policy, threshold, skip_threshold, known)
        kept = groups >= 0
        columns = [pa.array([name[0].as_py()] * int(kept.sum()), batch.schema.field("k").type), pa.array(order_of[places][kept], pa.int64())]
        return pa.Table.from_arrays([*columns, pa.array(groups[kept], pa.int32()), pa.array(subs[kept], pa.int32())], names=schema.names)

    return slim.groupBy("k").applyInArrow(fold, schema)


def lead(hashes: np.ndarray, policy: str, threshold: float, skip_threshold: float | None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Group and subgroup numbers of hashes in order, -1 for those left out; see ``leader_groups``."""
    start = 0 if policy == "first" else 1
    groups, subs = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
    leaders, kept, ids = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.int64)
    sizes: list[int] = []
    n_kept = n_leaders = 0
    for i, h in enumerate(hashes):
        seen = known is None or known[i]
        if skip_threshold is not None and seen and n_kept and (1 - np.bitwise_count(kept[:n_kept] ^ h).min() / 64.0) > skip_threshold:
            continue
        g = len(sizes)
        if seen and n_leaders:
            like = 1 - np.bitwise_count(leaders[:n_leaders] ^ h) / 64.0
            best = int(np.argmax(like > threshold)) if policy == "first" else int(np.argmax(like))
            if like[best] > threshold or policy != "first" and like[best] >= threshold:
                g = int(ids[best])
        if g == len(sizes):
            if seen:
                leaders[n_leaders], ids[n_leaders] = h, g
                n_leaders += 1
            sizes.append(0)
        sizes[g] += 1
        groups[i], subs[i] = g + start, sizes[g]
        if seen:
            kept[n_kept] = h
            n_kept += 1
    return groups, subs


def chosen(hashes: np.ndarray, most: int) -> np.ndarray:
    """Mask of the hashes that are not within ``most`` of an earlier chosen one."""
    held, n, out = np.zeros(len(hashes), np.uint64), 0, np.zeros(len(hashes), bool)
    for i, h in enumerate(hashes):
        if not n or np.bitwise_count(held[:n] ^ h).min() > most:
            held[n] = h
            n += 1
            out[i] = True
    return out


def _hashes(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().view(np.uint64)


def independent(nodes: DataFrame, most: int, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """Of ``nodes(k, o, h)``, distinct hashes of each sequence, those that no earlier one of the result is within ``most`` of."""

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("o")
        return table.select(["k", "o", "h"]).filter(pa.array(chosen(_hashes(table, "h"), most)))

    def survive(rows: pa.Table, new: pa.Table) -> pa.Table:
        if not rows.num_rows or not new.num_rows:
            return rows.select(names)
        hashes, held = _hashes(rows, "h"), new.column("held").combine_chunks().values.to_numpy().view(np.uint64)
        step = max(1, _SLICE // 8 // len(held))
        far = [np.bitwise_count(hashes[a : a + step, None] ^ held).min(axis=1) > most for a in range(0, len(hashes), step)]
        return rows.select(names).filter(pa.array(np.concatenate(far)))

    left, found, names = stage(nodes.select("k", "o", "h").withColumn("c", F.floor(F.col("o") / block)), "undecided"), [], ["k", "o", "h", "c"]
    while True:
        sizes = left.groupBy("k", "c").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("k").orderBy("c"))
        taken = sizes.withColumn("sum", before).where((F.col("sum") <= batch) | (F.col("sum") == F.col("n"))).select("k", "c")
        new = stage(left.join(taken, ["k", "c"], "left_semi").groupBy("k").applyInArrow(walk, left.select("k", "o", "h").schema), "leaders")
        found.append(new)
        rest = left.join(taken, ["k", "c"], "left_anti")
        # a batch bounds the array of a sequence
        arrays = new.groupBy("k").agg(F.collect_list("h").alias("held")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        copies = rest.select("k", "c").distinct().withColumn("salt", F.pmod("c", F.lit(_SALTS)).cast("int")).join(arrays, ["k", "salt"]).select(F.col("k").alias("of"), F.col("c").alias("at"), "held")
        left = stage(rest.groupBy("k", "c").cogroup(copies.groupBy("of", "at")).applyInArrow(survive, left.schema), "undecided")
        if left.isEmpty():
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out


def nearest(rows: DataFrame, leaders: DataFrame, policy: str, most: int, block: int = BLOCK) -> DataFrame:
    """(k, o, uid, lead, by) of ``rows(k, o, h, uid)``: order and uid of the leader each joins, of those up to its own order
    within ``most`` the first, or the most similar. Blocks of rows meet blocks of leaders up to their own."""

    def best(table: pa.Table, held: pa.Table) -> pa.Table:
        if not table.num_rows or not held.num_rows:
            return empty
        held = held.sort_by([("o", "ascending"), ("uid", "ascending")])
        orders, hashes, at = held.column("o").to_numpy(), _hashes(held, "h"), table.column("o").to_numpy()
        kinds, kind = np.unique(_hashes(table, "h"), return_inverse=True)
        reach, place, far = np.searchsorted(orders, at, side="right"), np.zeros(len(at), np.int64), np.full(len(at), 65, np.int64)
        step = max(1, _SLICE // 8 // len(hashes))
        by_kind = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[by_kind], np.arange(0, len(kinds) + step, step))
        for k, a in enumerate(range(0, len(kinds), step)):
            apart = np.bitwise_count(kinds[a : a + step, None] ^ hashes)
            own = by_kind[edges[k] : edges[k + 1]]
            if reach.min() == len(orders):
                spot = np.argmax(apart <= most, axis=1) if policy == "first" else np.argmin(apart, axis=1)
                place[own] = spot[kind[own] - a]
                far[own] = apart[kind[own] - a, place[own]]
            else:
                for i in own:
                    row = apart[kind[i] - a, : reach[i]]
                    if len(row):
                        place[i] = np.argmax(row <= most) if policy == "first" else np.argmin(row)
                        far[i] = row[place[i]]
        near = pa.array(far <= most)
        distance = np.zeros(len(at), np.int32) if policy == "first" else far.astype(np.int32)
        return table.select(["k", "o", "uid"]).append_column("d", pa.array(distance)).append_column("lead", pa.array(orders[place])).append_column("by", held.column("uid").take(pa.array(place))).filter(near)

    rows, leaders = (df.withColumn("c", F.floor(F.col("o") / block)) for df in (rows, leaders))
    row_blocks, lead_blocks = (stage(df.groupBy("k").agg(F.collect_set("c").alias("blocks")), "blocks") for df in (rows, leaders))
    left = rows.join(lead_blocks, "k").withColumn("lc", F.explode(F.filter("blocks", lambda b: b <= F.col("c")))).drop("blocks")
    right = leaders.withColumnRenamed("c", "lc").join(row_blocks, "k").withColumn("c", F.explode(F.filter("blocks", lambda b: b >= F.col("lc")))).drop("blocks")
    kinds = {"k": pa.string(), "o": pa.int64(), "uid": pa.int64(), "d": pa.int32(), "lead": pa.int64(), "by": pa.int64()}
    empty, schema = pa.Table.from_pylist([], pa.schema(list(kinds.items()))), "k string, o long, uid long, d int, lead long, by long"
    right = right.select("k", "c", "lc", "o", "h", "uid").toDF("of", "rows", "leads", "o", "h", "uid")
    found = left.groupBy("k", "c", "lc").cogroup(right.groupBy("of", "rows", "leads")).applyInArrow(best, schema)
    return found.groupBy("k", "o", "uid").agg(F.min(F.struct("d", "lead", "by")).alias("m")).select("k", "o", "uid", "m.lead", "m.by")


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str, block: int = BLOCK, by: str = "o") -> DataFrame:
    """Adds the place (from 1) of each row in its group: rows of the group's blocks before, and its place in its own."""
    placed = rows.withColumn("c", F.floor(F.col(by) / block))
    sizes = placed.groupBy(*keys, "c").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("c")) - F.col("n")
    joined = placed.join(sizes.select(*keys, "c", before.alias("before")), [*keys, "c"])
    return joined.withColumn(name, F.col("before") + F.row_number().over(Window.partitionBy(*keys, "c").orderBy(*order))).drop("before", "c")


def _in_rounds(slim: DataFrame, policy: str, threshold: float, skip_threshold: float | None, block: int, batch: int) -> DataFrame:
    rows = stage(slim.withColumn("uid", F.monotonically_increasing_id()), "rows")
    known, blank = rows.where("h IS NOT NULL"), rows.where("h IS NULL").select("k", "o", "uid", F.col("o").alias("lead"), F.col("uid").alias("by"))
    most, skip = most_distance(threshold, policy == "first"), -1 if skip_threshold is None else most_distance(skip_threshold, True)
    least = F.min(F.struct("o", "uid"))
    reps = known.groupBy("k", "h").agg(least.alias("r")).select("k", "h", "r.o", "r.uid")
    if skip >= 0:
        known = stage(reps.join(independent(reps, skip, block, batch).select("k", "h"), ["k", "h"], "left_semi"), "kept")
        reps = known
    if most < 0:
        joined = known.select("k", "o", "uid", F.col("o").alias("lead"), F.col("uid").alias("by"))
    else:
        leaders = independent(reps, most, block, batch).join(reps.select("k", "h", "uid"), ["k", "h"])
        joined = nearest(known.select("k", "o", "h", "uid"), leaders, policy, most, block)
    joined = stage(joined.unionByName(blank), "joined")
    heads = numbered(joined.where("uid = by").select("k", F.col("o").alias("lead"), "by"), ["k"], ["lead", "by"], "g", block, "lead")
    members = numbered(joined, ["k", "by"], ["o", "uid"], "sub", block)
    groups = members.join(heads.select("k", "by", "g"), ["k", "by"])
    start = 0 if policy == "first" else 1
    return groups.select("k", "o", (F.col("g") - 1 + start).cast("int").alias("group_id"), F.col("sub").cast("int").alias("subgroup_idx"))
