"""Pairs of hashes within a Hamming distance, exact, by few wide tables or by blocks.

Tables: the 64 bits are cut into a few parts. Two hashes at most ``most`` apart agree in one part but for a few bits, so
every value within that radius of a hash's part is looked up in the part's table. That pays for small distances; a large one
has too many values to look up and too many false candidates. Then blocks of hashes are compared with each other in bulk.
"""

from __future__ import annotations

import json
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import hamming
from ..sources.staging import stage

#: Distinct hashes of a block; bytes of a slice of comparisons.
BLOCK, _SLICE = 1 << 14, 1 << 24
#: Cost of a look-up and of a candidate of the tables, in comparisons of a block.
_LOOKUP, _CANDIDATE = 300.0, 100.0
_MOST_LOOKUPS = 5000


class Part(NamedTuple):
    """Bits ``low`` to ``low + width`` of a hash, looked up to ``radius`` bits away."""

    low: int
    width: int
    radius: int

    def values(self) -> int:
        return sum(comb(self.width, k) for k in range(self.radius + 1))

    def masks(self) -> list[int]:
        # as signed numbers: bit 63 is the sign
        return [sum(1 << b if b < 63 else -(1 << 63) for b in bits) for k in range(self.radius + 1) for bits in combinations(range(self.width), k)]

    def of(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, self.low).bitwiseAND(F.lit((1 << self.width) - 1 if self.width < 64 else -1))


def parts_of(n: int, most: int) -> list[Part]:
    """``n`` parts, of which one at least is met by every pair within ``most``: if no part were, the differences would add up
    to more. The first ``most % n + 1`` parts look ``most // n`` bits far, the others a bit less (-1: not at all)."""
    edges = [64 * k // n for k in range(n + 1)]
    return [Part(a, b - a, most // n - (k > most % n)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def plan(rows: float, most: int) -> list[Part] | None:
    """The parts whose look-ups and (if bits were random) candidates cost least for a scope of so many hashes; None if blocks cost less."""
    best, cost = None, rows * rows / 2
    for n in range(1, 9):
        parts = [p for p in parts_of(n, most) if p.radius >= 0]
        lookups = sum(p.values() for p in parts)
        candidates = rows * rows * sum(p.values() / 2.0**p.width for p in parts) / 2
        now = rows * lookups * _LOOKUP + candidates * _CANDIDATE
        if lookups <= _MOST_LOOKUPS and now < cost:
            best, cost = parts, now
    return best


def candidates(hashes: DataFrame, parts: list[Part]) -> DataFrame:
    """(id_a, ha, id_b, hb, part) of pairs of ``hashes(scope, id, h)`` that meet in a part's table, id_a the smaller one."""
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), p.of(F.col("h")).alias("v")) for k, p in enumerate(parts)])).alias("c")

    def around(k: int, p: Part) -> Column:
        masks = F.from_json(F.lit(json.dumps(p.masks())), "array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("part"), p.of(F.col("h")).bitwiseXOR(m).alias("v")))

    looked = F.explode(F.flatten(F.array(*[around(k, p) for k, p in enumerate(parts)]))).alias("c")
    left = hashes.select("scope", F.col("id").alias("id_a"), F.col("h").alias("ha"), looked).select("scope", "id_a", "ha", "c.*")
    right = hashes.select("scope", F.col("id").alias("id_b"), F.col("h").alias("hb"), own).select("scope", "id_b", "hb", "c.*")
    return left.join(right, ["scope", "part", "v"]).where("id_a < id_b").select("id_a", "ha", "id_b", "hb", "part")


def by_tables(hashes: DataFrame, most: int, parts: list[Part]) -> DataFrame:
    """Pairs within ``most``, each kept in the first part that it meets in."""
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*[F.when(F.bit_count(p.of(differ)) <= p.radius, k) for k, p in enumerate(parts)])
    near = candidates(hashes, parts).where(F.bit_count(differ) <= most).where(first == F.col("part"))
    return near.select("id_a", "id_b", hamming(F.col("ha"), F.col("hb")).alias("distance"))


def by_blocks(hashes: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """Pairs within ``most``: the hashes of a scope are dealt to blocks, and each block meets itself and the later ones."""
    id_type = hashes.schema["id"].dataType
    sizes = hashes.groupBy("scope").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = hashes.join(sizes, "scope").withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")))
    left = dealt.withColumn("other", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1))).select("scope", F.col("own").alias("i"), F.col("other").alias("j"), "id", "h")
    right = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own")))).select("scope", "other", "own", "id", "h").toDF("of", "x", "y", "id", "h")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        ids_a, ids_b = a.column("id").combine_chunks(), b.column("id").combine_chunks()
        ha, hb = (t.column("h").to_numpy().view(np.uint64) for t in (a, b))
        same = a.num_rows > 0 and b.num_rows > 0 and a.column("i")[0] == a.column("j")[0]
        step, found = max(1, _SLICE // 8 // max(1, len(hb))), [np.zeros((3, 0), np.int64)]
        for at in range(0, len(ha), step):
            apart = np.bitwise_count(ha[at : at + step, None] ^ hb)
            x, y = np.nonzero(apart <= most)
            found.append(np.stack([x + at, y, apart[x, y]]))
        x, y, d = np.concatenate(found, axis=1)
        first, second = ids_a.take(pa.array(x)), ids_b.take(pa.array(y))
        table = pa.Table.from_arrays([first, second, pa.array(d, pa.int32())], names=["id_a", "id_b", "distance"])
        # a block that meets itself sees each pair twice, another block's pairs come in any order
        smaller = pa.compute.less(first, second)
        if same:
            return table.filter(smaller)
        turned = pa.Table.from_arrays([second, first, table.column("distance")], names=table.schema.names)
        return pa.concat_tables([table.filter(smaller), turned.filter(pa.compute.invert(smaller))])

    schema = f"id_a {id_type.simpleString()}, id_b {id_type.simpleString()}, distance int"
    return left.groupBy("scope", "i", "j").cogroup(right.groupBy("of", "x", "y")).applyInArrow(compare, schema)


def similar_pairs(rows: DataFrame, id_column: str, hash_column: str, max_distance: int, within: str | None = None, method: str | None = None) -> DataFrame:
    """(id_a, id_b, distance) of hashes at most ``max_distance`` apart, exact; null hashes have no partner.

    Equal hashes stand for one: the row of the smallest id is paired with the others' smallest, and each copy with its
    own smallest at distance 0, so a blank picture that comes again a million times gives a million rows, not their square.
    Ids must differ. ``method`` is ``tables`` or ``blocks``; by default what is cheaper for the largest scope, where tables that
    many hashes share a value of are counted, not guessed.
    """
    scope = F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit("")) if within else F.lit("")
    slim = rows.select(F.col(id_column).alias("id"), F.col(hash_column).alias("h"), scope.alias("scope")).where("h IS NOT NULL")
    least = stage(slim.groupBy("scope", "h").agg(F.min("id").alias("id")), "hashes")
    copies = slim.join(least.withColumnRenamed("id", "id_a"), ["scope", "h"]).where("id > id_a").select("id_a", F.col("id").alias("id_b"), F.lit(0).alias("distance"))
    parts = None
    if method != "blocks":
        most = least.groupBy("scope").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        parts = plan(most, max_distance) if method is None else _cheapest(max_distance)
        if parts and method is None and _crowded(least, parts) * _CANDIDATE > most * most / 2:
            parts = None
    near = by_tables(least, max_distance, parts) if parts else by_blocks(least, max_distance)
    return near.unionByName(copies)


def _cheapest(most: int) -> list[Part]:
    """The parts with the fewest candidates that keep to the bound of look-ups."""
    wanted = min(64, most + 1)
    ways = [[p for p in parts_of(n, most) if p.radius >= 0] for n in range(1, 65)]
    fit = [parts for n, parts in enumerate(ways, 1) if n == wanted or sum(p.values() for p in parts) <= _MOST_LOOKUPS]
    return min(fit, key=lambda parts: sum(p.values() / 2.0**p.width for p in parts))


def _crowded(hashes: DataFrame, parts: list[Part]) -> float:
    """Pairs of the largest scope that agree in all of a part's bits, over all parts: what crowded values cost at least."""
    values = hashes.select("scope", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), p.of(F.col("h")).alias("v")) for k, p in enumerate(parts)])).alias("c"))
    pairs = values.groupBy("scope", "c.part", "c.v").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).groupBy("scope").agg(F.sum("n").alias("n"))
    return float(pairs.agg(F.max("n").alias("n")).first()["n"] or 0.0)
