"""Leader groups of long sequences and near pairs by tables and blocks, against the walk and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import groups as G
from lectern.operators import leaders as L
from lectern.operators import near as N


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def drifting(rng, n, clusters, flips):
    """Hashes that stay near one of some centres for a while, with exact copies among them."""
    centres = [rng.getrandbits(64) for _ in range(clusters)]
    out, now = [], centres[0]
    for _ in range(n):
        if rng.random() < 0.02:
            now = rng.choice(centres)
        h = now
        for b in rng.sample(range(64), rng.randrange(flips)):
            h ^= 1 << b
        out.append(rng.choice(out[-50:]) if out and rng.random() < 0.2 else h)
    return out


@pytest.mark.parametrize(("policy", "threshold", "skip"), [("first", 0.9, None), ("best", 0.85, 0.95), ("best", 0.8, None), ("first", 1.0, None)])
def test_rounds_equal_the_walk(spark, policy, threshold, skip):
    rng = random.Random(21)
    hashes = {"a": drifting(rng, 1500, 12, 9), "b": drifting(rng, 700, 40, 4), "c": [rng.getrandbits(64) for _ in range(300)], None: drifting(rng, 400, 3, 8), "short": drifting(rng, 60, 3, 5)}
    rows = [(k, i * 3, signed(h) if i % 97 else None) for k, hs in hashes.items() for i, h in enumerate(hs)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "video_id string, frame_idx long, phash long").repartition(5)
    found = {(r.video_id, r.frame_idx): (r.group_id, r.subgroup_idx) for r in L.leader_groups(frame, policy, threshold, skip, limit=100, block=256, batch=500).collect()}
    wanted = {}
    for k, hs in hashes.items():
        known = np.arange(len(hs)) % 97 > 0
        groups, subs = L.lead(np.array(hs, np.uint64), policy, threshold, skip, known)
        wanted |= {(k, i * 3): (int(g), int(s)) for i, (g, s) in enumerate(zip(groups, subs)) if g >= 0}
    assert found == wanted


def test_one_long_sequence(spark):
    """100,000 frames of one video, of which no task sees all; the walk is the measure."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    noise = (np.uint64(1) << rng.integers(0, 64, (3, 100_000), dtype=np.uint64)).astype(np.uint64)
    hashes = centres[np.sort(rng.integers(0, 3000, 100_000))] ^ noise[0] ^ noise[1] ^ noise[2]
    frame = spark.createDataFrame(list(enumerate(hashes.view(np.int64).tolist())), "frame_idx long, phash long").withColumn("video_id", F.lit(7))
    found = L.leader_groups(frame, "first", 0.9).orderBy("frame_idx").toPandas()
    groups, subs = L.lead(hashes, "first", 0.9, None)
    assert found["group_id"].tolist() == groups.tolist() and found["subgroup_idx"].tolist() == subs.tolist()


def test_select_keeps_slides_without_a_group(spark):
    rows = [("v", i, g, float(s)) for i, (g, s) in enumerate([(-1, 3), (-1, 9), (-1, 1), (5, 2), (5, 8), (5, 8), (None, 4), (None, 5), (0, 1)])]
    frame = spark.createDataFrame(rows, "video_id string, frame_idx long, group_id int, sharpness double")
    single = {0, 1, 2, 6, 7, 8}
    for rule, one in (("first", 3), ("middle", 4), ("sharpest", 4)):
        assert {r.frame_idx for r in G.select_best(frame, rule, ["video_id", "group_id"]).collect()} == single | {one}


def clustered(rng, clusters, size):
    centres = [rng.getrandbits(64) for _ in range(clusters)]
    return list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12))) for c in centres for _ in range(size)})


@pytest.mark.parametrize("most", [1, 6, 19])
@pytest.mark.parametrize("method", ["tables", "blocks", None])
def test_pairs_equal_brute_force(spark, most, method, monkeypatch):
    rng = random.Random(31)
    hashes = clustered(rng, 12, 12)
    rows = [(i, signed(h), i % 2) for i, h in enumerate(hashes)] + [(5000 + i, signed(hashes[i]), i % 2) for i in range(10)] + [(9000, None, 0)]
    near = N.similar_pairs(spark.createDataFrame(rows, "id long, h long, video int"), "id", "h", most, "video", method)
    found = [tuple(r) for r in near.collect()]
    wanted = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and i % 2 == j % 2 and (a ^ b).bit_count() <= most}
    assert len(found) == len(set(found)) and set(found) == wanted | {(i, 5000 + i, 0) for i in range(10)}


def test_blocks_of_blocks(spark):
    rng = random.Random(32)
    hashes = clustered(rng, 20, 10)
    frame = spark.createDataFrame([("", i, signed(h)) for i, h in enumerate(hashes)], "scope string, id long, h long")
    found = sorted((r.id_a, r.id_b) for r in N.by_blocks(frame, 9, block=30).collect())
    assert found == [(i, j) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 9]


@pytest.mark.parametrize(("most", "share"), [(6, 0.02)])
def test_tables_compare_few_pairs(spark, most, share):
    """Candidates beyond the pairs of a cluster, of all pairs."""
    rng = random.Random(33)
    hashes = clustered(rng, 150, 12)
    frame = spark.createDataFrame([("", i, signed(h)) for i, h in enumerate(hashes)], "scope string, id long, h long")
    n = N.candidates(frame, N.plan(1e6, most)).count()
    assert 0 < n < share * len(hashes) * (len(hashes) - 1) / 2


def test_plans():
    for most in range(20):
        for n in range(1, 12):
            parts = N.parts_of(n, most)
            # differences that no part meets add up to more than the distance
            assert sum(p.width for p in parts) == 64 and sum(p.radius + 1 for p in parts) >= most + 1
    assert N.plan(1000, 19) is None and N.plan(1e6, 6) and N.plan(1e6, 1)
    assert sorted(N.Part(0, 4, 2).masks()) == sorted(m for m in range(16) if m.bit_count() <= 2)
