"""Folds cut into chunks against the same folds in one go, for rules that meet soon, late or never."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import sequence as S
from lectern.streaming import progress as Z


def walked(rows, accept, apart=None):
    out = set()
    for key in {r[0] for r in rows}:
        walk = S.Walk(accept, apart)
        out |= {(key, r[1]) for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]) if walk.takes(list(r[1:]))}
    return out


RULES = [
    lambda last, row: last is None or abs(row[1] - last[1]) > 30,
    lambda last, row: last is None or row[0] - last[0] >= 50,  # chunks that accept nothing, and no two walks meet by chance
    lambda last, row: row[1] == 3,  # rarely, and whatever came before
    lambda last, row: False,
    lambda last, row: last is None or row[1] > last[1],  # records: almost nothing after the first chunks
]


@pytest.mark.parametrize(("rule", "chunk"), [(0, 7), (0, 1000), (1, 40), (2, 40), (3, 100), (4, 40)])
def test_chunks_equal_one_go(spark, rule, chunk):
    accept, rng = RULES[rule], random.Random(41)
    rows = [(k, i * 2, rng.randrange(100)) for k, n in (("a", 300), ("b", 41), (None, 90), ("c", 3)) for i in range(n)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, o long, v int").repartition(3)
    found = [tuple(r) for r in S.fold_accepted(frame, "k", "o", ["v"], accept, chunk=chunk).collect()]
    assert len(found) == len(set(found)) and set(found) == walked(rows, accept)


@pytest.mark.parametrize("chunk", [25, 200])
def test_hashes_stay_apart_over_chunks(spark, chunk):
    rng = random.Random(42)
    centres = [rng.getrandbits(63) for _ in range(60)]
    rows = [("v", i, rng.randrange(100), rng.choice(centres) ^ (1 << rng.randrange(63)) if i % 11 else None) for i in range(400)]
    accept = lambda last, row: last is None or abs(row[1] - last[1]) > 20
    frame = spark.createDataFrame(rows, "k string, o long, v int, h long").repartition(3)
    found = {tuple(r) for r in S.fold_accepted(frame, "k", "o", ["v", "h"], accept, (2, 5), chunk=chunk).collect()}
    assert found == walked(rows, accept, (2, 5))
    assert 0 < len(found) < len(walked(rows, accept))


def test_one_video_over_many_tasks(spark):
    """All modes, grids included, for a long video beside short ones."""
    rng = random.Random(43)
    grid, rows = [float(rng.randrange(256)) for _ in range(16)], []
    for i in range(1200):
        if rng.random() < 0.1:
            grid = [float(rng.randrange(256)) for _ in range(16)]
        rows.append(("long", i, [min(255.0, max(0.0, v + rng.randrange(-9, 10))) for v in grid] if i % 53 else None, rng.getrandbits(12)))
    rows += [("short", i, [float(rng.randrange(256)) for _ in range(16)], rng.getrandbits(40)) for i in range(20)]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx long, luma array<double>, phash long").cache()
    for mode in ("improved", "advanced", "standard", "range", "coarse", "main"):
        whole = {tuple(r) for r in S.accept_changes(frames, mode).collect()}
        cut = [tuple(r) for r in S.accept_changes(frames, mode, chunk=100).collect()]
        assert len(cut) == len(set(cut)) and set(cut) == whole and whole
    tasks = S.fold_accepted(frames, "video_id", "frame_idx", ["luma"], lambda last, row: True, chunk=100)
    assert tasks.count() == len(rows)
    frames.unpersist()


@pytest.mark.parametrize("mode", ["advanced", "standard"])
def test_frames_out_of_order_over_batches(spark, tmp_path, mode):
    """Every batch has frames of its own seconds and of those before and after; a late frame of another video moves time on."""
    rng, rows, grid = random.Random(44), [], [0.0] * 16
    for i in range(120):
        if rng.random() < 0.3:
            grid = [float(rng.randrange(256)) for _ in range(16)]
        rows += [(v, i, [x + v for x in grid], rng.getrandbits(9)) for v in (1, 2)]
    schema = "video_id long, frame_idx long, luma array<double>, phash long"
    frames = spark.createDataFrame(rows, schema)
    wanted = {tuple(r) for r in S.accept_changes(frames, mode, threshold=0.5).collect()}
    batches = [[] for _ in range(7)]
    for row in rows:
        batches[min(5, max(0, row[1] // 20 + rng.choice([-1, 0, 0, 1])))].append(row)
    batches[6] = [(3, 10_000, None, None)]
    for k, batch in enumerate(batches):
        rng.shuffle(batch)
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        timed = stream.withColumn("ts", F.timestamp_seconds(F.col("frame_idx") + 1704067200))
        Z.run_available(spark, Z.stream_ordered_frames(timed, mode, "ts", "90 seconds", threshold=0.5), str(tmp_path / "out"), str(tmp_path / "check"))
    except Exception as error:  # the state processor needs a protobuf module that a Python may lack
        if "protobuf" in str(error):
            pytest.skip("no protobuf for the state processor")
        raise
    finally:
        if before is not None:
            spark.conf.set(store, before)
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("video_id < 3").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 5
