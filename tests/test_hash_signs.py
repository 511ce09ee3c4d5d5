"""Hashes that differ in their first bit, which is the sign of a BIGINT: alike but for it, or unlike in all bits."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import sequence as S
from lectern.plans import queries
from lectern.plans.capture import capture_standard
from lectern.streaming import progress as Z

BIT = -(1 << 63)
#: Of 1, 1 and 64 bits from the first hash: only the last is far from it.
HASHES = [5, 5 ^ BIT, 5 ^ BIT ^ 1, ~5]


def shown(spark, hashes=HASHES, luma=None):
    rows = [(0, i * 2, luma or [255.0 * ((p + i) % 2) for p in range(64)], h) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "video_id long, frame_idx long, luma array<double>, phash long")


@pytest.mark.parametrize("chunk", [1, S.CHUNK])
def test_accept_standard(spark, chunk):
    found = S.accept_changes(shown(spark), "standard", threshold=2.0, chunk=chunk).collect()
    assert sorted(r["frame_idx"] for r in found) == [0, 6]


def test_stream_of_frames(spark, tmp_path):
    """The first two hashes and the last meet over batches, beside a frame without a hash, which leaves the others as they are."""
    big = (1 << 62) + 1
    frames = shown(spark, [big, big ^ BIT, None, ~big, ~big ^ 0b11111])
    wanted = sorted(r["frame_idx"] for r in S.accept_changes(frames, "standard", threshold=2.0).collect())
    assert wanted == [0, 4, 6, 8]
    for k in range(2):
        frames.where(F.col("frame_idx") > 3 if k else F.col("frame_idx") <= 3).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        timed = stream.withColumn("ts", F.timestamp_seconds(F.col("frame_idx") + 1704067200))
        Z.run_available(spark, Z.stream_ordered_frames(timed, "standard", "ts", "90 seconds", threshold=2.0), str(tmp_path / "o"), str(tmp_path / "c"))
        # a frame of a later time moves the watermark on
        assert spark.read.schema("video_id long, frame_idx long").parquet(str(tmp_path / "o")).count() == 0
        late = shown(spark, [0]).withColumn("video_id", F.lit(1).cast("long")).withColumn("frame_idx", F.lit(1000).cast("long"))
        late.coalesce(1).write.parquet(str(tmp_path / "in" / "part=2"))
        Z.run_available(spark, Z.stream_ordered_frames(timed, "standard", "ts", "90 seconds", threshold=2.0), str(tmp_path / "o"), str(tmp_path / "c"))
    except Exception as error:  # the state processor needs a protobuf module that a Python may lack
        if "protobuf" in str(error):
            pytest.skip("no protobuf for the state processor")
        raise
    finally:
        if before is not None:
            spark.conf.set(store, before)
    found = spark.read.parquet(str(tmp_path / "o")).where("video_id = 0").collect()
    assert sorted(r["frame_idx"] for r in found) == wanted


def test_capture_standard(spark):
    videos = spark.createDataFrame([(0, 8, 1.0)], "video_id long, total_frames long, fps double")
    slides = capture_standard(shown(spark), videos, threshold=2.0).orderBy("slide_index").collect()
    assert [r["filename"] for r in slides] == ["slide_000_t0m0.0s_h00000000.jpg", "slide_001_t0m6.0s_hffffffff.jpg"]


def test_capture_standard_at_length(spark, tmp_path):
    """The query and its SQL on more than 1,000 slides, with later near-copies of frames whose hashes differ in the first bit and few others."""
    random = np.random.default_rng(3)
    g = random.normal(size=(9000, 64))
    g[6000:] = g[:3000] - 2 * g[:3000].mean(axis=1, keepdims=True) + random.normal(size=(3000, 64)) / 20
    rows = [(i, v, 0) for i, v in enumerate(g.astype(np.float32).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    name, columns = "w21_capture_standard", ["video_id", "frame_idx", "slide_index", "filename"]
    found = sorted(map(tuple, queries.queries()[name](spark, str(tmp_path)).select(columns).collect()))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())
    assert len(wanted) > 1000
    assert found == wanted
