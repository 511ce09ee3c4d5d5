"""Structured Streaming twins of the batch operators; on bounded input each equals its batch result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequence import Walk, acceptance
from ..sources.progress_log import log_batch


def stream_new_items(items: DataFrame, progress_path: str, checkpoint: str, process=None, writer: str = "stream"):
    """Process each new item and log it (see ``log_batch``); returns the started query.

    A batch that a restarted query repeats replaces what it had logged, so an item is logged once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = process(batch) if process else batch.select("item", F.lit("processed").alias("status"))
        log_batch(done, progress_path, writer, batch_id)

    return items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_gap_groups(events: DataFrame, key: str, ts: str, gap: str, delay: str = "1 day") -> DataFrame:
    """(key, start, end, n): session windows that close after ``gap``."""
    sessions = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_exact_dedup(frames: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of every exact copy that arrives within the delay."""
    return frames.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class LastAccepted(StatefulProcessor):
    """Keeps a row whose value differs from the last accepted one by more than ``least`` and is over ``gap`` later."""

    def __init__(self, least: float, gap: float):
        self.least, self.gap = least, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "t double, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        frame = pd.concat(list(rows)).sort_values(["t", "order_id"])
        kept = []
        for row in frame.itertuples():
            if last is None or (abs(row.v - last[1]) > self.least and row.t - last[0] > self.gap):
                last = (float(row.t), float(row.v))
                kept.append((key[0], int(row.order_id), float(row.t), float(row.v)))
        if last is not None:
            self.state.update(last)
        yield pd.DataFrame(kept, columns=["key", "order_id", "t", "v"])

    def close(self) -> None:
        pass


def stream_accept_changes(series: DataFrame, least: float, gap: float) -> DataFrame:
    """(key, order_id, t, v) of accepted rows of ``series(key, order_id, t, v)``; rows of a key are ordered per batch."""
    return series.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LastAccepted(least, gap), outputStructType="key long, order_id long, t double, v double", outputMode="Append", timeMode="None"
    )


class LastAcceptedFrame(StatefulProcessor):
    """The batch fold's rule over frames; the state is the last accepted frame's number and grid."""

    def __init__(self, mode: str, fps: float, threshold: float | None):
        self.takes = acceptance(mode, fps, threshold)[0]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "frame_idx long, luma array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        grid = lambda values: None if values is None else np.asarray(values, float)
        last = [self.state.get()[0], grid(self.state.get()[1])] if self.state.exists() else None
        kept = []
        batch = pd.concat(list(rows)).sort_values("frame_idx")
        for at, luma in zip(batch.frame_idx, batch.luma):
            row = [int(at), grid(luma)]
            if self.takes(last, row):
                last = row
                kept.append((key[0], row[0]))
        if kept:
            self.state.update((last[0], None if last[1] is None else last[1].tolist()))
        yield pd.DataFrame(kept, columns=["video_id", "frame_idx"])

    def close(self) -> None:
        pass


def stream_accept_frames(frames: DataFrame, mode: str, fps: float = 1.0, threshold: float | None = None) -> DataFrame:
    """(video_id, frame_idx) of the accepted frames of a capture mode other than standard, as ``accept_changes`` has them;
    frames of a video are ordered within a batch, and later batches bring later frames."""
    if mode == "standard":
        raise ValueError("standard mode compares with all accepted hashes, which a stream does not keep")
    return frames.select("video_id", "frame_idx", "luma").groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=LastAcceptedFrame(mode, fps, threshold), outputStructType="video_id long, frame_idx long", outputMode="Append", timeMode="None"
    )


class OrderedFrames(StatefulProcessor):
    """The batch fold's rule over frames that arrive out of order: they wait, by number, until the watermark has passed them,
    and are then taken in order of time. The state is what waits, the last accepted frame and (standard mode) all accepted hashes."""

    def __init__(self, mode: str, fps: float, threshold: float | None):
        self.rule = acceptance(mode, fps, threshold)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, frame_idx long, luma array<double>, phash long")
        self.last = handle.getValueState("last", "frame_idx long, luma array<double>, phash long")
        self.hashes = handle.getListState("hashes", "h long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        come = [
            (int(ms), int(at), None if luma is None else [float(x) for x in luma], None if pd.isna(phash) else int(phash))
            for frame in rows for at, ms, luma, phash in zip(frame.frame_idx, frame.ms, frame.luma, frame.phash)
        ]
        if come:
            self.waiting.appendList(come)
            # a time that is past is due with the next watermark
            self.handle.registerTimer(max(min(x[0] for x in come), timers.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=["video_id", "frame_idx"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {x[1]: x for x in self.waiting.get()} if self.waiting.exists() else {}
        due, later = sorted((x for x in held.values() if x[0] <= now), key=lambda x: (x[0], x[1])), [tuple(x) for x in held.values() if x[0] > now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(x[0] for x in later))
        else:
            self.waiting.clear()
        grid = lambda values: None if values is None else np.asarray(values, float)
        before = self.last.get() if self.last.exists() else None
        walk = Walk(*self.rule, None if before is None else [before[0], grid(before[1]), before[2]])
        if self.rule[1] and self.hashes.exists():
            walk.hashes.extend(h[0] for h in self.hashes.get())
        seen, kept = len(walk.hashes), []
        for _, at, luma, phash in due:
            if walk.takes([at, grid(luma), phash]):
                kept.append((key[0], at))
        if kept:
            at, luma, phash = walk.last
            self.last.update((at, None if luma is None else luma.tolist(), phash))
            if len(walk.hashes) > seen:
                self.hashes.appendList([(int(h),) for h in walk.hashes[seen:]])
        yield pd.DataFrame(kept, columns=["video_id", "frame_idx"])

    def close(self) -> None:
        pass


def stream_ordered_frames(frames: DataFrame, mode: str, ts: str, delay: str, fps: float = 1.0, threshold: float | None = None) -> DataFrame:
    """(video_id, frame_idx) of the accepted frames of a capture mode, as ``accept_changes`` has them, whatever order frames
    arrive in, over batches too, as long as they are no more than ``delay`` late by their time ``ts``.

    A frame is decided once the watermark has passed it, so the last ``delay`` of a stream waits for what comes after. Of frames
    of one number the last to arrive counts. Standard mode needs phash; the others do without.
    """
    timed = frames.withWatermark(ts, delay)
    phash = F.col("phash") if "phash" in frames.columns else F.lit(None)
    # pandas holds whole numbers beside nulls as doubles, which are too short for a hash
    slim = timed.select(ts, "video_id", "frame_idx", "luma", phash.cast("long").cast("string").alias("phash"), F.unix_millis(F.col(ts)).alias("ms"))
    return slim.groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=OrderedFrames(mode, fps, threshold), outputStructType="video_id long, frame_idx long", outputMode="Append", timeMode="EventTime"
    )


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there and append its rows to a table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
