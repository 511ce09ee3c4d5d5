"""The capture pipelines: candidates, accepted changes, probes in gaps, groups and file names, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames as M
from ..functions import paths as P
from ..operators import groups as G
from ..operators import sequence as S


def _seconds() -> Column:
    return F.col("frame_idx") / F.col("_fps")


def _hexed() -> Column:
    return F.lower(F.lpad(F.hex("phash"), 16, "0"))


def _timed(frames: DataFrame, videos: DataFrame, mode: str, step: int | None) -> tuple[DataFrame, DataFrame]:
    """The videos with _fps and the stride _step of a mode, and the frames with both."""
    stride = F.lit(step) if step else S.sample_step(mode, F.col("fps"), F.col("total_frames"))
    paced = videos.select("video_id", "total_frames", F.col("fps").alias("_fps"), stride.alias("_step"))
    return paced, frames.join(paced.select("video_id", "_fps", "_step"), "video_id")


def capture_pipeline(
    frames: DataFrame, videos: DataFrame, mode: str, step: int | None = None, change: float = 0.95, threshold: float = 0.85, group: float | None = None,
    skip: float = 0.98, like: float = 0.95, shape: tuple[int, int] | None = None, window: int | None = None, edges: str = "step",
) -> DataFrame:
    """(video_id, frame_idx, group_id, subgroup_idx, filename) of the slides of a mode.

    Frames on the stride of their video (``step``, or by its length) are compared with the sampled one before; the frames
    around a change are candidates, and only these enter the folds. improved: accepted by structure and edges, probes in
    long gaps, groups of the first like leader (over 0.9), of each the sharpest slide; a slide alone has group -1.
    advanced: accepted by structure, near-copies left out (over 0.98), groups of the best leader (from 0.88), all kept.
    Times follow each video's frame rate. ``frames`` needs luma, phash and (for improved) sharpness, ``videos``
    total_frames and fps. ``shape``, ``window`` and ``edges`` are those of ``accept_changes``.
    """
    paced, timed = _timed(frames, videos, "improved", step)
    near = S.change_candidates(timed.where(F.col("frame_idx") % F.col("_step") == 0), paced, "_step", change)
    candidates = timed.join(near, ["video_id", "frame_idx"], "left_semi")
    slides = timed.join(S.accept_changes(candidates, mode, "_fps", threshold, shape, window, edges), ["video_id", "frame_idx"], "left_semi")
    if mode == "improved":
        slides = slides.unionByName(timed.join(S.probe_gaps(slides, timed, "_fps", like=like), ["video_id", "frame_idx"], "left_semi"))
        groups = G.leader_groups(slides, "first", 0.9 if group is None else group)
    else:
        groups = G.leader_groups(slides, "best", 0.88 if group is None else group, skip)
    named = groups.join(timed, ["video_id", "frame_idx"])
    if mode == "improved":
        sizes = groups.groupBy("video_id", "group_id").agg(F.count("*").alias("_size"))
        best = G.select_best(named, "sharpest", ["video_id", "group_id"]).join(sizes, ["video_id", "group_id"])
        named = best.withColumn("group_id", F.when(F.col("_size") > 1, F.col("group_id")).otherwise(-1)).withColumn("subgroup_idx", F.lit(1))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx"))
    name = P.slide_filename(number, _seconds(), _hexed(), F.col("group_id"), F.col("subgroup_idx"))
    return named.select("video_id", "frame_idx", "group_id", "subgroup_idx", name.alias("filename"))


def capture_standard(frames: DataFrame, videos: DataFrame, step: int | None = None, threshold: float = 0.8, shape: tuple[int, int] | None = None, window: int | None = None) -> DataFrame:
    """(video_id, frame_idx, slide_index, filename): one frame a second (or every ``step``-th), accepted two seconds after
    the last accepted one if unlike it, and unlike the hash of all accepted ones; slides are numbered from 0. ``frames``
    needs luma and phash, ``videos`` total_frames and fps. Frames without luma are passed over."""
    _, timed = _timed(frames, videos, "standard", step)
    sampled = timed.where((F.col("frame_idx") % F.col("_step") == 0) & F.col("luma").isNotNull())
    slides = timed.join(S.accept_changes(sampled, "standard", "_fps", threshold, shape, window), ["video_id", "frame_idx"], "left_semi")
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1
    numbered = slides.withColumn("slide_index", index)
    return numbered.select("video_id", "frame_idx", "slide_index", P.slide_filename(F.col("slide_index"), _seconds(), _hexed()).alias("filename"))


def capture_ultra(
    frames: DataFrame, videos: DataFrame, step: int | None = None, threshold: float = 0.85, high: float = 0.95, low: float = 0.85, least: float = 0.01,
    shape: tuple[int, int] | None = None, window: int | None = None, kernel: int | None = None,
) -> DataFrame:
    """(video_id, frame_idx, group_id, subgroup_idx, filename) of slides and their animation states.

    A dense scan picks the first sample, samples unlike the one before and partial changes; of the frames around them
    (by threes) exact copies go. Candidates alike in a row are a group (from 1), of which the frames whose edges change
    are kept, and numbered from 1. ``frames`` needs luma, ``videos`` total_frames and fps. Frames without luma are passed
    over.
    """
    paced, timed = _timed(frames.where(F.col("luma").isNotNull()), videos, "ultra", step)
    sampled = timed.where(F.col("frame_idx") % F.col("_step") == 0)
    in_order = Window.partitionBy("video_id").orderBy("frame_idx")
    picked = S.dense_candidates(sampled, threshold, "_fps", shape, window, kernel).withColumn("_n", F.row_number().over(in_order))
    near = S.around(picked, paced, "_step", 3, F.col("_n") == 1)
    scanned = timed.join(near, ["video_id", "frame_idx"], "left_semi").withColumn("_md5", M.thumb_fingerprint(F.col("luma")))
    grouped = S.animation_groups(S.first_of_copies(scanned, fingerprint="_md5"), high, low, fps="_fps", shape=shape, window=window, kernel=kernel)
    kept = grouped.select("video_id", "frame_idx", "_fps").join(S.key_frames(grouped, least=least, shape=shape), ["video_id", "frame_idx"])
    states = Window.partitionBy("video_id", "group_no")
    state, of = F.row_number().over(states.orderBy("frame_idx")), F.count("*").over(states)
    numbered = kept.withColumn("subgroup_idx", state).withColumn("_of", of).withColumn("_number", F.row_number().over(in_order))
    name = P.animation_filename(F.col("_number"), _seconds(), F.col("group_no"), F.col("subgroup_idx"), F.col("_of"))
    return numbered.select("video_id", "frame_idx", F.col("group_no").alias("group_id"), "subgroup_idx", name.alias("filename"))


def capture_animation(
    frames: DataFrame, videos: DataFrame, step: int | None = None, fine: int | None = None, threshold: float = 0.85, stop: float = 0.7, most_cells: int = 4,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """(video_id, frame_idx, group_id, subgroup_idx, filename) of main slides and the animation states after each.

    Main slides are samples (every two seconds, or ``step``) under ``threshold`` like the last one, numbered from 1; states
    are read half a second (or ``fine`` frames) apart from each main slide on, and numbered from 2. ``frames`` needs luma,
    ``videos`` total_frames and fps. Frames without luma are passed over.
    """
    _, timed = _timed(frames.where(F.col("luma").isNotNull()), videos, "main", step)
    main = S.accept_changes(timed.where(F.col("frame_idx") % F.col("_step") == 0), "main", "_fps", threshold)
    every = F.lit(fine) if fine else S.sample_step("animation", F.col("_fps"), F.lit(None))
    slides = timed.join(main, ["video_id", "frame_idx"], "left_semi").withColumn("_fine", every)
    states = S.animation_states(timed, slides, "_fps", stop=stop, most_cells=most_cells, step="_fine", shape=shape)
    both = states.unionByName(main.withColumn("main_idx", F.col("frame_idx"))).join(videos.select("video_id", F.col("fps").alias("_fps")), "video_id")
    by_main = Window.partitionBy("video_id").orderBy("main_idx")
    placed = both.withColumn("group_id", F.dense_rank().over(by_main)).withColumn("subgroup_idx", F.row_number().over(Window.partitionBy("video_id", "main_idx").orderBy("frame_idx")))
    name = P.state_filename(F.col("group_id"), _seconds(), F.col("subgroup_idx"))
    return placed.select("video_id", "frame_idx", "group_id", "subgroup_idx", name.alias("filename"))
