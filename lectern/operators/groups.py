"""Grouping of slides: similar pairs, leader groups, choice within groups, renumbering, group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .leaders import lead, leader_groups  # noqa: F401  (part of this module's interface)
from .near import similar_pairs  # noqa: F401


def group_summary(slides: DataFrame, *keys: str) -> DataFrame:
    """Slides, time range and ordered members of every group."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx"))), lambda m: m["frame_idx"])
    return slides.groupBy(*keys).agg(
        F.count("*").alias("slide_count"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), members.alias("members")
    )


def group_statistics(slides: DataFrame, key: str = "video_id", group: str = "group_id") -> DataFrame:
    """Totals, slides per group and the distribution of group sizes, per key."""
    sizes = slides.groupBy(key, group).agg(F.count("*").alias("n"))
    spread = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(group), F.col("n")))))
    return sizes.groupBy(key).agg(F.sum("n").alias("total_slides"), F.count("*").alias("total_groups"), (F.sum("n") / F.greatest(F.count("*"), F.lit(1))).alias("slides_per_group"), spread.alias("distribution"))


def group_count_with_singles(slides: DataFrame, key: str, group: str) -> DataFrame:
    """Groups plus slides without one (null or negative)."""
    inside = F.col(group) >= 0
    return slides.groupBy(key).agg((F.count_distinct(F.when(inside, F.col(group))) + F.count_if(~F.coalesce(inside, F.lit(False)))).alias("group_count"))


def select_best(slides: DataFrame, rule: str, keys: list[str], order: str = "frame_idx", sharpness: str = "sharpness") -> DataFrame:
    """One slide of every group, and every slide without a group: middle (element n // 2 from 0), first, or sharpest (the
    earliest on ties). The last of ``keys`` is the group's number; where it is null or negative, a slide stands alone and stays.
    """
    alone = F.col(keys[-1]).isNull() | (F.col(keys[-1]) < 0)
    # a slide alone is a group of its own, so many of them do not share a task
    own = F.when(alone, F.struct(*(F.col(c) for c in keys), F.col(order)))
    w = Window.partitionBy(*keys, own)
    if rule == "sharpest":
        number = F.row_number().over(w.orderBy(F.desc(sharpness), order))
        ranked = slides.withColumns({"_alone": alone, "_n": number, "_best": F.lit(1)})
    else:
        best = F.lit(1) if rule == "first" else F.floor(F.count("*").over(w) / 2) + 1
        ranked = slides.withColumns({"_alone": alone, "_n": F.row_number().over(w.orderBy(order)), "_best": best})
    return ranked.where("_alone OR _n = _best").drop("_alone", "_n", "_best")


def drop_close_duplicates(slides: DataFrame, keys: list[str], similarity: Column, max_gap: float = 1.0, threshold: float = 0.95, order: str = "timestamp") -> DataFrame:
    """Leaves out a slide that follows the one before it in its group within the gap and is over the threshold like it.

    ``similarity`` is an expression on luma and prev_luma.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    paired = slides.withColumn("prev_luma", F.lag("luma").over(w)).withColumn("_gap", F.col(order) - F.lag(order).over(w))
    return paired.where(~F.coalesce((F.col("_gap") < max_gap) & (similarity > threshold), F.lit(False))).drop("prev_luma", "_gap")


def animation_sequence_flag(frames: DataFrame, keys: list[str], similarity: Column, threshold: float = 0.85) -> DataFrame:
    """Per group: frames, mean similarity of neighbours, and whether it is an animation (two frames and more)."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    scored = frames.withColumn("prev_luma", F.lag("luma").over(w)).withColumn("_s", similarity)
    out = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_s").alias("mean_similarity"))
    return out.withColumn("animated", (F.col("n") >= 2) & F.coalesce(F.col("mean_similarity") > threshold, F.lit(False)))


def retain_existing(slides: DataFrame, files: DataFrame, name: str = "filename") -> DataFrame:
    """Slides whose file is still there."""
    return slides.join(files.select(name).distinct(), name, "left_semi")


def recount_groups(groups: DataFrame, slides: DataFrame, *keys: str) -> DataFrame:
    """Groups with slide_count recounted over the slides that are left, 0 for an emptied one; time ranges stay."""
    left = slides.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = groups.join(left, list(keys), "left")
    return joined.select(*[F.coalesce("_n", F.lit(0)).cast("long").alias(c) if c == "slide_count" else F.col(c) for c in groups.columns])


def apply_rename(slides: DataFrame, plan: DataFrame) -> DataFrame:
    """New index and file name where ``plan(old_name, new_name, new_index)`` has the old one."""
    joined = slides.join(plan, slides.filename == plan.old_name, "left")
    changed = {"filename": F.coalesce("new_name", "filename"), "slide_index": F.coalesce("new_index", "slide_index")}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in slides.columns])
