"""Operators over ordered sequences: sampling, change candidates, folds against the last accepted row, gap groups.

``frame_idx`` orders a sequence. A fold streams the sorted rows of a sequence in Arrow batches and carries only the last
accepted row (and, in standard mode, the accepted hashes). Long sequences are folded in chunks at the same time.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frames as M
from ..functions import grids as N
from ..functions import windows as W
from ..sources.staging import stage

#: Text regions more or less that make a new slide.
MORE_REGIONS = 5


def sample_step(mode: str, fps: Column, total: Column) -> Column:
    """Stride of a capture mode."""
    whole = fps.cast("int")
    return {
        "improved": F.when(total > 10000, 60).when(total > 5000, 45).otherwise(30),
        "ultra": F.when(total > 10000, 30).when(total < 1000, 10).otherwise(15),
        "standard": F.greatest(whole, F.lit(1)),
        "main": F.greatest((fps * 2).cast("int"), F.lit(30)),
        "animation": F.greatest((fps / 2).cast("int"), F.lit(5)),
        "specific": F.greatest((fps / 2).cast("int"), F.lit(1)),
    }[mode]


def sample_stride(frames: DataFrame, videos: DataFrame, mode: str) -> DataFrame:
    """Frames on the stride of their video."""
    steps = videos.select("video_id", sample_step(mode, F.col("fps"), F.col("total_frames")).alias("_step"))
    return frames.join(steps, "video_id").where(F.col("frame_idx") % F.col("_step") == 0).drop("_step")


def time_range(frames: DataFrame, start: float, stop: float) -> DataFrame:
    """Frames from ``start`` to before ``stop`` seconds."""
    return frames.where((F.col("frame_idx") >= F.floor(start * F.col("fps"))) & (F.col("frame_idx") < F.floor(stop * F.col("fps"))))


def with_previous(frames: DataFrame, *columns: str, key: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """Adds ``prev_<column>`` from the row before in the same sequence."""
    w = Window.partitionBy(key).orderBy(order)
    return frames.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def change_candidates(frames: DataFrame, videos: DataFrame, step: int | str, threshold: float = 0.95) -> DataFrame:
    """(video_id, frame_idx) around every frame (feed sampled ones) whose histogram differs from the one before.

    ``step`` is the stride of sampling, or the column of ``videos`` that has it; offsets run from -step / 2, rounded down,
    to step / 2 by fives.
    """
    changed = with_previous(frames, "luma").where(M.histogram_corr(F.col("luma"), F.col("prev_luma")) < threshold)
    return around(changed, videos, step, 5)


def around(picked: DataFrame, videos: DataFrame, step: int | str, every: int, alone: Column | None = None) -> DataFrame:
    """(video_id, frame_idx) from -step / 2, rounded down, to step / 2 around the picked frames, in steps of ``every``;
    the picked frame only where ``alone`` holds."""
    stride = F.col(step) if isinstance(step, str) else F.lit(step)
    known = videos.select("video_id", "total_frames", stride.cast("int").alias("_stride"))
    offsets = F.sequence(F.floor(-F.col("_stride") / 2).cast("int"), F.floor(F.col("_stride") / 2).cast("int"), F.lit(every))
    placed = picked.select("video_id", "frame_idx", (F.lit(False) if alone is None else alone).alias("_alone")).join(known, "video_id")
    offsets = F.when(F.col("_alone"), F.array(F.lit(0))).otherwise(offsets)
    near = placed.select("video_id", "total_frames", F.explode(F.transform(offsets, lambda o: F.col("frame_idx") + o)).alias("frame_idx"))
    return near.where((F.col("frame_idx") >= 0) & (F.col("frame_idx") < F.col("total_frames"))).select("video_id", "frame_idx").distinct()


def rate_of(fps: float | str) -> Column:
    """A frame rate given as a number, or as the column that has each video's."""
    return F.col(fps) if isinstance(fps, str) else F.lit(float(fps))


#: ``accept(last, row)``: rows are lists of the order column and the fold's columns, ``last`` is None before the first.
Accept = Callable[[list | None, list], bool]
#: Place of a hash in a row, and how far apart (bits) the hashes of accepted rows are at least.
Apart = tuple[int, int]
#: Rows of a sequence that are folded as one.
CHUNK = 1 << 14


class Walk:
    """The state of a fold: the last accepted row and, if hashes must be apart, those of all accepted rows."""

    def __init__(self, accept: Accept, apart: Apart | None, last: list | None = None):
        self.accept, self.apart, self.last, self.hashes = accept, apart, last, array("q")

    def near(self, row: list) -> bool:
        """Whether an accepted row has a hash too near this one's."""
        if not self.apart or row[self.apart[0]] is None or not self.hashes:
            return False
        # unsigned, as numpy counts the bits of a negative number's absolute value
        differ = (np.frombuffer(self.hashes, np.int64) ^ row[self.apart[0]]).view(np.uint64)
        return int(np.bitwise_count(differ).min()) < self.apart[1]

    def keep(self, row: list) -> None:
        self.last = row
        if self.apart and row[self.apart[0]] is not None:
            self.hashes.append(row[self.apart[0]])

    def takes(self, row: list) -> bool:
        if not self.accept(self.last, row) or self.near(row):
            return False
        self.keep(row)
        return True


class Repair(Walk):
    """A chunk folded again from its true entry, until that meets what was accepted from a guessed one.

    They meet at a row that both accept, as both go on from it alike; if hashes must be apart, the guess must also have no
    hash that the true walk has not. From there on only the guessed rows are looked at, and only at their hashes.
    """

    def __init__(self, accept: Accept, apart: Apart | None):
        super().__init__(accept, apart)
        self.guess, self.met, self.extra = set(), False, set()

    def decides(self, uid: int, row: list) -> bool:
        guessed = uid in self.guess
        if self.met:
            if not guessed:
                return False
            if not self.near(row):
                self.keep(row)
                return True
            self.met, took = False, False
        else:
            took = self.takes(row)
        if self.apart:
            value = row[self.apart[0]]
            if took:
                self.extra.discard(value)
            elif guessed and value is not None:
                self.extra.add(value)
        self.met = took and guessed and not self.extra
        return took


def fold_accepted(rows: DataFrame, key: str, order: str, columns: list[str], accept: Accept, apart: Apart | None = None, chunk: int = CHUNK) -> DataFrame:
    """(key, order) of the rows that are accepted, one after the other.

    Sequences are hashed to partitions and sorted there, so that batches of a sequence come in its order and no sequence
    is ever held as a whole. A sequence of more than ``chunk`` rows is cut by its order, and its chunks are folded at the same
    time: each from nothing, then again from what the chunk before ended with, until no entry changes.
    """
    slim = rows.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), *columns)
    sizes = slim.groupBy("k").agg(F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).where(F.col("n") > chunk)
    long = stage(sizes.withColumn("kid", F.monotonically_increasing_id()).withColumnRenamed("k", "kk"), "long")
    if long.isEmpty():
        return _fold_whole(slim, columns, accept, apart).toDF(key, order)
    same = F.col("k").eqNullSafe(F.col("kk"))
    short = _fold_whole(slim.join(long, same, "left_anti"), columns, accept, apart)
    pieces = F.ceil(F.col("n") / chunk)
    place = F.floor((F.col("o") - F.col("low")).cast("double") * pieces / (F.col("high") - F.col("low") + 1).cast("double"))
    cut = slim.join(long, same).select("kid", F.coalesce(place, F.lit(0)).alias("c"), "o", F.monotonically_increasing_id().alias("uid"), *columns)
    found = _fold_chunks(stage(cut, "chunks"), columns, accept, apart).join(long, "kid").select(F.col("kk").alias("k"), "o")
    return short.unionByName(found).toDF(key, order)


def _fold_whole(slim: DataFrame, columns: list[str], accept: Accept, apart: Apart | None) -> DataFrame:
    schema = T.StructType([slim.schema["k"], T.StructField("o", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = walk = None
        for batch in batches:
            keys, taken = batch.column("k").to_pylist(), np.zeros(batch.num_rows, bool)
            for i, (k, *row) in enumerate(zip(keys, batch.column("o").to_pylist(), *[cells(batch.column(c)) for c in columns])):
                if walk is None or k != name:
                    name, walk = k, Walk(accept, apart)
                taken[i] = walk.takes(row)
            mask = pa.array(taken)
            yield pa.RecordBatch.from_arrays([batch.column("k").filter(mask), batch.column("o").filter(mask)], names=["k", "o"])

    return slim.repartition("k").sortWithinPartitions("k", "o").mapInArrow(fold, schema)


#: Kinds of rows of a chunk, in the order in which its task reads them: what the walk enters with, guessed rows, its own.
_ENTRY, _GUESS, _ROW = range(3)


def _fold_chunks(rows: DataFrame, columns: list[str], accept: Accept, apart: Apart | None) -> DataFrame:
    """(kid, o) of the accepted ones of ``rows(kid, c, o, uid, columns)``."""
    schema = "kid long, c long, o long, uid long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = walk = None
        for batch in batches:
            names = list(zip(batch.column("kid").to_pylist(), batch.column("c").to_pylist()))
            taken, uids = np.zeros(batch.num_rows, bool), batch.column("uid").to_pylist()
            fields = (batch.column("kind").to_pylist(), uids, cells(batch.column("past")), batch.column("o").to_pylist(), *[cells(batch.column(c)) for c in columns])
            for i, (kind, uid, past, *row) in enumerate(zip(*fields)):
                if names[i] != name:
                    name, walk = names[i], Repair(accept, apart)
                if kind == _ROW:
                    taken[i] = walk.decides(uid, row)
                elif kind == _GUESS:
                    walk.guess.add(uid)
                else:
                    walk.last = [x.copy() if isinstance(x, np.ndarray) else x for x in row]
                    walk.hashes.extend([] if past is None else past.tolist())
            mask = pa.array(taken)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("kid", "c", "o", "uid")], names=["kid", "c", "o", "uid"])

    def folded(own: DataFrame, *more: DataFrame) -> DataFrame:
        both = own.select("kid", "c", F.lit(_ROW).alias("kind"), "o", "uid", F.lit(None).cast("array<long>").alias("past"), *columns)
        for other in more:
            both = both.unionByName(other, allowMissingColumns=True)
        return stage(both.repartition("kid", "c").sortWithinPartitions("kid", "c", "kind", "o", "uid").mapInArrow(fold, schema), "folded")

    chunks = stage(rows.select("kid", "c").distinct(), "pieces")
    first, known = folded(rows), chunks.select("kid", "c", F.lit(None).cast("long").alias("entered"))
    accepted = first
    before = Window.partitionBy("kid").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    hashed = columns[apart[0] - 1] if apart else None
    while True:
        ends = accepted.groupBy("kid", "c").agg(F.max(F.struct("o", "uid"))["uid"].alias("end"), F.bit_xor(F.xxhash64("uid")).alias("print"))
        entered = F.last("end", ignorenulls=True).over(before)
        # with hashes apart a chunk enters with all rows accepted before, else with the last one
        seen = F.bit_xor("print").over(before) if apart else entered
        entries = stage(chunks.join(ends, ["kid", "c"], "left").select("kid", "c", entered.alias("uid"), seen.alias("entered")), "entries")
        dirty = entries.join(known.withColumnRenamed("entered", "was"), ["kid", "c"]).where(~F.col("entered").eqNullSafe(F.col("was"))).select("kid", "c", "uid")
        dirty = stage(dirty, "dirty")
        if dirty.isEmpty():
            return accepted.select("kid", "o")
        known = entries.select("kid", "c", "entered")
        heads = dirty.withColumnRenamed("c", "at").join(rows.drop("c"), ["kid", "uid"]).select("kid", F.col("at").alias("c"), F.lit(_ENTRY).alias("kind"), "o", "uid", *columns)
        # a guess that entered with hashes may have refused what they were near; the first entered with none
        guesses = (first if apart else accepted).join(dirty.select("kid", "c"), ["kid", "c"], "left_semi").select("kid", "c", F.lit(_GUESS).alias("kind"), "o", "uid")
        if apart:
            own = accepted.join(rows.select("kid", "uid", hashed), ["kid", "uid"]).groupBy("kid", "c").agg(F.collect_list(hashed).alias("held"))
            past = chunks.join(own, ["kid", "c"], "left").select("kid", "c", F.flatten(F.collect_list("held").over(before)).alias("past"))
            heads = heads.join(past, ["kid", "c"])
        again = folded(rows.join(dirty.select("kid", "c"), ["kid", "c"], "left_semi"), heads, guesses)
        accepted = stage(accepted.join(dirty.select("kid", "c"), ["kid", "c"], "left_anti").unionByName(again), "accepted")


def cells(column: pa.Array) -> Iterator:
    """Values of a column; lists of numbers as arrays, which share the batch's memory."""
    if not pa.types.is_list(column.type):
        yield from column.to_pylist()
        return
    flat, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i, missing in enumerate(column.is_null().to_pylist()):
        yield None if missing else flat[bounds[i] : bounds[i + 1]]


def acceptance(mode: str, fps: float | None = 1.0, threshold: float | None = None, shape: tuple[int, int] | None = None, window: int | None = None, edges: str = "step") -> tuple[Accept, Apart | None]:
    """The rule of a mode over rows of order, luma, hash (standard mode), and the frame rate if ``fps`` is None, and how far
    apart hashes must be; see ``accept_changes``."""
    limit = threshold if threshold is not None else {"standard": 0.8, "coarse": 0.5, "main": 0.85}.get(mode, 0.85)
    plane = lambda g: g.reshape(1, *W.shape_of(len(g), shape)[::-1])
    like = N.ssim if window is None else lambda a, b: float(W.window_ssim(plane(a), plane(b), window)[0])

    def ranged(a: np.ndarray, b: np.ndarray) -> bool:
        like = N.pixel_corr(a, b)
        return N.mean_abs_diff(a, b) > 5 or like is not None and like < 0.98

    def redrawn(a: np.ndarray, b: np.ndarray) -> bool:
        if like(a, b) < limit:
            return True
        alike = 1 - N.edge_change(a, b, *W.shape_of(len(a), shape)) if edges == "step" else float(W.edge_similarity(plane(a), plane(b))[0])
        # a grid of fewer pixels than a region needs has none
        return alike < 0.9 or len(a) > W.TEXT_AREA and abs(int(W.text_regions(plane(a))[0]) - int(W.text_regions(plane(b))[0])) > MORE_REGIONS

    alike = lambda a, b: like(a, b) < limit
    unlike = {"improved": redrawn, "advanced": alike, "standard": alike, "coarse": alike, "range": ranged, "main": lambda a, b: N.mse_similarity(a, b) < limit}[mode]
    least = {"improved": 1.0, "advanced": 0.5}.get(mode)

    def accept(last: list | None, row: list) -> bool:
        at, luma, rate = row[0], row[1], row[-1] if fps is None else fps
        if least is not None and not at - (last[0] if last else -1) > least * rate:
            return False
        first = last is None or last[1] is None
        return first or not (luma is None or mode == "standard" and (at - last[0]) / rate < 2.0 or not unlike(last[1], luma))

    return accept, (2, 5) if mode == "standard" else None


def accept_changes(
    frames: DataFrame, mode: str, fps: float | str = 1.0, threshold: float | None = None, shape: tuple[int, int] | None = None, window: int | None = None, edges: str = "step", chunk: int = CHUNK,
) -> DataFrame:
    """(video_id, frame_idx) of the accepted frames of a capture mode, each compared with the last accepted one.

    improved: first, or structural similarity under the threshold, or edges less than 0.9 alike, or over 5 text regions more
    or less; and more than a second later. advanced: structural similarity only, more than half a second later. standard: at
    least two seconds later and under the threshold, then not within a Hamming distance under 5 of any accepted hash. range:
    mean difference over 5 or correlation under 0.98. coarse: structural similarity under 0.5. main: mean-square similarity
    under 0.85. ``fps`` is a number, or the column of ``frames`` that has each video's. A frame without luma is accepted
    only where a first one would be. ``shape`` is the grids' width and height (square ones need none); ``window`` the side of
    sliding windows for structural similarity, None for the whole grid at once; ``edges`` is ``step``, or ``slope`` for
    gradients with two thresholds.
    """
    named = isinstance(fps, str)
    columns = (["luma", "phash"] if mode == "standard" else ["luma"]) + ([fps] if named else [])
    accept, apart = acceptance(mode, None if named else fps, threshold, shape, window, edges)
    return fold_accepted(frames, "video_id", "frame_idx", columns, accept, apart, chunk)


def dense_candidates(frames: DataFrame, threshold: float = 0.85, fps: float | str = 1.0, shape: tuple[int, int] | None = None, window: int | None = None, kernel: int | None = None) -> DataFrame:
    """(video_id, frame_idx): first sample, samples unlike the one before, and partial changes over two seconds after
    the last emitted sample. ``fps`` is a number, or the column of ``frames`` that has each video's. ``window`` and ``shape`` are
    those of ``accept_changes``; ``kernel`` is the side of the opening of changes, None for the changed pixels as they are."""
    pairs = with_previous(frames, "luma")
    flags = pairs.select(
        "video_id", "frame_idx", F.col("prev_luma").isNull().alias("start"),
        F.coalesce(likeness(shape, window) < threshold, F.lit(False)).alias("unlike"),
        F.coalesce(partly_changed(shape, kernel), F.lit(False)).alias("partly"), rate_of(fps).alias("rate"),
    )
    return fold_accepted(
        flags, "video_id", "frame_idx", ["start", "unlike", "partly", "rate"],
        lambda last, row: row[1] or row[2] or (row[3] and row[0] - (last[0] if last else -1) > 2 * row[4]),
    )


def likeness(shape: tuple[int, int] | None, window: int | None) -> Column:
    """Structural similarity of luma and prev_luma: of the whole grid, or over sliding windows."""
    a, b = F.col("luma"), F.col("prev_luma")
    return M.ssim(a, b) if window is None else W.window_ssim_of(a, b, shape, window)


def partly_changed(shape: tuple[int, int] | None, kernel: int | None) -> Column:
    """Whether a part of luma, and no more, differs from prev_luma."""
    a, b = F.col("luma"), F.col("prev_luma")
    return M.has_change(a, b) if kernel is None else W.has_opened_change(a, b, shape, kernel)


def first_of_copies(frames: DataFrame, key: str = "video_id", order: str = "frame_idx", fingerprint: str = "md5") -> DataFrame:
    """The first row of every exact copy within a sequence."""
    w = Window.partitionBy(key, fingerprint).orderBy(order)
    return frames.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def islands(rows: DataFrame, key: str, order: str, starts: Column, name: str = "group_no") -> DataFrame:
    """Adds the running number (from 1) of groups that begin where ``starts`` holds or is null."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def animation_groups(
    frames: DataFrame, high: float = 0.95, low: float = 0.85, max_gap: float = 10.0, fps: float | str = 1.0, shape: tuple[int, int] | None = None, window: int | None = None, kernel: int | None = None,
) -> DataFrame:
    """Adds group_no: a frame stays with the one before if alike, or fairly alike, partly changed and soon after. ``fps``
    is a number, or the column of ``frames`` that has each video's; the rest as for ``dense_candidates``."""
    pairs = with_previous(frames, "luma", "frame_idx").withColumns({"_like": likeness(shape, window), "_partly": partly_changed(shape, kernel)})
    like = F.col("_like")
    soon = (F.col("frame_idx") - F.col("prev_frame_idx")) / rate_of(fps) < max_gap
    same = (like > high) | ((like > low) & F.col("_partly") & soon)
    return islands(pairs, "video_id", "frame_idx", ~same).drop("prev_luma", "prev_frame_idx", "_like", "_partly")


def gap_groups(rows: DataFrame, key: str, ts: str, gap: float, order: str | None = None) -> DataFrame:
    """Adds group_no: a new group where the time since the row before is at least ``gap``."""
    w = Window.partitionBy(key).orderBy(ts, *([order] if order else []))
    flagged = rows.withColumn("_new", (F.coalesce(F.col(ts) - F.lag(ts).over(w) >= gap, F.lit(True))).cast("int"))
    return flagged.withColumn("group_no", F.sum("_new").over(w)).drop("_new")


def key_frames(frames: DataFrame, group: str = "group_no", least: float = 0.01, shape: tuple[int, int] | None = None) -> DataFrame:
    """(video_id, group, frame_idx): the first, then every frame whose edges changed since the last kept one; the last
    one too where only the first is left. ``shape`` is the grids' width and height, if they are not square."""
    keyed = frames.withColumn("_key", F.struct("video_id", group))
    kept = fold_accepted(
        keyed, "_key", "frame_idx", ["luma"],
        lambda last, row: last is None or last[1] is None or row[1] is not None and N.edge_change(last[1], row[1], *W.shape_of(len(row[1]), shape)) > least,
    )
    last = keyed.groupBy("_key").agg(F.max("frame_idx").alias("frame_idx"))
    lonely = kept.groupBy("_key").agg(F.count("*").alias("n")).where("n = 1").join(last, "_key").select("_key", "frame_idx")
    return kept.union(lonely).distinct().select("_key.video_id", F.col(f"_key.{group}").alias(group), "frame_idx")


def animation_states(
    frames: DataFrame, mains: DataFrame, fps: float | str = 1.0, span: float = 60.0, least_gap: float = 1.0, stop: float = 0.7, most_cells: int = 4, step: int | str = 1,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """(video_id, main_idx, frame_idx): animation states after each main slide.

    Every ``step``-th frame after a main slide and before the next (or ``span`` seconds on) is read until one is under
    ``stop`` like the main slide; a frame counts if one to ``most_cells`` grid cells differ from the last state and the
    gap is long enough. ``fps`` and ``step`` are numbers, or columns of ``mains`` that have each video's.
    ``shape`` is the grids' width and height, if they are not square.
    """
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    stride = F.col(step) if isinstance(step, str) else F.lit(step)
    mains = mains.select("video_id", "frame_idx", "luma", rate_of(fps).alias("_rate"), stride.alias("_every"))
    ends = F.coalesce(F.lead("frame_idx").over(w), F.col("frame_idx") + F.floor(F.lit(float(span)) * F.col("_rate")).cast("long"))
    opened = F.struct(F.col("frame_idx").alias("main_idx"), F.col("luma").alias("base"), ends.alias("end_idx"), "_rate", "_every")
    # spans do not overlap, so the last main slide up to a frame is the only one that it can belong to
    lines = frames.select("video_id", "frame_idx", "luma").unionByName(mains.select("video_id", "frame_idx", opened.alias("_main")), allowMissingColumns=True)
    placed = lines.withColumn("_main", F.last("_main", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    read = placed.select("video_id", "frame_idx", "luma", "_main.*")
    pairs = read.where("frame_idx > main_idx AND frame_idx < end_idx AND (frame_idx - main_idx) % _every = 0")
    near = pairs.withColumn("_ok", (M.mse_similarity(F.col("base"), F.col("luma")) >= stop).cast("int"))
    run = Window.partitionBy("video_id", "main_idx").orderBy("frame_idx")
    read = near.withColumn("_open", F.min("_ok").over(run)).where("_open = 1").select("video_id", "main_idx", "frame_idx", "luma", "_rate")
    seeds = mains.select("video_id", F.col("frame_idx").alias("main_idx"), "frame_idx", "luma", "_rate")
    keyed = read.unionByName(seeds).withColumn("_key", F.struct("video_id", "main_idx"))
    states = fold_accepted(
        keyed, "_key", "frame_idx", ["luma", "_rate"],
        lambda last, row: last is None or last[1] is None
        or row[1] is not None and 1 <= N.changed_cells(last[1], row[1], *W.shape_of(len(row[1]), shape)) <= most_cells and (row[0] - last[0]) / row[2] >= least_gap,
    )
    return states.select("_key.video_id", "_key.main_idx", "frame_idx").where("frame_idx > main_idx")


def probe_gaps(slides: DataFrame, frames: DataFrame, fps: float | str = 1.0, gap: float = 30.0, every: float = 5.0, like: float = 0.95) -> DataFrame:
    """(video_id, frame_idx) of probes in long gaps between slides that are like none of the slides around. ``fps`` is a
    number, or the column of ``slides`` that has each video's."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    step = F.floor(F.col("_rate") * every).cast("long")
    placed = slides.select("video_id", "frame_idx", "luma", rate_of(fps).alias("_rate"), F.row_number().over(w).alias("pos"), F.lead("frame_idx").over(w).alias("next_idx"))
    long = placed.where((F.col("next_idx") - F.col("frame_idx") > F.col("_rate") * gap) & (step > 0) & (F.col("frame_idx") + step < F.col("next_idx")))
    probes = long.select("video_id", "pos", F.explode(F.sequence(F.col("frame_idx") + step, F.col("next_idx") - 1, step)).alias("frame_idx"))
    seen = probes.join(frames.select("video_id", "frame_idx", F.col("luma").alias("probe")), ["video_id", "frame_idx"])
    near = seen.select("*", F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("near")).join(
        placed.select("video_id", F.col("pos").alias("near"), "luma"), ["video_id", "near"]
    )
    alike = near.where(M.ssim(F.col("luma"), F.col("probe")) > like).select("video_id", "frame_idx")
    return seen.select("video_id", "frame_idx").join(alike, ["video_id", "frame_idx"], "left_anti")
