"""Transcript operators: sentences, timed cues, subtitles, translation batches, request tables, repetition loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"^\s+|\s+$"
BATCH = 30
SEGMENT_SECONDS = 600.0
TAIL = 200


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def sentence_list(text: Column) -> Column:
    """Sentences between full stops of either script, stripped, without empty ones (decimals split too)."""
    return F.filter(F.transform(F.split(text, "[.。]"), stripped), lambda s: s != "")


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence: sentence_no from 0 and sentence, beside the other columns."""
    return docs.select("*", F.posexplode(sentence_list(F.col(text))).alias("sentence_no", "sentence")).drop(text)


def cues_even(segments: DataFrame) -> DataFrame:
    """Sentences share their segment's duration; (doc_id, cue_no, start_s, end_s, text), numbered over the document."""
    listed = segments.withColumn("_s", sentence_list(F.col("text")))
    each = listed.select("doc_id", "seg_no", "start", (F.col("duration") / F.size("_s")).alias("_share"), F.posexplode("_s").alias("_k", "_text"))
    w = Window.partitionBy("doc_id").orderBy("seg_no", "_k")
    return each.select(
        "doc_id", F.row_number().over(w).alias("cue_no"), (F.col("start") + F.col("_k") * F.col("_share")).alias("start_s"),
        (F.col("start") + (F.col("_k") + 1) * F.col("_share")).alias("end_s"), F.concat("_text", F.lit("。")).alias("text"),
    )


def cues_by_length(docs: DataFrame) -> DataFrame:
    """Cues one after the other, each 0.3 seconds a character, at least 2 and at most 10; counted in tenths."""
    each = docs.select("doc_id", F.posexplode(sentence_list(F.col("text"))).alias("_k", "_text"))
    tenths = F.least(F.greatest(F.length("_text") * 3, F.lit(20)), F.lit(100))
    w = Window.partitionBy("doc_id").orderBy("_k")
    end = F.sum(tenths).over(w)
    return each.select("doc_id", (F.col("_k") + 1).alias("cue_no"), ((end - tenths) / 10.0).alias("start_s"), (end / 10.0).alias("end_s"), F.concat("_text", F.lit("。")).alias("text"))


def offset_cues(segments: DataFrame) -> DataFrame:
    """Cues of ``segments(doc_id, seg_no, start, cues)`` on the document's clock."""
    each = segments.select("doc_id", "seg_no", "start", F.posexplode("cues").alias("pos", "c"))
    return each.select("doc_id", "seg_no", "pos", (F.col("start") + F.col("c.start")).alias("start_s"), (F.col("start") + F.col("c.end")).alias("end_s"), F.col("c.text").alias("text"))


def cues_precise(segments: DataFrame) -> DataFrame:
    """Timed cues of all segments, stripped and numbered over the document."""
    w = Window.partitionBy("doc_id").orderBy("seg_no", "pos")
    return offset_cues(segments).select("doc_id", F.row_number().over(w).alias("cue_no"), "start_s", "end_s", stripped(F.col("text")).alias("text"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with milliseconds cut off."""
    ms = F.floor(F.round(seconds * 1e6) / 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda x: F.floor(x).cast("long")
    hours = whole(ms / 3600000)
    shown = F.when(hours < 10, two(hours)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), two(whole(ms / 60000) % 60), F.lit(":"), two(whole(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def srt_render(cues: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, srt): numbered blocks with times and text, in order, one per document."""
    block = F.concat_ws("\n", F.col("cue_no").cast("string"), F.concat(srt_time(F.col("start_s")), F.lit(" --> "), srt_time(F.col("end_s"))), F.col("text"), F.lit(""))
    return cues.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", block.alias("b")))), lambda x: x["b"]), "\n").alias("srt"))


def srt_cues(files: DataFrame, key: str = "doc_id", text: str = "srt") -> DataFrame:
    """(key, cue_no, text) of subtitle files: a line of digits opens a block, a time line after it is left out, the
    non-blank lines that follow are its text (joined by spaces) until a blank one; other lines are ignored."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("_k", "_raw")).withColumn("_line", stripped(F.col("_raw")))
    w = Window.partitionBy(key).orderBy("_k")
    prior = F.lag("_line").over(w)
    opens = F.col("_line").rlike(r"^\d+$") & F.coalesce((prior == "") | prior.isNull(), F.lit(True))
    blocks = lines.withColumn("_opens", opens).withColumn("_block", F.sum(F.col("_opens").cast("int")).over(w))
    inner = Window.partitionBy(key, "_block").orderBy("_k")
    marked = blocks.where("_block > 0").withColumn("_pos", F.row_number().over(inner)).withColumn("_blank", F.max((F.col("_line") == "").cast("int")).over(inner))
    said = marked.where("_pos > 1 AND _blank = 0").where(~((F.col("_pos") == 2) & F.contains("_line", F.lit("-->"))))
    told = said.groupBy(key, "_block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_line"))), lambda x: x["_line"]), " ").alias("text"))
    return told.select(key, F.col("_block").cast("int").alias("cue_no"), "text")


def translation_batches(cues: DataFrame, size: int = BATCH) -> DataFrame:
    """(doc_id, batch_no, request): numbered lines from 0, ``size`` cues each, line breaks in a cue made spaces."""
    w = Window.partitionBy("doc_id").orderBy("cue_no")
    placed = cues.withColumn("_n", F.row_number().over(w) - 1).withColumn("batch_no", F.floor(F.col("_n") / size).cast("int")).withColumn("line_no", (F.col("_n") % size).cast("int"))
    line = F.concat(F.col("line_no").cast("string"), F.lit(". "), F.replace("text", F.lit("\n"), F.lit(" ")))
    return placed.groupBy("doc_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("request"))


def parse_numbered_lines(responses: DataFrame) -> DataFrame:
    """(doc_id, batch_no, line_no, text) of ``response`` lines ``k. text``; the last of equal numbers counts."""
    lines = responses.select("doc_id", "batch_no", F.posexplode(F.split("response", "\n")).alias("_k", "_l"))
    lines = lines.withColumn("_l", stripped(F.col("_l"))).where(F.col("_l").rlike(r"^\d+\."))
    number = F.regexp_extract("_l", r"^(\d+)\.\s*(.*)", 1).try_cast("int")
    return lines.select("doc_id", "batch_no", number.alias("line_no"), "_k", F.regexp_extract("_l", r"^(\d+)\.\s*(.*)", 2).alias("_t")).groupBy("doc_id", "batch_no", "line_no").agg(F.max_by("_t", "_k").alias("text"))


def align_translations(cues: DataFrame, responses: DataFrame, size: int = BATCH) -> DataFrame:
    """(doc_id, cue_no, text): the translated line of each cue, its own text where there is none."""
    w = Window.partitionBy("doc_id").orderBy("cue_no")
    placed = cues.withColumn("_n", F.row_number().over(w) - 1)
    placed = placed.select("doc_id", "cue_no", F.col("text").alias("_own"), F.floor(F.col("_n") / size).cast("int").alias("batch_no"), (F.col("_n") % size).cast("int").alias("line_no"))
    return placed.join(parse_numbered_lines(responses), ["doc_id", "batch_no", "line_no"], "left").select("doc_id", "cue_no", F.coalesce("text", "_own").alias("text"))


def segment_plan(docs: DataFrame, seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """(doc_id, seg_no, start, duration) of ``docs(doc_id, duration)``; the last segment is shorter."""
    n = F.ceil(F.col("duration") / seconds).cast("int")
    each = docs.where("duration > 0").select("doc_id", F.col("duration").alias("_d"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seg_no"))
    return each.select("doc_id", "seg_no", (F.col("seg_no") * seconds).alias("start"), F.least(F.lit(seconds), F.col("_d") - F.col("seg_no") * seconds).alias("duration"))


def merge_transcript(segments: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts of all segments in order, joined by blank lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"])
    return segments.groupBy(*by).agg(F.array_join(ordered, "\n\n").alias("text"))


def render_markdown(slides: DataFrame) -> DataFrame:
    """(doc, body) of ``slides(doc, title, number, image, text)``: title, then number, image, text and rule per slide."""
    part = F.concat(F.lit("## "), F.col("number").cast("string"), F.lit("\n\n![]("), F.col("image"), F.lit(")\n\n"), F.col("text"), F.lit("\n\n---\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", part.alias("p")))), lambda x: x["p"])
    return slides.groupBy("doc").agg(F.concat(F.lit("# "), F.max("title"), F.lit("\n\n"), F.array_join(ordered, "\n")).alias("body"))


def context_tail(segments: DataFrame, n: int = TAIL) -> DataFrame:
    """Adds context: the last ``n`` characters of the latest segment before that has text."""
    w = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    own = stripped(F.col("text"))
    return segments.withColumn("context", F.last(F.when(own != "", F.right(own, F.lit(n))), ignorenulls=True).over(w))


def reuse_or_compute(segments: DataFrame, stored_cues: DataFrame, stored_texts: DataFrame) -> DataFrame:
    """(doc_id, seg_no, status, text): stored cues first, else the stored text, else pending."""
    cues = stored_cues.select("doc_id", "seg_no", F.col("text").alias("_c"))
    texts = stored_texts.select("doc_id", "seg_no", F.col("text").alias("_t"))
    out = segments.select("doc_id", "seg_no").join(cues, ["doc_id", "seg_no"], "left").join(texts, ["doc_id", "seg_no"], "left")
    status = F.when(F.col("_c").isNotNull(), "cues").when(F.col("_t").isNotNull(), "text").otherwise("pending")
    return out.select("doc_id", "seg_no", status.alias("status"), F.coalesce("_c", "_t").alias("text"))


#: The longest phrase of a loop.
LONGEST = 80


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` characters, put together from hashes of doubled widths."""
    # an array, as its products wrap around silently
    power, width = np.full(1, 0x9E3779B97F4A7C15, np.uint64), 1
    half, out, done = codes.astype(np.uint64), None, 0
    while True:
        if size & width:
            if out is None:
                out = half
            else:
                n = len(codes) - done - width + 1
                out = out[:n] * power + half[done : done + n]
            done += width
        if done == size:
            return out
        half = half[:-width] * power + half[width:]
        power, width = power * power, 2 * width


def periods(codes: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Phrase lengths that a loop may have, the longest first: the distances at which equal runs of ``least`` characters
    stand, often enough for ``repeats`` phrases in a row. Each run is chained to those before it within ``LONGEST``."""
    hashes = gram_hashes(codes, least)
    order = np.argsort(hashes, kind="stable")
    ordered, counts = hashes[order], np.zeros(LONGEST + 1, np.int64)
    left = np.flatnonzero(ordered[1:] == ordered[:-1])
    for back in range(1, LONGEST + 1):
        # chains go on only where the run before was near
        left = left[left + back < len(order)]
        apart = order[left + back] - order[left]
        near = (ordered[left + back] == ordered[left]) & (apart <= LONGEST)
        left = left[near]
        if not len(left):
            break
        counts += np.bincount(apart[near], minlength=LONGEST + 1)
    sizes = np.arange(LONGEST, least - 1, -1)
    return sizes[counts[sizes] >= (repeats - 1) * sizes - least + 1]


def find_loop(text: str, min_len: int = 15, max_repeat: int = 3) -> tuple[int, int, int] | None:
    """(start, phrase length, count) of the loop that counts, or None.

    Phrase lengths fall from min(80, a third of the text) to ``min_len``; the first length with a non-blank phrase said
    ``max_repeat`` times in a row ends the search, and there the highest count wins, the earliest start on ties.
    """
    n = len(text)
    if n < 3 * min_len or n < min_len * max_repeat:
        return None
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for size in periods(codes, min_len, max_repeat).tolist():
        if size > n // 3:
            continue
        same = codes[size:] == codes[:-size]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        best = None
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < (max_repeat - 1) * size:
                continue
            # a run of r equal positions from a holds 1 + r // size copies of the phrase at a
            for s in range(int(a), int(min(b, a + size))):
                count = 1 + (int(b) - s) // size
                if count >= max_repeat and s < n - 2 * size and (best is None or count > best[2]) and text[s : s + size].strip():
                    best = s, size, count
        if best:
            return best
    return None


LOOP = T.StructType([
    T.StructField("has_repetition", T.BooleanType()), T.StructField("clean_text", T.StringType()), T.StructField("ratio", T.DoubleType()),
    T.StructField("phrase", T.StringType()), T.StructField("count", T.IntegerType()),
])


def repetition_loops(docs: DataFrame, text: str = "text", min_len: int = 15, max_repeat: int = 3) -> DataFrame:
    """Adds loop: has_repetition, clean_text, ratio, phrase (100 characters) and count; in time linear in a text but for the sort of its runs."""

    @F.pandas_udf(LOOP)
    def loops(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            found = None if value is None else find_loop(value, min_len, max_repeat)
            if found is None:
                rows.append((None,) * len(LOOP.names))
            else:
                start, size, count = found
                rows.append((True, value[: start + size].rstrip(), count * size / len(value), value[start : start + size][:100], count))
        return pd.DataFrame(rows, columns=LOOP.names).astype({"has_repetition": "boolean", "count": "Int32"})

    none = F.struct(F.lit(False).alias("has_repetition"), F.col(text).alias("clean_text"), F.lit(0.0).alias("ratio"), F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("count"))
    searched = docs.withColumn("loop", loops(F.col(text)))
    return searched.withColumn("loop", F.when(F.col("loop.has_repetition"), F.col("loop")).otherwise(none.cast(LOOP)))
