"""Readers and writers: catalogs, slide metadata, transcripts, progress logs, images, documents, reports, subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from .named import read_named, write_named

METADATA = """
  video_path string, total_frames bigint, fps double, threshold double,
  video_info struct<path:string, fps:double, total_frames:bigint, duration:double>,
  slides array<struct<index:int, filename:string, frame_index:bigint, frame_idx:bigint, timestamp:double, phash:string,
    dhash:string, group_id:int, subgroup_idx:int>>,
  groups map<string, struct<slide_count:int, time_range:struct<start:double, `end`:double>>>,
  similarity_groups map<string, array<array<string>>>
"""
PROGRESS = "processed array<string>, failed array<string>, skipped array<string>, stats struct<total_tokens:bigint>"


def scan_catalog(spark: SparkSession, path: str, extensions: tuple[str, ...] = P.VIDEO_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(path, length, mtime) of visible files of the given kinds; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    found = files.select("path", "length", F.unix_timestamp("modificationTime").alias("mtime"))
    return found.where(P.extension(F.col("path")).isin(*extensions) & ~P.is_hidden(F.col("path"))).distinct()


def read_slide_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per slide from metadata files of all three shapes; a slide without a group has group_id -1."""
    files = spark.read.schema(METADATA).option("multiLine", True).json(path).withColumn("source", F.input_file_name())
    video = F.coalesce("video_path", "video_info.path")
    slides = files.select("source", video.alias("video_path"), F.coalesce("fps", "video_info.fps").alias("fps"), "groups", "similarity_groups", F.explode("slides").alias("s"))
    shape = F.when(F.col("groups").isNotNull(), 3).when(F.col("similarity_groups").isNotNull(), 2).otherwise(1)
    return slides.select(
        "source", "video_path", "fps", shape.alias("shape"), F.col("s.index").alias("slide_index"), F.col("s.filename").alias("filename"),
        F.coalesce("s.frame_index", "s.frame_idx").alias("frame_idx"), F.col("s.timestamp").alias("timestamp"), F.col("s.phash").alias("phash"),
        F.coalesce("s.group_id", F.lit(-1)).alias("group_id"), F.coalesce("s.subgroup_idx", F.lit(1)).alias("subgroup_idx"),
    )


def _as_uri(path: Column) -> Column:
    """A local path as ``input_file_name`` shows it."""
    coded = path
    for sign in "%" + "".join(map(chr, range(1, 33))) + '"#<>?[\\]^`{|}\x7f':
        coded = F.replace(coded, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return F.concat(F.lit("file://"), F.when(path.rlike(r"[^\w/.\-]"), coded).otherwise(path))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of visible ``transcription*.txt`` and ``.srt`` files, whole. Those of a ``file:`` path, which all executors
    must reach, are read thousands to a task; elsewhere Spark's reader takes a few to a task, and passes over empty ones."""
    if path.startswith("file:"):
        found = read_named(spark, path, "transcription*.[ts][xr]t", binary=True)
        shown = F.col("name").rlike(r"\.(txt|srt)$") & ~F.col("name").rlike(r"(^|/)(\.|_[^/=]*(/|$))")
        return found.where(shown).select(_as_uri(F.col("path")).alias("path"), F.col("content").cast("string").alias("text"))
    # the reader of whole texts opens each file by way of a Hadoop job of its own, five times as slow as that of bytes
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "transcription*.{txt,srt}").load(path)
    return files.select(F.input_file_name().alias("path"), F.col("content").cast("string").alias("text"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(job, item, status, error) of progress logs whose failures are texts or structs."""
    logs = spark.read.schema(PROGRESS).option("multiLine", True).json(path).withColumn("job", F.input_file_name())
    failed = logs.select("job", F.explode("failed").alias("_f"))
    told = F.from_json("_f", "folder string, file string, error string")
    failed = failed.select("job", F.coalesce(told["folder"], told["file"], F.col("_f")).alias("item"), F.lit("failed").alias("status"), told["error"].alias("error"))
    plain = lambda c, s: logs.select("job", F.explode(c).alias("item"), F.lit(s).alias("status"), F.lit(None).cast("string").alias("error"))
    return plain("processed", "processed").unionByName(plain("skipped", "skipped")).unionByName(failed)


def append_progress(rows: DataFrame, path: str) -> None:
    """Append (job, item, status, error, tokens, ts) rows to the log table."""
    rows.select("job", "item", "status", "error", "tokens", "ts").write.mode("append").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, luma): grey frames of the images under a path; unreadable kinds have null luma."""
    kinds = "*.{png,PNG,jpg,JPG,jpeg,JPEG,heic,HEIC,heif,HEIF}"
    images = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", kinds).load(path).select("image.*")

    bgr = F.hex("data")
    byte = lambda at: F.conv(F.substring(bgr, at * 2 + 1, F.lit(2)), 16, 10).cast("double")
    channels = F.col("nChannels")
    pixels = F.transform(
        F.sequence(F.lit(0), F.col("width") * F.col("height") - 1),
        lambda i: F.when(channels == 1, byte(i)).otherwise(0.114 * byte(i * channels) + 0.587 * byte(i * channels + 1) + 0.299 * byte(i * channels + 2)),
    )
    readable = (F.col("width") > 0) & (F.col("height") > 0)
    return images.where(~P.is_hidden(F.col("origin"))).select(F.col("origin").alias("path"), "width", "height", F.when(readable, pixels).alias("luma"))


#: What may not stand in a file's name, or not first in one that readers see, with its code; the sign of codes is the first.
_CODES = {"%": "%25", "/": "%2F"}
_FIRST = {".": "%2E", "_": "%5F"}
_EMPTY, _NULL = "%empty", "%null"


def file_name(key: Column) -> Column:
    """A key as the name of a visible file: slashes, percent signs, and dots and underscores in front become codes."""
    text = key.cast("string")
    for sign, code in _CODES.items():
        text = F.replace(text, F.lit(sign), F.lit(code))
    named = F.when(text == "", _EMPTY)
    for sign, code in _FIRST.items():
        named = named.when(F.startswith(text, F.lit(sign)), F.concat(F.lit(code), F.substring(text, F.lit(2), F.length(text))))
    return F.coalesce(named.otherwise(text), F.lit(_NULL))


def key_of(name: Column) -> Column:
    """The key, as text, that ``file_name`` made a name of."""
    text = name
    for sign, code in reversed((_CODES | _FIRST).items()):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.when(name == _EMPTY, "").when(name != _NULL, text)


def write_documents(docs: DataFrame, path: str, key: str, body: str) -> None:
    """One text file per key (Markdown or subtitle bodies), named by ``file_name`` and whole when it shows; keys must differ."""
    write_named(docs.select(file_name(F.col(key)).alias("name"), F.col(body).cast("string").alias("content")), path)


def write_by_language(texts: DataFrame, path: str) -> None:
    """(stem, lang, body) as one file per text: a folder per language, and in it one named ``stem_lang``, or ``stem`` for
    a text without a language, below the folder of null. Names follow ``file_name`` and must differ."""
    name = F.concat_ws("/", file_name(F.col("lang")), file_name(F.concat_ws("_", "stem", "lang")))
    write_named(texts.select(name.alias("name"), F.col("body").cast("string").alias("content")), path)


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    report.write.json(path)
