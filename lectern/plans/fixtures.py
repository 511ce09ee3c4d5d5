"""Views of the given tables in the library's data model, in Spark and (same names) as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frames as M
from ..operators import catalog as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_of(embeddings: DataFrame) -> DataFrame:
    """video_id, frame_idx, fps, timestamp, g and luma (0..255) of 8x8 frames, from embeddings."""
    g = F.transform("embedding", lambda x: x.cast("double"))
    base = embeddings.select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame_idx"), g.alias("g"))
    low, high = F.array_min("g"), F.array_max("g")
    luma = F.transform("g", lambda x: F.floor((x - low) / (high - low) * 255).cast("double"))
    return base.select("video_id", "frame_idx", F.lit(1.0).alias("fps"), F.col("frame_idx").cast("double").alias("timestamp"), "g", luma.alias("luma"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(table(spark, sf_dir, "embeddings"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = M.phash_bits(F.col("g"))
    return frames(spark, sf_dir).withColumn("bits", bits).withColumn("phash", M.bits_to_long(F.col("bits")))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("video_id").agg((F.max("frame_idx") + 1).alias("total_frames"), F.lit(1.0).alias("fps"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed frames numbered without gaps, two (even videos) or four a second, with their sharpness."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1
    rate = F.when(F.col("video_id") % 2 == 0, 2.0).otherwise(4.0)
    shown = hashed(spark, sf_dir).withColumn("frame_idx", number.cast("long")).withColumn("fps", rate)
    return shown.withColumn("sharpness", F.round(M.sharpness(F.col("luma")), 6))


def dense_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("video_id")).agg(F.count("*").alias("total_frames"))
    return base.withColumn("fps", F.when(F.col("video_id") % 2 == 0, 2.0).otherwise(4.0))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, event_id, t (seconds of 2024) and v, from events."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", t.alias("t"), F.col("value").alias("v"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_no"), (F.col("turn") * 600.0).alias("start"), F.lit(600.0).alias("duration"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _entry(path: Column, is_dir: bool, length: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(is_dir).alias("is_dir"), length.cast("long").alias("length"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, is_dir, length and name parts of transcripts, videos, slide folders, agendas, notes and analyses."""
    d = table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"))
    name = F.concat(folder, F.lit("/transcription-"), F.col("doc_id").cast("string"))
    n, size = F.col("doc_id"), F.col("n_chars")
    ext = F.when(n % 3 == 0, ".txt").when(n % 3 == 1, ".srt").otherwise(".md")
    some = lambda when, entry: F.when(when, entry)
    entries = F.array(
        _entry(F.concat(name, ext), False, size),
        some(n % 5 == 0, _entry(F.concat(name, F.when(n % 3 == 1, ".txt").otherwise(".srt")), False, size)),
        some(n % 2 == 0, _entry(F.concat(name, F.lit(".mp4")), False, size * 20000)),
        some(n % 4 == 0, _entry(F.concat(name, F.lit("_slides")), True, F.lit(0))),
        some(n % 8 == 0, _entry(F.concat(name, F.lit("_slides/slide_001_t5m23.5s.png")), False, F.lit(1000))),
        some(n % 97 == 1, _entry(F.concat(folder, F.lit("/Slides")), True, F.lit(0))),
        some(n % 10 == 0, _entry(F.concat(folder, F.lit("/._transcription-"), n.cast("string"), F.lit(".txt")), False, F.lit(1))),
        some(n % 6 == 0, _entry(F.concat(folder, F.lit("/"), n.cast("string"), F.lit(".rtf")), False, size)),
        some(n % 9 == 0, _entry(F.concat(name, F.lit("_detailed_notes.md")), False, size)),
        some(n % 12 == 0, _entry(F.concat(name, F.lit("_slides/full_slides_analysis.md")), False, size)),
        some(n % 16 == 0, _entry(F.concat(name, F.lit("_slides/selected_slides_analysis.md")), False, size)),
    )
    listed = d.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.*").distinct()
    return C.with_parts(listed)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").alias("item"), F.when(F.col("quality") == 1, "processed").otherwise("failed").alias("status"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("item"), F.col("user_id").alias("job"), status.alias("status"), F.col("value").alias("seconds"), (F.col("event_id") % 40).alias("n_units"))


_D = "[" + ", ".join(repr(x) for x in M.dct_basis()) + "]"

SQL = {
    "frames": """frames AS (SELECT *, frame_idx::DOUBLE AS ts, list_transform(g, lambda x: floor((x - list_min(g)) / (list_max(g) - list_min(g)) * 255)) AS luma
      FROM (SELECT label::BIGINT AS video_id, vec_id AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE) AS g FROM embeddings))""",
    "pairs": """pairs AS (SELECT *, lag(luma) OVER w AS prev_luma, lag(frame_idx) OVER w AS prev_idx FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx))""",
    "hashed": f"""half AS (SELECT *, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 8), lambda k: {_D}[(i // 8) * 8 + k + 1] * g[k * 8 + i % 8 + 1]))) AS h FROM frames),
      coef AS (SELECT *, list_transform(range(0, 64), lambda i: round(list_sum(list_transform(range(0, 8), lambda k: h[(i // 8) * 8 + k + 1] * {_D}[(i % 8) * 8 + k + 1])), 9)) AS c FROM half),
      hashed AS (SELECT video_id, frame_idx, ts, luma, array_to_string(list_transform(c, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS bits
        FROM (SELECT *, round(list_sum(list_transform(range(0, 49), lambda i: c[(i // 7 + 1) * 8 + i % 7 + 2])) / 49, 9) AS m FROM coef))""",
    "videos": "videos AS (SELECT video_id, max(frame_idx) + 1 AS total_frames FROM frames GROUP BY video_id)",
    "series": "series AS (SELECT user_id AS key, event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS v FROM events)",
    "segments": "segments AS (SELECT conv_id AS doc_id, turn AS seg_no, turn * 600.0::DOUBLE AS start, 600.0::DOUBLE AS duration, text FROM conversations)",
    "catalog": r"""entries AS (SELECT doc_id AS n, n_chars AS size, '/corpus/' || source || '/' || lang AS folder, '/corpus/' || source || '/' || lang || '/transcription-' || doc_id AS stem0 FROM documents),
      listed AS (
        SELECT stem0 || CASE n % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.srt' ELSE '.md' END AS path, false AS is_dir, size AS length FROM entries
        UNION SELECT stem0 || CASE n % 3 WHEN 1 THEN '.txt' ELSE '.srt' END, false, size FROM entries WHERE n % 5 = 0
        UNION SELECT stem0 || '.mp4', false, size * 20000 FROM entries WHERE n % 2 = 0
        UNION SELECT stem0 || '_slides', true, 0 FROM entries WHERE n % 4 = 0
        UNION SELECT stem0 || '_slides/slide_001_t5m23.5s.png', false, 1000 FROM entries WHERE n % 8 = 0
        UNION SELECT folder || '/Slides', true, 0 FROM entries WHERE n % 97 = 1
        UNION SELECT folder || '/._transcription-' || n || '.txt', false, 1 FROM entries WHERE n % 10 = 0
        UNION SELECT folder || '/' || n || '.rtf', false, size FROM entries WHERE n % 6 = 0
        UNION SELECT stem0 || '_detailed_notes.md', false, size FROM entries WHERE n % 9 = 0
        UNION SELECT stem0 || '_slides/full_slides_analysis.md', false, size FROM entries WHERE n % 12 = 0
        UNION SELECT stem0 || '_slides/selected_slides_analysis.md', false, size FROM entries WHERE n % 16 = 0),
      catalog AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name,
        regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem,
        lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\.([^.]*)$', 1)) AS ext,
        starts_with(regexp_extract(path, '[^/]*$'), '._') AS hidden FROM listed)""",
    "progress": "progress AS (SELECT doc_id AS item, CASE WHEN quality = 1 THEN 'processed' ELSE 'failed' END AS status FROM labels)",
    "runs": "runs AS (SELECT event_id AS item, user_id AS job, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status, value AS seconds, event_id % 40 AS n_units FROM events)",
}


def sql_with(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
