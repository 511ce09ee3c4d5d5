"""Status, coverage, cost and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANALYSIS_KINDS = ("selected", "full", "selected_gemini", "full_gemini")
PRICE_PER_MILLION = 7.5
#: What a folder without an analysis is reckoned to need.
IMAGES_PER_FOLDER, SECONDS_PER_IMAGE = 30, 6


def status_flags(analyses: DataFrame, folder: str = "folder", kind: str = "kind") -> DataFrame:
    """Per folder: which of the four analyses exist, and whether any does."""
    flags = [F.bool_or(F.col(kind) == k).alias(f"has_{k}") for k in ANALYSIS_KINDS]
    return analyses.groupBy(folder).agg(*flags, F.bool_or(F.col(kind).isin(*ANALYSIS_KINDS)).alias("has_any"))


def status_totals(folders: DataFrame) -> DataFrame:
    """Totals over ``folders(folder, has_selected, openai, gemini)``; nothing done counts among selected ones only."""
    both = F.col("openai") & F.col("gemini")
    none = F.col("has_selected") & ~F.col("openai") & ~F.col("gemini")
    out = folders.agg(
        F.count("*").alias("total"), F.count_if("has_selected").alias("selected"), F.count_if("openai").alias("openai"),
        F.count_if("gemini").alias("gemini"), F.count_if(both).alias("both"), F.count_if(none).alias("none"),
        F.array_sort(F.collect_list(F.when(~F.col("has_selected"), F.col("folder")))).alias("without_selected"),
    )
    return out.withColumn("openai_pct", F.try_divide(F.col("openai") * 100.0, F.col("selected"))).withColumn("gemini_pct", F.try_divide(F.col("gemini") * 100.0, F.col("selected")))


def coverage(attached: DataFrame, folders: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """covered, folders and percent. ``attached(path, folder)``; special folders only add to the numerator, as the
    older report has it, and are left out by default."""
    covered = attached.where("folder IS NOT NULL").select("folder").distinct().join(folders.select("folder"), "folder", "left_semi")
    if special is not None:
        covered = covered.union(special.select("folder")).distinct()
    n = covered.agg(F.count("*").alias("covered")).crossJoin(F.broadcast(folders.agg(F.count("*").alias("folders"))))
    return n.withColumn("percent", F.round(F.try_divide(F.col("covered") * 100.0, F.col("folders")), 2))


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Totals of runs by status, with sums and averages per processed one."""
    ok = F.col("status") == "success"
    out = runs.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(ok, F.col("n_units")).otherwise(0)).alias("units"), F.sum(F.when(ok, F.col("seconds")).otherwise(0.0)).alias("seconds"),
    )
    out = out.withColumn("skipped", F.col("total") - F.col("processed") - F.col("failed"))
    return out.withColumn("avg_units", F.try_divide(F.col("units"), F.col("processed"))).withColumn("avg_seconds", F.try_divide(F.col("seconds"), F.col("processed")))


def analysis_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Totals of ``runs(status, images, api_calls, seconds)`` of slide analyses: images and calls of processed folders, the
    time of all, and averages per processed folder (null without one)."""
    ok = F.col("status") == "success"
    out = runs.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.sum(F.when(ok, F.col("images")).otherwise(0)).alias("images"),
        F.sum(F.when(ok, F.col("api_calls")).otherwise(0)).alias("api_calls"), F.sum("seconds").alias("seconds"),
    )
    return out.withColumn("avg_seconds", F.try_divide(F.col("seconds"), F.col("processed"))).withColumn("avg_images", F.try_divide(F.col("images"), F.col("processed")))


def token_cost(requests: DataFrame, *by: str) -> DataFrame:
    """Tokens (characters of request and response) and their cost."""
    tokens = F.sum(F.length("request") + F.length("response"))
    return requests.groupBy(*by).agg(tokens.alias("tokens")).withColumn("cost", F.round(F.col("tokens") / 1e6 * PRICE_PER_MILLION, 2))


def merge_rate(counts: DataFrame) -> DataFrame:
    """``counts(merged, notes, slides)`` with rate in percent, null if there is nothing to merge."""
    return counts.withColumn("rate", F.round(F.try_divide(F.col("merged") * 100.0, F.least("notes", "slides")), 1))


def counts_by_ext(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("n"))


def agenda_presence(notes: DataFrame, marker: str, head: int = 500) -> DataFrame:
    """Notes whose first characters hold the marker, and all."""
    return notes.agg(F.count_if(F.contains(F.substring("text", 1, head), F.lit(marker))).alias("with_agenda"), F.count("*").alias("notes"))


def eta(runs: DataFrame, key: str, order: str, seconds: str = "seconds") -> DataFrame:
    """Per run: time so far, mean per item so far and the time left for the rest of its job."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = runs.withColumn("done", F.row_number().over(w)).withColumn("elapsed", F.sum(seconds).over(w))
    total = F.count("*").over(Window.partitionBy(key))
    return numbered.withColumn("eta", F.col("elapsed") / F.col("done") * (total - F.col("done")))


def static_estimate(flags: DataFrame, done: str, images: int = IMAGES_PER_FOLDER, seconds: int = SECONDS_PER_IMAGE) -> DataFrame:
    """remaining folders (``done`` does not hold) and the minutes and hours that they take at fixed averages."""
    out = flags.agg(F.count_if(~F.coalesce(F.col(done), F.lit(False))).alias("remaining"))
    return out.withColumn("minutes", F.col("remaining") * images * seconds / 60.0).withColumn("hours", F.col("minutes") / 60.0)


def folder_listing(items: DataFrame, key: str, name: str) -> DataFrame:
    """Names per folder in order."""
    return items.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"), F.count_distinct(name).alias("n_distinct"))


def last_failed(progress: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The last ``n`` failed items of each job, and how many more there are."""
    w = Window.partitionBy(key)
    failed = progress.where("status = 'failed'").withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("more", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return failed.where(F.col("_n") <= n).drop("_n")


def latest_status(progress: DataFrame) -> DataFrame:
    """(job, item, status): the last status of every item wins."""
    return progress.groupBy("job", "item").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))


def compare_speed(runs: DataFrame, modes: tuple[str, str], *by: str) -> DataFrame:
    """Seconds of two modes from ``runs(mode, seconds)``, how many times faster the second is (0 if it took no time) and
    the seconds that it saves."""
    a, b = (F.sum(F.when(F.col("mode") == m, F.col("seconds")).otherwise(0.0)).alias(f"{m}_seconds") for m in modes)
    first, second = (F.col(f"{m}_seconds") for m in modes)
    return runs.groupBy(*by).agg(a, b).withColumn("speed_ratio", F.coalesce(F.try_divide(first, second), F.lit(0.0))).withColumn("saved", first - second)


def compare_modes(slides: DataFrame, modes: tuple[str, str]) -> DataFrame:
    """Slides per mode and their difference, per video."""
    out = slides.groupBy("video_id").pivot("mode", list(modes)).count().na.fill(0, list(modes))
    return out.withColumn("difference", F.col(modes[1]) - F.col(modes[0]))
