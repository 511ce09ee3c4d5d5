"""Matching and work lists over a file catalog (path, dir, name, stem, ext, is_dir, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

# Kinds of agenda files, the likeliest first.
AGENDA_EXTENSIONS = ("rtfd", "rtf", "docx", "doc", "txt")
# Analysis files by rank: of a selection, then of a slide folder.
SELECTED_ANALYSIS = "selected_slides_analysis.md"
FOLDER_ANALYSES = ("full_slides_analysis.md", "selected_slides_analysis_gemini.md", "full_slides_analysis_gemini.md")


def with_parts(catalog: DataFrame) -> DataFrame:
    """Adds dir, name, stem, ext and hidden to ``catalog(path, ...)``."""
    path = F.col("path")
    return catalog.select("*", P.dirname(path).alias("dir"), P.basename(path).alias("name"), P.stem(path).alias("stem"), P.extension(path).alias("ext"), P.is_hidden(path).alias("hidden"))


def visible_files(catalog: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Files of the given kinds that are not hidden."""
    return catalog.where(~F.col("is_dir") & ~F.col("hidden") & F.col("ext").isin(*extensions))


def find_slide_folders(catalog: DataFrame) -> DataFrame:
    """(path) of directories named ``*_slides``, but for the selections."""
    return catalog.where(F.col("is_dir") & F.col("name").rlike("_slides$") & (F.col("name") != "selected_slides")).select("path").distinct()


def match_slide_folders(catalog: DataFrame) -> DataFrame:
    """(path, status, matches) of every video: specific if a folder beside it carries its name, else generic if one is
    just called slides, else none. Matches of the winning kind are listed in order.

    A folder is joined on its name's parts of the lengths that the stems beside it have, not with every video.
    """
    videos = visible_files(catalog, P.VIDEO_EXTENSIONS).select("path", "dir", F.lower("stem").alias("_stem"))
    dirs = catalog.where(F.col("is_dir") & F.contains(F.lower("name"), F.lit("slide"))).select("dir", F.col("name").alias("folder"), F.lower("name").alias("_low")).distinct()
    plain = F.col("_low").isin("slide", "slides")
    generic = dirs.where(plain).groupBy("dir").agg(F.array_sort(F.collect_set("folder")).alias("_g"))
    lengths = videos.groupBy("dir").agg(F.collect_set(F.length("_stem")).alias("_lengths"))
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length("_low") - n + 1), lambda i: F.substring(F.col("_low"), i, n))
    fitting = F.filter("_lengths", lambda n: n <= F.length("_low"))
    parts = dirs.where(~plain).join(lengths, "dir").select("dir", "folder", F.explode(F.array_distinct(F.flatten(F.transform(fitting, starts)))).alias("_stem"))
    specific = videos.join(parts, ["dir", "_stem"]).groupBy("path").agg(F.array_sort(F.collect_set("folder")).alias("_s"))
    found = videos.select("path", "dir").join(specific, "path", "left").join(generic, "dir", "left")
    status = F.when(F.col("_s").isNotNull(), "specific").when(F.col("_g").isNotNull(), "generic").otherwise("none")
    return found.select("path", status.alias("status"), F.coalesce("_s", "_g", F.array().cast("array<string>")).alias("matches"))


def without_slide_folder(catalog: DataFrame) -> DataFrame:
    """(path) of videos with no folder beside them whose name holds "slide"."""
    dirs = catalog.where(F.col("is_dir") & F.contains(F.lower("name"), F.lit("slide"))).select("dir").distinct()
    return visible_files(catalog, P.VIDEO_EXTENSIONS).join(dirs, "dir", "left_anti").select("path")


#: Folders that may hold a video's slides, by capture tool, the likeliest first; ``{}`` is the video's stem.
CAPTURE_FOLDERS = {
    "standard": ("{}_slides", "{}_slide", "slides", "slide", "Slides", "Slide"),
    "improved": ("slides_improved_{}", "{}_slides_improved", "{}_slides", "{}_slide", "slides_improved", "slides", "slide", "Slides", "Slide"),
}


def capture_folders(stem: Column, mode: str = "standard") -> list[Column]:
    return [F.concat(F.lit(x.partition("{}")[0]), stem, F.lit(x.partition("{}")[2])) if "{}" in x else F.lit(x) for x in CAPTURE_FOLDERS[mode]]


def already_captured(catalog: DataFrame, mode: str = "standard", force: bool = False) -> DataFrame:
    """(path, folder) of every video: the first candidate folder beside it that holds a visible image, else null."""
    videos = visible_files(catalog, P.VIDEO_EXTENSIONS).select("path", "dir", "stem")
    if force:
        return videos.select("path", F.lit(None).cast("string").alias("folder"))
    ranked = F.posexplode(F.array(*[F.concat_ws("/", F.col("dir"), c) for c in capture_folders(F.col("stem"), mode)]))
    candidates = videos.select("path", ranked.alias("rank", "folder"))
    holding = visible_files(catalog, P.CAPTURED_EXTENSIONS).select(F.col("dir").alias("folder")).distinct()
    found = candidates.join(holding, "folder").groupBy("path").agg(F.min_by("folder", "rank").alias("folder"))
    return videos.select("path").join(found, "path", "left")


def todo(items: DataFrame, progress: DataFrame, outputs: DataFrame | None = None, retry_failed: bool = False, key: str = "item") -> DataFrame:
    """Items that are not processed, not failed (unless those are tried again) and have no output yet."""
    done = progress.where((F.col("status") == "processed") | (F.lit(not retry_failed) & (F.col("status") == "failed"))).select(key).distinct()
    left = items.join(done, key, "left_anti")
    return left.join(outputs.select(key).distinct(), key, "left_anti") if outputs is not None else left


def todo_sibling(files: DataFrame, processed: DataFrame) -> DataFrame:
    """(path) of subtitle files of which neither they nor the text file of the same name are processed."""
    srt = files.where("ext = 'srt' AND NOT hidden")
    keys = srt.select("path", F.explode(F.array("path", F.regexp_replace("path", r"\.srt$", ".txt"))).alias("_key"))
    done = keys.join(processed.select(F.col("path").alias("_key")).distinct(), "_key", "left_semi").select("path").distinct()
    return srt.select("path").join(done, "path", "left_anti")


def match_agenda(catalog: DataFrame, sessions: DataFrame) -> DataFrame:
    """(path, agenda): the best agenda file in the folder of each session transcript, or null.

    By extension, then by name: the session's own, without ``transcription-``, the folder's. Failing these, any rich-text
    or word file whose name does not speak of a transcription.
    """
    base = sessions.select("path", "dir", "stem", P.basename(F.col("dir")).alias("folder"))
    names = F.array("stem", F.replace(F.col("stem"), F.lit("transcription-"), F.lit("")), F.col("folder"))
    files = catalog.where(~F.col("hidden") & F.col("ext").isin(*AGENDA_EXTENSIONS)).select("dir", F.col("stem").alias("_name"), "ext", F.col("name").alias("_file"))
    ext_rank = F.array_position(F.array(*map(F.lit, AGENDA_EXTENSIONS)), F.col("ext"))
    wanted = base.select("path", "dir", F.posexplode(names).alias("_k", "_name"))
    exact = wanted.join(files, ["dir", "_name"]).select("path", (ext_rank * 10 + F.col("_k")).alias("rank"), "_file", "dir")
    other = files.where(F.col("ext") != "txt").where(~F.contains(F.lower("_file"), F.lit("transcription")))
    other = other.groupBy("dir").agg(F.min_by("_file", F.struct(ext_rank, "_file")).alias("_file"))
    loose = base.join(other, "dir").select("path", F.lit(1000).alias("rank"), "_file", "dir")
    best = exact.unionByName(loose).groupBy("path").agg(F.min_by(F.concat_ws("/", "dir", "_file"), F.struct("rank", "_file")).alias("agenda"))
    return sessions.select("path").join(best, "path", "left")


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def match_notes_slides(catalog: DataFrame) -> DataFrame:
    """(folder, notes, analysis): notes with the best analysis file at or below their folder."""
    notes = catalog.where(F.col("name").rlike(r"^transcription-.*_detailed_notes\.md$")).select(F.col("dir").alias("folder"), F.col("path").alias("notes"))
    ranks = F.array_position(F.array(*map(F.lit, (SELECTED_ANALYSIS, *FOLDER_ANALYSES))), F.col("name"))
    found = catalog.where(ranks > 0).select(F.col("path").alias("analysis"), ranks.alias("rank"), F.explode(ancestors(F.col("path"))).alias("folder"))
    best = found.groupBy("folder").agg(F.min_by("analysis", F.struct("rank", "analysis")).alias("analysis"))
    return notes.join(best, "folder")


def prefix_attach(files: DataFrame, folders: DataFrame, raw: bool = False) -> DataFrame:
    """(path, folder): the first folder (by ``rank``) at or above each file's directory, or null.

    ``raw`` takes a folder whose text the directory's begins with, so ``/a/x_slides`` has ``/a/x_slides_v2/n.md`` too. Such a
    folder's parent is still above the file, so a file meets, below each of its ancestors, only starts of its next
    name that are as long as a folder's name there.
    """
    if not raw:
        up = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
        best = up.join(folders.select("folder", "rank"), "folder").groupBy("path").agg(F.min_by("folder", "rank").alias("folder"))
        return files.select("path").join(best, "path", "left")
    parts = lambda path: F.split(path, "/")
    above = lambda names, k: F.array_join(F.slice(names, F.lit(1), k), "/")
    listed = folders.select("folder", "rank", parts(F.col("folder")).alias("p")).select("folder", "rank", (F.size("p") - 1).alias("depth"), above(F.col("p"), F.size("p") - 1).alias("parent"), F.element_at("p", -1).alias("start"))
    lengths = listed.groupBy("depth", "parent").agg(F.collect_set(F.length("start")).alias("lengths"))
    inside = files.select("path", F.slice(parts(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1).alias("p"))
    steps = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.struct(k.alias("depth"), above(F.col("p"), k).alias("parent"), F.get(F.col("p"), k).alias("name")))
    each = inside.where(F.size("p") > 0).select("path", F.explode(steps).alias("s")).select("path", "s.*").join(lengths, ["depth", "parent"])
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    met = each.select("path", "depth", "parent", F.explode(starts).alias("start")).join(listed, ["depth", "parent", "start"])
    return files.select("path").join(met.groupBy("path").agg(F.min_by("folder", "rank").alias("folder")), "path", "left")


def prefer_text(files: DataFrame) -> DataFrame:
    """Per directory and stem the text file before the subtitle file."""
    w = Window.partitionBy("dir", "stem").orderBy((F.col("ext") != "txt").cast("int"), "path")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def take_per_folder(files: DataFrame, n: int, key: str = "dir", order: str = "name") -> DataFrame:
    """The first ``n`` files of each folder by name."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def slide_order(files: DataFrame, key: str = "dir") -> DataFrame:
    """Adds position in folder order: files with a time in their name first, by time (or mtime), then natural order."""
    t = P.slide_time(F.col("name"))
    w = Window.partitionBy(key).orderBy(F.when(t.isNull(), 1).otherwise(0), F.coalesce(t, F.col("mtime")), P.natural_key(F.col("name")), "name")
    return files.withColumn("position", F.row_number().over(w))


def renumber(slides: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, old_name, new_index, new_name): slides by time with running numbers and the hash part kept."""
    w = Window.partitionBy(key).orderBy("timestamp", "filename")
    numbered = slides.withColumn("new_index", F.row_number().over(w))
    tag = F.regexp_extract("filename", r"_h([0-9a-f]{8})", 1)
    return numbered.select(key, F.col("filename").alias("old_name"), "new_index", P.slide_filename(F.col("new_index"), F.col("timestamp"), tag).alias("new_name"))
