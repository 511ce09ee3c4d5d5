"""Path, file-name and text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of files, and the largest upload.
VIDEO_EXTENSIONS = ("mp4", "avi", "mkv", "mov", "wmv", "flv", "webm")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "heic", "heif")
CAPTURED_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp")
AUDIO_SUPPORTED = ("mp3", "mp4", "mpeg", "mpga", "m4a", "wav", "webm")
AUDIO_COMPATIBLE = ("mp3", "wav", "m4a")
AUDIO_IN_VIDEO = ("mp4", "mov", "avi", "mkv", "webm")
MAX_UPLOAD_BYTES = 25 * 1024 * 1024


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    """Name without its last extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def is_hidden(path: Column) -> Column:
    return F.startswith(basename(path), F.lit("._"))


def path_parts(path: Column) -> Column:
    """dir, parent, name, stem, ext and hidden of a path."""
    return F.struct(
        dirname(path).alias("dir"), basename(dirname(path)).alias("parent"), basename(path).alias("name"),
        stem(path).alias("stem"), extension(path).alias("ext"), is_hidden(path).alias("hidden"),
    )


def _number(text: Column) -> Column:
    return text.try_cast("double")


def slide_time(name: Column) -> Column:
    """Seconds that a file name tells: minutes and seconds first, then plain seconds; null if it tells none."""
    # Forms of times in names.
    both = r"(?i)_t(\d+)m(\d+(?:\.\d+)?)s"
    plain = r"(?i)_t(\d+(?:\.\d+)?)s(?:[^a-z]|$)"
    minutes = _number(F.regexp_extract(name, both, 1)) * 60 + _number(F.regexp_extract(name, both, 2))
    return F.coalesce(minutes, _number(F.regexp_extract(name, plain, 1)))


def slide_time_legacy(name: Column) -> Column:
    """The older parser: three patterns in turn, else 0. It reads the minutes of ``_t5m23.5s`` as seconds."""
    # Older forms of times in names.
    patterns = (r"_t(\d+\.?\d*)s", r"_(\d+\.?\d*)s", r"t(\d+\.?\d*)")
    return F.coalesce(*[_number(F.regexp_extract(name, p, 1)) for p in patterns], F.lit(0.0))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers, of any length, and letters without case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))

    def number(digits: Column) -> Column:
        short = F.regexp_replace(digits, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(short).cast("string"), 6, "0"), short)

    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike(r"^\d"), number(t)).otherwise(t)), "")


def path_match_key(path: Column) -> Column:
    """Path whose parts are free of semicolons, runs of white space and outer blanks."""
    clean = lambda part: F.trim(F.regexp_replace(F.replace(part, F.lit(";"), F.lit("")), r"\s+", " "))
    return F.array_join(F.transform(F.split(path, "/"), clean), "/")


def speaker_title(folder: Column) -> Column:
    """Name part before the word that precedes an institution word; the whole name if there is none."""
    words = F.filter(F.split(F.trim(folder), r"\s+"), lambda w: w != "")
    marks = F.transform(words, lambda w: F.lower(w).rlike("university|center|hospital|association"))
    at = F.array_position(F.transform(marks, lambda m: m.cast("int")), 1)
    return F.when(at > 2, F.array_join(F.slice(words, 1, (at - 2).cast("int")), " ")).otherwise(folder)


def _tenths(seconds: Column) -> Column:
    """Seconds with one decimal, from whole tenths."""
    tenths = F.floor(seconds * 10 + 0.5).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def padded(number: Column, width: int) -> Column:
    """A number with leading zeros; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def slide_filename(number: Column, seconds: Column, phash_hex: Column, group: Column | None = None, subgroup: Column | None = None) -> Column:
    """``slide_NNN_tMmS.Ss[_gGG[-SS]]_hXXXXXXXX.jpg``; numbers that need more digits get them."""
    minutes = F.floor(seconds / 60)
    tag = F.lit("")
    if group is not None:
        tag = F.when(group >= 0, F.concat(F.lit("_g"), padded(group, 2))).otherwise("")
        if subgroup is not None:
            tag = F.concat(tag, F.when((group >= 0) & (subgroup > 1), F.concat(F.lit("-"), padded(subgroup, 2))).otherwise(""))
    return F.concat(
        F.lit("slide_"), padded(number, 3), F.lit("_t"), minutes.cast("string"), F.lit("m"),
        _tenths(seconds - minutes * 60), F.lit("s"), tag, F.lit("_h"), F.substring(phash_hex, 1, 8), F.lit(".jpg"),
    )


def animation_filename(number: Column, seconds: Column, group: Column, state: Column, states: Column) -> Column:
    """``slide_NNN_tMmS.Ss[_animG-K].jpg``: the tag only where a group has more states than one."""
    minutes = F.floor(seconds / 60)
    tag = F.when(states > 1, F.concat(F.lit("_anim"), group.cast("string"), F.lit("-"), state.cast("string"))).otherwise("")
    return F.concat(F.lit("slide_"), padded(number, 3), F.lit("_t"), minutes.cast("string"), F.lit("m"), _tenths(seconds - minutes * 60), F.lit("s"), tag, F.lit(".jpg"))


def state_filename(number: Column, seconds: Column, state: Column) -> Column:
    """``slide_NNN[_K]_tS.Ss.jpg``: K from the second state of a slide on."""
    tag = F.when(state > 1, F.concat(F.lit("_"), state.cast("string"))).otherwise("")
    return F.concat(F.lit("slide_"), padded(number, 3), tag, F.lit("_t"), _tenths(seconds), F.lit("s.jpg"))


def media_triage(ext: Column, length: Column, duration: Column) -> Column:
    """Supported, too_large, needs_convert, needs_split and extract_audio of a media file."""
    supported, compatible = ext.isin(*AUDIO_SUPPORTED), ext.isin(*AUDIO_COMPATIBLE)
    large = length > MAX_UPLOAD_BYTES
    return F.struct(
        supported.alias("supported"), large.alias("too_large"), (~supported | ~compatible).alias("needs_convert"),
        (large | (duration > 600)).alias("needs_split"), ext.isin(*AUDIO_IN_VIDEO).alias("extract_audio"),
    )


def budget_truncate(text: Column, budget: int) -> Column:
    """text cut to its budget, and whether it was cut."""
    return F.struct(F.substring(text, 1, budget).alias("text"), (F.length(text) > budget).alias("truncated"))


def strip_markup(text: Column, budget: int = 3000) -> Column:
    """Plain text of rich-text markup, cut to ``budget`` characters."""
    out = F.regexp_replace(text, r"\\par", "\n")
    out = F.regexp_replace(out, r"\\tab", "\t")
    out = F.regexp_replace(out, r"\\[a-z]+\d*\s?", "")
    return F.substring(F.regexp_replace(out, r"[{}]", ""), 1, budget)
