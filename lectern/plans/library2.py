"""Registered queries of the library and their SQL, part two: names, catalogs, transcripts, reports, streams."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ..functions import frames as M
from ..functions import paths as P
from ..functions import windows as W
from ..operators import catalog as C
from ..operators import groups as G
from ..operators import reports as R
from ..operators import transcripts as T
from ..operators.sequence import with_previous
from ..sources import files as S
from ..sources import images as I
from ..sources import named as N
from ..sources import progress_log as PL
from ..sources.staging import new_folder as _folder
from ..streaming import progress as Z
from . import fixtures as X
from . import metric_sql as Q
from .capture import capture_animation, capture_pipeline, capture_standard, capture_ultra
from .fixtures import sql_with
from .library import _SIDES, ORACLES, query

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(sql_with("catalog") + "SELECT path, dir, regexp_extract(dir, '[^/]*$') AS parent, name, stem, ext, hidden FROM catalog")
def p1_path_parts(spark, sf_dir):
    return X.catalog(spark, sf_dir).select("path").select("path", P.path_parts(F.col("path")).alias("p")).select("path", "p.*")


def _names(spark, sf_dir):
    """Slide names with both time forms, and without one."""
    n = F.col("doc_id").cast("string")
    name = F.when(n.cast("int") % 4 == 0, F.concat(F.lit("slide_"), n, F.lit("_t5m"), (n.cast("int") % 60).cast("string"), F.lit(".5s_h0a1b2c3d.jpg")))
    name = name.when(n.cast("int") % 4 == 1, F.concat(F.lit("Slide"), n, F.lit("_T"), n, F.lit(".25s.JPG"))).when(n.cast("int") % 4 == 2, F.concat(F.lit("img"), n, F.lit("_12s.png")))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dir"), name.otherwise(F.concat(F.lit("page"), n, F.lit("T7.png"))).alias("name"), F.col("n_chars").cast("double").alias("mtime"))


_NAMES = """names AS (SELECT doc_id, source AS dir, n_chars::DOUBLE AS mtime, CASE doc_id % 4 WHEN 0 THEN 'slide_' || doc_id || '_t5m' || doc_id % 60 || '.5s_h0a1b2c3d.jpg'
  WHEN 1 THEN 'Slide' || doc_id || '_T' || doc_id || '.25s.JPG' WHEN 2 THEN 'img' || doc_id || '_12s.png' ELSE 'page' || doc_id || 'T7.png' END AS name FROM documents)"""
_SLIDE_TIME = r"""coalesce(try_cast(regexp_extract(name, '(?i)_t(\d+)m(\d+(?:\.\d+)?)s', 1) AS DOUBLE) * 60 + try_cast(regexp_extract(name, '(?i)_t(\d+)m(\d+(?:\.\d+)?)s', 2) AS DOUBLE),
  try_cast(regexp_extract(name, '(?i)_t(\d+(?:\.\d+)?)s(?:[^a-z]|$)', 1) AS DOUBLE))"""
_NATURAL = r"""array_to_string(list_transform(regexp_extract_all(lower(name), '\d+|\D+'), lambda t: CASE WHEN regexp_matches(t, '^\d')
  THEN lpad(length(regexp_replace(t, '^0+(\d)', '\1'))::VARCHAR, 6, '0') || regexp_replace(t, '^0+(\d)', '\1') ELSE t END), '')"""


@query(f"WITH {_NAMES} SELECT name, {_SLIDE_TIME} AS seconds FROM names")
def p2_slide_time(spark, sf_dir):
    return _names(spark, sf_dir).select("name", P.slide_time(F.col("name")).alias("seconds"))


@query(rf"WITH {_NAMES} SELECT name, coalesce(try_cast(regexp_extract(name, '_t(\d+\.?\d*)s', 1) AS DOUBLE), try_cast(regexp_extract(name, '_(\d+\.?\d*)s', 1) AS DOUBLE), try_cast(regexp_extract(name, 't(\d+\.?\d*)', 1) AS DOUBLE), 0.0) AS seconds FROM names")
def p3_slide_time_legacy(spark, sf_dir):
    return _names(spark, sf_dir).select("name", P.slide_time_legacy(F.col("name")).alias("seconds"))


@query(f"WITH {_NAMES} SELECT name, {_NATURAL} AS k FROM names")
def p4_natural_key(spark, sf_dir):
    return _names(spark, sf_dir).select("name", P.natural_key(F.col("name")).alias("k"))


@query(
    sql_with("catalog")
    + """SELECT path, ext IN ('mp3', 'mp4', 'mpeg', 'mpga', 'm4a', 'wav', 'webm') AS supported, length > 26214400 AS too_large, ext NOT IN ('mp3', 'wav', 'm4a') AS needs_convert,
    length > 26214400 OR length / 10000.0 > 600 AS needs_split, ext IN ('mp4', 'mov', 'avi', 'mkv', 'webm') AS extract_audio FROM catalog WHERE NOT is_dir"""
)
def p5_media_triage(spark, sf_dir):
    files = X.catalog(spark, sf_dir).where("NOT is_dir")
    return files.select("path", P.media_triage(F.col("ext"), F.col("length"), F.col("length") / 10000.0).alias("t")).select("path", "t.*")


@query("SELECT doc_id FROM documents WHERE length(text) >= 100")
def p6_min_length(spark, sf_dir):
    return X.documents(spark, sf_dir).where(F.length("text") >= 100).select("doc_id")


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '[.]', ';/ ', 'g'), '/'), lambda p: trim(regexp_replace(replace(p, ';', ''), '\s+', ' ', 'g'))), '/') AS k FROM documents""")
def p7_path_match_key(spark, sf_dir):
    raw = F.regexp_replace("text", "[.]", ";/ ")
    return X.documents(spark, sf_dir).select("doc_id", P.path_match_key(raw).alias("k"))


@query(
    r"""WITH f AS (SELECT doc_id, string_split(text, ' ')[1] || ' ' || source || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'Saint University' WHEN doc_id % 3 = 1 THEN 'City hospital' ELSE 'x' END AS folder FROM documents),
    w AS (SELECT doc_id, folder, list_filter(regexp_split_to_array(trim(folder), '\s+'), lambda x: x <> '') AS words FROM f),
    m AS (SELECT *, list_position(list_transform(words, lambda x: regexp_matches(lower(x), 'university|center|hospital|association')), true) AS k FROM w)
    SELECT doc_id, CASE WHEN k > 2 THEN array_to_string(words[1:k - 2], ' ') ELSE folder END AS title FROM m"""
)
def p8_speaker_title(spark, sf_dir):
    place = F.when(F.col("doc_id") % 3 == 0, "Saint University").when(F.col("doc_id") % 3 == 1, "City hospital").otherwise("x")
    folder = F.concat_ws(" ", F.get(F.split("text", " "), F.lit(0)), F.col("source"), place)
    return X.table(spark, sf_dir, "documents").select("doc_id", P.speaker_title(folder).alias("title"))


_FILENAME = """'slide_' || printf('%03d', n::BIGINT) || '_t' || floor(s / 60)::BIGINT || 'm' || (floor((s - floor(s / 60) * 60) * 10 + 0.5)::BIGINT // 10) || '.' || (floor((s - floor(s / 60) * 60) * 10 + 0.5)::BIGINT % 10) || 's'"""


@query(
    f"""SELECT doc_id, {_FILENAME} || '_g' || printf('%02d', doc_id % 150) || CASE WHEN doc_id % 120 > 1 THEN '-' || printf('%02d', doc_id % 120) ELSE '' END || '_h' || left(md5(doc_id::VARCHAR), 8) || '.jpg' AS filename
    FROM (SELECT doc_id, doc_id * 7 AS n, n_chars / 7.0::DOUBLE AS s FROM documents)"""
)
def p9_slide_filename(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    tag = F.md5(F.col("doc_id").cast("string").cast("binary"))
    return d.select("doc_id", P.slide_filename(F.col("doc_id") * 7, F.col("n_chars") / 7.0, tag, F.col("doc_id") % 150, F.col("doc_id") % 120).alias("filename"))


@query("SELECT doc_id, length(left(text, 3000)) AS kept, length(text) > 3000 AS truncated FROM documents")
def p10_budget_truncate(spark, sf_dir):
    out = X.documents(spark, sf_dir).select("doc_id", P.budget_truncate(F.col("text"), 3000).alias("b"))
    return out.select("doc_id", F.length("b.text").cast("long").alias("kept"), "b.truncated")


_MARKUP = r"'{\b0 ' || replace(replace(text, '. ', '\par '), ', ', '\tab ') || '}'"


@query(rf"""SELECT doc_id, md5(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\\par', chr(10), 'g'), '\\tab', chr(9), 'g'), '\\[a-z]+\d*\s?', '', 'g'), '[{{}}]', '', 'g'), 3000)) AS plain FROM (SELECT doc_id, {_MARKUP} AS m FROM documents)""")
def p13_strip_markup(spark, sf_dir):
    markup = F.concat(F.lit("{\\b0 "), F.replace(F.replace("text", F.lit(". "), F.lit("\\par ")), F.lit(", "), F.lit("\\tab ")), F.lit("}"))
    return X.documents(spark, sf_dir).select("doc_id", F.md5(P.strip_markup(markup).cast("binary")).alias("plain"))


@query(f"WITH {_NAMES} SELECT doc_id, row_number() OVER (PARTITION BY dir ORDER BY ({_SLIDE_TIME} IS NULL)::INTEGER, coalesce({_SLIDE_TIME}, mtime), {_NATURAL}, name) AS position FROM names")
def w1_slide_order(spark, sf_dir):
    return C.slide_order(_names(spark, sf_dir)).select("doc_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {_NAMES}, r AS (SELECT dir, name, mtime AS s, row_number() OVER (PARTITION BY dir ORDER BY mtime, name) AS n FROM names) SELECT dir, name AS old_name, n AS new_index, {_FILENAME} || '_h' || regexp_extract(name, '_h([0-9a-f]{{8}})', 1) || '.jpg' AS new_name FROM r")
def w17_renumber(spark, sf_dir):
    slides = _names(spark, sf_dir).select("dir", F.col("name").alias("filename"), F.col("mtime").alias("timestamp"))
    return C.renumber(slides, "dir").withColumn("new_index", F.col("new_index").cast("long"))


@query(f"WITH {_NAMES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new_' || name ELSE name END AS filename, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1000 ELSE doc_id END AS slide_index FROM names")
def j13_apply_rename(spark, sf_dir):
    names = _names(spark, sf_dir)
    plan = names.where("doc_id % 2 = 0").select(F.col("name").alias("old_name"), F.concat(F.lit("new_"), "name").alias("new_name"), (F.col("doc_id") + 1000).alias("new_index"))
    return G.apply_rename(names.select("doc_id", F.col("name").alias("filename"), F.col("doc_id").alias("slide_index")), plan)


@query(f"WITH {_NAMES} SELECT doc_id FROM names WHERE doc_id % 3 = 0")
def j14_retain_existing(spark, sf_dir):
    names = _names(spark, sf_dir).withColumnRenamed("name", "filename")
    return G.retain_existing(names, names.where("doc_id % 3 = 0")).select("doc_id")


@query(sql_with("catalog") + "SELECT DISTINCT path FROM catalog WHERE is_dir AND regexp_matches(name, '_slides$') AND name <> 'selected_slides'")
def s2_find_slide_folders(spark, sf_dir):
    return C.find_slide_folders(X.catalog(spark, sf_dir))


@query(sql_with("catalog") + "SELECT path, length FROM catalog WHERE NOT is_dir AND NOT hidden AND ext IN ('mp4', 'avi', 'mkv', 'mov', 'wmv', 'flv', 'webm')")
def s1_catalog_videos(spark, sf_dir):
    return C.visible_files(X.catalog(spark, sf_dir), P.VIDEO_EXTENSIONS).select("path", "length")


_VIDEOS = "v AS (SELECT * FROM catalog WHERE NOT is_dir AND NOT hidden AND ext = 'mp4'), d AS (SELECT DISTINCT dir, name FROM catalog WHERE is_dir AND contains(lower(name), 'slide'))"


@query(
    sql_with("catalog")
    + f""", {_VIDEOS}, m AS (SELECT v.path, list(DISTINCT d.name ORDER BY d.name) FILTER (lower(d.name) NOT IN ('slide', 'slides') AND contains(lower(d.name), lower(v.stem))) AS s,
      list(DISTINCT d.name ORDER BY d.name) FILTER (lower(d.name) IN ('slide', 'slides')) AS g FROM v LEFT JOIN d ON v.dir = d.dir GROUP BY v.path)
    SELECT path, CASE WHEN len(s) > 0 THEN 'specific' WHEN len(g) > 0 THEN 'generic' ELSE 'none' END AS status, array_to_string(coalesce(CASE WHEN len(s) > 0 THEN s ELSE g END, []), ',') AS matches FROM m"""
)
def j1_match_slide_folders(spark, sf_dir):
    return C.match_slide_folders(X.catalog(spark, sf_dir)).withColumn("matches", F.array_join("matches", ","))


@query(sql_with("catalog") + f", {_VIDEOS} SELECT path FROM v WHERE dir NOT IN (SELECT dir FROM d)")
def j2_without_slide_folder(spark, sf_dir):
    return C.without_slide_folder(X.catalog(spark, sf_dir))


# Image folders beside the videos of the catalog, for the order of candidates.
_IMAGE_FOLDERS = (("slides", "a.jpg", 3), ("Slides", "b.webp", 5), ("slide", "c.gif", 7), ("Slide", "._d.png", 2), ("slides_improved", "e.PNG", 11))


def _with_images(spark, sf_dir):
    """The catalog of each document in a folder of its own, with image folders of all names."""
    d = X.table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"))
    entry = lambda when, path: F.when(when, path)
    n = F.col("doc_id")
    files = [entry(n % k == 0, F.concat(folder, F.lit(f"/{name}/{file}"))) for name, file, k in _IMAGE_FOLDERS]
    own = [entry(n % 13 == 0, F.concat(folder, F.lit("/talk_slide/x.jpeg"))), entry(n % 17 == 0, F.concat(folder, F.lit("/slides_improved_talk/y.png")))]
    listed = d.select(F.explode(F.filter(F.array(F.concat(folder, F.lit("/talk.mp4")), *files, *own), lambda p: p.isNotNull())).alias("path"))
    return C.with_parts(listed.withColumn("is_dir", F.lit(False)))


def _captured_sql(names: tuple[str, ...]) -> str:
    """The first folder in order that holds a visible image, case by case."""
    held = {name: f"(doc_id % {k} = 0)" for name, file, k in _IMAGE_FOLDERS if not file.startswith("._")} | {"talk_slide": "(doc_id % 13 = 0)", "slides_improved_talk": "(doc_id % 17 = 0)"}
    cases = " ".join(f"WHEN {held[x]} THEN '{x}'" for x in names if x in held)
    return f"SELECT '/corpus/' || doc_id || '/talk.mp4' AS path, '/corpus/' || doc_id || '/' || CASE {cases} END AS folder FROM documents"


@query(_captured_sql(("talk_slides", "talk_slide", "slides", "slide", "Slides", "Slide")))
def j3_already_captured(spark, sf_dir):
    return C.already_captured(_with_images(spark, sf_dir))


@query(_captured_sql(("slides_improved_talk", "talk_slides_improved", "talk_slides", "talk_slide", "slides_improved", "slides", "slide", "Slides", "Slide")))
def j3_already_captured_improved(spark, sf_dir):
    return C.already_captured(_with_images(spark, sf_dir), "improved")


@query(sql_with("progress") + "SELECT doc_id AS item FROM documents WHERE doc_id NOT IN (SELECT item FROM progress WHERE status IN ('processed', 'failed')) AND doc_id % 7 <> 0")
def j4_todo(spark, sf_dir):
    items = X.documents(spark, sf_dir).select(F.col("doc_id").alias("item"))
    return C.todo(items, X.progress(spark, sf_dir), items.where("item % 7 = 0"))


@query(sql_with("progress") + "SELECT doc_id AS item FROM documents WHERE doc_id NOT IN (SELECT item FROM progress WHERE status = 'processed')")
def j4_todo_retry_failed(spark, sf_dir):
    return C.todo(X.documents(spark, sf_dir).select(F.col("doc_id").alias("item")), X.progress(spark, sf_dir), retry_failed=True)


@query(
    sql_with("catalog")
    + r""", p AS (SELECT path FROM catalog WHERE length % 3 = 0) SELECT path FROM catalog WHERE ext = 'srt' AND NOT hidden
    AND path NOT IN (SELECT path FROM p) AND regexp_replace(path, '\.srt$', '.txt') NOT IN (SELECT path FROM p)"""
)
def j5_todo_sibling(spark, sf_dir):
    files = X.catalog(spark, sf_dir)
    return C.todo_sibling(files, files.where("length % 3 = 0"))


@query(
    sql_with("catalog")
    + """, s AS (SELECT path, dir, stem, regexp_extract(dir, '[^/]*$') AS folder FROM catalog WHERE starts_with(name, 'transcription-') AND ext = 'txt'),
    f AS (SELECT dir, stem AS n, name, ext, list_position(['rtfd', 'rtf', 'docx', 'doc', 'txt'], ext) AS e FROM catalog WHERE NOT hidden AND ext IN ('rtfd', 'rtf', 'docx', 'doc', 'txt')),
    x AS (SELECT s.path, e * 10 + list_position([s.stem, replace(s.stem, 'transcription-', ''), s.folder], n) - 1 AS r, name, s.dir FROM s JOIN f ON s.dir = f.dir AND n IN (s.stem, replace(s.stem, 'transcription-', ''), s.folder)
      UNION ALL SELECT s.path, 1000, o.name, s.dir FROM s JOIN (SELECT dir, arg_min(name, (e, name)) AS name FROM f WHERE ext <> 'txt' AND NOT contains(lower(name), 'transcription') GROUP BY dir) o ON s.dir = o.dir)
    SELECT s.path, b.agenda FROM s LEFT JOIN (SELECT path, arg_min(dir || '/' || name, (r, name)) AS agenda FROM x GROUP BY path) b ON s.path = b.path"""
)
def j6_match_agenda(spark, sf_dir):
    files = X.catalog(spark, sf_dir)
    return C.match_agenda(files, files.where("startswith(name, 'transcription-') AND ext = 'txt'"))


_UP = "list_transform(range(1, greatest(len(string_split(path, '/')), 2)), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))"


@query(
    sql_with("catalog")
    + rf""", n AS (SELECT dir AS folder, path AS notes FROM catalog WHERE regexp_matches(name, '^transcription-.*_detailed_notes\.md$')),
    a AS (SELECT path, list_position(['selected_slides_analysis.md', 'full_slides_analysis.md', 'selected_slides_analysis_gemini.md', 'full_slides_analysis_gemini.md'], name) AS r FROM catalog),
    u AS (SELECT path AS analysis, r, unnest({_UP}) AS folder FROM a WHERE r > 0)
    SELECT n.folder, n.notes, b.analysis FROM n JOIN (SELECT folder, arg_min(analysis, (r, analysis)) AS analysis FROM u GROUP BY folder) b USING (folder)"""
)
def j7_match_notes_slides(spark, sf_dir):
    return C.match_notes_slides(X.catalog(spark, sf_dir))


_ATTACHED = f"""md AS (SELECT path FROM catalog WHERE name LIKE '%analysis.md'), fo AS (SELECT path AS folder, row_number() OVER (ORDER BY path) AS rank FROM catalog WHERE is_dir),
  att AS (SELECT md.path, b.folder FROM md LEFT JOIN (SELECT path, arg_min(folder, rank) AS folder FROM (SELECT path, unnest({_UP}) AS folder FROM md) JOIN fo USING (folder) GROUP BY path) b USING (path))"""


def _attached(spark, sf_dir):
    files = X.catalog(spark, sf_dir)
    folders = files.where("is_dir").select(F.col("path").alias("folder"), F.col("path").alias("rank"))
    return C.prefix_attach(files.where("name LIKE '%analysis.md'"), folders), folders


@query(sql_with("catalog") + f", {_ATTACHED} SELECT path, folder FROM att")
def j8_prefix_attach(spark, sf_dir):
    return _attached(spark, sf_dir)[0]


@query(
    sql_with("catalog")
    + """, starts AS (SELECT regexp_replace(path, '[0-9]?_slides$', '') AS folder, min(path) AS rank FROM catalog WHERE is_dir GROUP BY ALL),
    files AS (SELECT path, dir FROM catalog WHERE name LIKE '%analysis.md')
    SELECT f.path, arg_min(folder, (rank, folder)) AS folder FROM files f LEFT JOIN starts s ON starts_with(f.dir, s.folder) GROUP BY f.path"""
)
def j8_prefix_attach_raw(spark, sf_dir):
    """Analyses attached to starts of folder names, such as transcription-1 for transcription-12_slides."""
    files = X.catalog(spark, sf_dir)
    starts = files.where("is_dir").groupBy(F.regexp_replace("path", "[0-9]?_slides$", "").alias("folder")).agg(F.min("path").alias("rank"))
    return C.prefix_attach(files.where("name LIKE '%analysis.md'"), starts.withColumn("rank", F.struct("rank", "folder")), raw=True)


@query(sql_with("catalog") + f", {_ATTACHED} SELECT count(DISTINCT att.folder) AS covered, (SELECT count(*) FROM fo) AS folders, round(count(DISTINCT att.folder) * 100.0 / (SELECT count(*) FROM fo), 2)::DOUBLE AS percent FROM att")
def a6_coverage(spark, sf_dir):
    return R.coverage(*_attached(spark, sf_dir))


@query(sql_with("catalog") + ", r AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY (ext <> 'txt')::INTEGER, path) AS n FROM catalog WHERE ext IN ('txt', 'srt') AND NOT hidden) SELECT path FROM r WHERE n = 1")
def w18_prefer_text(spark, sf_dir):
    return C.prefer_text(X.catalog(spark, sf_dir).where("ext IN ('txt', 'srt') AND NOT hidden")).select("path")


@query(sql_with("catalog") + ", r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name) AS n FROM catalog) SELECT path FROM r WHERE n <= 20")
def w19_take_per_folder(spark, sf_dir):
    return C.take_per_folder(X.catalog(spark, sf_dir), 20).select("path")


# Transcripts


_SENTENCES = rf"list_filter(list_transform(regexp_split_to_array(text, '[.。]'), lambda s: {_STRIP.format('s')}), lambda s: s <> '')"


@query(f"SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS sentence_no, unnest(l) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS l FROM documents)")
def t2_sentences(spark, sf_dir):
    return T.sentences(X.documents(spark, sf_dir))


_EVEN = f"""each AS (SELECT doc_id, seg_no, start, 600.0::DOUBLE / len(l) AS share, unnest(range(0, len(l))) AS k, unnest(l) AS s FROM (SELECT *, {_SENTENCES} AS l FROM segments)),
  cues AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, k)::INTEGER AS cue_no, start + k * share AS start_s, start + (k + 1) * share AS end_s, s || '。' AS text FROM each)"""


@query(sql_with("segments") + f", {_EVEN} SELECT doc_id, cue_no, round(start_s, 4) AS start_s, round(end_s, 4) AS end_s, text FROM cues")
def t3_cues_even(spark, sf_dir):
    return T.cues_even(X.segments(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("start_s", "end_s")})


_LENGTH = f"""lined AS (SELECT doc_id, unnest(range(0, len(l))) AS k, unnest(l) AS s FROM (SELECT doc_id, {_SENTENCES} AS l FROM documents)),
  timed AS (SELECT *, least(greatest(length(s) * 3, 20), 100) AS d FROM lined),
  cues AS (SELECT doc_id, (k + 1)::INTEGER AS cue_no, (sum(d) OVER w - d) / 10.0::DOUBLE AS start_s, sum(d) OVER w / 10.0::DOUBLE AS end_s, s || '。' AS text FROM timed WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""


@query(f"WITH {_LENGTH} SELECT doc_id, cue_no, start_s::DOUBLE AS start_s, end_s::DOUBLE AS end_s, text FROM cues")
def t4_cues_by_length(spark, sf_dir):
    return T.cues_by_length(X.documents(spark, sf_dir))


def _timed_segments(spark, sf_dir):
    cue = lambda s, k: F.struct((k * 2.5).alias("start"), (k * 2.5 + 2).alias("end"), F.concat(F.lit(" "), s).alias("text"))
    return X.segments(spark, sf_dir).select("doc_id", "seg_no", "start", F.transform(T.sentence_list(F.col("text")), cue).alias("cues"))


@query(sql_with("segments") + f", e AS (SELECT doc_id, seg_no, start, unnest(range(0, len(l))) AS k, unnest(l) AS s FROM (SELECT *, {_SENTENCES} AS l FROM segments)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, k)::INTEGER AS cue_no, start + k * 2.5::DOUBLE AS start_s, start + k * 2.5::DOUBLE + 2 AS end_s, s AS text FROM e")
def t5_cues_precise(spark, sf_dir):
    return T.cues_precise(_timed_segments(spark, sf_dir))


@query(sql_with("segments") + f", e AS (SELECT doc_id, seg_no, start, unnest(range(0, len(l))) AS k, unnest(l) AS s FROM (SELECT *, {_SENTENCES} AS l FROM segments)) SELECT doc_id, seg_no, k::INTEGER AS pos, start + k * 2.5::DOUBLE AS start_s, start + k * 2.5::DOUBLE + 2 AS end_s, ' ' || s AS text FROM e")
def j12_offset_cues(spark, sf_dir):
    return T.offset_cues(_timed_segments(spark, sf_dir))


def _srt_time(x: str) -> str:
    ms = f"floor(round({x} * 1e6) / 1000)::BIGINT"
    hours = f"{ms} // 3600000"
    shown = f"CASE WHEN {hours} < 10 THEN lpad(({hours})::VARCHAR, 2, '0') ELSE ({hours})::VARCHAR END"
    return f"{shown} || ':' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


@query(sql_with("series") + f"SELECT event_id, {_srt_time('t')} AS shown FROM series")
def t6_srt_time(spark, sf_dir):
    return X.series(spark, sf_dir).select("event_id", T.srt_time(F.col("t")).alias("shown"))


_SRT = f"srt AS (SELECT doc_id, string_agg(cue_no || chr(10) || {_srt_time('start_s')} || ' --> ' || {_srt_time('end_s')} || chr(10) || text || chr(10), chr(10) ORDER BY cue_no) AS srt FROM cues GROUP BY doc_id)"


def _srt_files(spark, sf_dir):
    return T.srt_render(T.cues_by_length(X.documents(spark, sf_dir)))


@query(f"WITH {_LENGTH}, {_SRT} SELECT doc_id, md5(srt) AS srt FROM srt")
def t7_srt_render(spark, sf_dir):
    return _srt_files(spark, sf_dir).select("doc_id", F.md5(F.col("srt").cast("binary")).alias("srt"))


@query(
    rf"""WITH {_LENGTH}, {_SRT}, li AS (SELECT doc_id, unnest(range(0, len(l))) AS k, unnest(l) AS line FROM (SELECT doc_id, list_transform(string_split(srt, chr(10)), lambda s: {_STRIP.format('s')}) AS l FROM srt)),
    o AS (SELECT *, regexp_full_match(line, '\d+') AND coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY k) = '', true) AS opens FROM li),
    b AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM o),
    p AS (SELECT *, row_number() OVER w AS pos, max((line = '')::INTEGER) OVER w AS blank FROM b WHERE block > 0 WINDOW w AS (PARTITION BY doc_id, block ORDER BY k))
    SELECT doc_id, block::INTEGER AS cue_no, string_agg(line, ' ' ORDER BY k) AS text FROM p WHERE pos > 1 AND blank = 0 AND NOT (pos = 2 AND contains(line, '-->')) GROUP BY ALL"""
)
def t8_srt_cues(spark, sf_dir):
    return T.srt_cues(_srt_files(spark, sf_dir))


_BATCHES = "placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cue_no) - 1 AS n FROM cues), req AS (SELECT doc_id, (n // 30)::INTEGER AS batch_no, string_agg((n % 30) || '. ' || replace(text, chr(10), ' '), chr(10) ORDER BY n) AS request FROM placed GROUP BY ALL)"


@query(f"WITH {_LENGTH}, {_BATCHES} SELECT doc_id, batch_no, md5(request) AS request FROM req")
def t9_translation_batches(spark, sf_dir):
    out = T.translation_batches(T.cues_by_length(X.documents(spark, sf_dir)))
    return out.select("doc_id", "batch_no", F.md5(F.col("request").cast("binary")).alias("request"))


def _responses(spark, sf_dir):
    """Answers in upper case of ASCII letters; every seventh line from the third on is missing."""
    requests = T.translation_batches(T.cues_by_length(X.documents(spark, sf_dir)))
    lines = F.filter(F.split("request", "\n"), lambda l: ~(F.regexp_extract(l, r"^(\d+)", 1).cast("int") % 7 == 3))
    return requests.select("doc_id", "batch_no", F.translate(F.array_join(lines, "\n"), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("response"))


_UPPER = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"WITH {_LENGTH}, {_BATCHES} SELECT doc_id, (n // 30)::INTEGER AS batch_no, (n % 30)::INTEGER AS line_no, {_UPPER.format(_STRIP.format('replace(text, chr(10), chr(32))'))} AS text FROM placed WHERE n % 30 % 7 <> 3")
def t10_parse_numbered_lines(spark, sf_dir):
    return T.parse_numbered_lines(_responses(spark, sf_dir))


@query(f"WITH {_LENGTH}, {_BATCHES} SELECT doc_id, cue_no, CASE WHEN n % 30 % 7 = 3 THEN text ELSE {_UPPER.format(_STRIP.format('replace(text, chr(10), chr(32))'))} END AS text FROM placed")
def j11_align_translations(spark, sf_dir):
    return T.align_translations(T.cues_by_length(X.documents(spark, sf_dir)), _responses(spark, sf_dir))


@query("SELECT doc_id, 'Session: ' || source || chr(10) || 'Agenda: ' || lang || chr(10) || left(text, 50000) AS request FROM (SELECT doc_id, source, lang, text FROM documents WHERE length(text) >= 100 AND doc_id % 2 = 0) UNION ALL SELECT doc_id, 'Session: ' || source || chr(10) || left(text, 50000) FROM documents WHERE length(text) >= 100 AND doc_id % 2 = 1")
def t11_request_table(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").where(F.length("text") >= 100)
    agenda = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Agenda: "), "lang"))
    return d.select("doc_id", F.concat_ws("\n", F.concat(F.lit("Session: "), "source"), agenda, P.budget_truncate(F.col("text"), 50000)["text"]).alias("request"))


@query("SELECT doc_id, unnest(range(0, n))::INTEGER AS seg_no, unnest(list_transform(range(0, n), lambda k: k * 600.0::DOUBLE)) AS start, unnest(list_transform(range(0, n), lambda k: least(600.0::DOUBLE, d - k * 600.0))) AS duration FROM (SELECT doc_id, n_chars::DOUBLE AS d, ceil(n_chars / 600.0)::BIGINT AS n FROM documents WHERE n_chars > 0)")
def t12_segment_plan(spark, sf_dir):
    return T.segment_plan(X.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("duration")))


@query(sql_with("segments") + "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY seg_no, text) AS text FROM segments GROUP BY doc_id")
def t13_merge_transcript(spark, sf_dir):
    return T.merge_transcript(X.segments(spark, sf_dir))


_MARKDOWN = "SELECT doc_id AS doc, '# Talk ' || doc_id || chr(10) || chr(10) || string_agg('## ' || seg_no || chr(10) || chr(10) || '![](' || seg_no || '.png)' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY seg_no) AS body FROM (SELECT doc_id, seg_no, min(text) AS text FROM segments GROUP BY ALL) GROUP BY doc_id"


def _slide_documents(spark, sf_dir):
    s = X.segments(spark, sf_dir).groupBy(F.col("doc_id").alias("doc"), F.col("seg_no").alias("number")).agg(F.min("text").alias("text"))
    return T.render_markdown(s.select("doc", F.concat(F.lit("Talk "), F.col("doc").cast("string")).alias("title"), "number", F.concat(F.col("number").cast("string"), F.lit(".png")).alias("image"), "text"))


@query(sql_with("segments") + _MARKDOWN)
def t13_render_markdown(spark, sf_dir):
    return _slide_documents(spark, sf_dir)


@query(sql_with("segments") + _MARKDOWN)
def s7_write_markdown(spark, sf_dir):
    """Written as one file per document and read back."""
    path = _folder(spark, "markdown")
    S.write_documents(_slide_documents(spark, sf_dir), path, "doc", "body")
    return N.read_named(spark, path).select(S.key_of(F.col("name")).cast("long").alias("doc"), F.col("content").alias("body"))


@query(sql_with("segments") + "SELECT doc_id % 2 = 0 AS even, count(*) AS segments, count(DISTINCT doc_id) AS documents, sum(length(text))::BIGINT AS characters FROM segments GROUP BY ALL")
def s8_write_report(spark, sf_dir):
    """A report written as JSON and read back."""
    path = _folder(spark, "report")
    report = X.segments(spark, sf_dir).groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(
        F.count("*").alias("segments"), F.count_distinct("doc_id").alias("documents"), F.sum(F.length("text")).alias("characters")
    )
    S.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


_LANGS = "langs AS (SELECT * FROM segments, (VALUES ('en'), ('de')) AS l(lang))"


@query(sql_with("segments") + f", {_LANGS} SELECT lang, doc_id || '_' || lang AS name, string_agg(lang || ' ' || text, chr(10) ORDER BY seg_no, text) AS body FROM langs GROUP BY ALL")
def s9_write_srt(spark, sf_dir):
    """One text a document and language, named stem_lang below its language, written and read back."""
    path = _folder(spark, "srt")
    s = X.segments(spark, sf_dir).withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("de"))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"])
    texts = s.groupBy("lang", "doc_id").agg(lines.alias("lines"))
    texts = texts.select(F.col("doc_id").cast("string").alias("stem"), "lang", F.array_join(F.transform("lines", lambda t: F.concat_ws(" ", "lang", t)), "\n").alias("body"))
    S.write_by_language(texts, path)
    part = lambda k: S.key_of(F.split_part("name", F.lit("/"), F.lit(k)))
    return N.read_named(spark, path).select(part(1).alias("lang"), part(2).alias("name"), F.col("content").alias("body"))


@query(sql_with("frames") + "SELECT video_id, frame_idx, ts AS timestamp, CASE WHEN frame_idx % 3 = 0 THEN -1 ELSE frame_idx % 5 END::INTEGER AS group_id, 1 + video_id % 3 AS shape FROM frames")
def s3_read_slide_metadata(spark, sf_dir):
    """Metadata of all three shapes written as JSON, a file or more a video, and read into one table."""
    path = _folder(spark, "metadata")
    f = X.frames(spark, sf_dir).select("video_id", "frame_idx", "timestamp", F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("video"))
    group = F.when(F.col("frame_idx") % 3 != 0, F.col("frame_idx") % 5).cast("int")
    key = F.when(F.col("video_id") % 3 == 2, "frame_idx").otherwise("frame_index")
    slide = F.struct(F.when(key == "frame_index", F.col("frame_idx")).alias("frame_index"), F.when(key == "frame_idx", F.col("frame_idx")).alias("frame_idx"), "timestamp", group.alias("group_id"))
    videos = f.withColumn("part", F.floor(F.col("frame_idx") / 500)).groupBy("video_id", "part", "video").agg(F.collect_list(slide).alias("slides"))
    kind = F.col("video_id") % 3
    body = F.struct(
        F.when(kind < 2, F.col("video")).alias("video_path"), F.when(kind == 2, F.struct(F.col("video").alias("path"))).alias("video_info"), "slides",
        F.when(kind == 1, F.create_map(F.lit("0"), F.array(F.array(F.lit("1"), F.lit("h"))))).alias("similarity_groups"),
        F.when(kind == 2, F.create_map(F.lit("group_1"), F.struct(F.lit(1).alias("slide_count")))).alias("groups"),
    )
    videos.select(F.to_json(body).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    out = S.read_slide_metadata(spark, path)
    return out.select(F.regexp_extract("video_path", r"(\d+)$", 1).cast("long").alias("video_id"), "frame_idx", "timestamp", "group_id", F.col("shape").cast("long").alias("shape"))


@query(sql_with("segments") + "SELECT doc_id, seg_no, CASE WHEN seg_no % 3 = 0 THEN 'cues' WHEN seg_no % 3 = 1 THEN 'text' ELSE 'pending' END AS status, CASE WHEN seg_no % 3 < 2 THEN text END AS text FROM segments")
def t14_reuse_or_compute(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    return T.reuse_or_compute(s, s.where("seg_no % 3 = 0"), s.where("seg_no % 3 < 2"))


@query(sql_with("segments") + f"SELECT doc_id, seg_no, last_value(CASE WHEN {_STRIP.format('text')} <> '' THEN right({_STRIP.format('text')}, 200) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM segments")
def w20_context_tail(spark, sf_dir):
    return T.context_tail(X.segments(spark, sf_dir)).select("doc_id", "seg_no", "context")


@query(
    r"""WITH grams AS (SELECT doc_id, s, substr(text, s, 15) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 13)) AS s FROM documents)),
    near AS (SELECT a.doc_id, a.s, b.s - a.s AS size FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.s - a.s BETWEEN 15 AND 80),
    runs AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, size ORDER BY s) AS run FROM near),
    counted AS (SELECT doc_id, s, size, 1 + (max(s) OVER (PARTITION BY doc_id, size, run) - s + 15) // size AS times FROM runs),
    said AS (SELECT c.*, substr(text, s, size) AS said FROM counted c JOIN documents USING (doc_id) WHERE times >= 3),
    best AS (SELECT * FROM said WHERE regexp_matches(said, '\S') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, times DESC, s) = 1)
    SELECT doc_id, times IS NOT NULL AS has_repetition, coalesce(times * size / length(d.text)::DOUBLE, 0.0) AS ratio, left(said, 100) AS phrase, coalesce(times, 0)::INTEGER AS count,
      CASE WHEN times IS NULL THEN length(d.text) ELSE length(regexp_replace(left(d.text, s - 1 + size), '\s+$', '')) END::INTEGER AS clean_length
    FROM documents d LEFT JOIN best USING (doc_id)"""
)
def t1_repetition_loops(spark, sf_dir):
    return T.repetition_loops(X.documents(spark, sf_dir)).select("doc_id", "loop.has_repetition", "loop.ratio", "loop.phrase", "loop.count", F.length("loop.clean_text").alias("clean_length"))


# Reports


def _analyses(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, R.ANALYSIS_KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return X.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("folder"), kind.alias("kind"))


_ANALYSES = "an AS (SELECT source || '/' || lang AS folder, ['selected', 'full', 'selected_gemini', 'full_gemini'][doc_id % 4 + 1] AS kind FROM documents)"
_FLAGS = "SELECT folder, bool_or(kind = 'selected') AS has_selected, bool_or(kind = 'full') AS has_full, bool_or(kind = 'selected_gemini') AS has_selected_gemini, bool_or(kind = 'full_gemini') AS has_full_gemini, true AS has_any FROM an GROUP BY folder"


@query(f"WITH {_ANALYSES} {_FLAGS}")
def a4_status_flags(spark, sf_dir):
    return R.status_flags(_analyses(spark, sf_dir))


@query(
    f"""WITH {_ANALYSES}, fl AS ({_FLAGS}) SELECT count(*) AS total, count(*) FILTER (has_selected) AS selected, count(*) FILTER (has_full) AS openai, count(*) FILTER (has_full_gemini) AS gemini,
    count(*) FILTER (has_full AND has_full_gemini) AS both, count(*) FILTER (has_selected AND NOT has_full AND NOT has_full_gemini) AS none, coalesce(string_agg(folder, ',' ORDER BY folder) FILTER (NOT has_selected), '') AS without_selected,
    round(count(*) FILTER (has_full) * 100.0 / count(*) FILTER (has_selected), 4)::DOUBLE AS openai_pct, round(count(*) FILTER (has_full_gemini) * 100.0 / count(*) FILTER (has_selected), 4)::DOUBLE AS gemini_pct FROM fl"""
)
def a5_status_totals(spark, sf_dir):
    flags = R.status_flags(_analyses(spark, sf_dir)).select("folder", "has_selected", F.col("has_full").alias("openai"), F.col("has_full_gemini").alias("gemini"))
    out = R.status_totals(flags).withColumn("without_selected", F.array_join("without_selected", ","))
    return out.withColumns({c: F.round(c, 4) for c in ("openai_pct", "gemini_pct")})


@query(sql_with("runs") + """SELECT job, total, processed, failed, units, round(seconds, 6) AS seconds, total - processed - failed AS skipped, round(units / processed, 6) AS avg_units, round(seconds / processed, 6) AS avg_seconds FROM (
    SELECT job, count(*) AS total, count(*) FILTER (status = 'success') AS processed, count(*) FILTER (status = 'failed') AS failed, sum(CASE WHEN status = 'success' THEN n_units ELSE 0 END)::BIGINT AS units, sum(CASE WHEN status = 'success' THEN seconds ELSE 0 END) AS seconds FROM runs GROUP BY job)""")
def a7_run_summary(spark, sf_dir):
    return R.run_summary(X.runs(spark, sf_dir), "job").withColumns({c: F.round(c, 6) for c in ("seconds", "avg_units", "avg_seconds")})


@query(sql_with("runs") + """SELECT job, total, processed, failed, skipped, images, api_calls, round(seconds, 6) AS seconds, round(seconds / nullif(processed, 0), 6) AS avg_seconds, round(images / nullif(processed, 0), 6) AS avg_images FROM (
    SELECT job, count(*) AS total, count(*) FILTER (status = 'success') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
    sum(CASE WHEN status = 'success' THEN n_units ELSE 0 END)::BIGINT AS images, sum(CASE WHEN status = 'success' THEN (n_units + 9) // 10 ELSE 0 END)::BIGINT AS api_calls, sum(seconds) AS seconds FROM runs GROUP BY job)""")
def a7_analysis_summary(spark, sf_dir):
    runs = X.runs(spark, sf_dir).withColumn("images", F.col("n_units")).withColumn("api_calls", F.expr("(n_units + 9) div 10"))
    return R.analysis_summary(runs, "job").withColumns({c: F.round(c, 6) for c in ("seconds", "avg_seconds", "avg_images")})


@query(f"WITH {_ANALYSES}, fl AS ({_FLAGS}) SELECT n AS remaining, n * 3.0::DOUBLE AS minutes, n / 20.0::DOUBLE AS hours FROM (SELECT count(*) FILTER (NOT has_selected_gemini) AS n FROM fl)")
def a11_static_estimate(spark, sf_dir):
    return R.static_estimate(R.status_flags(_analyses(spark, sf_dir)), "has_selected_gemini")


@query("SELECT source, sum(length(text) + length(lang))::BIGINT AS tokens, round(sum(length(text) + length(lang)) / 1e6 * 7.5, 2) AS cost FROM documents GROUP BY source")
def a8_token_cost(spark, sf_dir):
    return R.token_cost(X.table(spark, sf_dir, "documents").select("source", F.col("text").alias("request"), F.col("lang").alias("response")), "source")


@query("SELECT source, count(*) FILTER (doc_id % 5 = 0) AS merged, count(*) FILTER (doc_id % 2 = 0) AS notes, count(*) FILTER (doc_id % 3 = 0) AS slides, round(count(*) FILTER (doc_id % 5 = 0) * 100.0 / nullif(least(count(*) FILTER (doc_id % 2 = 0), count(*) FILTER (doc_id % 3 = 0)), 0), 1)::DOUBLE AS rate FROM documents GROUP BY source")
def a9_merge_rate(spark, sf_dir):
    some = lambda k: F.count_if(F.col("doc_id") % k == 0)
    return R.merge_rate(X.table(spark, sf_dir, "documents").groupBy("source").agg(some(5).alias("merged"), some(2).alias("notes"), some(3).alias("slides")))


@query(sql_with("catalog") + "SELECT ext, count(*) AS n FROM catalog GROUP BY ext")
def a10_counts_by_ext(spark, sf_dir):
    return R.counts_by_ext(X.catalog(spark, sf_dir))


@query("SELECT count(*) FILTER (contains(left(text, 500), 'the')) AS with_agenda, count(*) AS notes FROM documents")
def a10_agenda_presence(spark, sf_dir):
    return R.agenda_presence(X.documents(spark, sf_dir), "the")


@query(sql_with("runs") + "SELECT item, n AS done, round(e, 4) AS elapsed, round(e / n * (total - n), 6) AS eta FROM (SELECT item, row_number() OVER w AS n, sum(seconds) OVER w AS e, count(*) OVER (PARTITION BY job) AS total FROM runs WINDOW w AS (PARTITION BY job ORDER BY item))")
def a11_eta(spark, sf_dir):
    out = R.eta(X.runs(spark, sf_dir), "job", "item")
    return out.select("item", F.col("done").cast("long").alias("done"), F.round("elapsed", 4).alias("elapsed"), F.round("eta", 6).alias("eta"))


@query(sql_with("catalog") + "SELECT dir, string_agg(name, '|' ORDER BY name) AS names, count(DISTINCT name) AS n_distinct FROM catalog GROUP BY dir")
def a13_folder_listing(spark, sf_dir):
    return R.folder_listing(X.catalog(spark, sf_dir), "dir", "name").withColumn("names", F.array_join("names", "|"))


@query(sql_with("runs") + "SELECT job, item, greatest(c - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY item DESC) AS n, count(*) OVER (PARTITION BY job) AS c FROM runs WHERE status = 'failed') WHERE n <= 10")
def a13_last_failed(spark, sf_dir):
    return R.last_failed(X.runs(spark, sf_dir), "job", "item").select("job", "item", "more")


@query("SELECT user_id AS job, event_id % 500 AS item, arg_max(event_type, (epoch_us(ts), event_type)) AS status FROM events GROUP BY ALL")
def s5_latest_status(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    return R.latest_status(events.select(F.col("user_id").alias("job"), (F.col("event_id") % 500).alias("item"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")))


@query("SELECT user_id::VARCHAR AS job, (event_id % 500)::VARCHAR AS item, arg_max(event_type, (epoch_us(ts), event_type)) AS status FROM events GROUP BY ALL")
def s5_progress_log(spark, sf_dir):
    """Events logged as batches, one of them again, and compacted."""
    path = _folder(spark, "log")
    status = F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status")))
    events = X.table(spark, sf_dir, "events").withColumn("batch", F.col("event_id") % 3)
    for batch in (0, 1, 2, 1):
        rows = events.where(F.col("batch") == batch).groupBy(F.col("user_id").alias("job"), (F.col("event_id") % 500).alias("item")).agg(status.alias("s"))
        PL.log_batch(rows.select("job", "item", "s.status", "s.ts"), path, "events", batch)
    return PL.compact(spark, path).select("job", "item", "status")


@query("SELECT source || '/' || lang || '/transcription-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.srt' END AS name, md5(text) AS text FROM documents WHERE doc_id % 7 > 1")
def s4_read_transcripts(spark, sf_dir):
    """Transcripts written under their names, beside hidden files and others, and read back. Names are below folders of source and
    language, those of null too, and a document without a text is an empty file below a folder of its own."""
    path = _folder(spark, "transcripts")
    n = F.col("doc_id")
    start = F.when(n % 7 > 1, "transcription-").when(n % 7 == 0, "._transcription-").otherwise("notes-")
    folders = [S.file_name(c) for c in (F.when(F.col("text").isNotNull(), "text"), F.col("source"), F.col("lang"))]
    name = F.concat_ws("/", *folders, F.concat(start, n.cast("string"), F.when(n % 2 == 0, ".txt").otherwise(".srt")))
    N.write_named(X.table(spark, sf_dir, "documents").where(n.isNotNull()).select(name.alias("name"), F.col("text").alias("content")), path)
    # a path without a scheme was written to as a local one
    read = S.read_transcripts(spark, path if ":/" in path else Path(path).absolute().as_uri())
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    part = lambda k: S.key_of(F.element_at(parts, k))
    own = F.concat(part(-3), F.lit("/"), part(-2), F.lit("/"), F.element_at(parts, -1))
    return read.select(own.alias("name"), F.when(part(-4).isNotNull(), F.md5(F.col("text").cast("binary"))).alias("text"))


@query(sql_with("segments") + f", {_LANGS} SELECT 'talk-' || doc_id || CASE lang WHEN 'en' THEN '' ELSE '_' || lang END || '.srt' AS name, string_agg(lang || ' ' || text, chr(10) ORDER BY seg_no, text) AS content FROM langs GROUP BY doc_id, lang")
def s9_named_subtitles(spark, sf_dir):
    """One file a document and language, the original without a mark, written under its name and read back."""
    path = _folder(spark, "subtitles")
    s = X.segments(spark, sf_dir).withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("de"))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"])
    texts = s.groupBy("lang", "doc_id").agg(lines.alias("lines"))
    name = N.subtitle_name(F.concat(F.lit("talk-"), "doc_id"), F.when(F.col("lang") != "en", F.col("lang")))
    N.write_named(texts.select(name.alias("name"), F.array_join(F.transform("lines", lambda t: F.concat_ws(" ", "lang", t)), "\n").alias("content")), path)
    return N.read_named(spark, path, "*.srt").select("name", "content")


_DRAWN = "CASE WHEN frame_idx % 50 = 7 THEN 'broken file' WHEN frame_idx % 50 = 9 THEN 'unsupported kind' END"


def _drawn(spark, sf_dir):
    """Frames written as images of three kinds, some of them cut off, hidden or of a kind that is not decoded, and read."""
    path = _folder(spark, "images")
    n, size = F.col("frame_idx"), F.lit(8).cast("int")
    header = F.concat(F.lit("P5\n8 8\n255\n").cast("binary"))
    bytes_ = F.unhex(F.array_join(F.transform("luma", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    low = lambda v, k: F.concat(*[F.unhex(F.lpad(F.hex(F.lit(v >> 8 * i & 255)), 2, "0")) for i in range(k)])
    # 24-bit rows from the last to the first, each value three times
    rows = F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda y: F.array_join(F.transform(F.slice("luma", y * size + 1, size), lambda v: F.repeat(F.lpad(F.hex(v.cast("long")), 2, "0"), 3)), ""))
    bitmap = F.concat(F.lit("BM").cast("binary"), low(246, 4), low(0, 4), low(54, 4), low(40, 4), low(8, 4), low(8, 4), low(1, 2), low(24, 2), low(0, 24), F.unhex(F.array_join(rows, "")))
    whole = F.when(n % 2 == 0, F.concat(header, bytes_)).otherwise(bitmap)
    content = F.when(n % 50 == 7, F.expr("substring(whole, 1, 30)")).otherwise(F.col("whole"))
    kind = F.when(n % 50 == 9, ".heic").when(n % 2 == 0, ".pgm").otherwise(".BMP")
    name = F.concat(F.when(n % 50 == 11, "._").otherwise(""), F.lit("slide_"), n.cast("string"), kind)
    N.write_named(X.frames(spark, sf_dir).select("frame_idx", whole.alias("whole")).select(name.alias("name"), content.alias("content")), path)
    return I.decode_images(spark, path).withColumn("frame_idx", F.regexp_extract("path", r"slide_(\d+)", 1).cast("long"))


@query(sql_with("frames") + f"SELECT frame_idx, CASE WHEN {_DRAWN} IS NULL THEN array_to_string(list_transform(luma, lambda v: v::INTEGER::VARCHAR), ',') END AS luma, {_DRAWN} AS error FROM frames WHERE frame_idx % 50 <> 11")
def s6_decode_images(spark, sf_dir):
    shown = F.array_join(F.transform("luma", lambda v: F.round(v).cast("int").cast("string")), ",")
    return _drawn(spark, sf_dir).select("frame_idx", shown.alias("luma"), "error")


@query(sql_with("frames") + f"SELECT count(*) AS total, count({_DRAWN}) AS skipped, count(*) - count({_DRAWN}) AS valid, count(*) FILTER ({_DRAWN} = 'broken file') AS broken FROM frames WHERE frame_idx % 50 <> 11")
def s6_image_counts(spark, sf_dir):
    out = I.image_counts(_drawn(spark, sf_dir))
    return out.select("total", "skipped", "valid", F.coalesce(F.element_at("reasons", "broken file"), F.lit(0)).alias("broken"))


# Streams: the given tables read as streams, run to their end, results read back


def _stream(spark, sf_dir, name):
    """A table as a file stream; the pattern lets it be one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque?")


def _finished(spark, stream, tag):
    path = _folder(spark, tag)
    Z.run_available(spark, stream, path, _folder(spark, f"{tag}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


def _stateful(spark, stream, tag):
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _finished(spark, stream, tag)
    finally:  # the stream has ended; other streams of the session keep their own store
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


@query(sql_with("progress") + "SELECT doc_id AS item, 'processed' AS status FROM documents WHERE doc_id NOT IN (SELECT item FROM progress WHERE status IN ('processed', 'failed'))")
def x1_stream_new_items(spark, sf_dir):
    items = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"))
    done, path = X.progress(spark, sf_dir), _folder(spark, "x1")
    Z.stream_new_items(items, path, _folder(spark, "x1-checkpoint"), lambda batch: C.todo(batch, done).withColumn("status", F.lit("processed"))).awaitTermination()
    return PL.read_log(spark, path).select(F.col("item").cast("long").alias("item"), "status")


@query("SELECT DISTINCT event_type, user_id FROM events")
def x3_stream_exact_dedup(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _finished(spark, Z.stream_exact_dedup(events, "ts", ["event_type", "user_id"], "400 days").select("event_type", "user_id"), "x3")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e), s AS (SELECT user_id, g, min(ts) AS a, max(ts) AS z, count(*) AS n FROM g GROUP BY ALL)
    SELECT user_id, epoch_us(a) AS start_us, n FROM s WHERE z + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""
)
def x2_stream_gap_groups(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _finished(spark, Z.stream_gap_groups(events, "user_id", "ts", "6 hours", "1 day"), "x2")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@query(
    sql_with("series")
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS k FROM series)
    SELECT key, unnest(list_transform(list_filter(kept, lambda r: r.k > 0), lambda r: r.e)) AS order_id FROM (
      SELECT key, list_reduce(list_concat([[{k: 0::BIGINT, e: 0::BIGINT, t: 0::DOUBLE, v: 0::DOUBLE}]], items),
        lambda acc, x: CASE WHEN acc[-1].k = 0 OR (abs(x[1].v - acc[-1].v) > 20 AND x[1].t - acc[-1].t > 36000) THEN list_concat(acc, x) ELSE acc END) AS kept
      FROM (SELECT key, list([{k: k, e: event_id, t: t, v: v}] ORDER BY k) AS items FROM o GROUP BY key))"""
)
def x4_stream_accept_changes(spark, sf_dir):
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("order_id"), t.alias("t"), F.col("value").alias("v"))
    return _stateful(spark, Z.stream_accept_changes(events, 20.0, 36000.0), "x4").select("key", "order_id")


@query(ORACLES["w4_accept_advanced"])
def x4_stream_accept_frames(spark, sf_dir):
    frames = X.frames_of(_stream(spark, sf_dir, "embeddings"))
    return _stateful(spark, Z.stream_accept_frames(frames, "advanced", threshold=0.0), "x4f")


@query(ORACLES["w5_accept_standard"])
def x4_stream_ordered_frames(spark, sf_dir):
    """Frames as they come, each decided when the watermark has passed it."""
    hashes = M.bits_to_long(M.phash_bits(F.col("g")))
    frames = X.frames_of(_stream(spark, sf_dir, "embeddings")).withColumn("phash", hashes).withColumn("ts", F.timestamp_seconds(F.col("frame_idx") + 1704067200))
    return _stateful(spark, Z.stream_ordered_frames(frames, "standard", "ts", "0 seconds", threshold=0.1), "x4o")


def _wide(spark, sf_dir):
    """32x32 grids: each value of an 8x8 frame four times in both directions, with a ramp over it."""
    g = X.frames(spark, sf_dir)
    place = lambda i: F.floor(i / 128).cast("int") * 8 + F.floor((i % 32) / 4).cast("int")
    grown = lambda luma: F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.get(luma, place(i)) + i / 64.0)
    return g.select("frame_idx", M.let(F.col("luma"), grown).alias("wide"))


_WIDE = "wide AS (SELECT frame_idx, list_transform(range(0, 1024), lambda i: luma[(i // 128) * 8 + (i % 32) // 4 + 1] + i / 64.0::DOUBLE) AS g FROM frames)"
_D32 = "[" + ", ".join(repr(x) for x in M.dct_basis(32)[: 8 * 32]) + "]"


@query(
    sql_with("frames")
    + f""", {_WIDE}, h AS (SELECT frame_idx, list_transform(range(0, 256), lambda i: list_sum(list_transform(range(0, 32), lambda k: {_D32}[(i // 32) * 32 + k + 1] * g[k * 32 + i % 32 + 1]))) AS h FROM wide),
    c AS (SELECT frame_idx, list_transform(range(0, 64), lambda i: round(list_sum(list_transform(range(0, 32), lambda k: h[(i // 8) * 32 + k + 1] * {_D32}[(i % 8) * 32 + k + 1])), 9)) AS c FROM h)
    SELECT frame_idx, array_to_string(list_transform(c, lambda x: CASE WHEN x > round((list_sum(c) - c[1]) / 63, 9) THEN '1' ELSE '0' END), '') AS bits FROM c"""
)
def f2_phash32(spark, sf_dir):
    return _wide(spark, sf_dir).select("frame_idx", M.phash32_bits(F.col("wide")).alias("bits"))


@query(
    sql_with("frames")
    + f""", {_WIDE} SELECT frame_idx, array_to_string(list_transform(range(0, 64), lambda i: round(list_sum(list_transform(range(0, 16), lambda k: g[((i // 8) * 4 + k // 4) * 32 + (i % 8) * 4 + k % 4 + 1])) / 16, 4)::VARCHAR), ',') AS grid FROM wide"""
)
def s6_resize_area(spark, sf_dir):
    small = M.resize_area(F.col("wide"), F.lit(32), F.lit(32), 8, 8)
    return _wide(spark, sf_dir).select("frame_idx", F.array_join(F.transform(small, lambda x: F.round(x, 4).cast("string")), ",").alias("grid"))


def _wide_pairs(spark, sf_dir):
    """Wide grids of each frame and the one before it in its video."""
    wide = _wide(spark, sf_dir).join(X.frames(spark, sf_dir).select("video_id", "frame_idx"), "frame_idx")
    return with_previous(wide, "wide").where("prev_wide IS NOT NULL")


_PIXELS = f"""{_WIDE}, pixels AS (SELECT p.frame_idx, i // 32 AS y, i % 32 AS x, a.g[i + 1] AS a, b.g[i + 1] AS b
  FROM pairs p JOIN wide a ON a.frame_idx = p.frame_idx JOIN wide b ON b.frame_idx = p.prev_idx, range(0, 1024) t(i))"""


def _swept(steps: list[tuple[str, str]], source: str) -> str:
    """Common table expressions s1, s2, ... each of which takes a maximum or minimum of five neighbours of ``m`` along x or y."""
    out = []
    for k, (op, along) in enumerate(steps, 1):
        across = "y" if along == "x" else "x"
        out.append(f"s{k} AS (SELECT frame_idx, y, x, {op}(m) OVER (PARTITION BY frame_idx, {across} ORDER BY {along} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM {source if k == 1 else f's{k - 1}'})")
    return ", ".join(out)


_MOMENTS = ", ".join(f"sum({v}) OVER w AS {n}" for n, v in (("a", "a"), ("b", "b"), ("aa", "aa"), ("bb", "bb"), ("ab", "ab")))


@query(
    sql_with("frames", "pairs")
    + f""", {_PIXELS}, lines AS (SELECT frame_idx, y, x, {_MOMENTS} FROM (SELECT *, a * a AS aa, b * b AS bb, a * b AS ab FROM pixels) WINDOW w AS (PARTITION BY frame_idx, y ORDER BY x ROWS 6 PRECEDING) QUALIFY x >= 6),
    boxes AS (SELECT frame_idx, y, {_MOMENTS} FROM lines WINDOW w AS (PARTITION BY frame_idx, x ORDER BY y ROWS 6 PRECEDING) QUALIFY y >= 6),
    n AS (SELECT frame_idx, a / 49 AS ma, b / 49 AS mb, (aa / 49 - a / 49 * (a / 49)) * 49 / 48 AS va, (bb / 49 - b / 49 * (b / 49)) * 49 / 48 AS vb, (ab / 49 - a / 49 * (b / 49)) * 49 / 48 AS cov FROM boxes)
    SELECT frame_idx, round(avg((2 * ma * mb + {M.C1!r}) * (2 * cov + {M.C2!r}) / ((ma * ma + mb * mb + {M.C1!r}) * (va + vb + {M.C2!r}))), 6) AS value FROM n GROUP BY frame_idx"""
)
def f9_window_ssim(spark, sf_dir):
    """Structural similarity over sliding windows of 7x7 on 32x32 grids."""
    return _wide_pairs(spark, sf_dir).select("frame_idx", F.round(W.window_ssim_of(F.col("wide"), F.col("prev_wide")), 6).alias("value"))


@query(
    sql_with("frames", "pairs")
    + f""", {_PIXELS}, mask AS (SELECT frame_idx, y, x, CASE WHEN abs(a - b) > {M.PIXEL_CHANGE} THEN 1 ELSE 0 END AS m FROM pixels),
    {_swept([("max", "x"), ("max", "y"), ("min", "x"), ("min", "y"), ("min", "x"), ("min", "y"), ("max", "x"), ("max", "y")], "mask")}
    SELECT frame_idx, round(sum(m) / 1024.0::DOUBLE, 6) AS value FROM s8 GROUP BY frame_idx"""
)
def f7_opened_change(spark, sf_dir):
    """Changed share of 32x32 grids after closing and opening with 5x5."""
    return _wide_pairs(spark, sf_dir).select("frame_idx", F.round(W.opened_change_of(F.col("wide"), F.col("prev_wide")), 6).alias("value"))


@query(
    sql_with("frames").replace("WITH", "WITH RECURSIVE", 1)
    + f""", {_WIDE}, pixels AS (SELECT frame_idx, i // 32 AS y, i % 32 AS x, g[i + 1] AS g FROM wide, range(0, 1024) t(i)),
    lined AS (SELECT frame_idx, y, x, max(g) OVER w - min(g) OVER w > 30 AS m FROM pixels WINDOW w AS (PARTITION BY frame_idx, y ORDER BY x ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
    placed AS (SELECT frame_idx, y, x, x - row_number() OVER (PARTITION BY frame_idx, y ORDER BY x) AS island FROM lined WHERE m),
    runs AS (SELECT frame_idx, y, min(x) AS a, max(x) AS z, y * 32 + min(x) AS id FROM placed GROUP BY frame_idx, y, island),
    touching AS (SELECT p.frame_idx, p.id AS p, q.id AS q FROM runs p JOIN runs q ON p.frame_idx = q.frame_idx AND abs(p.y - q.y) = 1 AND p.a <= q.z + 1 AND q.a <= p.z + 1),
    reached AS (SELECT frame_idx, id AS p, id AS q FROM runs UNION SELECT r.frame_idx, r.p, t.q FROM reached r JOIN touching t ON t.frame_idx = r.frame_idx AND t.p = r.q),
    named AS (SELECT frame_idx, p AS id, min(q) AS region FROM reached GROUP BY ALL),
    sizes AS (SELECT frame_idx, region, sum(z - a + 1) AS n FROM runs JOIN named USING (frame_idx, id) GROUP BY ALL)
    SELECT frame_idx, count(n) FILTER (n > 40) AS regions FROM frames LEFT JOIN sizes USING (frame_idx) GROUP BY frame_idx"""
)
def f10_text_regions(spark, sf_dir):
    """Regions of contrast of more than 40 pixels on 32x32 grids."""
    # an Arrow function takes no lambda in its argument, so the grid is a column of its own first
    grids = _wide(spark, sf_dir).select("frame_idx", F.explode(F.array("wide")).alias("wide"))
    return grids.select("frame_idx", W.text_regions_of(F.col("wide"), area=40).alias("regions"))


_DENSE = f"""rate AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS frame_idx, CASE WHEN video_id % 2 = 0 THEN 2.0::DOUBLE ELSE 4.0 END AS fps, luma, bits FROM hashed),
    paced AS (SELECT video_id, count(*) AS total_frames FROM rate GROUP BY ALL),
    sampled AS (SELECT *, lag(luma) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev_luma FROM rate WHERE frame_idx % 3 = 0),
    near AS (SELECT DISTINCT video_id, idx AS frame_idx FROM (SELECT video_id, unnest(list_transform([-2], lambda o: frame_idx + o)) AS idx FROM sampled WHERE {Q.histogram_corr('luma', 'prev_luma')} < 0.3)
      JOIN paced USING (video_id) WHERE idx >= 0 AND idx < total_frames),
    cand AS (SELECT r.* FROM rate r JOIN near USING (video_id, frame_idx))"""
_LIKE = lambda k: f"(1 - {Q.hamming(f'{k}.bits', 'x[1].bits')} / 64.0)"


def _capture_taken(accept: str) -> str:
    return f"taken AS (SELECT h.* FROM rate h JOIN {Q.fold('cand', 'video_id', 'frame_idx', {'luma': 'DOUBLE[]', 'fps': 'DOUBLE'}, accept)} USING (video_id, frame_idx))"


def _capture_led(source: str, group: str, keep: str) -> str:
    new = f"[{{frame_idx: x[1].frame_idx, bits: x[1].bits, g: ({group})::BIGINT, sub: (len(list_filter(acc, lambda k: k.sub > 0 AND k.g = ({group}))) + 1)::BIGINT}}]"
    return f"""led AS (SELECT video_id, m.frame_idx AS frame_idx, m.g::INTEGER AS group_id, m.sub::INTEGER AS subgroup_idx FROM (
      SELECT video_id, unnest(list_reduce(list_concat([[{{frame_idx: (-1)::BIGINT, bits: repeat('0', 64), g: (-1)::BIGINT, sub: 0::BIGINT}}]], items),
        lambda acc, x: CASE WHEN {keep} THEN list_concat(acc, {new}) ELSE acc END)) AS m
      FROM (SELECT video_id, list([{{frame_idx: frame_idx, bits: bits, g: 0::BIGINT, sub: 0::BIGINT}}] ORDER BY frame_idx) AS items FROM {source} GROUP BY video_id)) WHERE m.frame_idx >= 0)"""


def _capture_name(tag: str) -> str:
    shown = _FILENAME.replace("n::BIGINT", "row_number() OVER (PARTITION BY video_id ORDER BY frame_idx)").replace("s /", "(frame_idx / fps) /").replace("((s -", "(((frame_idx / fps) -")
    return f"{shown} || {tag} || '_h' || lower(lpad(printf('%x', bits::BIT::BIGINT), 16, '0'))[1:8] || '.jpg' AS filename"


def _advanced_sql() -> str:
    accept = f"(L.luma IS NULL OR coalesce({Q.ssim('L.luma', 'X.luma')} < 0.2, false)) AND X.frame_idx - L.frame_idx > 0.5 * X.fps"
    fit = f"list_filter(acc, lambda k: k.sub = 1 AND {_LIKE('k')} >= 0.55)"
    group = f"coalesce(list_filter({fit}, lambda k: {_LIKE('k')} = list_max(list_transform({fit}, lambda k: {_LIKE('k')})))[1].g, len(list_filter(acc, lambda k: k.sub = 1)) + 1)"
    led = _capture_led("taken", group, f"len(list_filter(acc, lambda k: k.sub > 0 AND {_LIKE('k')} > 0.7)) = 0")
    tag = "'_g' || printf('%02d', group_id::BIGINT) || CASE WHEN subgroup_idx > 1 THEN '-' || printf('%02d', subgroup_idx::BIGINT) ELSE '' END"
    return sql_with("frames", "hashed") + f", {_DENSE}, {_capture_taken(accept)}, {led} SELECT video_id, frame_idx, group_id, subgroup_idx, {_capture_name(tag)} FROM led JOIN rate USING (video_id, frame_idx)"


def _improved_sql() -> str:
    accept = f"(L.luma IS NULL OR coalesce({Q.ssim('L.luma', 'X.luma')} < 0.0 OR 1 - {Q.edge_change('L.luma', 'X.luma')} < 0.9, false)) AND X.frame_idx - L.frame_idx > X.fps"
    group = f"coalesce(list_filter(acc, lambda k: k.sub = 1 AND {_LIKE('k')} > 0.6)[1].g, len(list_filter(acc, lambda k: k.sub = 1)))"
    return (
        sql_with("frames", "hashed")
        + f""", {_DENSE}, {_capture_taken(accept)},
    placed AS (SELECT *, row_number() OVER w AS pos, lead(frame_idx) OVER w AS nxt FROM taken WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
    probes AS (SELECT video_id, pos, unnest(range(frame_idx + (fps * 5)::BIGINT, nxt, (fps * 5)::BIGINT)) AS frame_idx FROM placed WHERE nxt - frame_idx > 30 * fps),
    seen AS (SELECT p.pos, r.* FROM probes p JOIN rate r USING (video_id, frame_idx)),
    more AS (SELECT * EXCLUDE (pos) FROM seen s WHERE NOT EXISTS (SELECT 1 FROM placed k WHERE k.video_id = s.video_id AND k.pos BETWEEN s.pos - 2 AND s.pos + 2 AND {Q.ssim('k.luma', 's.luma')} > 0.3)),
    slides AS (SELECT * FROM taken UNION ALL SELECT * FROM more),
    {_capture_led("slides", group, "true")},
    sharp AS (SELECT video_id, frame_idx, group_id, fps, bits, count(*) OVER (PARTITION BY video_id, group_id) AS size,
      row_number() OVER (PARTITION BY video_id, group_id ORDER BY round(list_sum(list_transform(l, lambda v: v * v)) / 64 - (list_sum(l) / 64) * (list_sum(l) / 64), 6) DESC, frame_idx) AS k
      FROM (SELECT *, list_transform(range(0, 64), lambda p: {_SIDES} - 4 * luma[p + 1]) AS l FROM led JOIN rate USING (video_id, frame_idx)))
    SELECT video_id, frame_idx, CASE WHEN size > 1 THEN group_id ELSE -1 END AS group_id, 1 AS subgroup_idx, {_capture_name("CASE WHEN size > 1 THEN '_g' || printf('%02d', group_id::BIGINT) ELSE '' END")} FROM sharp WHERE k = 1"""
    )


@query(_advanced_sql())
def w21_capture_advanced(spark, sf_dir):
    return capture_pipeline(X.dense(spark, sf_dir), X.dense_videos(spark, sf_dir), "advanced", step=3, change=0.3, threshold=0.2, group=0.55, skip=0.7)


@query(_improved_sql())
def w21_capture_improved(spark, sf_dir):
    return capture_pipeline(X.dense(spark, sf_dir), X.dense_videos(spark, sf_dir), "improved", step=3, change=0.3, threshold=0.0, group=0.6, like=0.3)


_RATE = _DENSE[: _DENSE.index("paced AS")]
_NUMBERED = lambda n: _FILENAME.replace("n::BIGINT", n).replace("s /", "(frame_idx / fps) /").replace("((s -", "(((frame_idx / fps) -")
_ROW = "row_number() OVER (PARTITION BY video_id ORDER BY frame_idx)"


@query(
    sql_with("frames", "hashed")
    + f""", {_RATE} sampled AS (SELECT * FROM rate WHERE frame_idx % 3 = 0),
    taken AS (SELECT r.* FROM rate r JOIN {Q.fold('sampled', 'video_id', 'frame_idx', {'luma': 'DOUBLE[]', 'bits': 'VARCHAR', 'fps': 'DOUBLE'},
      f"(L.luma IS NULL OR coalesce((X.frame_idx - L.frame_idx) / X.fps >= 2.0 AND {Q.ssim('L.luma', 'X.luma')} < 0.1, false)) AND len(list_filter(acc, lambda k: k.frame_idx >= 0 AND {Q.hamming('k.bits', 'X.bits')} < 5)) = 0")} USING (video_id, frame_idx))
    SELECT video_id, frame_idx, ({_ROW} - 1)::INTEGER AS slide_index, {_NUMBERED(f'({_ROW} - 1)::BIGINT')} || '_h' || lower(lpad(printf('%x', bits::BIT::BIGINT), 16, '0'))[1:8] || '.jpg' AS filename FROM taken"""
)
def w21_capture_standard(spark, sf_dir):
    return capture_standard(X.dense(spark, sf_dir), X.dense_videos(spark, sf_dir), step=3, threshold=0.1)


@query(
    sql_with("frames", "hashed")
    + f""", {_RATE} paced AS (SELECT video_id, count(*) AS total_frames FROM rate GROUP BY ALL),
    sampled AS (SELECT *, lag(luma) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev_luma FROM rate WHERE frame_idx % 3 = 0),
    flags AS (SELECT video_id, frame_idx, fps, prev_luma IS NULL AS start, coalesce({Q.ssim('prev_luma', 'luma')} < -0.2, false) AS unlike, coalesce({Q.has_change('prev_luma', 'luma')}, false) AS partly FROM sampled),
    hits AS (SELECT video_id, frame_idx, start FROM flags JOIN {Q.fold('flags', 'video_id', 'frame_idx', {'start': 'BOOLEAN', 'unlike': 'BOOLEAN', 'partly': 'BOOLEAN', 'fps': 'DOUBLE'},
      'X.start OR X.unlike OR (X.partly AND X.frame_idx - L.frame_idx > 2.0 * X.fps)')} USING (video_id, frame_idx)),
    near AS (SELECT DISTINCT video_id, idx AS frame_idx FROM (SELECT video_id, unnest(CASE WHEN start THEN [frame_idx] ELSE [frame_idx - 2, frame_idx + 1] END) AS idx FROM hits) JOIN paced USING (video_id) WHERE idx >= 0 AND idx < total_frames),
    cand AS (SELECT * FROM rate JOIN near USING (video_id, frame_idx) QUALIFY row_number() OVER (PARTITION BY video_id, luma ORDER BY frame_idx) = 1),
    pairs AS (SELECT *, lag(luma) OVER w AS prev_luma, lag(frame_idx) OVER w AS prev_idx FROM cand WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
    grouped AS (SELECT *, sum(CASE WHEN coalesce({Q.ssim('prev_luma', 'luma')} > 0.05 OR ({Q.ssim('prev_luma', 'luma')} > -0.05 AND {Q.has_change('prev_luma', 'luma')} AND (frame_idx - prev_idx) / fps < 10.0), false) THEN 0 ELSE 1 END)
      OVER (PARTITION BY video_id ORDER BY frame_idx)::BIGINT AS group_no FROM pairs),
    keyed AS (SELECT video_id * 100000000 + group_no AS key, frame_idx, luma FROM grouped),
    kept AS (SELECT key, frame_idx FROM {Q.fold('keyed', 'key', 'frame_idx', {'luma': 'DOUBLE[]'}, f"L.luma IS NULL OR coalesce({Q.edge_change('L.luma', 'X.luma')} > 0.35, false)")}),
    lonely AS (SELECT key, max(k.frame_idx) AS frame_idx FROM keyed k WHERE key IN (SELECT key FROM kept GROUP BY key HAVING count(*) = 1) GROUP BY key),
    slides AS (SELECT DISTINCT key // 100000000 AS video_id, key % 100000000 AS group_id, frame_idx FROM (SELECT * FROM kept UNION ALL SELECT * FROM lonely)),
    placed AS (SELECT s.*, fps, row_number() OVER (PARTITION BY video_id, group_id ORDER BY frame_idx)::INTEGER AS subgroup_idx, count(*) OVER (PARTITION BY video_id, group_id) AS size FROM slides s JOIN rate USING (video_id, frame_idx))
    SELECT video_id, frame_idx, group_id, subgroup_idx, {_NUMBERED(_ROW)} || CASE WHEN size > 1 THEN '_anim' || group_id || '-' || subgroup_idx ELSE '' END || '.jpg' AS filename FROM placed"""
)
def w21_capture_ultra(spark, sf_dir):
    return capture_ultra(X.dense(spark, sf_dir), X.dense_videos(spark, sf_dir), step=3, threshold=-0.2, high=0.05, low=-0.05, least=0.35)


@query(
    sql_with("frames", "hashed")
    + f""", {_RATE} sampled AS (SELECT * FROM rate WHERE frame_idx % 5 = 0),
    mains AS (SELECT video_id, frame_idx AS main_idx, luma AS base, fps, lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS nxt
      FROM rate JOIN {Q.fold('sampled', 'video_id', 'frame_idx', {'luma': 'DOUBLE[]'}, f"L.luma IS NULL OR coalesce({Q.mse('L.luma', 'X.luma')} < 0.85, false)")} USING (video_id, frame_idx)),
    near AS (SELECT f.video_id, main_idx, frame_idx, luma, f.fps, min(CASE WHEN {Q.mse('base', 'luma')} >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY f.video_id, main_idx ORDER BY frame_idx) AS open
      FROM rate f JOIN mains m ON f.video_id = m.video_id AND frame_idx > main_idx AND frame_idx < coalesce(nxt, main_idx + floor(60 * m.fps)) AND (frame_idx - main_idx) % 2 = 0),
    keyed AS (SELECT video_id * 10000000 + main_idx AS key, frame_idx, luma, fps FROM near WHERE open = 1 UNION ALL SELECT video_id * 10000000 + main_idx, main_idx, base, fps FROM mains),
    states AS (SELECT key // 10000000 AS video_id, key % 10000000 AS main_idx, frame_idx
      FROM {Q.fold('keyed', 'key', 'frame_idx', {'luma': 'DOUBLE[]', 'fps': 'DOUBLE'}, f"L.luma IS NULL OR (coalesce({Q.is_animation('L.luma', 'X.luma', 8)}, false) AND (X.frame_idx - L.frame_idx) / X.fps >= 1.0)")}),
    placed AS (SELECT s.*, fps, dense_rank() OVER (PARTITION BY video_id ORDER BY main_idx)::INTEGER AS group_id, row_number() OVER (PARTITION BY video_id, main_idx ORDER BY frame_idx)::INTEGER AS subgroup_idx
      FROM states s JOIN rate USING (video_id, frame_idx)),
    tenths AS (SELECT *, floor(frame_idx / fps * 10 + 0.5)::BIGINT AS t FROM placed)
    SELECT video_id, frame_idx, group_id, subgroup_idx, 'slide_' || printf('%03d', group_id) || CASE WHEN subgroup_idx > 1 THEN '_' || subgroup_idx ELSE '' END || '_t' || t // 10 || '.' || t % 10 || 's.jpg' AS filename FROM tenths"""
)
def w21_capture_animation(spark, sf_dir):
    return capture_animation(X.dense(spark, sf_dir), X.dense_videos(spark, sf_dir), step=5, fine=2, threshold=0.85, most_cells=8)
