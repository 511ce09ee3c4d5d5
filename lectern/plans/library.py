"""Registered queries of the library and their SQL, part one: frames, sequences and groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as M
from ..operators import groups as G
from ..operators import reports as R
from ..operators import sequence as S
from . import fixtures as X
from . import metric_sql as Q
from .fixtures import sql_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIMILAR = 0.70  # frames of the test tables are far apart; the library's own thresholds are covered by golden rows


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _metric(name: str, spark_metric, sql_metric: str) -> None:
    """A metric of each frame and the one before it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = S.with_previous(X.frames(spark, sf_dir), "luma").where("prev_luma IS NOT NULL")
        return pairs.select("frame_idx", F.round(spark_metric(F.col("luma"), F.col("prev_luma")), 6).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = sql_with("frames", "pairs") + f"SELECT frame_idx, round({sql_metric}, 6) AS value FROM pairs WHERE prev_luma IS NOT NULL"


_AB = ("luma", "prev_luma")
_metric("f5_histogram_corr", M.histogram_corr, Q.histogram_corr(*_AB))
_metric("f6_mse_similarity", M.mse_similarity, Q.mse(*_AB))
_metric("f7_changed_ratio", M.changed_ratio, Q.changed(*_AB))
_metric("f8_grid_change", lambda a, b: M.grid_change(a, b)["avg_change"], f"list_sum(list_transform(range(0, 9), lambda k: {Q.cell(*_AB, 'k')})) / 9")
_metric("f9_ssim", M.ssim, Q.ssim(*_AB))
_metric("f10_edge_change", M.edge_change, Q.edge_change(*_AB))
_metric("f12_mean_abs_diff", M.mean_abs_diff, Q.mad(*_AB))
_metric("f12_pixel_corr", M.pixel_corr, Q.corr(*_AB))


@query(sql_with("frames", "hashed") + "SELECT frame_idx, bits FROM hashed")
def f1_phash8(spark, sf_dir):
    return X.hashed(spark, sf_dir).select("frame_idx", "bits")


@query(
    sql_with("frames")
    + "SELECT frame_idx, array_to_string(list_transform(range(0, 56), lambda i: CASE WHEN luma[(i // 7) * 8 + i % 7 + 2] > luma[(i // 7) * 8 + i % 7 + 1] THEN '1' ELSE '0' END), '') AS bits FROM frames"
)
def f3_dhash(spark, sf_dir):
    return X.frames(spark, sf_dir).select("frame_idx", M.dhash_bits(F.col("luma")).alias("bits"))


@query(
    sql_with("frames", "hashed")
    + f"""SELECT frame_idx, {Q.hamming('bits', 'prev')}::INTEGER AS distance, round(1 - {Q.hamming('bits', 'prev')} / 64.0, 6) AS similarity
    FROM (SELECT *, lag(bits) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM hashed) WHERE prev IS NOT NULL"""
)
def f4_hash_similarity(spark, sf_dir):
    pairs = S.with_previous(X.hashed(spark, sf_dir), "phash").where("prev_phash IS NOT NULL")
    a, b = F.col("phash"), F.col("prev_phash")
    return pairs.select("frame_idx", M.hamming(a, b).alias("distance"), F.round(M.hash_similarity(a, b), 6).alias("similarity"))


_SIDES = " + ".join(
    f"luma[{row} * 8 + {column} + 1]"
    for row, column in (
        ("abs(p // 8 - 1)", "p % 8"), ("(7 - abs(7 - (p // 8 + 1)))", "p % 8"), ("p // 8", "abs(p % 8 - 1)"), ("p // 8", "(7 - abs(7 - (p % 8 + 1)))"),
    )
)


@query(
    sql_with("frames")
    + f"""SELECT frame_idx, round(list_sum(list_transform(l, lambda v: v * v)) / 64 - (list_sum(l) / 64) * (list_sum(l) / 64), 6) AS value
    FROM (SELECT frame_idx, list_transform(range(0, 64), lambda p: {_SIDES} - 4 * luma[p + 1]) AS l FROM frames)"""
)
def f11_sharpness(spark, sf_dir):
    return X.frames(spark, sf_dir).select("frame_idx", F.round(M.sharpness(F.col("luma")), 6).alias("value"))


@query(sql_with("frames") + "SELECT frame_idx, md5(array_to_string(list_transform(luma, lambda v: v::INTEGER::VARCHAR), ',')) AS md5 FROM frames")
def f13_thumb_fingerprint(spark, sf_dir):
    return X.frames(spark, sf_dir).select("frame_idx", M.thumb_fingerprint(F.col("luma")).alias("md5"))


@query(sql_with("frames") + "SELECT video_id, frame_idx FROM frames WHERE frame_idx >= 100 AND frame_idx < 300")
def p11_time_range(spark, sf_dir):
    return S.time_range(X.frames(spark, sf_dir), 100.0, 300.0).select("video_id", "frame_idx")


@query(
    sql_with("frames", "videos")
    + """SELECT video_id, frame_idx FROM frames JOIN videos USING (video_id)
    WHERE frame_idx % CASE WHEN total_frames > 10000 THEN 30 WHEN total_frames < 1000 THEN 10 ELSE 15 END = 0"""
)
def p12_sample_stride(spark, sf_dir):
    return S.sample_stride(X.frames(spark, sf_dir), X.videos(spark, sf_dir), "ultra").select("video_id", "frame_idx")


@query(
    sql_with("frames", "pairs", "videos")
    + f"""SELECT DISTINCT video_id, idx AS frame_idx FROM (
      SELECT video_id, unnest(list_transform(range(-15, 16, 5), lambda o: frame_idx + o)) AS idx FROM pairs WHERE {Q.histogram_corr(*_AB)} < 0.3)
    JOIN videos USING (video_id) WHERE idx >= 0 AND idx < total_frames"""
)
def w2_change_candidates(spark, sf_dir):
    return S.change_candidates(X.frames(spark, sf_dir), X.videos(spark, sf_dir), 30, 0.3)


def _accept(name: str, mode: str, rule: str, threshold: float | None = None, columns: dict[str, str] | None = None, source: tuple[str, ...] = ("frames",)) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.accept_changes(X.hashed(spark, sf_dir) if mode == "standard" else X.frames(spark, sf_dir), mode, threshold=threshold)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = sql_with(*source) + f"SELECT video_id, frame_idx FROM {Q.fold(source[-1], 'video_id', 'frame_idx', columns or {'luma': 'DOUBLE[]'}, rule)}"


_LX = ("L.luma", "X.luma")
_accept("w3_accept_improved", "improved", f"(L.luma IS NULL OR coalesce({Q.ssim(*_LX)} < 0.85 OR 1 - {Q.edge_change(*_LX)} < 0.9, false)) AND X.frame_idx - L.frame_idx > 1.0")
_accept("w4_accept_advanced", "advanced", f"(L.luma IS NULL OR coalesce({Q.ssim(*_LX)} < 0.0, false)) AND X.frame_idx - L.frame_idx > 0.5", 0.0)
_accept(
    "w5_accept_standard", "standard",
    f"(L.luma IS NULL OR coalesce((X.frame_idx - L.frame_idx) / 1.0 >= 2.0 AND {Q.ssim(*_LX)} < 0.1, false)) AND len(list_filter(acc, lambda k: k.frame_idx >= 0 AND {Q.hamming('k.bits', 'X.bits')} < 5)) = 0",
    0.1, {"luma": "DOUBLE[]", "bits": "VARCHAR"}, ("frames", "hashed"),
)
_accept("w13_main_slides", "main", f"L.luma IS NULL OR coalesce({Q.mse(*_LX)} < 0.9, false)", 0.9)
_accept("w15_accept_range", "range", f"L.luma IS NULL OR coalesce({Q.mad(*_LX)} > 5 OR {Q.corr(*_LX)} < 0.98, false)")
_accept("w15_accept_coarse", "coarse", f"L.luma IS NULL OR coalesce({Q.ssim(*_LX)} < 0.0, false)", 0.0)


@query(
    sql_with("frames", "pairs")
    + f""", flags AS (SELECT video_id, frame_idx, prev_luma IS NULL AS start, coalesce({Q.ssim(*_AB)} < -0.2, false) AS unlike, coalesce({Q.has_change(*_AB)}, false) AS partly FROM pairs)
    SELECT video_id, frame_idx FROM {Q.fold('flags', 'video_id', 'frame_idx', {'start': 'BOOLEAN', 'unlike': 'BOOLEAN', 'partly': 'BOOLEAN'}, 'X.start OR X.unlike OR (X.partly AND X.frame_idx - L.frame_idx > 2.0)')}"""
)
def w6_dense_candidates(spark, sf_dir):
    return S.dense_candidates(X.frames(spark, sf_dir), -0.2)


@query(
    sql_with("frames")
    + """SELECT video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, md5(array_to_string(list_transform(luma, lambda v: v::INTEGER::VARCHAR), ',')) ORDER BY frame_idx) AS n FROM frames) WHERE n = 1"""
)
def w6_first_of_copies(spark, sf_dir):
    return S.first_of_copies(X.frames(spark, sf_dir).withColumn("md5", M.thumb_fingerprint(F.col("luma")))).select("video_id", "frame_idx")


_GROUPED = f"""grouped AS (SELECT *, sum(CASE WHEN coalesce({Q.ssim(*_AB)} > 0.05 OR ({Q.ssim(*_AB)} > -0.05 AND {Q.has_change(*_AB)} AND frame_idx - prev_idx < 10.0), false) THEN 0 ELSE 1 END)
  OVER (PARTITION BY video_id ORDER BY frame_idx)::BIGINT AS group_no FROM pairs)"""


def _groups(spark, sf_dir):
    return S.animation_groups(X.frames(spark, sf_dir), 0.05, -0.05)


@query(sql_with("frames", "pairs") + f", {_GROUPED} SELECT video_id, frame_idx, group_no FROM grouped")
def w7_animation_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("video_id", "frame_idx", "group_no")


@query(
    sql_with("frames", "pairs")
    + f""", {_GROUPED}, keyed AS (SELECT video_id * 100000 + group_no AS key, frame_idx, luma FROM grouped),
    kept AS (SELECT key, frame_idx FROM {Q.fold('keyed', 'key', 'frame_idx', {'luma': 'DOUBLE[]'}, f'L.luma IS NULL OR coalesce({Q.edge_change(*_LX)} > 0.35, false)')}),
    lonely AS (SELECT key, max(k.frame_idx) AS frame_idx FROM keyed k WHERE key IN (SELECT key FROM kept GROUP BY key HAVING count(*) = 1) GROUP BY key)
    SELECT DISTINCT key // 100000 AS video_id, key % 100000 AS group_no, frame_idx FROM (SELECT * FROM kept UNION ALL SELECT * FROM lonely)"""
)
def w8_key_frames(spark, sf_dir):
    return S.key_frames(_groups(spark, sf_dir), least=0.35).select("video_id", "group_no", "frame_idx")


@query(
    sql_with("frames")
    + f"""SELECT video_id, frame_idx FROM (SELECT *, lag(luma) OVER w AS p, ts - lag(ts) OVER w AS gap FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY ts))
    WHERE NOT coalesce(gap < 8.0 AND {Q.ssim('luma', 'p')} > 0.1, false)"""
)
def w9_drop_close_duplicates(spark, sf_dir):
    like = M.ssim(F.col("luma"), F.col("prev_luma"))
    return G.drop_close_duplicates(X.frames(spark, sf_dir), ["video_id"], like, 8.0, 0.1).select("video_id", "frame_idx")


@query(
    sql_with("frames", "pairs")
    + f""", {_GROUPED} SELECT video_id, group_no, frame_idx FROM (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY video_id, group_no) AS size FROM grouped
    WINDOW w AS (PARTITION BY video_id, group_no ORDER BY frame_idx)) WHERE n = size // 2"""
)
def w10_select_middle(spark, sf_dir):
    return G.select_best(_groups(spark, sf_dir), "middle", ["video_id", "group_no"]).select("video_id", "group_no", "frame_idx")


@query(
    sql_with("frames", "pairs")
    + f""", {_GROUPED}, sharp AS (SELECT video_id, group_no, frame_idx, round(list_sum(list_transform(l, lambda v: v * v)) / 64 - (list_sum(l) / 64) * (list_sum(l) / 64), 6) AS s
    FROM (SELECT *, list_transform(range(0, 64), lambda p: {_SIDES} - 4 * luma[p + 1]) AS l FROM grouped))
    SELECT video_id, group_no, arg_max(frame_idx, (s, -frame_idx)) AS frame_idx FROM sharp GROUP BY ALL"""
)
def w10_select_sharpest(spark, sf_dir):
    sharp = _groups(spark, sf_dir).withColumn("sharpness", F.round(M.sharpness(F.col("luma")), 6))
    return G.select_best(sharp, "sharpest", ["video_id", "group_no"]).select("video_id", "group_no", "frame_idx")


def _leaders(policy: str) -> str:
    near = lambda k: f"(1 - {Q.hamming(f'{k}.bits', 'x[1].bits')} / 64.0)"
    if policy == "first":
        group = f"coalesce(list_filter(acc, lambda k: k.sub = 1 AND {near('k')} > {SIMILAR})[1].g, len(list_filter(acc, lambda k: k.sub = 1)))"
        keep = "true"
    else:
        fit = f"list_filter(acc, lambda k: k.sub = 1 AND {near('k')} >= {SIMILAR})"
        best = f"list_max(list_transform({fit}, lambda k: {near('k')}))"
        group = f"coalesce(list_filter({fit}, lambda k: {near('k')} = {best})[1].g, len(list_filter(acc, lambda k: k.sub = 1)) + 1)"
        keep = f"len(list_filter(acc, lambda k: k.sub > 0 AND {near('k')} > 0.75)) = 0"
    new = f"[{{frame_idx: x[1].frame_idx, bits: x[1].bits, g: ({group})::BIGINT, sub: (len(list_filter(acc, lambda k: k.sub > 0 AND k.g = ({group}))) + 1)::BIGINT}}]"
    return (
        sql_with("frames", "hashed")
        + f"""SELECT video_id, m.frame_idx AS frame_idx, m.g::INTEGER AS group_id, m.sub::INTEGER AS subgroup_idx FROM (
      SELECT video_id, unnest(list_reduce(list_concat([[{{frame_idx: (-1)::BIGINT, bits: repeat('0', 64), g: (-1)::BIGINT, sub: 0::BIGINT}}]], items),
        lambda acc, x: CASE WHEN {keep} THEN list_concat(acc, {new}) ELSE acc END)) AS m
      FROM (SELECT video_id, list([{{frame_idx: frame_idx, bits: bits, g: 0::BIGINT, sub: 0::BIGINT}}] ORDER BY frame_idx) AS items FROM hashed GROUP BY video_id)) WHERE m.frame_idx >= 0"""
    )


@query(_leaders("first"))
def w11_leader_groups_first(spark, sf_dir):
    return G.leader_groups(X.hashed(spark, sf_dir), "first", SIMILAR)


@query(_leaders("best"))
def w12_leader_groups_best(spark, sf_dir):
    return G.leader_groups(X.hashed(spark, sf_dir), "best", SIMILAR, 0.75)


#: Main slides and slides that the next two queries start from, by the folds of W13 and W4.
_MAINS = f"(SELECT * FROM {Q.fold('frames', 'video_id', 'frame_idx', {'luma': 'DOUBLE[]'}, f'L.luma IS NULL OR coalesce({Q.mse(*_LX)} < 0.8, false)')})"


@query(
    sql_with("frames")
    + f""", mains AS (SELECT video_id, frame_idx AS main_idx, luma AS base, lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS nxt FROM frames JOIN {_MAINS} USING (video_id, frame_idx)),
    near AS (SELECT f.video_id, main_idx, frame_idx, luma, min(CASE WHEN {Q.mse('base', 'luma')} >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY f.video_id, main_idx ORDER BY frame_idx) AS open
      FROM frames f JOIN mains m ON f.video_id = m.video_id AND frame_idx > main_idx AND frame_idx < coalesce(nxt, main_idx + 60)),
    keyed AS (SELECT video_id * 10000000 + main_idx AS key, frame_idx, luma FROM near WHERE open = 1 UNION ALL SELECT video_id * 10000000 + main_idx, main_idx, base FROM mains)
    SELECT key // 10000000 AS video_id, key % 10000000 AS main_idx, frame_idx
    FROM {Q.fold('keyed', 'key', 'frame_idx', {'luma': 'DOUBLE[]'}, f'L.luma IS NULL OR (coalesce({Q.is_animation(*_LX, 8)}, false) AND X.frame_idx - L.frame_idx >= 1.0)')} WHERE frame_idx > key % 10000000"""
)
def w14_animation_states(spark, sf_dir):
    frames = X.frames(spark, sf_dir)
    mains = frames.join(S.accept_changes(frames, "main", threshold=0.8), ["video_id", "frame_idx"], "left_semi")
    return S.animation_states(frames, mains, most_cells=8)


@query(
    sql_with("series")
    + """SELECT key, event_id, sum(CASE WHEN gap < 21600.0 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t, event_id)::BIGINT AS group_no
    FROM (SELECT *, t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id) AS gap FROM series)"""
)
def w16_gap_groups(spark, sf_dir):
    return S.gap_groups(X.series(spark, sf_dir), "key", "t", 21600.0, "event_id").select("key", "event_id", "group_no")


@query(
    sql_with("frames", "hashed")
    + f""", r AS (SELECT *, min(frame_idx) OVER (PARTITION BY video_id, bits) AS rep FROM hashed)
    SELECT a.frame_idx AS id_a, b.frame_idx AS id_b, {Q.hamming('a.bits', 'b.bits')}::INTEGER AS distance
    FROM r a JOIN r b ON a.video_id = b.video_id AND a.frame_idx < b.frame_idx WHERE a.frame_idx = a.rep AND b.frame_idx = b.rep AND {Q.hamming('a.bits', 'b.bits')} <= 19
    UNION ALL SELECT rep, frame_idx, 0 FROM r WHERE frame_idx > rep"""
)
def j9_similar_pairs(spark, sf_dir):
    return G.similar_pairs(X.hashed(spark, sf_dir), "frame_idx", "phash", 19, "video_id")


@query(
    sql_with("frames", "hashed")
    + f""", c AS (SELECT video_id, frame_idx * 4 + k AS id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN
        (k = 1 AND 63 - i = frame_idx % 64) OR (k = 2 AND 63 - i BETWEEN frame_idx % 61 AND frame_idx % 61 + 2) OR (k = 3 AND 63 - i <= 14 AND (63 - i) % 2 = 0)
        THEN CASE bits[i + 1] WHEN '1' THEN '0' ELSE '1' END ELSE bits[i + 1] END), '') AS bits FROM hashed, range(0, 4) t(k)),
    r AS (SELECT *, min(id) OVER (PARTITION BY video_id, bits) AS rep FROM c)
    SELECT a.id AS id_a, b.id AS id_b, {Q.hamming('a.bits', 'b.bits')}::INTEGER AS distance
    FROM r a JOIN r b ON a.video_id = b.video_id AND a.id < b.id WHERE a.id = a.rep AND b.id = b.rep AND {Q.hamming('a.bits', 'b.bits')} <= 6
    UNION ALL SELECT rep, id, 0 FROM r WHERE id > rep"""
)
def j9_near_copies(spark, sf_dir):
    """Each frame beside copies of it with one, three and eight bits turned."""
    h, n = F.col("phash"), F.col("frame_idx")
    one, three = (F.call_function("shiftleft", F.lit(x).cast("long"), (n % m).cast("int")) for x, m in ((1, 64), (7, 61)))
    copies = F.array(h, h.bitwiseXOR(one), h.bitwiseXOR(three), h.bitwiseXOR(F.lit(0x5555).cast("long")))
    each = X.hashed(spark, sf_dir).select("video_id", "frame_idx", F.posexplode(copies).alias("k", "h"))
    return G.similar_pairs(each.select("video_id", (F.col("frame_idx") * 4 + F.col("k")).alias("id"), "h"), "id", "h", 6, "video_id")


@query(
    sql_with("frames")
    + f""", taken AS ({ORACLES['w4_accept_advanced']}), slides AS (SELECT *, row_number() OVER w AS pos, lead(frame_idx) OVER w AS nxt FROM frames JOIN taken USING (video_id, frame_idx) WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
    probes AS (SELECT video_id, pos, unnest(range(frame_idx + 5, nxt, 5)) AS frame_idx FROM slides WHERE nxt - frame_idx > 30),
    seen AS (SELECT p.*, f.luma FROM probes p JOIN frames f USING (video_id, frame_idx))
    SELECT video_id, frame_idx FROM seen s WHERE NOT EXISTS (SELECT 1 FROM slides k WHERE k.video_id = s.video_id AND k.pos BETWEEN s.pos - 2 AND s.pos + 2 AND {Q.ssim('k.luma', 's.luma')} > 0.15)"""
)
def j10_probe_gaps(spark, sf_dir):
    frames = X.frames(spark, sf_dir)
    slides = frames.join(S.accept_changes(frames, "advanced", threshold=0.0), ["video_id", "frame_idx"], "left_semi")
    return S.probe_gaps(slides, frames, like=0.15)


_LED = "led AS (" + _leaders("first") + ")"


@query(f"""WITH {_LED} SELECT video_id, group_id, count(*) AS slide_count, min(frame_idx::DOUBLE) AS "start", max(frame_idx::DOUBLE) AS "end", list(frame_idx ORDER BY frame_idx) AS members FROM led GROUP BY ALL""")
def a1_group_summary(spark, sf_dir):
    led = w11_leader_groups_first(spark, sf_dir).withColumn("timestamp", F.col("frame_idx").cast("double"))
    return G.group_summary(led, "video_id", "group_id")


@query(f"WITH {_LED} SELECT video_id, sum(n)::BIGINT AS total_slides, count(*) AS total_groups, round(sum(n) / count(*), 6) AS slides_per_group, string_agg(group_id || ':' || n, ',' ORDER BY group_id) AS spread FROM (SELECT video_id, group_id, count(*) AS n FROM led GROUP BY ALL) GROUP BY video_id")
def a2_group_statistics(spark, sf_dir):
    out = G.group_statistics(w11_leader_groups_first(spark, sf_dir))
    spread = F.array_join(F.transform(F.array_sort(F.map_entries("distribution")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return out.select("video_id", "total_slides", "total_groups", F.round("slides_per_group", 6).alias("slides_per_group"), spread.alias("spread"))


@query(f"WITH {_LED} SELECT video_id, count(DISTINCT CASE WHEN group_id >= 3 THEN group_id END) + count(*) FILTER (group_id < 3) AS group_count FROM led GROUP BY video_id")
def a3_group_count_with_singles(spark, sf_dir):
    led = w11_leader_groups_first(spark, sf_dir).withColumn("group_id", F.when(F.col("group_id") >= 3, F.col("group_id")).otherwise(-1))
    return G.group_count_with_singles(led, "video_id", "group_id")


@query(
    sql_with("frames", "pairs")
    + f""", {_GROUPED} SELECT video_id, group_no, n, round(m, 6) AS mean_similarity, n >= 2 AND coalesce(m > 0.2, false) AS animated FROM (
    SELECT video_id, group_no, count(*) AS n, avg(s) AS m FROM (SELECT *, {Q.ssim('luma', 'p')} AS s FROM (SELECT *, lag(luma) OVER (PARTITION BY video_id, group_no ORDER BY frame_idx) AS p FROM grouped)) GROUP BY ALL)"""
)
def a12_animation_sequence_flag(spark, sf_dir):
    out = G.animation_sequence_flag(_groups(spark, sf_dir), ["video_id", "group_no"], M.ssim(F.col("luma"), F.col("prev_luma")), 0.2)
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6))


def _two_modes(spark, sf_dir):
    a = S.accept_changes(X.frames(spark, sf_dir), "advanced", threshold=0.0).withColumn("mode", F.lit("advanced"))
    b = S.accept_changes(X.frames(spark, sf_dir), "main", threshold=0.9).withColumn("mode", F.lit("main"))
    return a.unionByName(b)


@query(f"WITH {_LED} SELECT video_id, frame_idx FROM led QUALIFY group_id < 3 OR row_number() OVER (PARTITION BY video_id, group_id ORDER BY frame_idx) = 1")
def w10_select_first(spark, sf_dir):
    """The first slide of every group, and all slides without one (here: of the first three groups)."""
    led = w11_leader_groups_first(spark, sf_dir).withColumn("group_id", F.when(F.col("group_id") >= 3, F.col("group_id")).when(F.col("group_id") > 0, -1))
    return G.select_best(led, "first", ["video_id", "group_id"]).select("video_id", "frame_idx")


@query(
    f"""WITH a AS ({ORACLES['w4_accept_advanced']}), b AS ({ORACLES['w13_main_slides']})
    SELECT video_id, n_a AS advanced, coalesce(n_b, 0) AS main, coalesce(n_b, 0) - n_a AS difference FROM (SELECT video_id, count(*) AS n_a FROM a GROUP BY ALL) LEFT JOIN (SELECT video_id, count(*) AS n_b FROM b GROUP BY ALL) USING (video_id)"""
)
def w22_compare_modes(spark, sf_dir):
    return R.compare_modes(_two_modes(spark, sf_dir), ("advanced", "main"))


@query(
    f"""WITH {_LED}, kept AS ({ORACLES['w4_accept_advanced']})
    SELECT video_id, group_id, count(k.frame_idx) AS slide_count, min(led.frame_idx::DOUBLE) AS "start", max(led.frame_idx::DOUBLE) AS "end"
    FROM led LEFT JOIN kept k USING (video_id, frame_idx) GROUP BY ALL"""
)
def j14_recount_groups(spark, sf_dir):
    led = w11_leader_groups_first(spark, sf_dir).withColumn("timestamp", F.col("frame_idx").cast("double"))
    left = G.retain_existing(led.withColumn("filename", F.struct("video_id", "frame_idx")), QUERIES["w4_accept_advanced"](spark, sf_dir).select(F.struct("video_id", "frame_idx").alias("filename")))
    return G.recount_groups(G.group_summary(led, "video_id", "group_id").drop("members"), left, "video_id", "group_id")


@query(
    sql_with("runs")
    + """SELECT job, round(a, 6) AS standard_seconds, round(b, 6) AS improved_seconds, round(coalesce(a / nullif(b, 0), 0), 6) AS speed_ratio, round(a - b, 6) AS saved
    FROM (SELECT job, sum(CASE WHEN status = 'failed' THEN seconds ELSE 0 END) AS a, sum(CASE WHEN status = 'success' THEN seconds ELSE 0 END) AS b FROM runs GROUP BY job)"""
)
def w22_compare_speed(spark, sf_dir):
    runs = X.runs(spark, sf_dir).withColumn("mode", F.when(F.col("status") == "failed", "standard").when(F.col("status") == "success", "improved"))
    out = R.compare_speed(runs, ("standard", "improved"), "job")
    return out.withColumns({c: F.round(c, 6) for c in ("standard_seconds", "improved_seconds", "speed_ratio", "saved")})
