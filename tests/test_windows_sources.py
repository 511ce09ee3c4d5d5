"""Window metrics against brute force on square and other grids; named files, images and the progress log."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import windows as W
from lectern.operators import sequence as S
from lectern.operators import transcripts as T
from lectern.plans import capture as K
from lectern.sources import images as I
from lectern.sources import named as N
from lectern.sources import progress_log as L
from lectern.streaming import progress as Z

SHAPES = [(16, 9), (32, 32), (7, 7), (3, 5), (11, 20)]


def grids(width, height, seed=0, n=4):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (n, height, width)).astype(float)
    b = np.where(rng.random(a.shape) < 0.7, a, rng.integers(0, 256, a.shape))
    return a, b.astype(float)


@pytest.mark.parametrize(("width", "height"), SHAPES)
def test_window_ssim(width, height):
    a, b = grids(width, height)
    size = min(7, width, height)

    def one(x, y):
        out = []
        for r in range(height - size + 1):
            for c in range(width - size + 1):
                u, v = x[r : r + size, c : c + size].ravel(), y[r : r + size, c : c + size].ravel()
                cov = np.cov(u, v, ddof=1)
                out.append((2 * u.mean() * v.mean() + W.C1) * (2 * cov[0, 1] + W.C2) / ((u.mean() ** 2 + v.mean() ** 2 + W.C1) * (cov[0, 0] + cov[1, 1] + W.C2)))
        return np.mean(out)

    assert W.window_ssim(a, b) == pytest.approx([one(x, y) for x, y in zip(a, b)])
    assert W.window_ssim(a, a) == pytest.approx(1.0)


def swept(x, width, height, op):
    """Maximum or minimum over a rectangle around each pixel, within the grid."""
    out = np.zeros_like(x)
    for y in range(x.shape[0]):
        for c in range(x.shape[1]):
            out[y, c] = op(x[max(0, y - height // 2) : y - height // 2 + height, max(0, c - width // 2) : c - width // 2 + width])
    return out


@pytest.mark.parametrize(("width", "height"), SHAPES)
def test_opening_and_regions(width, height):
    a, b = grids(width, height, 1)
    wanted = []
    for x, y in zip(a, b):
        m = (abs(x - y) > W.PIXEL_CHANGE).astype(float)
        for op in (np.max, np.min, np.min, np.max):
            m = swept(m, 5, 5, op)
        wanted.append(m.mean())
    assert W.opened_change(a, b).tolist() == wanted
    for w, h in ((10, 1), (1, 3), (4, 6)):
        assert (W.dilate(a, w, h) == [swept(x, w, h, np.max) for x in a]).all() and (W.erode(a, w, h) == [swept(x, w, h, np.min) for x in a]).all()
    for mask in [x > t for x in a for t in (60, 128, 200)] + [np.zeros((height, width), bool), np.ones((height, width), bool)]:
        number, seen, count = W.labels(mask), np.zeros((height, width), int), 0
        for y, c in zip(*np.nonzero(mask)):
            if seen[y, c]:
                continue
            count += 1
            open_ = [(y, c)]
            while open_:
                p, q = open_.pop()
                if 0 <= p < height and 0 <= q < width and mask[p, q] and not seen[p, q]:
                    seen[p, q] = count
                    open_ += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert number.max(initial=0) == count and len(set(zip(seen.ravel(), number.ravel()))) == count + (not mask.all())
        assert W.regions(mask, 3) == sum((seen == k).sum() > 3 for k in range(1, count + 1))


def test_edges_reach_over_the_high_threshold():
    g = np.zeros((1, 12, 12))
    g[0, :, 6:] = 20.0  # a soft step, 80 high
    assert not W.edges(g).any()
    g[0, :3, 6:] = 60.0  # sharp at one end
    found = W.edges(g)[0]
    assert found[11, 5] and found[0, 6] and not found[:, 0].any()
    assert W.edge_similarity(g, g)[0] == 1.0


def test_functions_of_columns(spark):
    a, b = grids(16, 9, 3, 40)
    rows = [(i, x.ravel().tolist(), y.ravel().tolist()) for i, (x, y) in enumerate(zip(a, b))] + [(90, None, [1.0]), (91, [1.0] * 7, [1.0] * 7), (92, [None] + [1.0] * 143, [1.0] * 144)]
    frame = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    x, y, shape = F.col("a"), F.col("b"), (16, 9)
    made = frame.select("i", W.window_ssim_of(x, y, shape).alias("s"), W.opened_change_of(x, y, shape).alias("o"), W.text_regions_of(x, shape, 5).alias("t"), W.edge_similarity_of(x, y, shape).alias("e"))
    found = {r.i: r for r in made.collect()}
    assert [found[i].s for i in range(40)] == pytest.approx(W.window_ssim(a, b).tolist()) and [found[i].o for i in range(40)] == W.opened_change(a, b).tolist()
    assert [found[i].t for i in range(40)] == W.text_regions(a, 5).tolist() and [found[i].e for i in range(40)] == W.edge_similarity(a, b).tolist()
    assert all(tuple(found[i])[1:] == (None,) * 4 for i in (90, 91, 92))
    assert made.where("i > 100").count() == 0


@pytest.mark.parametrize(("width", "height"), [(16, 9), (32, 32)])
def test_folds_on_other_grids(spark, width, height):
    """A pattern that moves every ten frames, in all modes that look at cells, edges or windows."""
    rng, rows, shape = np.random.default_rng(4), [], (width, height)
    for i in range(60):
        if i % 10 == 0:
            grid = np.repeat(rng.integers(0, 2, (height, 1)) * 200.0, width, axis=1) + rng.integers(0, 2, (height, width)) * 50
        rows.append(("v", i, grid.ravel().tolist(), int(rng.integers(1 << 60))))
    frames = spark.createDataFrame(rows, "video_id string, frame_idx long, luma array<double>, phash long").withColumn("sharpness", F.lit(1.0)).cache()
    turns = [0, 10, 20, 30, 40, 50]
    for mode, options in (("improved", {}), ("improved", {"window": 7, "edges": "slope"}), ("advanced", {"window": 7}), ("main", {})):
        found = S.accept_changes(frames, mode, shape=shape, threshold=0.99 if mode == "main" else None, **options).orderBy("frame_idx")
        # improved mode takes no frame within the first second
        assert [r.frame_idx for r in found.collect()] == [int(mode == "improved"), *turns[1:]]
    grouped = S.animation_groups(frames, shape=shape, window=7, kernel=3)
    assert grouped.groupBy("group_no").count().count() == 6
    assert [r.frame_idx for r in S.key_frames(grouped.withColumn("group_no", F.lit(1)), shape=shape).orderBy("frame_idx").collect()] == turns
    assert S.dense_candidates(frames, shape=shape, window=7, kernel=3).count() == 6
    assert S.animation_states(frames, frames.where("frame_idx = 0"), stop=-9.0, most_cells=9, shape=shape).count() == 5
    if width != height:
        videos = spark.createDataFrame([("v", 60, 1.0)], "video_id string, total_frames long, fps double")
        assert K.capture_ultra(frames, videos, step=5, shape=shape, window=7, kernel=3).count() > 0
        assert K.capture_pipeline(frames, videos, "improved", step=1, change=2.0, shape=shape, window=7, edges="slope").count() >= 6
    frames.unpersist()


def test_shapes():
    assert W.shape_of(64, None) == (8, 8) and W.shape_of(15, (5, 3)) == (5, 3)
    for size, shape in ((15, None), (64, (9, 7))):
        with pytest.raises(ValueError, match="give its shape"):
            W.shape_of(size, shape)


def test_more_text_regions_make_a_slide(spark):
    """Letters appear one after the other: structure and edges stay alike, the count of regions does not."""
    rows, grid = [], np.full((120, 160), 128.0)
    for i in range(16):
        rows.append(("v", i * 2, grid.ravel().tolist()))
        y, x = divmod(i, 4)
        grid[y * 30 + 5 : y * 30 + 12, x * 40 + 5] += 40
    frames = spark.createDataFrame(rows, "video_id string, frame_idx long, luma array<double>")
    found = S.accept_changes(frames, "improved", threshold=-1.0, shape=(160, 120)).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in found] == [0] or all(b.frame_idx - a.frame_idx == 12 for a, b in zip(found, found[1:]))
    assert W.text_regions(grid[None], 40)[0] == 16


def test_grams_and_periods():
    rng = random.Random(6)
    for size in (1, 2, 7, 15, 16):
        codes = np.frombuffer("".join(rng.choice("abc") for _ in range(120)).encode("utf-32-le"), np.uint32)
        hashes = T.gram_hashes(codes, size)
        assert all((hashes[i] == hashes[j]) == (codes[i : i + size] == codes[j : j + size]).all() for i in range(len(hashes)) for j in range(len(hashes)))
    assert T.periods(np.frombuffer(("x" * 5 + "abcdefghijklmnopqrst" * 3 + "y").encode("utf-32-le"), np.uint32), 15, 3).tolist() == [20]


# --- named files


def test_named_files(spark, tmp_path):
    rows = [("a/x.srt", "eins"), ("a/x_en.srt", "one"), ("b.txt", ""), ("ü/ö ä.txt", "é漢"), ("null.txt", None)]
    path = str(tmp_path / "out")
    N.write_named(spark.createDataFrame(rows, "name string, content string"), path)
    assert {(r.name, r.content) for r in N.read_named(spark, path).collect()} == {(n, c or "") for n, c in rows}
    assert (tmp_path / "out" / "a" / "x_en.srt").read_text() == "one" and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    N.write_named(spark.createDataFrame([("b.txt", b"\xff\x00")], "name string, content binary"), path)
    assert {(r.name, bytes(r.content)) for r in N.read_named(spark, path, "b.*", binary=True).collect()} == {("b.txt", b"\xff\x00")}
    assert N.read_named(spark, path, "*.srt").count() == 2
    one = spark.range(1).select(N.subtitle_name(F.lit("s"), F.lit(None).cast("string")).alias("a"), N.subtitle_name(F.lit("s"), F.lit("de"), ".md").alias("b")).first()
    assert tuple(one) == ("s.srt", "s_de.md")
    assert N.read_named(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("names", [["a.txt", "b.txt", "../c.txt"], ["a.txt", "a.txt"], ["a.txt", None], ["a.txt", "/etc/x"]])
def test_a_failed_write_leaves_no_file(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, "x") for n in names], "name string, content string")
    with pytest.raises(Exception, match="named"):
        N.write_named(rows, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


# --- images


def png(pixels, colour, filters, palette=None):
    height, width, n = pixels.shape
    raw, before = b"", np.zeros(width * n, int)
    for y in range(height):
        row, kind = pixels[y].astype(int).ravel(), filters[y % len(filters)]
        left, up, corner = np.concatenate((np.zeros(n, int), row[:-n])), before, np.concatenate((np.zeros(n, int), before[:-n]))
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        raw += bytes([kind]) + bytes(((row - (0, left, up, (left + up) // 2, paeth)[kind]) & 255).tolist())
        before = row

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)), *([chunk(b"PLTE", palette.tobytes())] if palette is not None else []), chunk(b"IDAT", zlib.compress(raw)), chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


def test_image_bytes():
    rng = np.random.default_rng(7)
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = rng.integers(0, 256, (9, 5, n)).astype(np.uint8)
        wanted = pixels[:, :, 0].astype(float) if n < 3 else pixels[:, :, :3].astype(float) @ I.GREY
        for filters in ([0], [1], [2], [3], [4], [4, 2, 0, 1, 3]):
            width, height, grey = I.decode(png(pixels, colour, filters))
            assert (width, height) == (5, 9) and grey == pytest.approx(wanted.ravel())
    palette, index = rng.integers(0, 256, (7, 3)).astype(np.uint8), rng.integers(0, 7, (4, 6, 1)).astype(np.uint8)
    assert I.decode(png(index, 3, [1], palette))[2] == pytest.approx((palette[index[:, :, 0]].astype(float) @ I.GREY).ravel())
    rgb = rng.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    for up in (1, -1):
        rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in rgb[::up][::-1])  # 15 bytes and one more
        bmp = b"BM" + struct.pack("<IIIIiiHHI", 0, 0, 54, 40, 5, 3 * up, 1, 24, 0) + bytes(20) + (rows if up > 0 else b"".join(r[:, ::-1].tobytes() + b"\0" for r in rgb))
        assert I.decode(bmp)[2] == pytest.approx((rgb.astype(float) @ I.GREY).ravel())
    assert I.decode(b"P6 # a comment\n5 3\n255\n" + rgb.tobytes())[:2] == (5, 3)
    good = png(index, 3, [1], palette)
    for data in (b"", b"abc", good[:40], good[:-20], good.replace(b"IDAT", b"IDAX"), b"P5\n9 9\n255\nshort", b"BM\0", b"P5\n1 1\n65535\n\0\0"):
        with pytest.raises(ValueError):
            I.decode(data)


def test_images_and_what_was_skipped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pgm").write_bytes(b"P5 2 1 255\n\x01\x02")
    (tmp_path / "in" / "b.PNG").write_bytes(png(np.array([[[9]]], np.uint8), 0, [0]))
    (tmp_path / "c.heic").write_bytes(b"x")
    (tmp_path / "d.png").write_bytes(b"no image")
    (tmp_path / "._e.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    rows = {r.path.rpartition("/")[2]: (r.width, r.height, r.luma, r.error) for r in I.decode_images(spark, str(tmp_path)).collect()}
    assert rows == {"a.pgm": (2, 1, [1.0, 2.0], None), "b.PNG": (1, 1, [9.0], None), "c.heic": (None, None, None, "unsupported kind"), "d.png": (None, None, None, "unknown kind")}
    counts = I.image_counts(I.decode_images(spark, str(tmp_path))).first()
    assert (counts.total, counts.valid, counts.skipped, counts.reasons) == (4, 2, 2, {"unknown kind": 1, "unsupported kind": 1})
    (tmp_path / "none").mkdir()
    empty = I.image_counts(I.decode_images(spark, str(tmp_path / "none"))).first()
    assert (empty.total, empty.valid, empty.skipped) == (0, 0, 0)


# --- the progress log


def test_a_batch_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "processed", 1), ("b", "failed", 1)], "item string, status string, t long").withColumn("ts", F.timestamp_seconds("t"))
    for _ in range(2):
        L.log_batch(rows, path, "w", 0)
    L.log_batch(rows.where("item = 'b'").withColumn("status", F.lit("processed")).withColumn("ts", F.timestamp_seconds(F.lit(5))), path, "w", 1)
    assert L.read_log(spark, path).count() == 3
    assert {(r.item, r.status) for r in L.compact(spark, path).collect()} == {("a", "processed"), ("b", "processed")}
    with pytest.raises(ValueError, match="names no folder"):
        L.log_batch(rows, path, "a/b", 0)


def test_a_replayed_stream_batch_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(10).select(F.col("id").cast("string").alias("item")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item string").parquet(str(tmp_path / "in"))
    log, place = str(tmp_path / "log"), tmp_path / "check"
    Z.stream_new_items(stream, log, str(place)).awaitTermination()
    for commit in (place / "commits").iterdir():  # as if it had crashed before the commit
        commit.unlink()
    Z.stream_new_items(stream, log, str(place)).awaitTermination()
    assert sorted(int(r.item) for r in L.read_log(spark, log).collect()) == list(range(10))
