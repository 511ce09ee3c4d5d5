"""Raw image files as grey grids: PNG, BMP and PGM/PPM bytes decoded in Arrow batches, with a reason for those that cannot be."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

# Kinds that are decoded here, kinds of images beside them, and the weights of red, green and blue.
DECODED = ("png", "bmp", "pgm", "ppm")
KNOWN = (*DECODED, "jpg", "jpeg", "gif", "webp", "heic", "heif")
GREY = np.array([0.299, 0.587, 0.114])
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of a batch that is given back.
BATCH_PIXELS = 1 << 22


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without their filters; ``raw`` has the filter's number first in every row."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    before = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == 1:
            lanes = row.reshape(-1, step)
            np.cumsum(lanes, axis=0, dtype=np.uint8, out=lanes)
        elif kind == 2:
            row += before
        elif kind in (3, 4):
            out, up = row.astype(int).tolist(), before.tolist()
            for x in range(len(out)):
                a, b = out[x - step] if x >= step else 0, up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x - step] if x >= step else 0
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                out[x] = (out[x] + guess) & 255
            row[:] = out
        elif kind:
            raise ValueError("unknown filter")
        before = row
    return rows


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise ValueError("unsupported form")
    n = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    pixels = _unfiltered(raw.reshape(height, 1 + width * n), n).reshape(height, width, n)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        return palette[pixels[:, :, 0]]
    return pixels[:, :, : 3 if n >= 3 else 1]


def _bmp(data: bytes) -> np.ndarray:
    start, head, width, height, _, bits, packing = struct.unpack("<10xIIiiHHI", data[:34])
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported form")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        return colours[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def _portable(data: bytes) -> np.ndarray:
    head = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", data)
    if not head or int(head[4]) != 255:
        raise ValueError("unsupported form")
    width, height, n = int(head[2]), int(head[3]), 1 if head[1] == b"5" else 3
    return np.frombuffer(data, np.uint8, width * height * n, head.end()).reshape(height, width, n)


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and grey values, row by row. ValueError says why not."""
    reader = _png if data.startswith(b"\x89PNG\r\n\x1a\n") else _bmp if data.startswith(b"BM") else _portable if data[:2] in (b"P5", b"P6") else None
    if reader is None:
        raise ValueError("unknown kind" if data else "empty file")
    try:
        pixels = reader(data)
    except (struct.error, zlib.error, IndexError, OverflowError) as error:
        raise ValueError("broken file") from error
    grey = pixels[:, :, 0].astype(float) if pixels.shape[2] == 1 else pixels[:, :, :3].astype(float) @ GREY
    return pixels.shape[1], pixels.shape[0], grey.ravel()


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, luma, error) of all image files below a folder.

    ``error`` is null for decoded images; else the grid is null and it says ``unsupported kind`` (an image of another kind;
    ``read_images`` knows some of them) or what is wrong with the bytes. Other files, and hidden ones, are not listed.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("luma", pa.list_(pa.float64())), ("error", pa.string())])
        for batch in batches:
            rows, pixels = [], 0
            for name, content, why in zip(*(batch.column(c) for c in ("path", "content", "why"))):
                row = (name.as_py(), None, None, None, why.as_py())
                if row[4] is None:
                    try:
                        width, height, grey = decode(content.as_py())
                        row = (row[0], width, height, grey, None)
                        pixels += len(grey)
                    except ValueError as error:
                        row = (*row[:4], str(error).split("\n")[0][:100])
                rows.append(row)
                if pixels > BATCH_PIXELS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, pixels = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = P.extension(F.col("path"))
    why = F.when(~kind.isin(*DECODED), "unsupported kind")
    listed = files.where(kind.isin(*KNOWN)).select("path", F.when(why.isNull(), F.col("content")).alias("content"), why.alias("why"))
    return listed.mapInArrow(decoded, "path string, width int, height int, luma array<double>, error string")


def image_counts(images: DataFrame, *keys: str) -> DataFrame:
    """How many images there are, were read and were skipped, and how many for each reason, per key."""
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n"))))
    by_reason = images.groupBy(*keys, "error").agg(F.count("*").alias("n"))
    skipped = F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("n"))), F.lit(0))
    counts = by_reason.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), skipped.alias("skipped"))
    told = by_reason.where("error IS NOT NULL").groupBy(*keys).agg(reasons.alias("reasons"))
    joined = counts.join(told, list(keys), "left") if keys else counts.join(told, F.lit(True), "left")
    return joined.withColumn("valid", F.col("total") - F.col("skipped"))
