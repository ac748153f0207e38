"""Images as points: TIFF channels, PNG and JPEG pictures; one row a pixel, point_id = row * width + col."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.scratch import cut, indexed, put_parts

# Fixed values of the TIFF format: sizes of the field types, and sample types by (format, bits).
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 16): "f2", (3, 32): "f4", (3, 64): "f8"}


def decode_tiff(data: bytes, flip: bool = False) -> np.ndarray:
    """The single channel of a TIFF (strips, uncompressed or deflated) as float32 rows."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(f"{order}I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(f"{order}HHI", entry[:8])
        size = FIELD_BYTES.get(kind, 1) * n
        raw = entry[8 : 8 + size] if size <= 4 else data[(o := struct.unpack(f"{order}I", entry[8:12])[0]) : o + size]
        letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
        if letter:
            tags[tag] = struct.unpack(f"{order}{n}{letter}", raw)
    width, height = tags[256][0], tags[257][0]
    bits, form, packing = tags.get(258, (1,))[0], tags.get(339, (1,))[0], tags.get(259, (1,))[0]
    if tags.get(277, (1,))[0] != 1 or (form, bits) not in SAMPLES or packing not in (1, 8, 32946):
        raise ValueError("only single channels of 8 to 64 bits, plain or deflated, are read")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(s if packing == 1 else zlib.decompress(s) for s in strips)
    out = np.frombuffer(raw, f"{order}{SAMPLES[form, bits]}", width * height).reshape(height, width).astype(np.float32)
    return out[::-1] if flip else out


def _tiff_ends(h: int, w: int) -> tuple[bytes, bytes]:
    """What leads and follows the pixels of a float32 TIFF of one uncompressed strip."""
    size = 4 * h * w
    if size >= 1 << 32:
        raise ValueError("a TIFF file ends at 4 GB")
    tags = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, size), (339, 3, 3)]
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + bytes(4)
    return b"II*\x00" + struct.pack("<I", 8 + size), directory


def encode_tiff(image: np.ndarray) -> bytes:
    """A float32 TIFF of one uncompressed strip."""
    head, directory = _tiff_ends(*image.shape)
    return head + np.ascontiguousarray(image, "<f4").tobytes() + directory


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG, grey or colour, as uint8 (height, width, 3); transparency is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int64)
    for r in range(h):
        kind, line = rows[r, 0], rows[r, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0).ravel() & 255
        elif kind == 2:
            line = line + above & 255
        elif kind in (3, 4):
            for i in range(len(line)):
                a, b, c = (line[i - channels] if i >= channels else 0), above[i], (above[i - channels] if i >= channels else 0)
                if kind == 3:
                    line[i] = line[i] + (a + b) // 2 & 255
                else:
                    guess = a + b - c
                    near = min((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]
                    line[i] = line[i] + near & 255
        out[r], above = line, line
    pixels = out.reshape(h, w, channels)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if colour in (0, 4) else pixels[:, :, :3]


def _explode(batches: Iterator[pa.RecordBatch], decode) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            image = decode(content)
            h, w = image.shape[:2]
            flat = image.reshape(h * w, -1).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float32()))
            ids = np.arange(h * w)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(ids), pa.array((ids // w).astype(np.int32)), pa.array((ids % w).astype(np.int32)), lists], ["path", "point_id", "row", "col", "features"])


PIXELS = "path string, point_id long, row int, col int, features array<float>"


def tiff_channel(spark: SparkSession, path: str, flip: bool = False) -> DataFrame:
    """(path, point_id, row, col, features) of each file found; features hold the one channel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _explode(it, lambda d: decode_tiff(d, flip)), PIXELS)


def tiff_stack(spark: SparkSession, folder: str, flip: bool = False) -> DataFrame:
    """(point_id, row, col, features): one channel a file, in the order of the file names; raises if their sizes differ."""
    cells = tiff_channel(spark, folder, flip)
    sizes = cells.groupBy("path").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).select("h", "w").distinct().count()
    if sizes > 1:
        raise ValueError("the channels have different sizes")
    own = cells.select("point_id", "row", "col", "path", F.col("features").getItem(0).alias("v"))
    stacked = F.array_sort(F.collect_list(F.struct("path", "v")))
    return own.groupBy("point_id", "row", "col").agg(F.transform(stacked, lambda s: s["v"]).alias("features"))


def rgb(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, row, col, features) of one PNG or JPEG picture, features being red, green and blue from 0 to 255."""
    if path.lower().endswith(".png"):
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInArrow(lambda it: _explode(it, decode_png), PIXELS).drop("path")
    if not path.lower().endswith((".jpg", ".jpeg")):
        raise ValueError(f"{path}: neither PNG nor JPEG")
    image = spark.read.format("image").load(path).select("image.*")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                x = x[:, :, 2::-1] if r["nChannels"] >= 3 else np.repeat(x[:, :, :1], 3, axis=2)
                w = r["width"]
                ids = np.arange(r["height"] * w)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).astype(np.float32)), 3).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((ids // w).astype(np.int32)), pa.array((ids % w).astype(np.int32)), lists], ["point_id", "row", "col", "features"])

    return image.select("height", "width", "nChannels", "data").mapInArrow(work, "point_id long, row int, col int, features array<float>")


def level_image(membership: DataFrame, rows: int, cols: int, seed: int | None = None) -> np.ndarray:
    """The component of each pixel as an image of a level small enough to look at; `seed` shuffles the ids for contrast."""
    t = membership.select("point_id", "component_id").orderBy("point_id").toArrow()
    ids = t.column("component_id").to_numpy()
    if len(ids) != rows * cols:
        raise ValueError("the image has another number of pixels")
    if seed is not None:
        ids = np.random.default_rng(seed).permutation(int(ids.max()) + 1)[ids]
    return ids.reshape(rows, cols).astype(np.float32)


#: Pixels that a task makes into a part of an image.
STRIP = 1 << 18


def level_strips(membership: DataFrame, seed: int | None = None) -> DataFrame:
    """(strip, pixels, data): the components of the pixels as float32 in parts of STRIP pixels; `seed` shuffles the ids for contrast."""
    own = membership.select("point_id", "component_id")
    if seed is not None:
        names = own.select("component_id").distinct().withColumn("_hash", F.xxhash64(F.lit(seed), "component_id"))
        own = own.join(indexed(names, "_hash", "shuffled").select("component_id", "shuffled"), "component_id").select("point_id", F.col("shuffled").alias("component_id"))

    def pack(table: pa.Table) -> pa.Table:
        ids, of = table.column("point_id").to_numpy(), table.column("component_id").to_numpy()
        data = of[np.argsort(ids)].astype("<f4").tobytes()
        return pa.table({"strip": table.column("strip")[:1], "pixels": pa.array([len(ids)]), "data": pa.array([data])})

    return own.withColumn("strip", F.floor(F.col("point_id") / STRIP).cast("long")).groupBy("strip").applyInArrow(pack, "strip long, pixels long, data binary")


def write_level_images(memberships: dict[int, DataFrame], rows: int, cols: int, folder: str, seed: int | None = 1) -> list[str]:
    """A float32 TIFF of each level's components, `level-0.tif` and on, shuffled for contrast unless `seed` is None; the paths written.

    Tasks make the strips; they go to the file one after another, in order, and no image is ever whole in memory.
    """
    paths = []
    for level, members in sorted(memberships.items()):
        strips = cut(level_strips(members, seed), "strips")
        if (strips.agg(F.sum("pixels")).first()[0] or 0) != rows * cols:
            raise ValueError("the image has another number of pixels")
        head, directory = _tiff_ends(rows, cols)
        paths.append(f"{folder.rstrip('/')}/level-{level}.tif")
        pixels = (bytes(r["data"]) for r in strips.select("strip", "data").orderBy("strip").toLocalIterator())
        put_parts(members.sparkSession, paths[-1], itertools.chain([head], pixels, [directory]))
    return paths
