"""Image collections in three forms, and the way between them.

* P: one row for each pixel (image_id, width, height, x, y, r, g, b, a)
* I: one row for each image (image_id, width, height, data BINARY), row-major RGBA
* T: one row for each tile (see ``operators.tiling``)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import positive_int, require
from .jpeg import encode_jpeg

PIXEL = ["image_id", "width", "height", "x", "y", "r", "g", "b", "a"]
PIXEL_SCHEMA = "image_id long, " + ", ".join(f"{c} int" for c in PIXEL[1:])
#: Pixels that Python hands to the JVM at a time.
BATCH_PIXELS = 1 << 18


def check_colour(colour) -> tuple[int, int, int, int]:
    values = (*colour, 255)[:4] if len(colour) < 4 else tuple(colour)
    require(len(values) == 4 and all(isinstance(v, int) and 0 <= v <= 255 for v in values), "Colours are integers from 0 to 255.")
    return values


def create_images(spark: SparkSession, width: int, height: int, colour=(0, 0, 0, 0), ids: DataFrame | None = None) -> DataFrame:
    """P-form images of one colour: one with id 0, or one for each image_id of ``ids``."""
    positive_int(width, "width"), positive_int(height, "height")
    require(width * height < 2**53, "width * height is too large.")
    r, g, b, a = check_colour(colour)
    # rows of the images first, dealt out, then their columns: no task makes a large image alone
    if ids is None:
        rows = spark.range(height).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("y"))
    else:
        rows = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id", "y")
    return rows.select(
        "image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), "y",
        *[F.lit(v).alias(c) for c, v in zip("rgba", (r, g, b, a), strict=True)],
    )


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 as 8x8 images."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding")
    p = rows.select("image_id", "embedding", F.posexplode("embedding").alias("k", "v"))
    value = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((c.cast("double") + F.lit(0.6)) * F.lit(212.0)))).cast("int")
    alpha = F.when((F.col("image_id") + F.col("k")) % 5 == 0, 128).when((F.col("image_id") + F.col("k")) % 11 == 0, 0).otherwise(255)
    return p.select(
        "image_id", F.lit(8).alias("width"), F.lit(8).alias("height"),
        (F.col("k") % 8).cast("int").alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"),
        value(F.col("v")).alias("r"), value(F.element_at("embedding", F.lit(64) - F.col("k"))).alias("g"),
        ((F.col("image_id") * 31 + F.col("k") * 17) % 256).cast("int").alias("b"), alpha.cast("int").alias("a"),
    )


def lineitem_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as images 20 wide, one for each supplier."""
    columns = ["l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(columns)
    own = Window.partitionBy("l_suppkey")
    k = F.row_number().over(own.orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice")) - 1
    p = rows.withColumn("k", k).withColumn("height", F.floor(F.count("*").over(own) / 20).cast("int")).where("k < height * 20")
    return p.select(
        F.col("l_suppkey").cast("long").alias("image_id"), F.lit(20).alias("width"), "height",
        (F.col("k") % 20).cast("int").alias("x"), F.floor(F.col("k") / 20).cast("int").alias("y"),
        (F.floor("l_extendedprice") % 256).cast("int").alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"),
        (F.floor("l_quantity") * 5).cast("int").alias("b"), F.when(F.col("l_returnflag") == "R", 128).otherwise(255).alias("a"),
    )


# P <-> I -------------------------------------------------------------------------------


def packed(cells: Column) -> Column:
    """BINARY of an array of struct(y, x, v) in row-major order, v = r << 24 | g << 16 | b << 8 | a."""
    return F.unhex(F.array_join(F.transform(F.array_sort(cells), lambda p: F.lpad(F.hex(p["v"]), 8, "0")), ""))


def pixel_word() -> Column:
    c = lambda n: F.col(n).cast("long")
    return c("r") * 16777216 + c("g") * 65536 + c("b") * 256 + c("a")


def pack_images(pixels: DataFrame) -> DataFrame:
    """P to I; one image's pixels meet in one row, so images are bounded by 2 GB as any BINARY."""
    cells = F.collect_list(F.struct("y", "x", pixel_word().alias("v")))
    return pixels.groupBy("image_id", "width", "height").agg(packed(cells).alias("data"))


def checked_images(images: DataFrame) -> DataFrame:
    """I-form with the length contract enforced on every row."""
    want = F.col("width").cast("long") * F.col("height") * 4
    bad = F.concat(F.lit("The image data have the wrong length: "), F.length("data").cast("string"), F.lit(" bytes instead of "), want.cast("string"), F.lit("."))
    ok = (F.col("width") > 0) & (F.col("height") > 0) & (F.length("data") == want)
    return images.withColumn("data", F.when(ok, F.col("data")).otherwise(F.raise_error(bad).cast("binary")))


def unpack_images(images: DataFrame) -> DataFrame:
    """I to P: numpy cuts the bytes up, some rows of an image at a time; nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, w, h, data in zip(*batch.columns, strict=True):
                w, h = w.as_py(), h.as_py()
                yield from pixel_batches(image_id.as_py(), w, h, (0, 0, w, h), data.as_buffer())

    return checked_images(images).select("image_id", "width", "height", "data").mapInArrow(run, PIXEL_SCHEMA)


def pixel_batches(image_id: int, width: int, height: int, rect: tuple[int, int, int, int], data) -> Iterator[pa.RecordBatch]:
    """Pixel rows of the bytes of one rectangle of an image, about BATCH_PIXELS at a time."""
    left, top, w, h = rect
    rgba = np.frombuffer(data, np.uint8).reshape(h, w, 4)
    step = max(1, BATCH_PIXELS // w)
    for at in range(0, h, step):
        part = rgba[at : at + step].reshape(-1, 4)
        y, x = np.divmod(np.arange(len(part), dtype=np.int32), np.int32(w))
        fixed = [pa.array(np.full(len(part), v, kind)) for v, kind in ((image_id, np.int64), (width, np.int32), (height, np.int32))]
        yield pa.record_batch([*fixed, pa.array(x + np.int32(left)), pa.array(y + np.int32(top + at)), *[pa.array(part[:, c].astype(np.int32)) for c in range(4)]], PIXEL)


# Files -----------------------------------------------------------------------------------


def _rgba(width: int, channels: int, raw: bytes) -> bytes:
    """Rows of B, BGR or BGRA bytes as RGBA."""
    data = np.frombuffer(raw, np.uint8).reshape(-1, channels)
    out = np.full((len(data), 4), 255, np.uint8)
    if channels == 1:
        out[:, :3] = data
    else:
        out[:, :3] = data[:, 2::-1]
        if channels == 4:
            out[:, 3] = data[:, 3]
    return out.tobytes()


def read_images(spark: SparkSession, path: str, keep_broken: bool = False) -> DataFrame:
    """Image files of any format that the JVM decodes, as I-form with ``origin``; image_id is a
    hash of the origin.  A file that can't be decoded is an error, or with ``keep_broken`` a row
    whose width, height and data are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, width, height, channels, raw = batch.columns
            fine = pa.array([w.as_py() > 0 for w in width], pa.bool_())
            data = [_rgba(w.as_py(), c.as_py(), d.as_py()) if f.as_py() else None for w, c, d, f in zip(width, channels, raw, fine, strict=True)]
            sizes = [pc.if_else(fine, x, pa.scalar(None, pa.int32())) for x in (width, height)]
            yield pa.record_batch([origin, *sizes, pa.array(data, pa.binary())], ["origin", "width", "height", "data"])

    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    if not keep_broken:
        message = F.concat(F.lit("This file is no image that can be decoded: "), "origin")
        raw = raw.withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(F.raise_error(message).cast("int")))
    rows = raw.mapInArrow(run, "origin string, width int, height int, data binary")
    return rows.select(F.xxhash64("origin").alias("image_id"), "width", "height", "data", "origin")


def encode_png(width: int, height: int, data: bytes) -> bytes:
    """RGBA bytes as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + data[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def encode_images(images: DataFrame, format: str = "png", quality: float = 0.92, background: tuple[int, int, int] = (255, 255, 255), keep: tuple[str, ...] = ()) -> DataFrame:
    """I-form with ``blob`` (the encoded file) in place of data, and the columns ``keep``.  PNG and
    JPEG are built in (JPEG over ``background``); other formats need a codec that is not there."""
    require(format in ("png", "jpeg"), f"No encoder for {format} is available.")
    encode = encode_png if format == "png" else lambda w, h, d: encode_jpeg(w, h, d, quality, background)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, width, height, data, *rest = batch.columns
            blobs = [encode(w.as_py(), h.as_py(), d.as_py()) for w, h, d in zip(width, height, data, strict=True)]
            yield pa.record_batch([ids, width, height, pa.array(blobs, pa.binary()), *rest], ["image_id", "width", "height", "blob", *keep])

    rows = checked_images(images).select("image_id", "width", "height", "data", *keep)
    extra = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"image_id long, width int, height int, blob binary{extra}")


def optimize_images(images: DataFrame) -> DataFrame:
    """(image_id, blob, input_bytes, output_bytes, kept_original): re-encoded unless the original
    file (``blob``, may be empty) is at most as large."""
    fresh = encode_images(images).select("image_id", F.col("blob").alias("fresh"))
    rows = images.select("image_id", F.col("blob").alias("old")).join(fresh, "image_id")
    keep = (F.length("old") > 0) & (F.length("old") <= F.length("fresh"))
    blob = F.when(keep, F.col("old")).otherwise(F.col("fresh"))
    return rows.select("image_id", blob.alias("blob"), F.length("old").cast("long").alias("input_bytes"), F.length(blob).cast("long").alias("output_bytes"), keep.alias("kept_original"))
