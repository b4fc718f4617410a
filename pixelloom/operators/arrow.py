"""Vectorised tile kernels: the same bytes as the expression path, in numpy over Arrow batches.

A processor is a function (array of the input rectangle, input and output rectangle as
(x, y, w, h)) -> array of the output rectangle.  Which one runs: the one given, else the one
registered for the session, else the built-in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RasterError, require
from ..functions.metadata import filter_overlap
from .tiling import from_tiles, tile_count, to_tiles

Processor = Callable[[np.ndarray, tuple, tuple, str], np.ndarray]
TILE_SCHEMA = (
    "image_id long, width int, height int, tile_index int, in_rect struct<x:int,y:int,width:int,height:int>, "
    "out_rect struct<x:int,y:int,width:int,height:int>, rgba binary"
)


def _edges(v: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours before and after along an axis, edges replicated."""
    n = v.shape[axis]
    at = np.arange(n)
    return np.take(v, np.maximum(at - 1, 0), axis), np.take(v, np.minimum(at + 1, n - 1), axis)


def filter_image(rgba: np.ndarray, name: str) -> np.ndarray:
    """One of the seven filters on a (h, w, 4) array of bytes; edges are the array's."""
    out, c = rgba.copy(), rgba[..., :3].astype(np.int32)
    if name == "invert":
        out[..., :3] = 255 - c
    elif name == "grayscale":
        out[..., :3] = ((c * (77, 150, 29)).sum(-1) >> 8)[..., None]
    elif name == "sharpen3x3":
        (left, right), (up, down) = _edges(c, 1), _edges(c, 0)
        out[..., :3] = np.clip(5 * c - left - right - up - down, 0, 255)
    elif name != "identity":
        middle = 1 if name == "boxBlur3x3" else 2
        left, right = _edges(c, 1)
        row = left + middle * c + right
        up, down = _edges(row, 0)
        total = up + middle * row + down
        if name == "boxBlur3x3":
            out[..., :3] = (total * 57 + 256) >> 9
        else:
            gain = {"smoothEnhance": 3, "unsharpMask": 5}[name]
            out[..., :3] = np.clip(c + (((c - (total >> 4)) * gain) >> 3), 0, 255)
    return out


def builtin(rgba: np.ndarray, in_rect: tuple, out_rect: tuple, name: str) -> np.ndarray:
    x, y = out_rect[0] - in_rect[0], out_rect[1] - in_rect[1]
    return filter_image(rgba, name)[y : y + out_rect[3], x : x + out_rect[2]]


def filter_tile(data: bytes, in_rect: tuple, out_rect: tuple, name: str, processor: Processor | None = None) -> bytes:
    """The output bytes of one tile; lengths are checked on both sides."""
    filter_overlap(name)
    want = in_rect[2] * in_rect[3] * 4
    require(len(data) == want, f"A tile's input has {len(data)} bytes instead of {want}.")
    rgba = np.frombuffer(data, np.uint8).reshape(in_rect[3], in_rect[2], 4)
    out = np.ascontiguousarray((processor or builtin)(rgba, in_rect, out_rect, name), np.uint8).tobytes()
    want = out_rect[2] * out_rect[3] * 4
    require(len(out) == want, f"A processor returned {len(out)} bytes instead of {want}.")
    return out


_REGISTERED: dict[str, Processor] = {}


def register_processor(spark: SparkSession, processor: Processor | None) -> None:
    """The session's processor; None takes it away."""
    key = spark.sparkContext.applicationId
    if processor is None:
        _REGISTERED.pop(key, None)
    else:
        _REGISTERED[key] = processor


def registered_processor(spark: SparkSession) -> Processor | None:
    return _REGISTERED.get(spark.sparkContext.applicationId)


def process_tiles(tiles: DataFrame, name: str, processor: Processor | None = None) -> DataFrame:
    """T-form with output-sized bytes."""
    filter_overlap(name)
    chosen = processor or registered_processor(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corner = lambda r: (r["x"], r["y"], r["width"], r["height"])
        for batch in batches:
            done = [filter_tile(d.as_py(), corner(i.as_py()), corner(o.as_py()), name, chosen) for d, i, o in zip(batch.column("rgba"), batch.column("in_rect"), batch.column("out_rect"), strict=True)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(done, pa.binary())], names=batch.schema.names)

    return tiles.select("image_id", "width", "height", "tile_index", "in_rect", "out_rect", "rgba").mapInArrow(run, TILE_SCHEMA)


def filter_images(images: DataFrame, names: list[str]) -> DataFrame:
    """I-form through filters, a whole image at a time: no shuffle at all."""
    for name in names:
        filter_overlap(name)
    require(len(names) > 0, "A pipeline needs at least one step.")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, d in zip(*batch.columns[1:], strict=True):
                w, h, d = w.as_py(), h.as_py(), d.as_py()
                if len(d) != w * h * 4:
                    raise RasterError(f"The image data have the wrong length: {len(d)} bytes instead of {w * h * 4}.")
                rgba = np.frombuffer(d, np.uint8).reshape(h, w, 4)
                for name in names:
                    rgba = filter_image(rgba, name)
                out.append(rgba.tobytes())
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.binary())], names=["image_id", "width", "height", "data"])

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, width int, height int, data binary")


def process(pixels: DataFrame, name: str = "identity", tile: int = 512, overlap: int = 1, processor: Processor | None = None) -> DataFrame:
    """P-form through tiles: deal out, filter, put together."""
    check_overlap(name, overlap)
    return from_tiles(process_tiles(to_tiles(pixels, tile, overlap), name, processor))


def check_overlap(name: str, overlap: int) -> None:
    need = filter_overlap(name)
    require(overlap >= need, f"The overlap {overlap} is too small: {name} needs {need}.")


def process_stats(pixels: DataFrame, name: str = "identity", tile: int = 512, overlap: int = 1, processor: Processor | None = None) -> DataFrame:
    """(image_id, total_tiles, processed_tiles, output_bytes) of a pass: the tiles that the images'
    sizes ask for, and those that went through the filter, with their output."""
    check_overlap(name, overlap)
    done = process_tiles(to_tiles(pixels, tile, overlap), name, processor)
    sums = done.groupBy("image_id", "width", "height").agg(F.count("*").alias("processed_tiles"), F.sum(F.length("rgba").cast("long")).alias("output_bytes"))
    return sums.select("image_id", tile_count(F.col("width"), F.col("height"), tile).alias("total_tiles"), "processed_tiles", "output_bytes")


def by_tile(rows: DataFrame, kernel: Callable[[dict[str, np.ndarray], tuple[int, int]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """A kernel over the rows of each tile of a table dealt by ``stencil.deal``: it gets the columns
    as arrays in order of (y, x), and the tile's place (tx, ty), and returns the columns of ``schema``.

    One tile with its halo is in memory at a time.
    """
    keys = ["image_id", "tx", "ty"]

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held)
            columns = {n: table.column(n).to_numpy() for n in table.column_names}
            out = kernel(columns, (int(columns["tx"][0]), int(columns["ty"][0])))
            yield pa.record_batch([pa.array(v) for v in out.values()], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(own[:, a].tolist())
                if key != last:
                    yield from flush(held)
                    held, last = [], key
                held.append(batch.slice(a, b - a))
        yield from flush(held)

    return rows.sortWithinPartitions(*keys, "y", "x").mapInArrow(run, schema)
