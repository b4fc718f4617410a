"""Tile, memory and asset plans, and images as tiles (T-form)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import natural, positive_int, require
from ..functions.metadata import filter_overlap, normalize_format_name
from ..sources.images import PIXEL, PIXEL_SCHEMA, packed, pixel_batches, pixel_word

# Filters of a goal, and its quality.
GOALS = {"archive": [], "preview": ["smoothEnhance"], "delivery": ["smoothEnhance"], "transparent-cutout": ["unsharpMask"]}
QUALITY = {"archive": 0.98, "transparent-cutout": 0.95, "preview": 0.84, "delivery": 0.92}
# Bounds of a tile's side, and the memory of an asset plan.
MIN_TILE, MAX_TILE, WORKER_BYTES = 256, 4096, 32 * 1024 * 1024


def check_tiles(tile: int, overlap: int) -> None:
    positive_int(tile, "tileSize"), natural(overlap, "overlap")
    require(overlap < tile, "A tile must be larger than its overlap.")


def plan_tiles(images: DataFrame, tile: int = 512, overlap: int = 1) -> DataFrame:
    """Tiles of (image_id, width, height), row by row: (image_id, tile_index, in_x .. in_h, out_x .. out_h)."""
    check_tiles(tile, overlap)
    rows = images.select("image_id", "width", "height")
    rows = rows.withColumn("out_y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(tile))))
    rows = rows.withColumn("out_x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(tile))))
    rows = rows.withColumns({"out_w": F.least(F.lit(tile), F.col("width") - F.col("out_x")), "out_h": F.least(F.lit(tile), F.col("height") - F.col("out_y"))})
    rows = rows.withColumns({"in_x": F.greatest(F.lit(0), F.col("out_x") - overlap), "in_y": F.greatest(F.lit(0), F.col("out_y") - overlap)})
    across = F.floor((F.col("width") + tile - 1) / tile)
    return rows.select(
        "image_id", (F.floor(F.col("out_y") / tile) * across + F.floor(F.col("out_x") / tile)).cast("int").alias("tile_index"), "in_x", "in_y",
        (F.least("width", F.col("out_x") + F.col("out_w") + overlap) - F.col("in_x")).alias("in_w"),
        (F.least("height", F.col("out_y") + F.col("out_h") + overlap) - F.col("in_y")).alias("in_h"),
        "out_x", "out_y", "out_w", "out_h",
    )


def rect_bytes(w: Column, h: Column, channels: int = 4) -> Column:
    return w.cast("long") * h.cast("long") * positive_int(channels, "channels")


def scratch_bytes(tile: Column, overlap: Column) -> Column:
    wide = (tile + 2 * overlap).cast("long")
    return (wide * wide + tile.cast("long") * tile.cast("long")) * 4


def scratch_bytes_of(tile: int, overlap: int) -> int:
    positive_int(tile, "tileSize"), natural(overlap, "overlap")
    return ((tile + 2 * overlap) ** 2 + tile**2) * 4


def choose_tile_size(max_bytes: float, overlap: int, least: int = MIN_TILE, most: int = MAX_TILE) -> int:
    """The largest halving of ``most`` whose scratch memory fits, but not under ``least``."""
    require(max_bytes > 0 and max_bytes != float("inf"), "maxBytes must be positive.")
    positive_int(least, "minTileSize"), positive_int(most, "maxTileSize")
    require(least <= most, "minTileSize must not be larger than maxTileSize.")
    tile = most
    while scratch_bytes_of(tile, overlap) > max_bytes and tile > least:
        tile = max(tile // 2, least)
    require(scratch_bytes_of(tile, overlap) <= max_bytes, "The memory budget does not fit the smallest tile.")
    return tile


def choose_tile_size_column(max_bytes: Column, overlap: Column, least: int = MIN_TILE, most: int = MAX_TILE) -> Column:
    """The same for a budget in each row; null where even the smallest tile does not fit."""
    sizes, size = [], most
    while size > least:
        sizes.append(size)
        size = max(size // 2, least)
    fitting = F.lit(None).cast("int")
    for s in sorted([*sizes, least]):
        fitting = F.when(scratch_bytes(F.lit(s), overlap) <= max_bytes, F.lit(s)).otherwise(fitting)
    return fitting


def tile_count(width: Column, height: Column, tile: int) -> Column:
    along = lambda n: F.ceil(n.cast("long") / tile)
    return along(width) * along(height)


def peak_tile_bytes(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """Bytes of the largest tile's input and output, without planning any tile.

    Along one side the second of three or more tiles has the longest input, as it has an overlap
    on both ends and is whole; of one or two tiles the first has.
    """

    def along(n: Column) -> tuple[Column, Column]:
        most = F.least(n - tile + overlap, F.lit(tile + 2 * overlap))
        return F.when(n > 2 * tile, most).otherwise(F.least(n, F.lit(tile + overlap))), F.least(n, F.lit(tile))

    (in_w, out_w), (in_h, out_h) = along(width), along(height)
    return rect_bytes(in_w, in_h) + rect_bytes(out_w, out_h)


def processing_plan(images: DataFrame, tile: int = 512, overlap: int = 1, filter: str = "sharpen3x3", lanes: int = 1) -> DataFrame:
    """Tiling and memory figures of every image (image_id, width, height): a projection.

    As a plan only, it takes an overlap that is too small for the filter; fewer than one lane
    count as one.
    """
    check_tiles(tile, overlap), filter_overlap(filter)
    lanes, width, height = max(1, lanes), F.col("width"), F.col("height")
    full, peak = rect_bytes(width, height), peak_tile_bytes(width, height, tile, overlap)
    return images.select(
        "image_id", "width", "height", (width.cast("long") * height).alias("pixels"), F.lit(filter).alias("filter"), F.lit(tile).alias("tile_size"), F.lit(overlap).alias("overlap"),
        tile_count(width, height, tile).alias("tile_count"), full.alias("full_frame_bytes"), peak.alias("peak_tile_bytes"), (peak * lanes).alias("active_bytes"),
        (full / (peak * lanes)).alias("memory_reduction_ratio"),
    )


def asset_plan(pixels: DataFrame, goal: str = "delivery", worker_bytes: int = WORKER_BYTES, preferred: str | None = None, filters: list[str] | None = None) -> DataFrame:
    """A recipe for every image: format, quality, filters, and its processing plan.  Pixels are
    read once, for whether an image has alpha; all else follows from its size."""
    require(goal in GOALS, f"Unknown goal: {goal}.")
    names = GOALS[goal] if filters is None else filters
    overlap = max([filter_overlap(n) for n in names], default=0)
    tile = choose_tile_size(worker_bytes, overlap)
    images = pixels.groupBy("image_id", "width", "height").agg((F.min("a") < 255).alias("has_alpha"))
    width, height = F.col("width"), F.col("height")
    full, peak = rect_bytes(width, height), peak_tile_bytes(width, height, tile, overlap)
    if preferred:
        preferred = normalize_format_name(preferred)
    fmt = F.lit(preferred) if preferred else {"archive": F.lit("png"), "transparent-cutout": F.lit("webp"), "preview": F.lit("webp"), "delivery": F.when(F.col("has_alpha"), "webp").otherwise("jpeg")}[goal]
    out = images.withColumn("format", fmt)
    quality = F.when(~F.col("format").isin("png", "bmp", "gif"), F.lit(QUALITY[goal]))
    return out.select(
        "image_id", F.lit(goal).alias("goal"), "width", "height", (width.cast("long") * height).alias("pixels"), full.alias("rgba_bytes"), "has_alpha",
        "format", quality.alias("quality"), F.lit(",".join(names)).alias("filters"), F.lit(overlap).alias("overlap"), F.lit(tile).alias("tile_size"),
        tile_count(width, height, tile).alias("tile_count"), peak.alias("peak_tile_bytes"), (full / peak).alias("memory_reduction_ratio"),
    )


# T-form ------------------------------------------------------------------------------------


def halo_read(pixels: DataFrame, tile: int = 512, overlap: int = 1) -> DataFrame:
    """Every pixel once for each tile whose input it lies in: (tile_index, own) and the pixel.

    The tiles follow from the pixel by arithmetic, so this range join is a narrow expansion.
    """
    check_tiles(tile, overlap)
    span = lambda c, size: F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - overlap) / tile).cast("int"), F.floor(F.least(F.col(size) - 1, F.col(c) + overlap) / tile).cast("int"))
    rows = pixels.withColumn("tx", F.explode(span("x", "width"))).withColumn("ty", F.explode(span("y", "height")))
    across = F.floor((F.col("width") + tile - 1) / tile)
    own = (F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty"))
    return rows.select(*PIXEL, (F.col("ty") * across + F.col("tx")).cast("int").alias("tile_index"), own.alias("own"))


def to_tiles(pixels: DataFrame, tile: int = 512, overlap: int = 1) -> DataFrame:
    """P to T: (image_id, width, height, tile_index, in_rect, out_rect, rgba)."""
    cells = F.collect_list(F.struct("y", "x", pixel_word().alias("v")))
    got = halo_read(pixels, tile, overlap).groupBy("image_id", "width", "height", "tile_index").agg(packed(cells).alias("rgba"))
    across = F.floor((F.col("width") + tile - 1) / tile)
    got = got.withColumns({"ox": ((F.col("tile_index") % across) * tile).cast("int"), "oy": (F.floor(F.col("tile_index") / across) * tile).cast("int")})
    ow, oh = F.least(F.lit(tile), F.col("width") - F.col("ox")), F.least(F.lit(tile), F.col("height") - F.col("oy"))
    ix, iy = F.greatest(F.lit(0), F.col("ox") - overlap), F.greatest(F.lit(0), F.col("oy") - overlap)
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    return got.select(
        "image_id", "width", "height", "tile_index",
        rect(ix, iy, F.least("width", F.col("ox") + ow + overlap) - ix, F.least("height", F.col("oy") + oh + overlap) - iy).alias("in_rect"),
        rect(F.col("ox"), F.col("oy"), ow, oh).alias("out_rect"), "rgba",
    )


def from_tiles(tiles: DataFrame) -> DataFrame:
    """T with output-sized bytes back to P."""
    w, h = F.col("out_rect.width"), F.col("out_rect.height")
    want = w.cast("long") * h * 4
    data = F.when(F.length("rgba") == want, F.col("rgba")).otherwise(F.raise_error(F.lit("A tile's data have the wrong length.")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, width, height, rect, rgba in zip(*batch.columns, strict=True):
                place = rect.as_py()
                yield from pixel_batches(image_id.as_py(), width.as_py(), height.as_py(), tuple(place[k] for k in ("x", "y", "width", "height")), rgba.as_buffer())

    return tiles.select("image_id", "width", "height", "out_rect", data.alias("rgba")).mapInArrow(run, PIXEL_SCHEMA)


def progress(images: DataFrame, tile: int = 512, overlap: int = 1) -> DataFrame:
    """(image_id, tile_index, percent) as a pass in tile order reports it."""
    tiles = plan_tiles(images, tile, overlap)
    total = tiles.groupBy("image_id").agg(F.count("*").alias("n"))
    return tiles.join(total, "image_id").select("image_id", "tile_index", ((F.col("tile_index") + 1) * 100.0 / F.col("n")).alias("percent"))
