"""3x3 filters as windows over rows and columns of a tile, with replicated edges.

Pixels are dealt out by (image, tile) once, those at a tile's border to the neighbours too;
both windows are satisfied by that, so only local sorts follow, and an image of any size is
many tasks.  The results are the same for every tile size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions.exprs import clamp_u8
from ..sources.images import PIXEL
from . import point

#: (detail weight in eighths) of the two enhancing filters.
GAIN = {"smoothEnhance": 3, "unsharpMask": 5}
STENCILS = ("sharpen3x3", "boxBlur3x3", "smoothEnhance", "unsharpMask")
TILE = 512


def _neighbours(c: str, w) -> tuple[Column, Column]:
    return F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))


def _stencil(pixels: DataFrame, name: str, keys: list[str], keep: list[str]) -> DataFrame:
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    rows = pixels
    if name == "sharpen3x3":
        sides = {c: _neighbours(c, across) for c in "rgb"}
        rows = rows.select(*keep, *[(5 * F.col(c) - l - r).alias(f"_{c}") for c, (l, r) in sides.items()])
        ends = {c: _neighbours(c, down) for c in "rgb"}
        return rows.select(*[k for k in keep if k not in "rgb"], *[clamp_u8(F.col(f"_{c}") - u - d).alias(c) for c, (u, d) in ends.items()])
    middle = 1 if name == "boxBlur3x3" else 2
    sides = {c: _neighbours(c, across) for c in "rgb"}
    rows = rows.select(*keep, *[(l + middle * F.col(c) + r).alias(f"_{c}") for c, (l, r) in sides.items()])
    ends = {c: _neighbours(f"_{c}", down) for c in "rgb"}
    total = {c: u + middle * F.col(f"_{c}") + d for c, (u, d) in ends.items()}
    if name == "boxBlur3x3":
        out = {c: F.shiftright(t * 57 + 256, 9) for c, t in total.items()}
    else:
        out = {c: clamp_u8(F.col(c) + F.shiftright((F.col(c) - F.shiftright(t, 4)) * GAIN[name], 3)) for c, t in total.items()}
    return rows.select(*[k for k in keep if k not in "rgb"], *[v.alias(c) for c, v in out.items()])


def own_tile(tile: int) -> Column:
    """Whether a pixel lies in the tile (tx, ty) itself, not only in its halo."""
    return (F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty"))


def deal(pixels: DataFrame, tile: int = TILE, halo: int = 1) -> DataFrame:
    """Pixels with (tx, ty), once for each tile whose halo they are in, dealt out by (image, tile)."""
    require(tile > halo, "A tile must be larger than its overlap.")
    index = lambda c: F.floor(c / tile).cast("int")
    near = lambda c, size: F.sequence(index(F.greatest(F.lit(0), F.col(c) - halo)), index(F.least(F.col(size) - 1, F.col(c) + halo)))
    rows = pixels.withColumn("tx", F.explode(near("x", "width"))).withColumn("ty", F.explode(near("y", "height")))
    return rows.repartition("image_id", "tx", "ty")


def stencil(pixels: DataFrame, name: str, tile: int = TILE) -> DataFrame:
    """One 3x3 filter; only a tile's own pixels are kept."""
    require(name in STENCILS, f"Unknown filter: {name}.")
    done = _stencil(deal(pixels, tile), name, ["image_id", "tx", "ty"], [*PIXEL, "tx", "ty"])
    return done.where(own_tile(tile)).select(PIXEL)


def apply_filter(pixels: DataFrame, name: str = "smoothEnhance") -> DataFrame:
    """Any of the seven filters by name."""
    simple = {"identity": point.identity, "invert": point.invert, "grayscale": point.grayscale}
    if name in simple:
        return simple[name](pixels)
    return stencil(pixels, name)


def apply_filters(pixels: DataFrame, names: list[str]) -> DataFrame:
    """Filters one after the other; every step ends in bytes."""
    require(len(names) > 0, "A pipeline needs at least one step.")
    for name in names:
        pixels = apply_filter(pixels, name)
    return pixels
