"""Cropping and resampling.

A pixel knows by arithmetic which output columns and rows it counts in, so resampling expands
pixels in place.  Nearest moves nothing; bilinear moves pixels by (image, row) and the rows that
it made by (image, column), before they are expanded, so an image of any size is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import natural, positive_int, require
from ..functions.exprs import jround
from ..sources.images import PIXEL

#: Up to so many rows a mask's tap table is broadcast.
BROADCAST_TAPS = 1_000_000


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Half-open rectangle with its origin moved to 0; it must lie within every image.

    Of an image that it does not lie in, the first pixel is kept to raise the error.
    """
    natural(x, "x"), natural(y, "y"), positive_int(width, "width"), positive_int(height, "height")
    inside = (F.col("width") >= x + width) & (F.col("height") >= y + height)
    message = F.lit("The crop rectangle is outside image bounds.")
    own = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    rows = pixels.where(F.when(inside, own).otherwise((F.col("x") == 0) & (F.col("y") == 0)))
    return rows.select(
        "image_id", F.when(inside, F.lit(width)).otherwise(F.raise_error(message).cast("int")).alias("width"), F.lit(height).alias("height"),
        (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "r", "g", "b", "a",
    )


def clamp_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """A rectangle cut to [0, width) x [0, height); sizes do not go below 0."""
    zero = F.lit(0)
    left, top = F.greatest(zero, x), F.greatest(zero, y)
    return {
        "x": left, "y": top,
        "width": F.greatest(zero, F.least(width, x + w) - left), "height": F.greatest(zero, F.least(height, y + h) - top),
    }


def has_transparency(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.min("a") < 255).alias("has_alpha"))


def _weighted(rows: DataFrame, axis: str, place: str, size: int) -> DataFrame:
    """Every pixel once for each output place o that it counts in, with w 256ths."""
    n, s = F.col(axis), F.col(place)
    scale = n.cast("double") / F.lit(float(size))
    half = F.lit(0.5)
    # a range that surely holds the places whose taps are s; the exact taps decide below
    low = F.greatest(F.lit(0), F.floor((s - half) / scale - half).cast("int") - 1)
    high = F.least(F.lit(size - 1), F.ceil((s + F.lit(1.5)) / scale - half).cast("int") + 1)
    rows = rows.withColumn("o", F.explode(F.sequence(low, high)))
    at = F.greatest(F.lit(0.0), (F.col("o") + half) * scale - half)
    rows = rows.withColumn("at", at).withColumn("tap", F.least(n - 1, F.floor("at").cast("int")))
    rows = rows.withColumn("f", F.floor((F.col("at") - F.col("tap")) * F.lit(256.0)).cast("int"))
    first, second = F.col("tap") == s, F.least(n - 1, F.col("tap") + 1) == s
    w = F.when(first, 256 - F.col("f")).otherwise(0) + F.when(second, F.col("f")).otherwise(0)
    return rows.where(first | second).withColumn("w", w).drop("at", "tap", "f")


def resize_bilinear(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """8-bit bilinear: horizontal pass, rounded to bytes, then vertical pass, rounded again."""
    positive_int(width, "width"), positive_int(height, "height")
    mean = lambda c: F.shiftright(F.sum(F.col(c) * F.col("w")) + 128, 8).cast("int").alias(c)
    rows = _weighted(pixels.repartition("image_id", "y"), "width", "x", width)
    rows = rows.groupBy("image_id", "height", "y", "o").agg(*[mean(c) for c in "rgba"]).withColumnRenamed("o", "x")
    rows = _weighted(rows.repartition("image_id", "x"), "height", "y", height)
    rows = rows.groupBy("image_id", "x", "o").agg(*[mean(c) for c in "rgba"])
    return rows.select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), "x", F.col("o").alias("y"), *"rgba")


def resize_nearest(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Every output place takes one source pixel: place s goes to ceil(s * out / in) and on, up to
    where the next one starts."""
    positive_int(width, "width"), positive_int(height, "height")
    rows = pixels
    for axis, place, size in (("width", "x", width), ("height", "y", height)):
        start = lambda s, n=F.col(axis), size=size: F.ceil(s.cast("long") * size / n).cast("int")
        begin, end = start(F.col(place)), start(F.col(place) + 1)
        rows = rows.where(end > begin).withColumn(place, F.explode(F.sequence(begin, end - 1)))
    return rows.withColumns({"width": F.lit(width), "height": F.lit(height)}).select(PIXEL)


def resize(pixels: DataFrame, width: int, height: int, method: str = "bilinear") -> DataFrame:
    require(method in ("nearest", "bilinear"), f"Unknown resize method: {method}.")
    return (resize_nearest if method == "nearest" else resize_bilinear)(pixels, width, height)


def resize_mask(masks: DataFrame, in_w: int, in_h: int, width: int, height: int) -> DataFrame:
    """(image_id, x, y, m) masks of one size by bilinear weights in doubles, rounded once."""
    positive_int(in_w, "width"), positive_int(in_h, "height"), positive_int(width, "width"), positive_int(height, "height")
    if (in_w, in_h) == (width, height):
        return masks.select("image_id", "x", "y", "m")

    def taps(n: int, size: int, name: str) -> DataFrame:
        o = masks.sparkSession.range(size).select(F.col("id").cast("int").alias(f"o{name}"))
        at = F.greatest(F.lit(0.0), (F.col(f"o{name}") + F.lit(0.5)) * F.lit(n / size) - F.lit(0.5))
        low = F.least(F.lit(n - 1), F.floor(at).cast("int"))
        o = o.select(f"o{name}", low.alias("low"), (at - low).alias(f"f{name}"))
        sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("s")), F.struct(F.lit(1).alias("side"), F.least(F.lit(n - 1), F.col("low") + 1).alias("s"))))
        o = o.select(f"o{name}", f"f{name}", sides.alias("t"))
        return o.select(f"o{name}", f"f{name}", F.col("t.side").alias(f"side{name}"), F.col("t.s").alias(name))

    small = lambda t, size: F.broadcast(t) if 2 * size <= BROADCAST_TAPS else t
    rows = masks.join(small(taps(in_w, width, "x"), width), "x").join(small(taps(in_h, height, "y"), height), "y")
    pick = lambda sy, sx: F.max(F.when((F.col("sidey") == sy) & (F.col("sidex") == sx), F.col("m"))).cast("double")
    four = rows.groupBy("image_id", "ox", "oy", "fx", "fy").agg(pick(0, 0).alias("p"), pick(0, 1).alias("q"), pick(1, 0).alias("s"), pick(1, 1).alias("t"))
    lerp = lambda a, b, f: a + (b - a) * f
    top, bottom = lerp(F.col("p"), F.col("q"), F.col("fx")), lerp(F.col("s"), F.col("t"), F.col("fx"))
    return four.select("image_id", F.col("ox").alias("x"), F.col("oy").alias("y"), jround(lerp(top, bottom, F.col("fy"))).alias("m"))
