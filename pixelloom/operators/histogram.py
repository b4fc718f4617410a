"""Histograms and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import jround, luma

CHANNELS = ["r", "g", "b", "luma"]


def histogram(pixels: DataFrame) -> DataFrame:
    """Sparse long form (image_id, channel, bucket, cnt); alpha does not count."""
    level = luma(F.col("r"), F.col("g"), F.col("b"))
    pairs = F.array(*[F.struct(F.lit(n).alias("channel"), c.alias("bucket")) for n, c in zip(CHANNELS, [F.col("r"), F.col("g"), F.col("b"), level], strict=True)])
    rows = pixels.select("image_id", F.explode(pairs).alias("p")).select("image_id", "p.channel", "p.bucket")
    return rows.groupBy("image_id", "channel", "bucket").agg(F.count("*").alias("cnt"))


def dense(counts: DataFrame) -> DataFrame:
    """All 256 buckets of every image and channel."""
    wide = counts.groupBy("image_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("m"))  # 256 entries at most
    rows = wide.select("image_id", "channel", "m", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bucket"))
    return rows.select("image_id", "channel", "bucket", F.coalesce(F.try_element_at("m", F.col("bucket")), F.lit(0)).cast("long").alias("cnt"))


def stats(pixels: DataFrame) -> DataFrame:
    """(image_id, pixel_count, mean_luma, range_low, range_high).

    low and high are the last buckets whose cumulative count is still below 2 % and 98 % of
    the pixels; 0 and 255 where there is none.  Only luma buckets are counted: one shuffle of
    at most 256 rows an image and task, then a window over them.
    """
    level = luma(F.col("r"), F.col("g"), F.col("b"))
    counts = pixels.select("image_id", level.alias("bucket")).groupBy("image_id", "bucket").agg(F.count("*").alias("cnt"))
    one = Window.partitionBy("image_id")
    rows = counts.withColumns({
        "cum": F.sum("cnt").over(one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.lead("bucket").over(one.orderBy("bucket")),
        "first": F.min("bucket").over(one),
        "n": F.sum("cnt").over(one),
    })
    goal = lambda share: F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.lit(share) + F.lit(0.5)))
    # the cumulative count stays the same up to the bucket before the next one that is filled
    upto = F.coalesce(F.col("next") - 1, F.lit(255))
    last = lambda share: F.max(F.when(F.col("cum") < goal(share), upto))
    out = rows.groupBy("image_id").agg(
        F.sum("cnt").alias("pixel_count"), F.sum(F.col("bucket") * F.col("cnt")).alias("total"), F.min("first").alias("first"), last(0.02).alias("low"), last(0.98).alias("high")
    )
    # buckets before the first filled one have the cumulative count 0
    before = F.when(F.col("first") > 0, F.col("first") - 1)
    return out.select(
        "image_id", "pixel_count", (F.col("total") / F.col("pixel_count")).alias("mean_luma"),
        F.coalesce("low", before, F.lit(0)).cast("int").alias("range_low"), F.coalesce("high", before, F.lit(255)).cast("int").alias("range_high"),
    )


def suggestion(low: Column, high: Column) -> tuple[Column, Column]:
    """(brightness, contrast) for a luma range."""
    width, middle = high - low, (low + high) / F.lit(2.0)
    brightness = jround((F.lit(128.0) - middle) / F.lit(127.0) * F.lit(50.0))
    contrast = F.greatest(F.lit(-50), F.least(F.lit(50), jround((F.lit(200.0) - width) / F.lit(200.0) * F.lit(40.0))))
    return F.when(width <= 0, F.lit(0)).otherwise(brightness), F.when(width <= 0, F.lit(0)).otherwise(contrast)


def auto_adjust(pixels: DataFrame) -> DataFrame:
    """(image_id, brightness, contrast) suggested for every image."""
    brightness, contrast = suggestion(F.col("range_low"), F.col("range_high"))
    return stats(pixels).select("image_id", brightness.alias("brightness"), contrast.alias("contrast"))


def apply_auto_adjust(pixels: DataFrame) -> DataFrame:
    """Every image adjusted by its own suggestion; the tone curve is evaluated by expression,
    as each image has another one."""
    found = auto_adjust(pixels)
    rows = pixels.join(found, "image_id")
    shift = jround(F.col("brightness") / F.lit(100.0) * F.lit(127.0))
    rate = F.col("contrast") / F.lit(100.0)
    gain = F.when(F.col("contrast") > 0, F.lit(1.0) + rate * 2).otherwise(F.lit(1.0) + rate)
    tone = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), jround(((F.col(c) / F.lit(255.0) - F.lit(0.5)) * gain + F.lit(0.5) + shift / F.lit(255.0)) * F.lit(255.0))))
    return rows.select("image_id", "width", "height", "x", "y", *[tone(c).alias(c) for c in "rgb"], "a")
