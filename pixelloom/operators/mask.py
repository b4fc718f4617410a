"""Alpha masks (image_id, x, y, m): refinement and composition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import jround, smoothstep_u8
from ..functions.metadata import MaskOptions
from ..sources.images import PIXEL
from .arrow import by_tile
from .stencil import TILE, deal

KEY = ["image_id", "x", "y"]


def guided_feather(pixels: DataFrame, masks: DataFrame, radius: int = 2, sensitivity: float = 48) -> DataFrame:
    """Edge-aware mean of partial mask values; 0 and 255 stay.  Neighbours outside do not count.

    Pixels with their masks are dealt out by (image, tile) once, those near a tile's border to the
    neighbours too; in a tile numpy adds the (2 * radius + 1)**2 shifted planes in a fixed order,
    so a rerun gives the same sums to the last bit.
    """
    if radius <= 0:
        return masks.select(*KEY, "m")
    square = float(sensitivity) ** 2

    def kernel(columns: dict[str, np.ndarray], tile: tuple[int, int]) -> dict[str, np.ndarray]:
        x, y = columns["x"], columns["y"]
        left, top = x.min() - radius, y.min() - radius
        place = (y - top, x - left)
        shape = (y.max() - top + radius + 1, x.max() - left + radius + 1)
        planes = np.zeros((4, *shape))
        for plane, c in zip(planes, "rgbm", strict=True):
            plane[place] = columns[c]
        there = np.zeros(shape, bool)
        there[place] = True
        own = (x // TILE == tile[0]) & (y // TILE == tile[1])
        m = columns["m"].copy()
        todo = np.flatnonzero(own & (m > 0) & (m < 255))
        row, col = place[0][todo], place[1][todo]
        centre = planes[:3, row, col]
        total, weights = np.zeros(len(todo)), np.zeros(len(todo))
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                near = planes[:, row + dy, col + dx]
                colour = ((near[:3] - centre) ** 2).sum(axis=0)
                weight = (1 / (1 + colour / square)) * (1 / (1 + float(dx * dx + dy * dy))) * there[row + dy, col + dx]
                total += near[3] * weight
                weights += weight
        m[todo] = np.floor(total / np.maximum(weights, 1) + 0.5)
        return {"image_id": columns["image_id"][own], "x": x[own], "y": y[own], "m": m[own]}

    rows = pixels.select(*KEY, "width", "height", "r", "g", "b").join(masks.select(*KEY, "m"), KEY)
    dealt = deal(rows, TILE, radius).select(*KEY, "tx", "ty", "r", "g", "b", F.col("m").cast("int").alias("m"))
    return by_tile(dealt, kernel, "image_id long, x int, y int, m int")


def smoothstep_mask(masks: DataFrame, options: MaskOptions) -> DataFrame:
    return masks.select(*KEY, smoothstep_u8(F.col("m"), options.threshold, options.upper).alias("m"))


def feather_mask(pixels: DataFrame, masks: DataFrame, options: MaskOptions = MaskOptions()) -> DataFrame:  # noqa: B008
    """Refined masks of the images' size."""
    return smoothstep_mask(guided_feather(pixels, masks, options.radius, options.edge_sensitivity), options)


def multiply_alpha(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """alpha * mask / 255, rounded, by pixel."""
    out = pixels.join(masks.select(*KEY, "m"), KEY)
    return out.withColumn("a", jround(F.col("a") * F.col("m") / F.lit(255.0))).select(PIXEL)


def apply_mask(pixels: DataFrame, masks: DataFrame, options: MaskOptions = MaskOptions()) -> DataFrame:  # noqa: B008
    return multiply_alpha(pixels, feather_mask(pixels, masks, options))


def mask_counts(pixels: DataFrame) -> DataFrame:
    """removed: alpha under 250, partial values among them; partial: neither 0 nor 255."""
    removed, partial = F.col("a") < 250, (F.col("a") > 0) & (F.col("a") < 255)
    return pixels.groupBy("image_id").agg(F.count_if(removed).alias("removed_pixels"), F.count_if(partial).alias("partial_pixels"))
