"""Per-pixel projections.  Alpha passes through unless said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import check_adjust, clamp_u8, colour_matrix, jround, lookup, luma, tone_tables
from ..sources.images import PIXEL


def identity(pixels: DataFrame) -> DataFrame:
    return pixels.select(PIXEL)


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: 255 - F.col(c) for c in "rgb"})


def grayscale(pixels: DataFrame) -> DataFrame:
    level = luma(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumns({c: level for c in "rgb"})


def fill_transparent(pixels: DataFrame, colour: tuple[int, int, int]) -> DataFrame:
    """Flatten onto a colour; the result is opaque.  Colours out of range wrap."""
    alpha = F.col("a") / F.lit(255.0)
    out = {c: jround(F.col(c) * alpha + F.lit(float(v)) * (F.lit(1.0) - alpha)) for c, v in zip("rgb", colour, strict=False)}
    if any(not 0 <= v <= 255 for v in colour[:3]):
        out = {c: F.pmod(v, F.lit(256)).cast("int") for c, v in out.items()}
    return pixels.withColumns({**out, "a": F.lit(255)})


def adjust(pixels: DataFrame, brightness=0, contrast=0, saturation=0, temperature=0, hue=0, gamma=1) -> DataFrame:
    """Colour matrix (only with hue or saturation), then one table for each channel."""
    check_adjust(brightness, contrast, saturation, temperature, hue, gamma)
    if not any((brightness, contrast, saturation, temperature, hue)) and gamma == 1:
        return pixels
    channels = {c: F.col(c) for c in "rgb"}
    if hue or saturation:
        m = colour_matrix(hue, saturation)
        dot = lambda row: F.col("r") * row[0] + F.col("g") * row[1] + F.col("b") * row[2]
        channels = {c: clamp_u8(F.shiftright(dot(row), 8)) for c, row in zip("rgb", m, strict=True)}
        if not any((brightness, contrast, temperature)) and gamma == 1:
            return pixels.withColumns(channels)
    tables = tone_tables(brightness, contrast, temperature, gamma)
    return pixels.withColumns({c: lookup(t, channels[c]) for c, t in zip("rgb", tables, strict=True)})
