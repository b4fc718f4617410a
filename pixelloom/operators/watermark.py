"""Watermarks: where the text goes, and a bitmap text blended over the pixels.

Text is drawn with a built-in 5x7 bitmap font in capitals, scaled to the text height; a canvas's
own glyph shapes can't be had here, so the pixels differ from a canvas's, the geometry does not.
Whether a pixel is covered follows from its place by arithmetic, so nothing is joined or moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.exprs import jround
from ..functions.metadata import ANCHORS, anchor_xy, check_watermark, font_height, font_pixels

SPACING = 200
FONT, COLOUR = "bold 48px Arial, sans-serif", (255, 255, 255, 0.6)
#: Cells of a glyph with the gap behind it, and rows.
CELL, ROWS = 6, 7
#: Seven rows of five cells for each character, the leftmost cell in bit 4.
GLYPHS = {
    "A": (14, 17, 17, 31, 17, 17, 17), "B": (30, 17, 17, 30, 17, 17, 30), "C": (14, 17, 16, 16, 16, 17, 14), "D": (28, 18, 17, 17, 17, 18, 28),
    "E": (31, 16, 16, 30, 16, 16, 31), "F": (31, 16, 16, 30, 16, 16, 16), "G": (14, 17, 16, 23, 17, 17, 15), "H": (17, 17, 17, 31, 17, 17, 17),
    "I": (14, 4, 4, 4, 4, 4, 14), "J": (7, 2, 2, 2, 2, 18, 12), "K": (17, 18, 20, 24, 20, 18, 17), "L": (16, 16, 16, 16, 16, 16, 31),
    "M": (17, 27, 21, 21, 17, 17, 17), "N": (17, 25, 21, 19, 17, 17, 17), "O": (14, 17, 17, 17, 17, 17, 14), "P": (30, 17, 17, 30, 16, 16, 16),
    "Q": (14, 17, 17, 17, 21, 18, 13), "R": (30, 17, 17, 30, 20, 18, 17), "S": (15, 16, 16, 14, 1, 1, 30), "T": (31, 4, 4, 4, 4, 4, 4),
    "U": (17, 17, 17, 17, 17, 17, 14), "V": (17, 17, 17, 17, 10, 10, 4), "W": (17, 17, 17, 21, 21, 27, 17), "X": (17, 17, 10, 4, 10, 17, 17),
    "Y": (17, 17, 10, 4, 4, 4, 4), "Z": (31, 1, 2, 4, 8, 16, 31), "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14),
    "2": (14, 17, 1, 6, 8, 16, 31), "3": (31, 2, 4, 2, 1, 17, 14), "4": (2, 6, 10, 18, 31, 2, 2), "5": (31, 16, 30, 1, 1, 17, 14),
    "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8), "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12),
    ".": (0, 0, 0, 0, 0, 12, 12), ",": (0, 0, 0, 0, 12, 4, 8), "-": (0, 0, 0, 31, 0, 0, 0), "_": (0, 0, 0, 0, 0, 0, 31), "+": (0, 4, 4, 31, 4, 4, 0),
    ":": (0, 12, 12, 0, 12, 12, 0), "!": (4, 4, 4, 4, 4, 0, 4), "?": (14, 17, 1, 2, 4, 0, 4), "/": (1, 1, 2, 4, 8, 16, 16), "@": (14, 17, 23, 21, 23, 16, 14),
    "&": (12, 18, 20, 8, 21, 18, 13), "(": (2, 4, 8, 8, 8, 4, 2), ")": (8, 4, 2, 2, 2, 4, 8), "#": (10, 10, 31, 10, 31, 10, 10), "'": (4, 4, 8, 0, 0, 0, 0),
    "\u00a9": (14, 17, 22, 20, 22, 17, 14),
}
#: A character without a glyph is a box.
BOX = (31, 17, 17, 17, 17, 17, 31)


def anchors(images: DataFrame, text_w: int, text_h: int, margin: int = 24) -> DataFrame:
    """(image_id, anchor, x, y) of all nine anchors."""
    rows = images.select("image_id", "width", "height", F.explode(F.array(*[F.lit(a) for a in ANCHORS])).alias("anchor"))
    x, y = anchor_xy(F.col("anchor"), F.col("width"), F.col("height"), F.lit(text_w), F.lit(text_h), F.lit(margin))
    return rows.select("image_id", "anchor", x.alias("x"), y.alias("y"))


def stamp_grid(images: DataFrame, text_w: int, text_h: int, spacing: int = SPACING, rotation: float = 0) -> DataFrame:
    """(image_id, x, y) of repeated stamps: a grid over the diagonal, turned about the middle."""
    require(spacing > 0 and text_w + spacing > 0 and text_h + spacing > 0, "spacing must be positive.")
    diagonal = F.ceil(F.sqrt((F.col("width") * F.col("width") + F.col("height") * F.col("height")).cast("double"))).cast("int")
    rows = images.select("image_id", "width", "height", diagonal.alias("d"))
    rows = rows.withColumn("gx", F.explode(F.sequence(-F.col("d"), F.col("d") - 1, F.lit(text_w + spacing))))
    rows = rows.withColumn("gy", F.explode(F.sequence(-F.col("d"), F.col("d") - 1, F.lit(text_h + spacing))))
    cos, sin = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    x = F.col("width") / 2.0 + F.col("gx") * F.lit(cos) - F.col("gy") * F.lit(sin)
    y = F.col("height") / 2.0 + F.col("gx") * F.lit(sin) + F.col("gy") * F.lit(cos)
    return rows.select("image_id", "gx", "gy", x.alias("x"), y.alias("y"))


def font_heights(fonts: DataFrame) -> DataFrame:
    return fonts.select("font", font_height(F.col("font")).alias("text_height"))


def text_size(text: str, height: int) -> tuple[int, int]:
    """(width of the text, side of a cell) in pixels."""
    scale = max(1, height // ROWS)
    return len(text) * CELL * scale, scale


def glyph_rows(text: str) -> list[int]:
    """The rows of all characters, one character after the other."""
    return [bits for ch in text for bits in ((0,) * ROWS if ch.isspace() else GLYPHS.get(ch.upper(), BOX))]


def covered(u: Column, v: Column, text: str, height: int) -> Column:
    """Whether the place (u, v) from the text's top left corner is drawn on."""
    width, scale = text_size(text, height)
    inside = (u >= 0) & (u < width) & (v >= 0) & (v < ROWS * scale)
    cell, row = F.floor(u / scale).cast("int"), F.floor(v / scale).cast("int")
    bits = F.get(F.array(*[F.lit(b) for b in glyph_rows(text)]), F.floor(cell / CELL).cast("int") * ROWS + row)
    mask = F.get(F.array(*[F.lit(1 << (4 - k) if k < 5 else 0) for k in range(CELL)]), cell % CELL)
    return F.when(inside, bits.bitwiseAND(mask) != 0).otherwise(F.lit(False))


def text_watermark(
    pixels: DataFrame,
    text: str,
    font: str = FONT,
    colour: tuple[int, int, int, float] = COLOUR,
    opacity: float = 1.0,
    position: str = "bottom-right",
    margin: int = 24,
    rotation: float = 0,
    tile_mode: str = "none",
    tile_spacing: int = SPACING,
) -> DataFrame:
    """Pixels with the text blended over them: once at ``position``, or with ``tile_mode="tile"``
    all over the image, turned clockwise by ``rotation`` degrees about its own middle or the image's.

    A pixel's middle is turned back and looked up in the glyphs.
    """
    check_watermark(text, opacity, margin, tile_spacing)
    require(position in ANCHORS, f"Unknown position: {position}.")
    require(tile_mode in ("none", "tile"), f"Unknown tile mode: {tile_mode}.")
    height = font_pixels(font)
    width, scale = text_size(text, height)
    w, h = F.col("width"), F.col("height")
    if tile_mode == "tile":
        x0, y0 = w / F.lit(2.0), h / F.lit(2.0)
    else:
        x0, y0 = anchor_xy(F.lit(position), w, h, F.lit(width), F.lit(height), F.lit(margin))
    cos, sin = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    dx, dy = F.col("x") + F.lit(0.5) - x0, F.col("y") + F.lit(0.5) - y0
    u, v = dx * F.lit(cos) + dy * F.lit(sin), dy * F.lit(cos) - dx * F.lit(sin)
    half_w, half_h = F.lit(width / 2.0), F.lit(ROWS * scale / 2.0)
    if tile_mode == "tile":
        step_x, step_y = width + tile_spacing, height + tile_spacing
        diagonal = F.ceil(F.sqrt((w * w + h * h).cast("double")))
        # the stamp whose box may hold the place, if there is one
        near = lambda c, half, step: F.floor((c + diagonal + half) / F.lit(float(step)))
        i, j = near(u, half_w, step_x), near(v, half_h, step_y)
        left, top = i * step_x - diagonal, j * step_y - diagonal
        stamped = (i >= 0) & (j >= 0) & (left < diagonal) & (top < diagonal)
        hit = stamped & covered(F.floor(u - left + half_w), F.floor(v - top + half_h), text, height)
    else:
        hit = covered(F.floor(u + half_w), F.floor(v + half_h), text, height)
    # source-over
    *rgb, own = (*colour, 1.0)[:4]
    strength = float(own) * float(opacity)
    under = F.col("a") / F.lit(255.0)
    alpha = F.lit(strength) + under * F.lit(1 - strength)
    blend = lambda c, value: jround((F.lit(value * strength) + F.col(c) * under * F.lit(1 - strength)) / F.greatest(alpha, F.lit(1e-12)))
    rows = pixels.withColumn("_hit", hit)
    out = {c: F.when(F.col("_hit"), blend(c, value)).otherwise(F.col(c)) for c, value in zip("rgb", rgb, strict=True)}
    out["a"] = F.when(F.col("_hit"), jround(alpha * F.lit(255.0))).otherwise(F.col("a"))
    return rows.withColumns(out).drop("_hit")
