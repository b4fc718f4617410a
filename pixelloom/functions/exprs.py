"""Column expressions of the pixel model, all built-in functions inside whole-stage codegen.

Channels are INT 0..255.  Rounding is floor(x + 0.5); integer shifts floor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import require

FIXED_SHIFT = 8
FIXED_ONE = 1 << FIXED_SHIFT
#: Luma weights of red, green and blue in 256ths.
LUMA = (77, 150, 29)


def jround(c: Column) -> Column:
    """floor(c + 0.5) as INT."""
    return F.floor(c + F.lit(0.5)).cast("int")


def clamp_u8(c: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), c))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * LUMA[0] + g * LUMA[1] + b * LUMA[2], FIXED_SHIFT)


def to_fixed(c: Column) -> Column:
    return F.floor(c * F.lit(float(FIXED_ONE)) + F.lit(0.5)).cast("int")


def from_fixed(c: Column) -> Column:
    return c / F.lit(float(FIXED_ONE))


def multiply_fixed(a: Column, b: Column) -> Column:
    """(a * b) >> 8 where the product wraps to 32 bits."""
    product = a.cast("long") * b.cast("long")
    low = F.pmod(product, F.lit(1 << 32))
    wrapped = F.when(low >= (1 << 31), low - (1 << 32)).otherwise(low)
    return F.shiftright(wrapped, FIXED_SHIFT).cast("int")


def lookup(table: list[int], index: Column) -> Column:
    """table[index] from a literal array (constant-folded once)."""
    return F.element_at(F.array(*[F.lit(v) for v in table]), index + 1)


def smoothstep_u8(v: Column, low: float, high: float) -> Column:
    """255 * smoothstep between two edges, rounded; equal edges are a step."""
    if low == high:
        return F.when(v < F.lit(low), F.lit(0)).otherwise(F.lit(255))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.lit(float(low))) / F.lit(float(high - low))))
    return jround(t * t * (F.lit(3.0) - F.lit(2.0) * t) * F.lit(255.0))


def register_sql(spark: SparkSession) -> None:
    """The helpers as SQL functions of the session."""
    for statement in (
        "CREATE OR REPLACE TEMPORARY FUNCTION luma(r INT, g INT, b INT) RETURNS INT RETURN shiftright(77 * r + 150 * g + 29 * b, 8)",
        "CREATE OR REPLACE TEMPORARY FUNCTION clamp_u8(v INT) RETURNS INT RETURN least(255, greatest(0, v))",
        "CREATE OR REPLACE TEMPORARY FUNCTION jround(v DOUBLE) RETURNS INT RETURN CAST(floor(v + 0.5D) AS INT)",
        "CREATE OR REPLACE TEMPORARY FUNCTION smoothstep_u8(v DOUBLE, low DOUBLE, high DOUBLE) RETURNS INT RETURN "
        "CASE WHEN low = high THEN CASE WHEN v < low THEN 0 ELSE 255 END ELSE CAST(floor("
        "pow(least(1D, greatest(0D, (v - low) / nullif(high - low, 0D))), 2) * (3D - 2D * least(1D, greatest(0D, (v - low) / nullif(high - low, 0D)))) * 255D + 0.5D) AS INT) END",
    ):
        spark.sql(statement)


# Plan-time scalars -------------------------------------------------------------------------


def py_round(x: float) -> int:
    return math.floor(x + 0.5)


def tone_tables(brightness: float = 0, contrast: float = 0, temperature: float = 0, gamma: float = 1) -> tuple[list[int], list[int], list[int]]:
    """The 256-entry tables of red, green and blue."""
    offset = py_round(brightness / 100 * 127)
    gain = 1.0 + contrast / 100 * (2 if contrast > 0 else 1)
    warm, cool = py_round(temperature / 100 * 30), py_round(-temperature / 100 * 30)

    def table(shift: int) -> list[int]:
        out = []
        for i in range(256):
            v = i / 255
            if gamma != 1:
                v = v**gamma
            v = (v - 0.5) * gain + 0.5 + shift / 255
            out.append(min(255, max(0, py_round(v * 255))))
        return out

    return table(offset + warm), table(offset), table(offset + cool)


def colour_matrix(hue: float = 0, saturation: float = 0) -> list[list[int]]:
    """Saturation after hue rotation about the grey axis, in 256ths."""
    angle = math.radians(hue)
    third, turn = (1 - math.cos(angle)) / 3, math.sin(angle) / math.sqrt(3)
    rotate = [[math.cos(angle) + third if i == j else third - turn if (j - i) % 3 == 1 else third + turn for j in range(3)] for i in range(3)]
    s = max(0.0, 1 + saturation / 100)
    grey = (0.299, 0.587, 0.114)
    saturate = [[(1 - s) * grey[j] + (s if i == j else 0) for j in range(3)] for i in range(3)]
    return [[py_round(256 * sum(saturate[i][k] * rotate[k][j] for k in range(3))) for j in range(3)] for i in range(3)]


def check_adjust(brightness=0, contrast=0, saturation=0, temperature=0, hue=0, gamma=1) -> None:
    for name, value in (("brightness", brightness), ("contrast", contrast), ("saturation", saturation), ("temperature", temperature)):
        require(not (value < -100 or value > 100), f"{name} must be between -100 and 100.")
    require(not (hue < -180 or hue > 180), "hue must be between -180 and 180.")
    require(not (gamma < 0.1 or gamma > 5), "gamma must be between 0.1 and 5.")


def check_kernel(values: list[float]) -> list[int]:
    """Nine coefficients of a 3x3 kernel in 256ths."""
    require(len(values) == 9, "A 3x3 kernel needs 9 coefficients.")
    return [py_round(v * FIXED_ONE) for v in values]
