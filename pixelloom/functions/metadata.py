"""Dimension tables and scalar rules: image formats, pixel filters, watermark geometry, mask options."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RasterError, require

# The image formats in their order.
# (format, MIME type, extensions, alpha, lossy, encodable)
FORMATS = [
    ("png", "image/png", ["png"], True, False, True),
    ("jpeg", "image/jpeg", ["jpg", "jpeg", "jpe", "jfif"], False, True, True),
    ("webp", "image/webp", ["webp"], True, True, True),
    ("avif", "image/avif", ["avif", "avifs"], True, True, True),
    ("bmp", "image/bmp", ["bmp", "dib"], False, False, False),
    ("gif", "image/gif", ["gif"], True, False, False),
    ("tiff", "image/tiff", ["tif", "tiff"], True, False, False),
]
# The pixel filters in their order.
# (filter, overlap, category, label)
FILTERS = [
    ("identity", 0, "utility", "Identity"),
    ("smoothEnhance", 1, "enhancement", "Natural Enhance"),
    ("sharpen3x3", 1, "enhancement", "Crisp Sharpen"),
    ("boxBlur3x3", 1, "enhancement", "Soft Blur"),
    ("unsharpMask", 1, "enhancement", "Clarity"),
    ("grayscale", 0, "creative", "Grayscale"),
    ("invert", 0, "creative", "Invert"),
]
#: What each filter does, and the execution paths that it has.
ABOUT = {
    "identity": "The pixels as they are.",
    "smoothEnhance": "Raises local contrast a little, by three eighths of the difference from a weighted mean.",
    "sharpen3x3": "Strong sharpening: five times the pixel less its four neighbours.",
    "boxBlur3x3": "Mean of the nine pixels around a place.",
    "unsharpMask": "Raises local contrast clearly, by five eighths of the difference from a weighted mean.",
    "grayscale": "Luma in 256ths in all three channels.",
    "invert": "255 less each channel; alpha stays.",
}
PATHS = ["expression", "arrow"]
# Default quality of lossy formats.
DEFAULT_QUALITY = 0.92
# The anchors of a watermark, row by row.
ANCHORS = ["top-left", "top-center", "top-right", "center-left", "center", "center-right", "bottom-left", "bottom-center", "bottom-right"]

OVERLAP = {name: overlap for name, overlap, *_ in FILTERS}
_ALIASES = {ext: name for name, _, exts, *_ in FORMATS for ext in [name, *exts]}


def list_image_formats(spark: SparkSession) -> DataFrame:
    rows = [(i, *f) for i, f in enumerate(FORMATS)]
    return spark.createDataFrame(rows, "position int, format string, mime string, extensions array<string>, alpha boolean, lossy boolean, encodable boolean")


def list_pixel_filters(spark: SparkSession) -> DataFrame:
    rows = [(i, *f, ABOUT[f[0]], PATHS) for i, f in enumerate(FILTERS)]
    return spark.createDataFrame(rows, "position int, filter string, overlap int, category string, label string, description string, paths array<string>")


def filter_profile(name: str) -> dict:
    """What ``list_pixel_filters`` says of one filter; an unknown name is an error."""
    for key, overlap, category, label in FILTERS:
        if key == name:
            return {"filter": key, "overlap": overlap, "category": category, "label": label, "description": ABOUT[key], "paths": PATHS}
    raise RasterError(f"Unknown filter: {name}.")


def filter_overlap(name: str) -> int:
    require(name in OVERLAP, f"Unknown filter: {name}.")
    return OVERLAP[name]


def _cleaned(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^image/", ""), r"^\.", "")


def known_format(name: Column) -> Column:
    """The format of a name, extension or MIME type, or null."""
    clean, out = _cleaned(name), F.lit(None).cast("string")
    for fmt, _, exts, *_ in FORMATS:
        out = F.when(clean.isin(fmt, *exts), fmt).otherwise(out)
    return out


def normalize_format(name: Column) -> Column:
    """The format of a name; an unknown one is an error."""
    return F.coalesce(known_format(name), F.raise_error(F.concat(F.lit("No such image format: "), name)).cast("string"))


def normalize_format_name(name: str) -> str:
    clean = re.sub(r"^\.", "", re.sub(r"^image/", "", name.strip().lower()))
    if clean not in _ALIASES:
        raise RasterError(f"No such image format: {name}.")
    return _ALIASES[clean]


def format_profile(name: str) -> dict:
    """The row of FORMATS for a name, extension or MIME type; an unknown one is an error."""
    found = normalize_format_name(name)
    keys = ("format", "mime", "extensions", "alpha", "lossy", "encodable")
    return next(dict(zip(keys, f, strict=True)) for f in FORMATS if f[0] == found)


def infer_format(mime: Column, name: Column) -> Column:
    """The format of an input: its MIME type where it has one, else its name's extension, else
    null.  A type or an extension that is no image format is an error."""
    extension = extension_of(name)
    return F.when(F.coalesce(mime, F.lit("")) != "", normalize_format(mime)).when(extension.isNotNull(), normalize_format(extension))


def can_encode(fmt: Column) -> Column:
    return F.coalesce(fmt.isin([f[0] for f in FORMATS if f[5]]), F.lit(False))


def extension_of(name: Column) -> Column:
    """The extension that a file name or address ends with, or null."""
    found = F.regexp_extract(name, r"(?i)\.([a-z0-9]+)(?:[?#].*)?$", 1)
    return F.lower(F.nullif(found, F.lit("")))


def default_quality(fmt: Column) -> Column:
    return F.when(fmt.isin([f[0] for f in FORMATS if f[4]]), F.lit(DEFAULT_QUALITY))


def check_quality(value: float | None) -> None:
    require(value is None or 0 <= value <= 1, "quality must be between 0 and 1.")


def saved_bytes(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), before - after)


def saved_ratio(before: Column, after: Column) -> Column:
    return F.when(before != 0, saved_bytes(before, after) / before)


# Watermarks ------------------------------------------------------------------------------


def font_height(font: Column) -> Column:
    """Leading digits of a font text, or 48."""
    digits = F.regexp_extract(font, r"^\s*(\d+)", 1)
    return F.when((digits == "") | (digits.rlike("^0+$")), F.lit(48)).otherwise(F.try_to_number(digits, F.lit("9999999999")).cast("int"))


def font_pixels(font: str) -> int:
    """The same for one font."""
    digits = re.match(r"\s*(\d+)", font)
    return int(digits[1]) or 48 if digits else 48


def anchor_xy(anchor: Column, width: Column, height: Column, text_w: Column, text_h: Column, margin: Column) -> tuple[Column, Column]:
    """Where the middle of the text goes."""
    half = lambda c: c / F.lit(2.0)
    x = F.when(anchor.endswith("left"), margin + half(text_w)).when(anchor.endswith("right"), width - margin - half(text_w)).otherwise(half(width))
    y = F.when(anchor.startswith("top"), margin + half(text_h)).when(anchor.startswith("bottom"), height - margin - half(text_h)).otherwise(half(height))
    return x, y


def check_watermark(text: str, opacity: float = 1, margin: float = 24, spacing: float = 200) -> None:
    require(bool(text and text.strip()), "Watermark text must not be blank.")
    require(0 <= opacity <= 1, "opacity must be between 0 and 1.")
    require(margin >= 0, "margin must not be negative.")
    require(spacing > 0, "spacing must be positive.")


# Mask options ----------------------------------------------------------------------------


@dataclass(frozen=True)
class MaskOptions:
    threshold: float = 4
    softness: float = 12
    feather_radius: int = 2
    edge_sensitivity: float = 48

    def __post_init__(self) -> None:
        require(0 <= self.threshold <= 255, "threshold must be between 0 and 255.")
        require(0 <= self.softness <= 255, "softness must be between 0 and 255.")
        require(isinstance(self.feather_radius, int) and self.feather_radius >= 0, "featherRadius must be a non-negative integer.")
        require(self.edge_sensitivity > 0, "edgeSensitivity must be positive.")

    @property
    def radius(self) -> int:
        return min(3, self.feather_radius)

    @property
    def upper(self) -> float:
        return min(255, self.threshold + self.softness)


def ai_mask_columns(cutoff: Column, guard: Column) -> dict[str, Column]:
    """Mask options that follow from a cutoff (0..255) and a subject guard (0..100)."""
    return {
        "threshold": F.greatest(F.lit(0.0), cutoff - F.lit(32.0)),
        "softness": F.lit(54.0),
        "feather_radius": F.lit(2),
        "edge_sensitivity": F.lit(34.0) + guard * F.lit(0.35),
    }


def ai_mask_options(cutoff: float = 38, guard: float = 70) -> MaskOptions:
    require(0 <= cutoff <= 255, "maskCutoff must be between 0 and 255.")
    require(0 <= guard <= 100, "subjectGuard must be between 0 and 100.")
    return MaskOptions(max(0, cutoff - 32), 54, 2, 34 + guard * 0.35)
