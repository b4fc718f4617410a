"""An immutable builder over image collections.

Every method checks its options and returns a new builder with one more step; nothing is
read until the DataFrame that ``to_df`` gives is.  Before that, rules rewrite the steps:
neutral steps go, a crop of a crop is one crop, a crop moves below point steps, and below a
stencil with a border of one pixel that a second crop takes off again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import natural, positive_int, require
from ..functions.exprs import check_adjust
from ..functions.metadata import MaskOptions, check_watermark, filter_overlap
from ..operators import backend, geometry, histogram, mask, point, tiling, watermark
from ..operators.stencil import STENCILS


@dataclass(frozen=True)
class Step:
    kind: str
    args: dict = field(default_factory=dict)

    @property
    def pointwise(self) -> bool:
        return self.kind in ("adjust", "background") or self.kind == "filter" and self.args["name"] not in STENCILS


def _crops(a: dict, b: dict) -> dict:
    """b after a."""
    require(b["x"] + b["width"] <= a["width"] and b["y"] + b["height"] <= a["height"], "The crop rectangle is outside image bounds.")
    return {"x": a["x"] + b["x"], "y": a["y"] + b["y"], "width": b["width"], "height": b["height"]}


def simplify(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """The rules, until none applies."""
    out = list(steps)
    again = True
    while again:
        again = False
        for i, s in enumerate(out):
            after = out[i + 1] if i + 1 < len(out) else None
            if s.kind == "filter" and s.args["name"] == "identity" or s.kind == "adjust" and not _active(s.args):
                out[i : i + 1] = []
            elif after is None:
                continue
            elif s.kind == after.kind == "filter" and s.args["name"] == after.args["name"] == "invert":
                out[i : i + 2] = []
            elif s.kind == after.kind == "filter" and s.args["name"] == after.args["name"] == "grayscale":
                out[i : i + 1] = []
            elif s.kind == after.kind == "crop":
                out[i : i + 2] = [Step("crop", _crops(s.args, after.args))]
            elif after.kind == "crop" and s.pointwise:
                out[i : i + 2] = [after, s]
            elif after.kind == "crop" and s.kind == "filter" and not s.args.get("fenced"):
                # the border is cut at the image's edge, so that edge replication stays what it is
                out[i : i + 2] = [Step("border", after.args), Step("filter", {**s.args, "fenced": True}), Step("unborder", after.args)]
            else:
                continue
            again = True
            break
    return tuple(out)


def _active(args: dict) -> bool:
    return any(v for k, v in args.items() if k != "gamma") or args.get("gamma", 1) != 1


@dataclass(frozen=True)
class Edit:
    source: DataFrame
    steps: tuple[Step, ...] = ()

    def _with(self, kind: str, **args) -> Edit:
        return replace(self, steps=(*self.steps, Step(kind, args)))

    def crop(self, x: int, y: int, width: int, height: int) -> Edit:
        natural(x, "x"), natural(y, "y"), positive_int(width, "width"), positive_int(height, "height")
        return self._with("crop", x=x, y=y, width=width, height=height)

    def resize(self, width: int, height: int, method: str = "bilinear") -> Edit:
        positive_int(width, "width"), positive_int(height, "height")
        require(method in ("nearest", "bilinear"), f"Unknown resize method: {method}.")
        return self._with("resize", width=width, height=height, method=method)

    def filter(self, name: str = "smoothEnhance") -> Edit:
        filter_overlap(name)
        return self._with("filter", name=name)

    def filters(self, names: list[str]) -> Edit:
        require(len(names) > 0, "A pipeline needs at least one step.")
        out = self
        for name in names:
            out = out.filter(name)
        return out

    def mask(self, masks: DataFrame, options: MaskOptions | None = None) -> Edit:
        return self._with("mask", masks=masks, options=options or MaskOptions())

    def background(self, colour: tuple[int, int, int]) -> Edit:
        return self._with("background", colour=colour)

    def adjust(self, **options) -> Edit:
        check_adjust(**options)
        return self._with("adjust", **options)

    def watermark(self, text: str, **options) -> Edit:
        """Options as those of ``operators.watermark.text_watermark``."""
        check_watermark(text, options.get("opacity", 1), options.get("margin", 24), options.get("tile_spacing", 200))
        return self._with("watermark", text=text, **options)

    def plan(self, goal: str = "delivery", **options) -> DataFrame:
        return tiling.asset_plan(self.to_df(), goal, **options)

    def histogram(self) -> DataFrame:
        return histogram.histogram(self.to_df())

    def to_df(self) -> DataFrame:
        rows = self.source
        for s in simplify(self.steps):
            rows = _apply(rows, s)
        return rows


def _border(rows: DataFrame, args: dict) -> DataFrame:
    """The crop and one pixel around it where the image has one; places are not moved yet.  Of an
    image that the crop does not lie in, the first pixel stays, for the crop to raise its error."""
    x, y, w, h = args["x"], args["y"], args["width"], args["height"]
    inside = (F.col("width") >= x + w) & (F.col("height") >= y + h)
    near = (F.col("x") >= x - 1) & (F.col("x") <= x + w) & (F.col("y") >= y - 1) & (F.col("y") <= y + h)
    return rows.where(F.when(inside, near).otherwise((F.col("x") == 0) & (F.col("y") == 0)))


def _apply(rows: DataFrame, s: Step) -> DataFrame:
    a = s.args
    if s.kind in ("crop", "unborder"):
        return geometry.crop(rows, **a)
    if s.kind == "border":
        return _border(rows, a)
    if s.kind == "resize":
        return geometry.resize(rows, **a)
    if s.kind == "filter":
        return backend.apply_filter(rows, a["name"])
    if s.kind == "mask":
        return mask.apply_mask(rows, a["masks"], a["options"])
    if s.kind == "background":
        return point.fill_transparent(rows, a["colour"])
    if s.kind == "adjust":
        return point.adjust(rows, **a)
    return watermark.text_watermark(rows, **a)


def edit(source: DataFrame) -> Edit:
    """A builder over P-form images."""
    return Edit(source)
