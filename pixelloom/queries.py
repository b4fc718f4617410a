"""Queries of the raster engine, each with SQL that gives the same rows.

Images come from two views over the test tables: vectors as 8x8 images (E) and order lines
as images 20 wide (L).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs, metadata
from .functions.metadata import MaskOptions
from .operators import ai, arrow, backend, geometry, histogram, mask, point, stencil, tiling, watermark
from .plans import edit
from .sources.images import create_images, embedding_images, lineitem_images, pack_images, unpack_images
from .streaming import ring_total

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Views in SQL ----------------------------------------------------------------------------

_U8 = "CAST(least(255, greatest(0, floor((CAST({} AS DOUBLE) + CAST(0.6 AS DOUBLE)) * 212))) AS INTEGER)"
E_VIEW = f"""e0 AS (SELECT vec_id AS image_id, embedding, CAST(unnest(range(64)) AS INTEGER) AS k FROM embeddings),
pix AS (SELECT image_id, 8 AS width, 8 AS height, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y,
  {_U8.format("embedding[k + 1]")} AS r, {_U8.format("embedding[64 - k]")} AS g,
  CAST((image_id * 31 + k * 17) % 256 AS INTEGER) AS b,
  CASE WHEN (image_id + k) % 5 = 0 THEN 128 WHEN (image_id + k) % 11 = 0 THEN 0 ELSE 255 END AS a FROM e0)"""
L_VIEW = """l0 AS (SELECT l_suppkey, l_extendedprice, l_partkey, l_quantity, l_returnflag,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_shipdate, l_extendedprice) - 1 AS k,
  CAST(count(*) OVER (PARTITION BY l_suppkey) // 20 AS INTEGER) AS height FROM lineitem),
pix AS (SELECT CAST(l_suppkey AS BIGINT) AS image_id, 20 AS width, height, CAST(k % 20 AS INTEGER) AS x, CAST(k // 20 AS INTEGER) AS y,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS INTEGER) AS r, CAST(l_partkey % 256 AS INTEGER) AS g,
  CAST(CAST(floor(l_quantity) AS INTEGER) * 5 AS INTEGER) AS b, CASE WHEN l_returnflag = 'R' THEN 128 ELSE 255 END AS a
  FROM l0 WHERE k < height * 20)"""
PIX = "image_id, width, height, x, y"


def J(x: str) -> str:
    return f"CAST(floor({x} + CAST(0.5 AS DOUBLE)) AS INTEGER)"


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def C(x: str) -> str:
    return f"least(255, greatest(0, {x}))"


LUMA = "((77 * r + 150 * g + 29 * b) >> 8)"


def query(name: str, sql: str | None = None, view: str = E_VIEW):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {view} {sql}" if view else sql
        return f

    return put


def E(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_images(spark, sf)


def L(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem_images(spark, sf)


def masks_of(pixels: DataFrame) -> DataFrame:
    """Masks of the images' size, by formula."""
    return pixels.select("image_id", "x", "y", ((F.col("x") * 37 + F.col("y") * 11 + F.col("image_id") * 7) % 256).cast("int").alias("m"))


def small_masks(spark: SparkSession, sf: str) -> DataFrame:
    """4x4 masks by the same formula."""
    ids = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("image_id"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")
    return masks_of(ids.select("image_id", grid).select("image_id", (F.col("k") % 4).alias("x"), F.floor(F.col("k") / 4).cast("int").alias("y")))


M_SQL = "CAST((x * 37 + y * 11 + image_id * 7) % 256 AS INTEGER)"
MASK_VIEW = f"{E_VIEW}, mask AS (SELECT image_id, x, y, {M_SQL} AS m FROM pix)"


def dims(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "width", "height").distinct()


DIMS_VIEW = f"{L_VIEW}, img AS (SELECT DISTINCT image_id, width, height FROM pix)"

# Sources and points ------------------------------------------------------------------------


@query("create_solid", "SELECT CAST(0 AS BIGINT) AS image_id, 40 AS width, 25 AS height, CAST(k % 40 AS INTEGER) AS x, CAST(k // 40 AS INTEGER) AS y, 12 AS r, 34 AS g, 56 AS b, 255 AS a FROM range(1000) t(k)", "")
def _(spark, sf):
    return create_images(spark, 40, 25, (12, 34, 56))


query("clone_identity", "SELECT * FROM pix", L_VIEW)(lambda s, d: point.identity(L(s, d)))
query("invert", f"SELECT {PIX}, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM pix", L_VIEW)(lambda s, d: point.invert(L(s, d)))
query("grayscale", f"SELECT {PIX}, {LUMA} AS r, {LUMA} AS g, {LUMA} AS b, a FROM pix", L_VIEW)(lambda s, d: point.grayscale(L(s, d)))
query("gray_then_invert", f"SELECT {PIX}, 255 - {LUMA} AS r, 255 - {LUMA} AS g, 255 - {LUMA} AS b, a FROM pix")(lambda s, d: stencil.apply_filters(E(s, d), ["grayscale", "invert"]))
_FILL = ", ".join(f"{J(f'{c} * (a / {D(255)}) + {v} * (1 - a / {D(255)})')} AS {c}" for c, v in zip("rgb", (12, 200, 99), strict=True))
query("fill_background", f"SELECT {PIX}, {_FILL}, 255 AS a FROM pix")(lambda s, d: point.fill_transparent(E(s, d), (12, 200, 99)))

_TONE = dict(brightness=12, contrast=30, temperature=-20, gamma=1.4)
_TABLES = exprs.tone_tables(**_TONE)
query("adjust_lut", f"SELECT {PIX}, " + ", ".join(f"{t}[{c} + 1] AS {c}" for c, t in zip("rgb", _TABLES, strict=True)) + ", a FROM pix")(lambda s, d: point.adjust(E(s, d), **_TONE))
_HUE = dict(hue=40, saturation=-35, brightness=5)
_MATRIX = exprs.colour_matrix(40, -35)
_HUE_TABLES = exprs.tone_tables(brightness=5)
query(
    "adjust_hue_sat",
    f", m AS (SELECT {PIX}, a, " + ", ".join(f"{C(f'(r * ({w[0]}) + g * ({w[1]}) + b * ({w[2]})) >> 8')} AS {c}" for c, w in zip("rgb", _MATRIX, strict=True))
    + f" FROM pix) SELECT {PIX}, " + ", ".join(f"{t}[{c} + 1] AS {c}" for c, t in zip("rgb", _HUE_TABLES, strict=True)) + ", a FROM m",
)(lambda s, d: point.adjust(E(s, d), **_HUE))


@query("fixed_point_scalars", """SELECT image_id, x, y, CAST(floor(r / CAST(100 AS DOUBLE) * 256 + CAST(0.5 AS DOUBLE)) AS INTEGER) AS fixed, r / CAST(256 AS DOUBLE) AS plain,
  CAST((CAST(r * 300 AS BIGINT) * (b - 128)) >> 8 AS INTEGER) AS product, least(255, greatest(0, r * 3 - 200)) AS clamped FROM pix""")
def _(spark, sf):
    r, b = F.col("r"), F.col("b")
    return E(spark, sf).select("image_id", "x", "y", exprs.to_fixed(r / 100.0).alias("fixed"), exprs.from_fixed(r).alias("plain"), exprs.multiply_fixed(r * 300, b - 128).alias("product"), exprs.clamp_u8(r * 3 - 200).alias("clamped"))


# Geometry ----------------------------------------------------------------------------------

query("crop", "SELECT image_id, 11 AS width, 9 AS height, x - 3 AS x, y - 5 AS y, r, g, b, a FROM pix WHERE x >= 3 AND x < 14 AND y >= 5 AND y < 14", L_VIEW)(lambda s, d: geometry.crop(L(s, d), 3, 5, 11, 9))
query("has_transparency", "SELECT image_id, min(a) < 255 AS has_alpha FROM pix GROUP BY image_id")(lambda s, d: geometry.has_transparency(E(s, d)))


@query("rect_clamp", """, t AS (SELECT image_id, width, height, x - 4 AS rx, y - 2 AS ry, 6 + x AS rw, 3 + y AS rh, x, y FROM pix)
SELECT image_id, x AS px, y AS py, greatest(0, rx) AS x, greatest(0, ry) AS y,
  greatest(0, least(width, rx + rw) - greatest(0, rx)) AS width, greatest(0, least(height, ry + rh) - greatest(0, ry)) AS height FROM t""")
def _(spark, sf):
    p = E(spark, sf)
    rect = geometry.clamp_rect(F.col("x") - 4, F.col("y") - 2, F.col("x") + 6, F.col("y") + 3, F.col("width"), F.col("height"))
    return p.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), *[v.alias(k) for k, v in rect.items()])


query("resize_nearest", """SELECT p.image_id, 13 AS width, 40 AS height, CAST(i.o AS INTEGER) AS x, CAST(j.o AS INTEGER) AS y, p.r, p.g, p.b, p.a
FROM range(13) i(o) CROSS JOIN range(40) j(o) JOIN pix p
  ON p.x = least(p.width - 1, i.o * p.width // 13) AND p.y = least(p.height - 1, j.o * p.height // 40)""", L_VIEW)(lambda s, d: geometry.resize(L(s, d), 13, 40, "nearest"))


def _bilinear_sql(w: int, h: int) -> str:
    at = lambda n, size: f"greatest({D(0)}, (o + {D(0.5)}) * (CAST({n} AS DOUBLE) / {D(size)}) - {D(0.5)})"
    place = lambda n, size: f"least({n} - 1, CAST(floor({at(n, size)}) AS INTEGER))"
    mean = lambda c: f"CAST((p.{c} * (256 - f) + q.{c} * f + 128) >> 8 AS INTEGER) AS {c}"
    return f""", img AS (SELECT DISTINCT image_id, width, height FROM pix),
cx AS (SELECT image_id, height, width, CAST(o AS INTEGER) AS o, {place("width", w)} AS lo, CAST(floor(({at("width", w)} - {place("width", w)}) * 256) AS INTEGER) AS f FROM img, range({w}) t(o)),
hor AS (SELECT c.image_id, c.height, c.o AS x, p.y, {", ".join(mean(c) for c in "rgba")} FROM cx c
  JOIN pix p ON p.image_id = c.image_id AND p.x = c.lo JOIN pix q ON q.image_id = c.image_id AND q.y = p.y AND q.x = least(c.width - 1, c.lo + 1)),
cy AS (SELECT image_id, height, CAST(o AS INTEGER) AS o, {place("height", h)} AS lo, CAST(floor(({at("height", h)} - {place("height", h)}) * 256) AS INTEGER) AS f FROM img, range({h}) t(o))
SELECT c.image_id, {w} AS width, {h} AS height, p.x, c.o AS y, {", ".join(mean(c) for c in "rgba")} FROM cy c
  JOIN hor p ON p.image_id = c.image_id AND p.y = c.lo JOIN hor q ON q.image_id = c.image_id AND q.x = p.x AND q.y = least(c.height - 1, c.lo + 1)"""


query("resize_bilinear", _bilinear_sql(5, 11))(lambda s, d: geometry.resize(E(s, d), 5, 11))
query("resize_bilinear_large", _bilinear_sql(33, 17), L_VIEW)(lambda s, d: geometry.resize(L(s, d), 33, 17))


def _mask_resize_sql() -> str:
    at = f"greatest({D(0)}, (o + {D(0.5)}) * {D(0.5)} - {D(0.5)})"
    lo = f"least(3, CAST(floor({at}) AS INTEGER))"
    lerp = lambda a, b, f: f"({a} + ({b} - {a}) * {f})"
    d = lambda n: f"CAST({n}.m AS DOUBLE)"
    top, bottom = lerp(d("p"), d("q"), "cx.f"), lerp(d("s"), d("t"), "cx.f")
    return f"""WITH m AS (SELECT vec_id AS image_id, CAST(i % 4 AS INTEGER) AS x, CAST(i // 4 AS INTEGER) AS y, CAST((i % 4 * 37 + i // 4 * 11 + vec_id * 7) % 256 AS INTEGER) AS m FROM embeddings, range(16) t(i)),
c AS (SELECT CAST(o AS INTEGER) AS o, {lo} AS lo, {at} - {lo} AS f FROM range(8) t(o))
SELECT p.image_id, cx.o AS x, cy.o AS y, {J(lerp(top, bottom, "cy.f"))} AS m FROM c cx CROSS JOIN c cy
JOIN m p ON p.x = cx.lo AND p.y = cy.lo JOIN m q ON q.image_id = p.image_id AND q.x = least(3, cx.lo + 1) AND q.y = cy.lo
JOIN m s ON s.image_id = p.image_id AND s.x = cx.lo AND s.y = least(3, cy.lo + 1) JOIN m t ON t.image_id = p.image_id AND t.x = least(3, cx.lo + 1) AND t.y = least(3, cy.lo + 1)"""


query("resize_mask", _mask_resize_sql(), "")(lambda s, d: geometry.resize_mask(small_masks(s, d), 4, 4, 8, 8))

# Stencils ----------------------------------------------------------------------------------


def _stencil_ctes(name: str, source: str, out: str) -> str:
    """CTEs that filter ``source`` into ``out``."""
    across, down = "OVER (PARTITION BY image_id, y ORDER BY x)", "OVER (PARTITION BY image_id, x ORDER BY y)"
    near = lambda c, w: (f"coalesce(lag({c}) {w}, {c})", f"coalesce(lead({c}) {w}, {c})")
    first, last = [], []
    for c in "rgb":
        left, right = near(c, across)
        up, below = near(f"h{c}", down)
        if name == "sharpen3x3":
            first.append(f"5 * {c} - {left} - {right} AS h{c}, coalesce(lag({c}) {down}, {c}) + coalesce(lead({c}) {down}, {c}) AS v{c}")
            last.append(f"CAST({C(f'h{c} - v{c}')} AS INTEGER) AS {c}")
        else:
            mid = 1 if name == "boxBlur3x3" else 2
            first.append(f"{left} + {mid} * {c} + {right} AS h{c}")
            total = f"({up} + {mid} * h{c} + {below})"
            if name == "boxBlur3x3":
                last.append(f"CAST(({total} * 57 + 256) >> 9 AS INTEGER) AS {c}")
            else:
                gain = {"smoothEnhance": 3, "unsharpMask": 5}[name]
                last.append(f"CAST({C(f'{c} + ((({c} - ({total} >> 4)) * {gain}) >> 3)')} AS INTEGER) AS {c}")
    return f"{out}_h AS (SELECT *, {', '.join(first)} FROM {source}), {out} AS (SELECT {PIX}, {', '.join(last)}, a FROM {out}_h)"


for _name, _key in (("sharpen3x3", "sharpen3x3"), ("boxBlur3x3", "box_blur3x3"), ("smoothEnhance", "smooth_enhance"), ("unsharpMask", "unsharp_mask")):
    query(_key, f", {_stencil_ctes(_name, 'pix', 'out')} SELECT * FROM out", L_VIEW)(lambda s, d, n=_name: stencil.apply_filter(L(s, d), n))
query("blur_then_sharpen", f", {_stencil_ctes('boxBlur3x3', 'pix', 'one')}, {_stencil_ctes('sharpen3x3', 'one', 'two')} SELECT * FROM two")(lambda s, d: stencil.apply_filters(E(s, d), ["boxBlur3x3", "sharpen3x3"]))
query("halo_stencil", f", {_stencil_ctes('smoothEnhance', 'pix', 'out')} SELECT * FROM out", L_VIEW)(lambda s, d: stencil.stencil(L(s, d), "smoothEnhance", 7))
query("arrow_tile_filter", f", {_stencil_ctes('unsharpMask', 'pix', 'out')} SELECT * FROM out", L_VIEW)(lambda s, d: arrow.process(L(s, d), "unsharpMask", 7, 1))
query("arrow_image_filter", f", {_stencil_ctes('boxBlur3x3', 'pix', 'one')}, {_stencil_ctes('sharpen3x3', 'one', 'two')} SELECT * FROM two", L_VIEW)(lambda s, d: unpack_images(arrow.filter_images(pack_images(L(s, d)), ["boxBlur3x3", "sharpen3x3"])))

# Masks -------------------------------------------------------------------------------------

_RAW = J(f"a * m / {D(255)}")
query("mask_apply_raw", f"SELECT {', '.join('pix.' + c for c in PIX.split(', '))}, r, g, b, {_RAW} AS a FROM pix JOIN mask USING (image_id, x, y)", MASK_VIEW)(lambda s, d: mask.multiply_alpha(E(s, d), masks_of(E(s, d))))


def _feather(radius: int, sens: float) -> str:
    return f""", offs AS (SELECT CAST(i AS INTEGER) AS dx, CAST(j AS INTEGER) AS dy FROM range(-{radius}, {radius + 1}) a(i), range(-{radius}, {radius + 1}) b(j)),
pm AS (SELECT p.image_id, p.x, p.y, r, g, b, m FROM pix p JOIN mask k ON p.image_id = k.image_id AND p.x = k.x AND p.y = k.y),
wide AS (SELECT c.image_id, c.x, c.y, n.m AS m,
  (1 / (1 + (CAST((n.r - c.r) * (n.r - c.r) + (n.g - c.g) * (n.g - c.g) + (n.b - c.b) * (n.b - c.b) AS DOUBLE)) / {D(sens**2)})) * (1 / (1 + CAST(dx * dx + dy * dy AS DOUBLE))) AS wt
  FROM pm c CROSS JOIN offs JOIN pm n ON n.image_id = c.image_id AND n.x = c.x + dx AND n.y = c.y + dy WHERE c.m > 0 AND c.m < 255),
soft AS (SELECT image_id, x, y, {J("sum(m * wt) / greatest(sum(wt), 1)")} AS m FROM wide GROUP BY image_id, x, y
  UNION ALL SELECT image_id, x, y, m FROM mask WHERE m <= 0 OR m >= 255)"""


def _smooth(column: str, low: float, high: float) -> str:
    if low == high:
        return f"CASE WHEN {column} < {low} THEN 0 ELSE 255 END"
    t = f"least({D(1)}, greatest({D(0)}, ({column} - {D(low)}) / {D(high - low)}))"
    return J(f"{t} * {t} * ({D(3)} - {D(2)} * {t}) * {D(255)}")


_FINE = f"{_feather(2, 48)}, fine AS (SELECT image_id, x, y, {_smooth('m', 4, 16)} AS m FROM soft)"
query("guided_feather", f"{_feather(2, 48)} SELECT image_id, x, y, m FROM soft", MASK_VIEW)(lambda s, d: mask.guided_feather(E(s, d), masks_of(E(s, d)), 2, 48))
query("smoothstep_mask", f"SELECT image_id, x, y, {_smooth('m', 60, 200)} AS m FROM mask", MASK_VIEW)(lambda s, d: mask.smoothstep_mask(masks_of(E(s, d)), MaskOptions(60, 140)))
_APPLIED = f"{_FINE}, out AS (SELECT p.image_id, p.width, p.height, p.x, p.y, r, g, b, {J(f'a * m / {D(255)}')} AS a FROM pix p JOIN fine f ON p.image_id = f.image_id AND p.x = f.x AND p.y = f.y)"
query("mask_apply_refined", f"{_APPLIED} SELECT * FROM out", MASK_VIEW)(lambda s, d: mask.apply_mask(E(s, d), masks_of(E(s, d))))
query("mask_counts", f"{_APPLIED} SELECT image_id, CAST(count(*) FILTER (a < 250) AS BIGINT) AS removed_pixels, CAST(count(*) FILTER (a > 0 AND a < 255) AS BIGINT) AS partial_pixels FROM out GROUP BY image_id", MASK_VIEW)(lambda s, d: mask.mask_counts(mask.apply_mask(E(s, d), masks_of(E(s, d)))))

# Histograms ----------------------------------------------------------------------------------

_LONG = f", long AS (SELECT image_id, channel, bucket, count(*) AS cnt FROM (SELECT image_id, unnest(['r', 'g', 'b', 'luma']) AS channel, unnest([r, g, b, {LUMA}]) AS bucket FROM pix) GROUP BY ALL)"
query("histogram_long", f"{_LONG} SELECT image_id, channel, CAST(bucket AS INTEGER) AS bucket, cnt FROM long", L_VIEW)(lambda s, d: histogram.histogram(L(s, d)))
_DENSE = f"{_LONG}, dense AS (SELECT i.image_id, i.channel, CAST(t.k AS INTEGER) AS bucket, coalesce(l.cnt, 0) AS cnt FROM (SELECT DISTINCT image_id, channel FROM long) i CROSS JOIN range(256) t(k) LEFT JOIN long l ON l.image_id = i.image_id AND l.channel = i.channel AND l.bucket = t.k)"
query("histogram_dense", f"{_DENSE} SELECT * FROM dense", L_VIEW)(lambda s, d: histogram.dense(histogram.histogram(L(s, d))))
_STATS = f"""{_DENSE}, cum AS (SELECT image_id, bucket, cnt, sum(cnt) OVER (PARTITION BY image_id ORDER BY bucket) AS c, sum(cnt) OVER (PARTITION BY image_id) AS n FROM dense WHERE channel = 'luma'),
st AS (SELECT image_id, CAST(max(n) AS BIGINT) AS pixel_count, CAST(sum(bucket * cnt) AS BIGINT) / CAST(max(n) AS DOUBLE) AS mean_luma,
  coalesce(max(bucket) FILTER (c < greatest(1, floor(CAST(n AS DOUBLE) * {D(0.02)} + {D(0.5)}))), 0) AS range_low,
  coalesce(max(bucket) FILTER (c < greatest(1, floor(CAST(n AS DOUBLE) * {D(0.98)} + {D(0.5)}))), 255) AS range_high FROM cum GROUP BY image_id)"""
query("histogram_stats", f"{_STATS} SELECT * FROM st", L_VIEW)(lambda s, d: histogram.stats(L(s, d)))
query("dynamic_range", f"{_STATS} SELECT image_id, range_low, range_high FROM st")(lambda s, d: histogram.stats(E(s, d)).select("image_id", "range_low", "range_high"))
_B = f"CASE WHEN range_high - range_low <= 0 THEN 0 ELSE {J(f'(128 - (range_low + range_high) / {D(2)}) / {D(127)} * 50')} END"
_C = f"CASE WHEN range_high - range_low <= 0 THEN 0 ELSE greatest(-50, least(50, {J(f'(200 - (range_high - range_low)) / {D(200)} * 40')})) END"
query("auto_adjust", f"{_STATS} SELECT image_id, {_B} AS brightness, {_C} AS contrast FROM st", L_VIEW)(lambda s, d: histogram.auto_adjust(L(s, d)))
_TONE_SQL = lambda c: f"least(255, greatest(0, {J(f'(({c} / {D(255)} - {D(0.5)}) * gain + {D(0.5)} + shift / {D(255)}) * {D(255)}')})) AS {c}"
query("auto_adjust_apply", f"{_STATS}, sug AS (SELECT image_id, {_B} AS br, {_C} AS co FROM st), tone AS (SELECT image_id, {J(f'br / {D(100)} * {D(127)}')} AS shift, CASE WHEN co > 0 THEN 1 + co / {D(100)} * 2 ELSE 1 + co / {D(100)} END AS gain FROM sug) SELECT {', '.join('pix.' + c for c in PIX.split(', '))}, {', '.join(_TONE_SQL(c) for c in 'rgb')}, a FROM pix JOIN tone USING (image_id)")(lambda s, d: histogram.apply_auto_adjust(E(s, d)))

# Tiles, memory, assets ----------------------------------------------------------------------


def _tiles_sql(ts: int, ov: int) -> str:
    return f""", o AS (SELECT image_id, width, height, CAST(i * {ts} AS INTEGER) AS out_x, CAST(j * {ts} AS INTEGER) AS out_y FROM img, range(2000) a(i), range(2000) b(j) WHERE i * {ts} < width AND j * {ts} < height),
t AS (SELECT image_id, CAST(out_y // {ts} * ((width + {ts - 1}) // {ts}) + out_x // {ts} AS INTEGER) AS tile_index, greatest(0, out_x - {ov}) AS in_x, greatest(0, out_y - {ov}) AS in_y,
  least(width, out_x + least({ts}, width - out_x) + {ov}) - greatest(0, out_x - {ov}) AS in_w, least(height, out_y + least({ts}, height - out_y) + {ov}) - greatest(0, out_y - {ov}) AS in_h,
  out_x, out_y, least({ts}, width - out_x) AS out_w, least({ts}, height - out_y) AS out_h FROM o)"""


query("tile_plan", f"{_tiles_sql(7, 2)} SELECT * FROM t", DIMS_VIEW)(lambda s, d: tiling.plan_tiles(dims(L(s, d)), 7, 2))
query("tile_bytes", f"{_tiles_sql(7, 1)} SELECT image_id, tile_index, CAST(in_w * in_h * 4 AS BIGINT) AS in_bytes, CAST(out_w * out_h * 4 AS BIGINT) AS out_bytes FROM t", DIMS_VIEW)(
    lambda s, d: tiling.plan_tiles(dims(L(s, d)), 7, 1).select("image_id", "tile_index", tiling.rect_bytes(F.col("in_w"), F.col("in_h")).alias("in_bytes"), tiling.rect_bytes(F.col("out_w"), F.col("out_h")).alias("out_bytes"))
)
query("tile_halo_read", f"{_tiles_sql(7, 1)} SELECT p.*, t.tile_index, p.x >= out_x AND p.x < out_x + out_w AND p.y >= out_y AND p.y < out_y + out_h AS own FROM pix p JOIN t ON t.image_id = p.image_id AND p.x >= in_x AND p.x < in_x + in_w AND p.y >= in_y AND p.y < in_y + in_h", DIMS_VIEW)(lambda s, d: tiling.halo_read(L(s, d), 7, 1))
query("tile_roundtrip", "SELECT * FROM pix", L_VIEW)(lambda s, d: arrow.process(L(s, d), "identity", 7, 0))
_T_SQL = """, g AS (SELECT p.image_id, t.tile_index, CAST(count(*) AS BIGINT) AS pixels, md5(string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' ORDER BY y, x)) AS digest
  FROM pix p JOIN t ON t.image_id = p.image_id AND p.x >= in_x AND p.x < in_x + in_w AND p.y >= in_y AND p.y < in_y + in_h GROUP BY p.image_id, t.tile_index) SELECT * FROM g"""
query("tile_pack", f"{_tiles_sql(9, 1)}{_T_SQL}", DIMS_VIEW)(lambda s, d: tiling.to_tiles(L(s, d), 9, 1).select("image_id", "tile_index", (F.length("rgba") / 4).cast("long").alias("pixels"), F.md5(F.hex("rgba").cast("binary")).alias("digest")))
query("process_stats", f"{_tiles_sql(7, 1)} SELECT image_id, count(*) AS total_tiles, count(*) AS processed_tiles, CAST(sum(out_w * out_h * 4) AS BIGINT) AS output_bytes FROM t GROUP BY image_id", DIMS_VIEW)(lambda s, d: arrow.process_stats(L(s, d), "sharpen3x3", 7, 1))
query("process_progress", f"{_tiles_sql(7, 1)} SELECT image_id, tile_index, (tile_index + 1) * {D(100)} / count(*) OVER (PARTITION BY image_id) AS percent FROM t", DIMS_VIEW)(lambda s, d: tiling.progress(dims(L(s, d)), 7, 1))
# the plan in closed form against the tiles one by one
_PLAN_SQL = f"""{_tiles_sql(8, 1)}, f AS (SELECT image_id, count(*) AS tile_count, CAST(max((in_w * in_h + out_w * out_h) * 4) AS BIGINT) AS peak_tile_bytes FROM t GROUP BY image_id)
SELECT i.image_id, i.width, i.height, CAST(i.width AS BIGINT) * i.height AS pixels, 'sharpen3x3' AS filter, 8 AS tile_size, 1 AS overlap, tile_count, CAST(i.width AS BIGINT) * i.height * 4 AS full_frame_bytes, peak_tile_bytes,
  peak_tile_bytes * 4 AS active_bytes, (CAST(i.width AS BIGINT) * i.height * 4) / CAST(peak_tile_bytes * 4 AS DOUBLE) AS memory_reduction_ratio FROM img i JOIN f USING (image_id)"""
query("processing_plan", _PLAN_SQL, DIMS_VIEW)(lambda s, d: tiling.processing_plan(dims(L(s, d)), 8, 1, "sharpen3x3", 4))


@query("choose_tile_size", """SELECT o_orderkey, max(s) AS tile_size FROM (SELECT o_orderkey, o_totalprice * 4000 AS budget FROM orders) o
LEFT JOIN (SELECT unnest([256, 512, 1024, 2048, 4096]) AS s) t ON (CAST(s + 2 AS BIGINT) * (s + 2) + CAST(s AS BIGINT) * s) * 4 <= budget GROUP BY o_orderkey""", "")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") * 4000).alias("budget"))
    return rows.select("o_orderkey", tiling.choose_tile_size_column(F.col("budget"), F.lit(1)).alias("tile_size"))


def _asset_sql(goal: str, filters: str, overlap: int, tile: int, fmt: str, quality: float) -> str:
    return f"""SELECT image_id, '{goal}' AS goal, width, height, CAST(width * height AS BIGINT) AS pixels, CAST(width * height * 4 AS BIGINT) AS rgba_bytes,
  has_alpha, format, CASE WHEN format NOT IN ('png', 'bmp', 'gif') THEN {D(quality)} END AS quality, '{filters}' AS filters,
  {overlap} AS overlap, {tile} AS tile_size, CAST(1 AS BIGINT) AS tile_count, CAST(width * height * 8 AS BIGINT) AS peak_tile_bytes, {D(0.5)} AS memory_reduction_ratio
  FROM (SELECT *, {fmt} AS format FROM (SELECT image_id, width, height, min(a) < 255 AS has_alpha FROM pix GROUP BY ALL))"""


query("asset_plan", " " + _asset_sql("delivery", "smoothEnhance", 1, 1024, "CASE WHEN has_alpha THEN 'webp' ELSE 'jpeg' END", 0.92), L_VIEW)(lambda s, d: tiling.asset_plan(L(s, d)))
query("asset_plan_archive", " " + _asset_sql("archive", "", 0, 2048, "'png'", 0.98))(lambda s, d: tiling.asset_plan(E(s, d), "archive"))
query("asset_plan_preview", " " + _asset_sql("preview", "smoothEnhance", 1, 1024, "'webp'", 0.84), L_VIEW)(lambda s, d: tiling.asset_plan(L(s, d), "preview"))
query("asset_plan_cutout", " " + _asset_sql("transparent-cutout", "unsharpMask", 1, 1024, "'webp'", 0.95))(lambda s, d: tiling.asset_plan(E(s, d), "transparent-cutout"))

# Dimensions and scalars ----------------------------------------------------------------------

_FORMAT_ROWS = ", ".join(f"({i}, '{n}', '{m}', {e}, {a}, {lo}, {en})" for i, (n, m, e, a, lo, en) in enumerate(metadata.FORMATS))
query("format_dim", f"SELECT * FROM (VALUES {_FORMAT_ROWS}) t(position, format, mime, extensions, alpha, lossy, encodable)", "")(lambda s, d: metadata.list_image_formats(s))
# written out, not taken from the code's table
_FILTER_ROWS = """(0, 'identity', 0, 'utility', 'Identity'), (1, 'smoothEnhance', 1, 'enhancement', 'Natural Enhance'), (2, 'sharpen3x3', 1, 'enhancement', 'Crisp Sharpen'),
(3, 'boxBlur3x3', 1, 'enhancement', 'Soft Blur'), (4, 'unsharpMask', 1, 'enhancement', 'Clarity'), (5, 'grayscale', 0, 'creative', 'Grayscale'), (6, 'invert', 0, 'creative', 'Invert')"""
query("filter_dim", f"SELECT * FROM (VALUES {_FILTER_ROWS}) t(position, filter, overlap, category, label)", "")(lambda s, d: metadata.list_pixel_filters(s).drop("description", "paths"))
query("filter_overlap", f", d AS (SELECT * FROM (VALUES {_FILTER_ROWS}) t(position, filter, overlap, category, label)), u AS (SELECT image_id, CAST(image_id % 7 AS INTEGER) AS position FROM pix GROUP BY ALL) SELECT image_id, filter, overlap FROM u JOIN d USING (position)")(
    lambda s, d: E(s, d).select("image_id", (F.col("image_id") % 7).cast("int").alias("position")).distinct().join(F.broadcast(metadata.list_pixel_filters(s)), "position").select("image_id", "filter", "overlap")
)
_EXT = r"nullif(lower(regexp_extract(url, '(?i)\.([a-z0-9]+)(?:[?#].*)?$', 1)), '')"
_KNOWN = "CASE " + " ".join(f"WHEN clean IN ({', '.join(repr(x) for x in dict.fromkeys([n, *e]))}) THEN '{n}'" for n, _, e, *_ in metadata.FORMATS) + " END"
query("infer_format_from_name", f"SELECT page_id, ext, CASE WHEN ext IS NOT NULL THEN (SELECT {_KNOWN} FROM (SELECT ext AS clean)) END AS format FROM (SELECT page_id, {_EXT} AS ext FROM pages)", "")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", metadata.extension_of(F.col("url")).alias("ext")).select("page_id", "ext", metadata.known_format(F.col("ext")).alias("format"))
)
_RAW_NAMES = [" .JPG", "image/webp", "tif", "PNG ", "dib", "avifs", "image/.gif", "jfif"]
_NAMES_SQL = "SELECT image_id, raw, " + _KNOWN.replace("clean", "regexp_replace(regexp_replace(lower(trim(raw)), '^image/', ''), '^\\.', '')")


def _raw_names(s, d):
    ids = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id"))
    return ids.withColumn("raw", F.element_at(F.array(*[F.lit(n) for n in _RAW_NAMES]), (F.col("image_id") % len(_RAW_NAMES) + 1).cast("int")))


_MIMES = ["image/jpeg", "", "", "image/avif", "", "image/x-none"]  # the last stands beside a name without extension only
_BY_NAME = ["a.png", "b.JPG?x=1", "folder.d/c", "d.gif", "e.tif#top", "f.webp"]
query("infer_format", f"SELECT image_id, {['jpeg', 'jpeg', None, 'avif', 'tiff']!r}[image_id % 5 + 1] AS format FROM (SELECT vec_id AS image_id FROM embeddings)".replace("None", "NULL"), "")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("image_id"),
        metadata.infer_format(*[F.element_at(F.array(*[F.lit(x) for x in names[:5]]), (F.col("vec_id") % 5 + 1).cast("int")) for names in (_MIMES, _BY_NAME)]).alias("format"),
    )
)
_RAW_SQL = f"(SELECT vec_id AS image_id, {_RAW_NAMES}[vec_id % {len(_RAW_NAMES)} + 1] AS raw FROM embeddings)"
query("normalize_format", f"{_NAMES_SQL} AS format FROM {_RAW_SQL}", "")(lambda s, d: _raw_names(s, d).withColumn("format", metadata.normalize_format(F.col("raw"))))
query("can_encode", f"SELECT image_id, format, format IN ('png', 'jpeg', 'webp', 'avif') AS encodable, CASE WHEN format IN ('jpeg', 'webp', 'avif') THEN {D(0.92)} END AS quality FROM ({_NAMES_SQL} AS format FROM {_RAW_SQL})", "")(
    lambda s, d: _raw_names(s, d).withColumn("format", metadata.normalize_format(F.col("raw"))).select("image_id", "format", metadata.can_encode(F.col("format")).alias("encodable"), metadata.default_quality(F.col("format")).alias("quality"))
)
query("conversion_metrics", "SELECT page_id, greatest(0, before - after) AS saved_bytes, CASE WHEN before <> 0 THEN greatest(0, before - after) / CAST(before AS DOUBLE) END AS saved_ratio FROM (SELECT page_id, CAST(length(html) AS BIGINT) AS before, CAST(length(url) * 40 AS BIGINT) AS after FROM pages)", "")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.length("html").cast("long").alias("p"), (F.length("url") * 40).cast("long").alias("q")).select("page_id", metadata.saved_bytes(F.col("p"), F.col("q")).alias("saved_bytes"), metadata.saved_ratio(F.col("p"), F.col("q")).alias("saved_ratio"))
)
_AX = lambda lo, hi, n, t: f"CASE WHEN anchor LIKE '{lo}' THEN 24 + {t} / {D(2)} WHEN anchor LIKE '{hi}' THEN {n} - 24 - {t} / {D(2)} ELSE {n} / {D(2)} END"
query("watermark_anchor", f"SELECT image_id, anchor, {_AX('%left', '%right', 'width', 90)} AS x, {_AX('top%', 'bottom%', 'height', 48)} AS y FROM (SELECT *, unnest(['top-left', 'top-center', 'top-right', 'center-left', 'center', 'center-right', 'bottom-left', 'bottom-center', 'bottom-right']) AS anchor FROM img)", DIMS_VIEW)(lambda s, d: watermark.anchors(dims(L(s, d)), 90, 48))
query("watermark_grid", f", g AS (SELECT image_id, width, height, CAST(ceil(sqrt(CAST(width * width + height * height AS DOUBLE))) AS INTEGER) AS d FROM img), s AS (SELECT *, unnest(range(-d, d, 15)) AS gx FROM g), u AS (SELECT *, unnest(range(-d, d, 9)) AS gy FROM s) SELECT image_id, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, width / {D(2)} + gx AS x, height / {D(2)} + gy AS y FROM u", DIMS_VIEW)(lambda s, d: watermark.stamp_grid(dims(L(s, d)), 10, 4, 5, 0))
_FONTS = ["bold 24px Arial", "24px Arial", " 12pt serif", "0px x", "large", "7 px"]
query("watermark_font_height", f"SELECT font, CASE font WHEN '24px Arial' THEN 24 WHEN ' 12pt serif' THEN 12 WHEN '7 px' THEN 7 ELSE 48 END AS text_height FROM (SELECT unnest({_FONTS}) AS font)", "")(lambda s, d: watermark.font_heights(s.createDataFrame([(f,) for f in _FONTS], "font string")))


def _mark_sql(text: str, place: str, own: float) -> str:
    """Pixels with white text of 7 pixels; ``place`` has du and dv, the place from its top left corner."""
    rows = watermark.glyph_rows(text)
    hit = f"du >= 0 AND du < {6 * len(text)} AND dv >= 0 AND dv < 7 AND du % 6 < 5 AND (({rows}[CAST(du // 6 * 7 + dv AS INTEGER) + 1] >> CAST(4 - du % 6 AS INTEGER)) & 1) = 1"
    alpha = f"({D(own)} + a / {D(255)} * {D(1 - own)})"
    mixed = ", ".join(f"CASE WHEN hit THEN {J(f'({D(255 * own)} + {c} * (a / {D(255)}) * {D(1 - own)}) / greatest({alpha}, {D(1e-12)})')} ELSE {c} END AS {c}" for c in "rgb")
    return f", placed AS ({place}), hits AS (SELECT *, {hit} AS hit FROM placed) SELECT {PIX}, {mixed}, CASE WHEN hit THEN {J(f'{alpha} * {D(255)}')} ELSE a END AS a FROM hits"


query("watermark_text", _mark_sql("Ab 7", "SELECT *, CAST(x - (width - 2 - 24) AS BIGINT) AS du, CAST(y - (height - 2 - 7) AS BIGINT) AS dv FROM pix", 0.6), L_VIEW)(
    lambda s, d: watermark.text_watermark(L(s, d), "Ab 7", "7px x", margin=2)
)
_TURN = math.radians(30)
_AROUND = f"""SELECT *, (x + {D(0.5)} - width / {D(2)}) * {D(repr(math.cos(_TURN)))} + (y + {D(0.5)} - height / {D(2)}) * {D(repr(math.sin(_TURN)))} AS u,
  (y + {D(0.5)} - height / {D(2)}) * {D(repr(math.cos(_TURN)))} - (x + {D(0.5)} - width / {D(2)}) * {D(repr(math.sin(_TURN)))} AS v,
  CAST(ceil(sqrt(CAST(width * width + height * height AS DOUBLE))) AS BIGINT) AS d FROM pix"""
# every stamp of the two loops is tried for every pixel
_STAMPS = f"""SELECT p.*, coalesce(s.du, -1) AS du, coalesce(s.dv, -1) AS dv FROM ({_AROUND}) p LEFT JOIN (
  SELECT image_id, x, y, CAST(floor(u - gx + 6) AS BIGINT) AS du, CAST(floor(v - gy + {D(3.5)}) AS BIGINT) AS dv
  FROM (SELECT *, unnest(range(-d, d, 16)) AS gx FROM ({_AROUND})) q, LATERAL (SELECT unnest(range(-q.d, q.d, 11)) AS gy) r
  WHERE u - gx + 6 >= 0 AND u - gx + 6 < 12 AND v - gy + {D(3.5)} >= 0 AND v - gy + {D(3.5)} < 7) s USING (image_id, x, y)"""
query("watermark_tiled", _mark_sql("X9", _STAMPS, 0.3), L_VIEW)(lambda s, d: watermark.text_watermark(L(s, d), "X9", "7px x", opacity=0.5, rotation=30, tile_mode="tile", tile_spacing=4))
query("ai_mask_options", f"SELECT vec_id, greatest({D(0)}, c - 32) AS threshold, {D(54)} AS softness, 2 AS feather_radius, {D(34)} + g * {D(0.35)} AS edge_sensitivity FROM (SELECT vec_id, CAST(vec_id % 256 AS DOUBLE) AS c, CAST(vec_id % 101 AS DOUBLE) AS g FROM embeddings)", "")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[v.alias(k) for k, v in metadata.ai_mask_columns((F.col("vec_id") % 256).cast("double"), (F.col("vec_id") % 101).cast("double")).items()])
)
query("mask_channel_pick", "SELECT image_id, list(a ORDER BY y, x) AS plane FROM pix GROUP BY image_id")(lambda s, d: pack_images(E(s, d)).select("image_id", ai.pick_channel_column(F.col("data"), F.lit(4)).alias("plane")))
query("pack_image_bytes", "SELECT image_id, width, height, count(*) * 4 AS n_bytes, md5(string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' ORDER BY y, x)) AS digest FROM pix GROUP BY image_id, width, height", L_VIEW)(
    lambda s, d: pack_images(L(s, d)).select("image_id", "width", "height", F.length("data").cast("long").alias("n_bytes"), F.md5(F.hex("data").cast("binary")).alias("digest"))
)
query("image_roundtrip", "SELECT * FROM pix", L_VIEW)(lambda s, d: unpack_images(pack_images(L(s, d))))
query("stream_bytes_total", "SELECT count(*) AS chunks, CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) AS total_bytes FROM pages", "")(lambda s, d: _chunks(s, d))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a stream of chunks, through the bounded buffer."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/pages.parquet")
    one = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()  # a stream reads folders
    reader = spark.readStream.schema(pages)
    stream = reader.option("pathGlobFilter", "pages.parquet").parquet(sf) if one else reader.parquet(f"{sf}/pages.parquet")
    return ring_total(stream.select(F.encode("html", "UTF-8").alias("content")))


# The builder ------------------------------------------------------------------------------

_CHAIN = f""", c AS (SELECT image_id, 12 AS width, 10 AS height, x - 4 AS x, y - 6 AS y, r, g, b, a FROM pix WHERE x >= 4 AND x < 16 AND y >= 6 AND y < 16), {_stencil_ctes("smoothEnhance", "c", "sm")},
adj AS (SELECT {PIX}, {", ".join(f"{t}[{c} + 1] AS {c}" for c, t in zip("rgb", _TABLES, strict=True))}, a FROM sm)"""
query("edit_chain", f"{_CHAIN} SELECT * FROM adj", L_VIEW)(lambda s, d: edit(L(s, d)).crop(4, 6, 12, 10).filter("smoothEnhance").adjust(**_TONE).to_df())
_AI_VIEW = f"{E_VIEW}, mask AS (SELECT image_id, x, y, {LUMA} AS m FROM pix)"
_AI_FINE = f"{_feather(2, 58.5)}, fine AS (SELECT image_id, x, y, {_smooth('m', 6, 60)} AS m FROM soft)"
query("ai_remove_background", f"{_AI_FINE} SELECT p.image_id, p.width, p.height, p.x, p.y, r, g, b, {J(f'a * m / {D(255)}')} AS a FROM pix p JOIN fine f ON p.image_id = f.image_id AND p.x = f.x AND p.y = f.y", _AI_VIEW)(lambda s, d: ai.remove_background(E(s, d)))
query("backend_arrow", f", {_stencil_ctes('smoothEnhance', 'pix', 'out')} SELECT * FROM out")(lambda s, d: backend.apply_filter(E(s, d), "smoothEnhance", "arrow"))
_WHOLE = f""", c AS (SELECT image_id, 5 AS width, 6 AS height, x - 1 AS x, y - 2 AS y, r, g, b, CAST(floor(a * m / {D(255)} + {D(0.5)}) AS INTEGER) AS a FROM pix p JOIN fine f USING (image_id, x, y) WHERE x >= 1 AND x < 6 AND y >= 2 AND y < 8),
flat AS (SELECT {PIX}, {_FILL}, 255 AS a FROM c)"""
query("edit_mask_background", f"{_FINE}{_WHOLE} SELECT * FROM flat", MASK_VIEW)(lambda s, d: edit(E(s, d)).mask(masks_of(E(s, d))).crop(1, 2, 5, 6).background((12, 200, 99)).to_df())


@query("flagship", f"{_CHAIN}, flat AS (SELECT image_id, r, g, b FROM adj){_STATS.replace('FROM pix', 'FROM flat')} SELECT s.*, {_B} AS brightness, {_C} AS contrast FROM st s", L_VIEW)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Crop, enhance, adjust; then each image's luma range and what auto-adjust suggests for it."""
    out = edit(L(spark, sf)).crop(4, 6, 12, 10).filter("smoothEnhance").adjust(**_TONE).to_df()
    brightness, contrast = histogram.suggestion(F.col("range_low"), F.col("range_high"))
    return histogram.stats(out).withColumns({"brightness": brightness, "contrast": contrast})
