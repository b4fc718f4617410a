"""Golden values, edge cases, validation, and equal results of the two execution paths."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pixelloom.errors import RasterError
from pixelloom.functions import exprs, metadata
from pixelloom.operators import ai, arrow, geometry, histogram, mask, point, stencil, tiling, watermark
from pixelloom.plans import edit
from pixelloom.plans.builder import Step, simplify
from pixelloom.sources.images import create_images, encode_images, encode_png, optimize_images, pack_images, read_images, unpack_images
from pixelloom.streaming import ByteRing, chunk_stream, pipe_chunks
from pixelloom.streaming.ingest import run_chunks

SCHEMA = "image_id long, width int, height int, x int, y int, r int, g int, b int, a int"


def image(spark, width, pixels, image_id=0):
    rows = [(image_id, width, len(pixels) // width, i % width, i // width, *(p if len(p) == 4 else (*p, 255))) for i, p in enumerate(pixels)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return [(r.r, r.g, r.b, r.a) for r in df.orderBy("y", "x").collect()]


def masks(spark, width, plane):
    return spark.createDataFrame([(0, i % width, i // width, v) for i, v in enumerate(plane)], "image_id long, x int, y int, m int")


@pytest.mark.parametrize("name, want", [("invert", (245, 235, 225, 255)), ("grayscale", (18, 18, 18, 255)), ("identity", (10, 20, 30, 255))])
def test_point_goldens(spark, name, want):
    px = image(spark, 2, [(10, 20, 30), (50, 60, 70), (90, 100, 110), (130, 140, 150)])
    assert values(stencil.apply_filter(px, name))[0] == want


@pytest.mark.parametrize("name, base, centre, want", [("sharpen3x3", 10, 100, 255), ("smoothEnhance", 10, 100, 125), ("unsharpMask", 10, 100, 142), ("boxBlur3x3", 0, 90, 10)])
def test_stencil_goldens(spark, name, base, centre, want):
    px = [(base,) * 3] * 9
    px[4] = (centre,) * 3
    assert values(stencil.apply_filter(image(spark, 3, px), name))[4][:3] == (want,) * 3


def test_pipeline_and_geometry_goldens(spark):
    assert values(stencil.apply_filters(image(spark, 1, [(10, 20, 30)]), ["grayscale", "invert"])) == [(237, 237, 237, 255)]
    sample = image(spark, 2, [(30 * p + 10, 30 * p + 20, 30 * p + 30) for p in range(4)])
    assert [v[:3] for v in values(geometry.crop(sample, 1, 0, 1, 2))] == [(40, 50, 60), (100, 110, 120)]
    assert values(geometry.resize(sample, 1, 1)) == [(55, 65, 75, 255)]
    assert [v[0] for v in values(geometry.resize(sample, 4, 4, "nearest"))[:4]] == [10, 10, 40, 40]
    assert values(point.fill_transparent(image(spark, 1, [(255, 0, 0, 0), (255, 0, 0, 255)]), (12, 20, 28))) == [(12, 20, 28, 255), (255, 0, 0, 255)]


def test_mask_goldens(spark):
    px = image(spark, 2, [(20, 30, 40, 255), (20, 30, 40, 128), (20, 30, 40), (20, 30, 40)])
    small = masks(spark, 1, [128])
    wide = geometry.resize_mask(small, 1, 1, 2, 2)
    out = mask.apply_mask(px, wide, metadata.MaskOptions(0, 0, 0, 48))
    assert [v[3] for v in values(out)] == [255, 128, 255, 255]
    edge = image(spark, 3, [(240,) * 3, (20,) * 3, (20,) * 3])
    soft = mask.feather_mask(edge, masks(spark, 3, [0, 128, 255]), metadata.MaskOptions(0, 255, 1, 20))
    assert [r.m for r in soft.orderBy("x").collect()] == [0, 189, 255]
    counts = mask.mask_counts(image(spark, 3, [(0, 0, 0, 0), (0, 0, 0, 100), (0, 0, 0, 255)])).first()
    assert (counts.removed_pixels, counts.partial_pixels) == (2, 1)


def test_histogram_quirks(spark):
    solid = histogram.stats(image(spark, 2, [(128,) * 3] * 4)).first()
    assert (solid.range_low, solid.range_high, solid.pixel_count) == (127, 127, 4)
    black = image(spark, 2, [(0, 0, 0, 0)] * 4)
    assert tuple(histogram.auto_adjust(black).first())[1:] == (0, -11)
    full = histogram.dense(histogram.histogram(black))
    assert full.count() == 4 * 256 and full.agg(F.sum("cnt")).first()[0] == 16


def test_tiling_goldens(spark):
    rows = tiling.plan_tiles(spark.createDataFrame([(0, 5, 5)], "image_id long, width int, height int"), 3, 1).orderBy("tile_index").collect()
    assert len(rows) == 4
    assert (rows[0].in_w, rows[0].in_h, rows[0].out_w) == (4, 4, 3)
    assert (rows[3].in_x, rows[3].in_y, rows[3].in_w, rows[3].out_x, rows[3].out_w) == (2, 2, 3, 3, 2)
    assert tiling.choose_tile_size(64 * 2**20, 1) == 2048 and tiling.choose_tile_size(1e6, 1, 300) == 300
    assert tiling.choose_tile_size(tiling.WORKER_BYTES, 1) == 1024 and tiling.choose_tile_size(tiling.WORKER_BYTES, 0) == 2048
    big = spark.createDataFrame([(0, 65536, 32768)], "image_id long, width int, height int")
    plan = tiling.processing_plan(big, 2048, 1, lanes=4).first()
    assert plan.tile_count == 512 and plan.full_frame_bytes == 8_589_934_592 and 63.9 < plan.memory_reduction_ratio < 64
    assert [r.percent for r in tiling.progress(spark.createDataFrame([(0, 3, 2)], "image_id long, width int, height int"), 2).orderBy("tile_index").collect()] == [50, 100]
    opaque = tiling.asset_plan(image(spark, 2, [(1, 2, 3)] * 2)).first()
    assert (opaque.format, opaque.quality, opaque.filters, opaque.overlap) == ("jpeg", 0.92, "smoothEnhance", 1)
    cut = tiling.asset_plan(image(spark, 2, [(1, 2, 3, 128), (1, 2, 3)]), "transparent-cutout").first()
    assert cut.has_alpha and (cut.format, cut.filters) == ("webp", "unsharpMask")


@pytest.mark.parametrize("name", stencil.STENCILS)
@pytest.mark.parametrize("tile", [2, 3, 100])
def test_tile_size_and_path_do_not_matter(spark, name, tile):
    px = image(spark, 5, [((i * 37) % 256, (i * 91) % 256, (i * i) % 256, 255 - i) for i in range(35)])
    want = values(stencil.stencil(px, name))
    assert values(stencil.stencil(px, name, tile)) == want
    assert values(arrow.process(px, name, tile, 1)) == want
    assert values(unpack_images(arrow.filter_images(pack_images(px), [name]))) == want


def test_processor_precedence_and_checks(spark):
    px = image(spark, 2, [(1, 2, 3)] * 4)
    arrow.register_processor(spark, lambda rgba, i, o, n: rgba * 0 + 7)
    try:
        assert values(arrow.process(px, "identity", 2, 0))[0] == (7, 7, 7, 7)
        assert values(arrow.process(px, "identity", 2, 0, lambda rgba, i, o, n: rgba * 0 + 9))[0][0] == 9
    finally:
        arrow.register_processor(spark, None)
    assert arrow.registered_processor(spark) is None
    with pytest.raises(RasterError):
        arrow.filter_tile(b"123", (0, 0, 1, 1), (0, 0, 1, 1), "invert")
    with pytest.raises(RasterError):
        arrow.filter_tile(b"1234", (0, 0, 1, 1), (0, 0, 1, 1), "invert", lambda *a: a[0][:0])


def test_builder_rules(spark):
    px = image(spark, 6, [((i * 53) % 256, (i * 17) % 256, i, 255) for i in range(36)])
    for chain in (lambda e: e.filter("smoothEnhance").crop(1, 1, 4, 3), lambda e: e.filter("invert").filter("invert").crop(0, 0, 3, 3).crop(1, 1, 2, 2), lambda e: e.filter("grayscale").adjust(brightness=9).crop(2, 0, 3, 6)):
        built = chain(edit(px))
        plain = px
        for s in built.steps:
            plain = geometry.crop(plain, **s.args) if s.kind == "crop" else point.adjust(plain, **s.args) if s.kind == "adjust" else stencil.apply_filter(plain, s.args["name"])
        assert values(built.to_df()) == values(plain)
    kinds = [s.kind for s in simplify((Step("filter", {"name": "identity"}), Step("adjust", {"gamma": 1}), Step("crop", dict(x=0, y=0, width=3, height=3)), Step("crop", dict(x=1, y=1, width=1, height=1))))]
    assert kinds == ["crop"]
    branch = edit(px).filter("invert")
    assert values(branch.filter("grayscale").to_df()) != values(branch.to_df())
    assert branch.plan().count() == 1 and branch.histogram().count() > 0


@pytest.mark.parametrize(
    "call",
    [
        lambda s: create_images(s, 0, 1), lambda s: create_images(s, 1, 1, (256, 0, 0)), lambda s: tiling.check_tiles(1, 1), lambda s: metadata.filter_overlap("x"),
        lambda s: geometry.resize(create_images(s, 1, 1), 1, 1, "cubic"), lambda s: metadata.MaskOptions(threshold=256), lambda s: metadata.MaskOptions(edge_sensitivity=0),
        lambda s: exprs.check_adjust(hue=181), lambda s: exprs.check_adjust(gamma=0), lambda s: metadata.check_watermark(" "), lambda s: metadata.check_watermark("a", opacity=2),
        lambda s: metadata.normalize_format_name("xyz"), lambda s: metadata.check_quality(1.5), lambda s: tiling.choose_tile_size(1, 1), lambda s: ByteRing(0),
        lambda s: metadata.ai_mask_options(cutoff=300), lambda s: exprs.check_kernel([1.0]), lambda s: stencil.apply_filters(create_images(s, 1, 1), []),
        lambda s: watermark.stamp_grid(create_images(s, 1, 1), 5, 5, 0), lambda s: edit(create_images(s, 1, 1)).crop(-1, 0, 1, 1), lambda s: encode_images(pack_images(create_images(s, 1, 1)), "webp"),
        lambda s: ai.pick_channel(__import__("numpy").zeros((1, 1, 2))), lambda s: arrow.process(create_images(s, 4, 4), "sharpen3x3", 2, 0),
    ],
)
def test_bad_options_raise_before_any_job(spark, call):
    with pytest.raises(RasterError):
        call(spark)


def test_bad_data_raises(spark):
    with pytest.raises(PySparkException):
        unpack_images(spark.createDataFrame([(0, 2, 2, b"123")], "image_id long, width int, height int, data binary")).collect()
    with pytest.raises(PySparkException):
        geometry.crop(image(spark, 2, [(1, 2, 3)] * 4), 1, 0, 2, 2).collect()
    with pytest.raises(PySparkException):
        spark.createDataFrame([("xyz",)], "n string").select(metadata.normalize_format(F.col("n"))).collect()


def test_formats_and_scalars(spark):
    assert [metadata.normalize_format_name(n) for n in (".jpg", "image/webp", "tif")] == ["jpeg", "webp", "tiff"]
    assert metadata.list_image_formats(spark).count() == 7 and metadata.list_pixel_filters(spark).count() == 7
    assert metadata.ai_mask_options() == metadata.MaskOptions(6, 54, 2, 58.5)
    exprs.register_sql(spark)
    assert tuple(spark.sql("SELECT luma(10, 20, 30), clamp_u8(300), jround(-2.5D), smoothstep_u8(5, 0, 10)").first()) == (18, 255, -2, 128)
    assert ai.capabilities(spark).first().backend == "catalyst"


def test_png_roundtrip(spark, tmp_path):
    px = image(spark, 2, [(1, 2, 3, 4), (5, 6, 7, 255), (0, 0, 0, 0), (255, 254, 253, 252)])
    blob = encode_images(pack_images(px)).first().blob
    (tmp_path / "a.png").write_bytes(bytes(blob))
    assert values(unpack_images(read_images(spark, str(tmp_path)).drop("origin"))) == values(px)
    original = pack_images(px).withColumn("blob", F.lit(b"x"))
    assert optimize_images(original).first().kept_original
    assert not optimize_images(original.withColumn("blob", F.lit(b""))).first().kept_original
    assert encode_png(1, 1, b"\0\0\0\0").startswith(b"\x89PNG")




def test_tile_source(spark):
    from pixelloom.sources.tiles import register, tile_rects

    assert len(tile_rects(5, 5, 3, 1)) == 4
    register(spark)
    tiles = spark.read.format("rastertiles").options(width=5, height=4, tileSize=2, overlap=0, provider="pixelloom.sources.demo:ramp").load()
    got = values(tiling.from_tiles(tiles))
    assert got[7] == (2, 1, 0, 255) and len(got) == 20


def test_ring_and_stream(spark, tmp_path):
    ring = ByteRing(4)
    ring.write_all(b"123")
    assert ring.read(2) == b"12"
    ring.write_all(b"456")
    assert ring.read(9) == b"3456" and ByteRing(5).capacity == 8
    with pytest.raises(RasterError):
        ByteRing(2).write_all(b"123")
    seen = []
    assert pipe_chunks([b"\1\2", b"\3"], seen.append, 2) == 3 and len(seen) == 2
    (tmp_path / "in").mkdir()
    for i, body in enumerate((b"abc", b"defg")):
        (tmp_path / "in" / f"{i}.bin").write_bytes(body)
    sizes = []
    query = run_chunks(chunk_stream(spark, str(tmp_path / "in")), lambda df, n: sizes.extend(r.length for r in df.collect()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert sorted(sizes) == [3, 4]


@settings(max_examples=40, deadline=None)
@given(st.integers(-(2**31), 2**31 - 1), st.floats(-300, 300))
def test_plan_time_rounding(n, x):
    assert exprs.py_round(x) - x <= 0.5 and x - exprs.py_round(x) < 0.5 + 1e-9
    assert sum(exprs.colour_matrix(n % 360 - 180, 0)[0]) in (255, 256, 257)
