"""Passes over collections."""

import threading

import pytest
from pyspark.sql import functions as F

from pixelloom.errors import RasterError
from pyspark.errors import PySparkException

from pixelloom.functions import metadata
from pixelloom.operators import backend, geometry, stencil, tiling, watermark
from pixelloom.plans import edit
from pixelloom.plans.process import FilterStep, convert_images, format_of, process_pipeline, process_with_stats, progress, run_tiles, stop, tagged
from pixelloom.sources.images import create_images, pack_images, read_images, unpack_images
from pixelloom.streaming import pipe_chunks

KEY = ["image_id", "y", "x"]


@pytest.fixture()
def pixels(spark):
    base = create_images(spark, 7, 5, (10, 20, 30))
    return base.withColumns({"r": (F.col("x") * 31 + F.col("y") * 17) % 256, "g": (F.col("x") * F.col("y")) % 256})


def rows(df):
    return df.select(*KEY, "r", "g", "b", "a").orderBy(KEY).collect()


def test_steps_have_their_own_tiles(spark, pixels):
    got = process_pipeline(pixels, [FilterStep("boxBlur3x3", 3, 1), FilterStep("grayscale", 2, 0), "sharpen3x3"], 4, 1)
    assert rows(got) == rows(stencil.apply_filters(pixels, ["boxBlur3x3", "grayscale", "sharpen3x3"]))
    for bad in ([], [FilterStep("sharpen3x3", 4, 0)], [FilterStep("none")], [FilterStep("invert", 2, 2)]):
        with pytest.raises(RasterError):
            process_pipeline(pixels, bad)


def test_stats_are_observed(spark, pixels):
    out, seen = process_with_stats(pixels, "invert", 4, 1)
    assert out.count() == 35
    assert seen.get == {"total_tiles": 4, "output_bytes": 140}


def test_tags_and_progress(spark, pixels):
    with tagged(spark, "pass"):
        assert pixels.count() == 35
    stop(spark, "pass")
    assert isinstance(progress(spark), list)


def test_conversion(spark, pixels):
    got = convert_images(pack_images(pixels).withColumn("input_bytes", F.lit(1000))).first()
    assert got.saved_bytes == 1000 - got.output_bytes and 0 < got.saved_ratio < 1
    names = format_of(spark.createDataFrame([("a/b.JPG?x=1",), ("c.tif",), ("none",)], "path string")).collect()
    assert [(r.format, r.quality) for r in names] == [("jpeg", 0.92), ("tiff", None), (None, None)]


def test_source_filter_sink(spark, pixels, tmp_path):
    seen, tiles = [], tiling.to_tiles(pixels, 4, 1)
    stats = run_tiles(tiles, "sharpen3x3", lambda df: df.write.parquet(str(tmp_path / "out")), on_progress=lambda done, total: seen.append((done, total)), interval=0.05)
    assert (stats.total_tiles, stats.processed_tiles, stats.output_bytes) == (4, 4, 140) and stats.elapsed_ms > 0
    assert seen[-1] == (4, 4)
    assert rows(tiling.from_tiles(spark.read.parquet(str(tmp_path / "out")))) == rows(stencil.apply_filter(pixels, "sharpen3x3"))


def test_a_pass_can_be_stopped(spark, pixels):
    def slow(rgba, i, o, n):
        import time

        time.sleep(2)
        return rgba[: o[3], : o[2]]

    over = threading.Event()

    def halt():
        while not over.wait(1):
            stop(spark, "halt")

    threading.Thread(target=halt, daemon=True).start()
    try:
        with pytest.raises(Exception, match="(?i)cancel|interrupt"):
            run_tiles(tiling.to_tiles(pixels, 1, 0), "identity", lambda df: df.write.format("noop").mode("overwrite").save(), slow, tag="halt")
    finally:
        over.set()
    seen = []
    with pytest.raises(RasterError):
        pipe_chunks([b"a", b"b", b"c"], seen.append, 4, aborted=lambda: len(seen) == 2)
    assert seen == [b"a", b"b"]


def test_backend(spark, pixels):
    want = rows(stencil.apply_filter(pixels, "unsharpMask"))
    assert rows(backend.apply_filter(pixels, "unsharpMask", "arrow", 3)) == rows(backend.apply_filter(pixels, "unsharpMask", "expression")) == want
    assert not backend.backend_ready(spark)
    try:
        backend.configure_backend(spark, "pixelloom.operators.arrow:builtin")
        assert backend.backend_ready(spark) and rows(edit(pixels).filter("unsharpMask").to_df()) == want
    finally:
        backend.configure_backend(spark, None)
    with pytest.raises(RasterError):
        backend.apply_filter(pixels, "invert", "gpu")


def test_jpeg_is_read_again(spark, tmp_path):
    n = 37
    base = create_images(spark, n, 21).withColumns({"r": F.col("x") * 6, "g": F.col("y") * 9, "b": F.lit(90), "a": F.lit(255)})
    for quality, most in ((0.95, 6), (0.3, 40)):
        got = convert_images(pack_images(base).withColumn("input_bytes", F.lit(1)), "jpg", quality=quality).first()
        folder = tmp_path / str(quality)
        folder.mkdir()
        (folder / "a.jpg").write_bytes(bytes(got.blob))
        back = unpack_images(read_images(spark, str(folder)).drop("origin")).drop("image_id")
        both = back.join(base.select("x", "y", *[F.col(c).alias(f"_{c}") for c in "rgb"]), ["x", "y"])
        assert both.count() == n * 21
        assert both.agg(*[F.max(F.abs(F.col(c) - F.col(f"_{c}"))) for c in "rgb"]).first()[0] <= most
    clear = pack_images(create_images(spark, 8, 8, (0, 0, 0, 0))).withColumn("input_bytes", F.lit(1))
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.jpg").write_bytes(bytes(convert_images(clear, "jpeg", (200, 10, 20)).first().blob))
    red = unpack_images(read_images(spark, str(tmp_path / "flat")).drop("origin")).first()
    assert abs(red.r - 200) < 4 and abs(red.g - 10) < 4 and red.a == 255
    with pytest.raises(RasterError):
        convert_images(clear, "webp")


def test_broken_files_are_not_lost(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(PySparkException):
        read_images(spark, str(tmp_path)).collect()
    row = read_images(spark, str(tmp_path), keep_broken=True).first()
    assert row.origin.endswith("bad.png") and row.data is None and row.width is None


def test_strict_formats(spark):
    names = spark.createDataFrame([("", "a.JPG"), ("image/avif", "b.png"), (None, "c")], "m string, n string")
    assert [r[0] for r in names.select(metadata.infer_format(F.col("m"), F.col("n"))).collect()] == ["jpeg", "avif", None]
    for mime, name in (("", "a.xyz"), ("text/html", "a.png")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(mime, name)], "m string, n string").select(metadata.infer_format(F.col("m"), F.col("n"))).collect()
    assert metadata.format_profile(".JPG")["mime"] == "image/jpeg" and metadata.filter_profile("invert")["category"] == "creative"
    with pytest.raises(RasterError):
        metadata.format_profile("xyz")


def test_watermark_goldens(spark):
    one = spark.createDataFrame([(0, 30, 40)], "image_id long, width int, height int")
    assert watermark.stamp_grid(one, 10, 10, 10).count() == 25
    assert {r.anchor for r in watermark.anchors(one, 4, 4).collect()} >= {"center-left", "center-right", "center"}
    blank = create_images(spark, 30, 20, (0, 0, 0, 255))
    drawn = watermark.text_watermark(blank, "I", "7px x", (255, 255, 255, 1.0), 1.0, "top-left", 0)
    lit = {(r.x, r.y) for r in drawn.where("r = 255").collect()}
    assert lit == {(x, 0) for x in (1, 2, 3)} | {(x, 6) for x in (1, 2, 3)} | {(2, y) for y in range(7)}
    turned = watermark.text_watermark(blank, "I", "7px x", (255, 255, 255, 1.0), 1.0, "center", 0, rotation=90)
    assert turned.where("r = 255").count() > 0
    for bad in (dict(tile_mode="grid"), dict(position="middle-left"), dict(tile_spacing=0)):
        with pytest.raises(RasterError):
            watermark.text_watermark(blank, "I", **bad)


def test_crop_outside_is_an_error(spark):
    small = create_images(spark, 4, 4)
    for chain in (lambda: geometry.crop(small, 100, 100, 2, 2), lambda: edit(small).filter("sharpen3x3").crop(100, 100, 2, 2).to_df()):
        with pytest.raises(PySparkException, match="outside image bounds"):
            chain().collect()


def test_a_large_image_is_many_tasks(spark):
    wide = create_images(spark, 2100, 600, (9, 9, 9), spark.range(1).withColumnRenamed("id", "image_id"))
    tiles = stencil.deal(wide, 512, 1).select("tx", "ty").distinct()
    assert tiles.count() == 10
    plan = stencil.stencil(wide, "sharpen3x3")._jdf.queryExecution().executedPlan().toString()
    dealt = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert len(dealt) == 2 and all(x in dealt[0] for x in ("image_id#", "tx#", "ty#")) and " y#" in dealt[1]
