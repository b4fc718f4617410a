"""Whole passes over image collections: steps with their own tiles, statistics, progress, stopping."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.metadata import DEFAULT_QUALITY, check_quality, default_quality, extension_of, known_format, normalize_format_name, saved_bytes, saved_ratio
from ..operators.arrow import Processor, check_overlap, process, process_tiles
from ..operators.tiling import check_tiles, from_tiles, to_tiles
from ..sources.images import encode_images

TILE, OVERLAP = 512, 1


@dataclass(frozen=True)
class FilterStep:
    """One filter of a pass; tile and overlap default to the pass's own."""

    filter: str
    tile: int | None = None
    overlap: int | None = None


def _resolved(steps: list[FilterStep | str], tile: int, overlap: int) -> list[FilterStep]:
    require(len(steps) > 0, "A pipeline needs at least one step.")
    out = []
    for s in steps:
        s = FilterStep(s) if isinstance(s, str) else s
        s = FilterStep(s.filter, s.tile or tile, overlap if s.overlap is None else s.overlap)
        check_tiles(s.tile, s.overlap)
        check_overlap(s.filter, s.overlap)
        out.append(s)
    return out


def process_pipeline(pixels: DataFrame, steps: list[FilterStep | str], tile: int = TILE, overlap: int = OVERLAP, processor: Processor | None = None) -> DataFrame:
    """Steps in order through tiles; every step is checked before the first one is planned."""
    for s in _resolved(steps, tile, overlap):
        pixels = process(pixels, s.filter, s.tile, s.overlap, processor)
    return pixels


def process_with_stats(pixels: DataFrame, filter: str = "identity", tile: int = TILE, overlap: int = OVERLAP, processor: Processor | None = None) -> tuple[DataFrame, Observation]:
    """The processed pixels, and total_tiles and output_bytes observed when they are computed."""
    (step,) = _resolved([filter], tile, overlap)
    seen = Observation("tiles")
    tiles = process_tiles(to_tiles(pixels, step.tile, step.overlap), step.filter, processor)
    tiles = tiles.observe(seen, F.count("*").alias("total_tiles"), F.sum(F.length("rgba")).cast("long").alias("output_bytes"))
    return from_tiles(tiles), seen


@dataclass(frozen=True)
class ProcessStats:
    total_tiles: int
    processed_tiles: int
    output_bytes: int
    elapsed_ms: float


def run_tiles(
    tiles: DataFrame,
    filter: str,
    write: Callable[[DataFrame], None],
    processor: Processor | None = None,
    on_progress: Callable[[int, int], None] | None = None,
    interval: float = 0.5,
    tag: str | None = None,
) -> ProcessStats:
    """From a tile source through a filter to a sink, in one job: ``tiles`` is T-form (as the tile
    source or ``to_tiles`` give it), ``write`` hands a T-form table to its sink.

    ``on_progress`` gets the finished and all tasks of the pass every ``interval`` seconds while it
    runs, and once at its end.  ``stop`` with the tag, from another thread, ends it with an error.
    """
    spark, seen, tag = tiles.sparkSession, Observation(), tag or f"tiles-{uuid.uuid4().hex}"
    read = Observation()
    source = tiles.observe(read, F.count("*").alias("total_tiles"))
    done = process_tiles(source, filter, processor)
    done = done.observe(seen, F.count("*").alias("processed_tiles"), F.coalesce(F.sum(F.length("rgba")), F.lit(0)).cast("long").alias("output_bytes"))
    over = threading.Event()

    def watch() -> None:
        while not over.wait(interval):
            running = progress(spark)
            if running:
                on_progress(sum(r[1] for r in running), sum(r[2] for r in running))

    watcher = threading.Thread(target=watch, daemon=True) if on_progress else None
    began = time.monotonic()
    if watcher:
        watcher.start()
    try:
        with tagged(spark, tag):
            write(done)
    finally:
        over.set()
        if watcher:
            watcher.join()
    stats = ProcessStats(read.get["total_tiles"], seen.get["processed_tiles"], seen.get["output_bytes"], (time.monotonic() - began) * 1000)
    if on_progress:
        on_progress(stats.processed_tiles, stats.total_tiles)
    return stats


@contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs inside carry the tag; ``stop`` ends them."""
    context = spark.sparkContext
    context.setInterruptOnCancel(True)
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)


def stop(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, finished tasks, all tasks) of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return [(i.stageId, i.numCompletedTasks, i.numTasks) for i in infos if i is not None]


def convert_images(images: DataFrame, format: str = "png", background: tuple[int, int, int] = (255, 255, 255), quality: float | None = None) -> DataFrame:
    """(image_id, blob, output_bytes, saved_bytes, saved_ratio) of I-form images with input_bytes.

    PNG and JPEG can be encoded; JPEG has no alpha, so images are flattened onto ``background``.
    """
    format = normalize_format_name(format)
    check_quality(quality)
    rows = encode_images(images, format, DEFAULT_QUALITY if quality is None else quality, background, keep=("input_bytes",))
    before, size = F.col("input_bytes").cast("long"), F.length("blob").cast("long")
    return rows.select("image_id", "blob", size.alias("output_bytes"), saved_bytes(before, size).alias("saved_bytes"), saved_ratio(before, size).alias("saved_ratio"))


def format_of(files: DataFrame) -> DataFrame:
    """(path, format, quality) by the files' names; null where the name says nothing known.
    ``metadata.infer_format`` is the strict form: an unknown extension is an error there."""
    fmt = known_format(extension_of(F.col("path")))
    return files.select("path", fmt.alias("format"), default_quality(fmt).alias("quality"))
