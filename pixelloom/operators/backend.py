"""Which execution path filters pixels: expressions in the JVM, or kernels over Arrow tiles.

Both give the same bytes.  A processor that was configured for the session makes the tile path
the default; without one, expressions are.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from ..errors import require
from . import arrow, stencil

BACKENDS = ("auto", "expression", "arrow")


def configure_backend(spark: SparkSession, processor: arrow.Processor | str | None = arrow.builtin) -> None:
    """Filters of this session go through ``processor`` from now on: a function, the dotted name
    ``module:attribute`` of one, or None to go back to expressions.  It is loaded here, once."""
    if isinstance(processor, str):
        module, _, name = processor.partition(":")
        processor = getattr(importlib.import_module(module), name)
    require(processor is None or callable(processor), "A processor is a function.")
    arrow.register_processor(spark, processor)


def backend_ready(spark: SparkSession) -> bool:
    """Whether a processor is configured."""
    return arrow.registered_processor(spark) is not None


def apply_filter(pixels: DataFrame, name: str = "smoothEnhance", backend: str = "auto", tile: int = stencil.TILE) -> DataFrame:
    """One of the seven filters by name, on the path asked for."""
    require(backend in BACKENDS, f"Unknown backend: {backend}.")
    if backend == "arrow" or backend == "auto" and backend_ready(pixels.sparkSession):
        return arrow.process(pixels, name, tile, 1)
    return stencil.apply_filter(pixels, name)
