"""Background removal with a mask provider of the caller's.

No model comes with the engine.  A provider is made once for each Python worker and turns a
batch of images into mask planes; ``luma_provider`` is a stand-in for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..errors import RasterError, require
from ..functions.metadata import MaskOptions, ai_mask_options
from ..sources.images import pack_images
from .mask import apply_mask

#: (h, w, 4) bytes -> (h, w, channels) bytes
Provider = Callable[[np.ndarray], np.ndarray]


def luma_provider() -> Provider:
    """A stand-in, not a model: bright pixels are the subject."""

    def run(rgba: np.ndarray) -> np.ndarray:
        return ((rgba[..., :3].astype(int) * (77, 150, 29)).sum(-1) >> 8)[..., None].astype(np.uint8)

    return run


def pick_channel(planes: np.ndarray) -> np.ndarray:
    """The mask of a provider's answer: the only channel, or the fourth of four or more."""
    channels = planes.shape[2]
    if channels == 1:
        return planes[..., 0]
    if channels >= 4:
        return planes[..., 3]
    raise RasterError(f"A mask needs 1 or at least 4 channels, got {channels}.")


@F.pandas_udf(ArrayType(IntegerType()))
def pick_channel_column(data: pd.Series, channels: pd.Series) -> pd.Series:
    """The same on a BINARY column of interleaved bytes, as an array of INT."""
    return pd.Series([pick_channel(np.frombuffer(d, np.uint8).reshape(1, -1, n))[0].astype(np.int32) for d, n in zip(data, channels, strict=True)])


def create_masks(images: DataFrame, make_provider: Callable[[], Provider]) -> DataFrame:
    """(image_id, x, y, m) of I-form images; the provider is made once a worker process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make_provider()
        for batch in batches:
            for image_id, w, h, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plane = pick_channel(provider(np.frombuffer(d, np.uint8).reshape(h, w, 4)))
                require(plane.shape == (h, w), "The mask has another size than the image.")
                y, x = np.divmod(np.arange(w * h, dtype=np.int32), w)
                yield pa.record_batch([pa.array(np.full(w * h, image_id)), pa.array(x), pa.array(y), pa.array(plane.reshape(-1).astype(np.int32))], ["image_id", "x", "y", "m"])

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, x int, y int, m int")


def remove_background(pixels: DataFrame, make_provider: Callable[[], Provider] = luma_provider, cutoff: float = 38, guard: float = 70, options: MaskOptions | None = None) -> DataFrame:
    """Pixels with the refined mask applied."""
    masks = create_masks(pack_images(pixels), make_provider)
    return apply_mask(pixels, masks, options or ai_mask_options(cutoff, guard))


def capabilities(spark: SparkSession) -> DataFrame:
    """One row: what this session runs on."""
    conf = spark.conf
    return spark.createDataFrame(
        [("catalyst", spark.sparkContext.defaultParallelism, conf.get("spark.sql.adaptive.enabled", "true") == "true", conf.get("spark.sql.codegen.wholeStage", "true") == "true")],
        "backend string, parallelism int, adaptive boolean, codegen boolean",
    )
