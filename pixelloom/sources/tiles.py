"""Tile source and sink in Spark's Python data source API.

``spark.read.format("rastertiles")`` reads rectangles from a provider of the caller's, one
input partition for each tile; ``df.write.format("rastertiles")`` hands tiles to a sink.
Options: width, height, tileSize, overlap, imageId, and provider or sink, a dotted name
``module:attribute`` importable on the executors.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import require
from ..operators.arrow import TILE_SCHEMA
from ..operators.tiling import check_tiles


def _named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def tile_rects(width: int, height: int, tile: int, overlap: int) -> list[tuple[int, tuple, tuple]]:
    """(index, input, output) rectangles in row order."""
    check_tiles(tile, overlap)
    out = []
    for y in range(0, height, tile):
        for x in range(0, width, tile):
            w, h = min(tile, width - x), min(tile, height - y)
            left, top = max(0, x - overlap), max(0, y - overlap)
            out.append((len(out), (left, top, min(width, x + w + overlap) - left, min(height, y + h + overlap) - top), (x, y, w, h)))
    return out


class _Tile(InputPartition):
    def __init__(self, tile):
        super().__init__(tile)
        self.tile = tile


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.size = int(options["width"]), int(options["height"])
        self.tiles = tile_rects(*self.size, int(options.get("tileSize", 512)), int(options.get("overlap", 1)))
        self.image_id, self.provider = int(options.get("imageId", 0)), options["provider"]

    def partitions(self):
        return [_Tile(t) for t in self.tiles]

    def read(self, partition: _Tile) -> Iterator[tuple]:
        index, in_rect, out_rect = partition.tile
        data = bytes(_named(self.provider)(in_rect))
        want = in_rect[2] * in_rect[3] * 4
        require(len(data) == want, f"Tile source returned {len(data)} bytes, expected {want}.")
        yield (self.image_id, *self.size, index, in_rect, out_rect, data)


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.sink = options["sink"]

    def write(self, rows) -> WriterCommitMessage:
        sink = _named(self.sink)
        for row in rows:
            rect = tuple(row.out_rect)
            require(len(row.rgba) == rect[2] * rect[3] * 4, "Tile byte length mismatch.")
            sink(row.image_id, rect, bytes(row.rgba))
        return WriterCommitMessage()


class RasterTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rastertiles"

    def schema(self) -> str:
        return TILE_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterTiles)
