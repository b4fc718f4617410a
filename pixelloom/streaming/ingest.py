"""Bounded ingestion of byte chunks: a ring buffer, and Structured Streaming over files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import positive_int, require

CHUNK_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


class ByteRing:
    """First-in first-out bytes in a fixed buffer; its size is the next power of two."""

    def __init__(self, capacity: int = 64 * 1024 * 1024):
        positive_int(capacity, "capacity")
        self.capacity = 1 << (capacity - 1).bit_length()
        self._data, self._head, self.size = bytearray(self.capacity), 0, 0

    @property
    def free(self) -> int:
        return self.capacity - self.size

    def write(self, chunk: bytes) -> int:
        """Takes what fits and says how much that was."""
        n = min(len(chunk), self.free)
        at = (self._head + self.size) % self.capacity
        first = min(n, self.capacity - at)
        self._data[at : at + first] = chunk[:first]
        self._data[: n - first] = chunk[first:n]
        self.size += n
        return n

    def write_all(self, chunk: bytes) -> None:
        require(len(chunk) <= self.free, "Ring buffer overflow.")
        self.write(chunk)

    def read(self, n: int) -> bytes:
        n = min(n, self.size)
        first = min(n, self.capacity - self._head)
        out = bytes(self._data[self._head : self._head + first]) + bytes(self._data[: n - first])
        self._head, self.size = (self._head + n) % self.capacity, self.size - n
        return out

    def clear(self) -> None:
        self._head = self.size = 0


def pipe_chunks(chunks: Iterable[bytes], on_chunk: Callable[[bytes], None], capacity: int = 64 * 1024 * 1024, aborted: Callable[[], bool] = lambda: False) -> int:
    """Every chunk through a bounded buffer to the callback; the total of bytes.  ``aborted`` is asked
    before each chunk; where it says so, an error ends the ingestion."""
    ring, total = ByteRing(capacity), 0
    for chunk in chunks:
        require(not aborted(), "The ingestion was aborted.")
        require(len(chunk) <= ring.capacity, "Chunk is larger than the buffer.")
        ring.write_all(chunk)
        on_chunk(ring.read(len(chunk)))
        total += len(chunk)
    return total


def chunk_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream of chunks; one file a batch is one chunk a callback."""
    return spark.readStream.format("binaryFile").schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", positive_int(files_per_batch, "files")).load(path)


def run_chunks(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """What is there now, batch by batch; ``query.stop()`` ends between batches."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring_total(stream: DataFrame, capacity: int = 64 * 1024 * 1024, column: str = "content", folder: str | None = None) -> DataFrame:
    """(chunks, total_bytes) of a stream of chunks that is there now: every batch goes through a
    bounded buffer in each task, and its totals are written before the next one starts.

    ``folder`` is shared by driver and executors: that of ``spark.checkpoint.dir`` by default, a
    temporary one where the master is local.
    """
    spark = stream.sparkSession
    base = f"{folder or shared_folder(spark)}/chunks-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def chunks() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for chunk in batch.column(0):
                    count += 1
                    yield chunk.as_py() or b""

        total = pipe_chunks(chunks(), lambda chunk: None, capacity)
        yield pa.record_batch([pa.array([count], pa.int64()), pa.array([total], pa.int64())], ["chunks", "total_bytes"])

    def on_batch(rows: DataFrame, number: int) -> None:
        rows.select(column).mapInArrow(run, "chunks long, total_bytes long").write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run_chunks(stream, on_batch, f"{base}/state").awaitTermination()
    done = spark.read.schema("chunks long, total_bytes long").option("recursiveFileLookup", True).parquet(f"{base}/out")
    return done.agg(F.coalesce(F.sum("chunks"), F.lit(0).cast("long")).alias("chunks"), F.coalesce(F.sum("total_bytes"), F.lit(0).cast("long")).alias("total_bytes"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is not set, a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    require(spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master, "Set spark.checkpoint.dir to a folder that all executors share.")
    return "file://" + tempfile.mkdtemp(prefix="scratch-")


def chunk_total(chunks: DataFrame, column: str = "content") -> DataFrame:
    """(chunks, total_bytes) of a table or stream of chunks."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length(column)), F.lit(0)).cast("long").alias("total_bytes"))
