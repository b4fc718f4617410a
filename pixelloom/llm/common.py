"""Helpers shared by the training-data operators.

* ``Scratch`` writes intermediate tables to the folder named by
  ``spark.checkpoint.dir`` so that a lost executor never takes lineage with it.
* ``text_chunks`` and ``Words`` turn Arrow string columns into numpy arrays of
  word hashes without a Python object per word.
* ``components`` finds connected components of an edge table in Spark.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer single text is one pass.
CHUNK_BYTES = 1 << 20

#: Rows that go to Python at a time: whole texts are long, and each task holds a batch in the
#: JVM and one in Python.
BATCH_ROWS = 1000

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of this application's, if its
    master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _OWN[context.applicationId]


class Scratch:
    """Intermediate Parquet tables in the shared checkpoint folder.

    Without ``spark.checkpoint.dir`` a local master gets a temporary folder; a cluster is an error,
    as its executors share none.  Tables that a returned DataFrame still reads stay until
    ``release``.
    """

    #: Folders that are not deleted yet.
    live: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self.live.append(self.base)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads, and let Spark free shuffle files."""
        _delete(self.spark, [f"{self.base}/{name}" for name in names])
        gc.collect()
        self.spark._jvm.System.gc()


def _delete(spark: SparkSession, folders: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete what operators of this process have written to the shared folder, but for the folders
    ``keep``: once their results are written, nothing reads it any more."""
    gone = [f for f in Scratch.live if f not in keep]
    _delete(spark, gone)
    Scratch.live[:] = [f for f in Scratch.live if f in keep]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place where possible."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def _powers(n: int, base: int, cache: dict) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = cache.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        cache[base] = have = out
    return have[:n]


_POWERS: dict[int, np.ndarray] = {}
BYTE_BASE = 0x5851F42D4C957F2D
BYTE_INV = pow(BYTE_BASE, -1, 1 << 64)
WORD_BASE = 0xD1342543DE82EF95
WORD_INV = pow(WORD_BASE, -1, 1 << 64)
OTHER_BASE = 0xAF251AF3B0F025B5
OTHER_INV = pow(OTHER_BASE, -1, 1 << 64)
#: One value for each byte; from a fixed seed, so alike in every process.
BYTE_VALUE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
#: ASCII white space 0x09-0x0D and 0x20 separates words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ranged_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Polynomial hash of values[s:e] for each range, from prefix sums modulo 2**64."""
    n = len(values)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(values * _powers(n, base, _POWERS), out=prefix[1:])
    out = prefix[ends] - prefix[starts]
    out *= _powers(n + 1, inverse, _POWERS)[starts]
    return mix(out ^ ((ends - starts).astype(U64) * _GOLD))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each, whole rows only."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of the texts of one chunk.

    ``first`` has n + 1 word indexes: words of text i are first[i]:first[i+1];
    ``starts``/``ends`` are byte positions in ``data``.
    """

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffers(column)
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        space = IS_SPACE[self.data]
        solid = ~space
        begin = solid.copy()
        begin[1:] &= space[:-1] | edge[1:n]
        finish = solid
        finish[:-1] &= space[1:] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return ranged_hash(BYTE_VALUE[self.data], self.starts, self.ends, BYTE_BASE, BYTE_INV)


def window_hashes(words: np.ndarray, n: int, base: int = WORD_BASE, inverse: int = WORD_INV) -> np.ndarray:
    """Hash of every n consecutive words, over text ends too; the caller masks those."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    at = np.arange(count)
    return ranged_hash(words, at, at + n, base, inverse)


def word_lists(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for chunk in text_chunks(batch, column):
            yield chunk, Words(chunk.column(column))


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_ROWS rows, with unused memory given back at the end.

    Spark reads the size of batches from the session when the plan runs, which is after this
    returns, so the setting stays lowered; a lower one of the caller's is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "0")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(wrapped, schema)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of an undirected edge table (a, b), as (id, component).

    Alternating large-star and small-star rounds: every node is linked to the
    smallest neighbour until only stars are left.  Every step is a group-by
    with map-side combine and an equi-join, so a hub's links are never in one
    task.  Nodes that have no edge are not returned.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(now, f"{name}-0")
    step, seen = 0, None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join reads both sides and can deal out a hub to several tasks
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least-{step}")
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("x"), F.col("m")).unionByName(low.select(F.col("a").alias("x"), F.col("m")))
        small = small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        after = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-least-{step}")
        now = after
    pairs = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), F.col("component")).distinct())


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first ``keys`` (integer) columns, as one table each."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(n, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if last is not None and tuple(c[0] for c in columns) != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def list_column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values, n + 1 bounds) of a list column of one group."""
    parts = table.column(name).chunks
    values = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    sizes = np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts])
    return np.concatenate(values), np.concatenate([[0], np.cumsum(sizes)])


def least_labels(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a symmetric link matrix reaches, itself included."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        step = np.minimum(label, np.where(links, label[None, :], top).min(axis=1, initial=top))
        if (step == label).all():
            return label
        label = step
