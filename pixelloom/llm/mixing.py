"""Mixing sources to target weights by balanced sampling with the cube method.

Each document of a source is wanted ``target / source_size`` times: whole copies first,
then a fractional inclusion probability.  The flight phase moves the probabilities of
three documents at a time along the null space of two constraints, the token total and
the document total, until one of them is 0 or 1.  Blocks of a source fly apart from each
other; the at most two open documents of each block fly again together, level by level;
the last two or fewer of a source are landed by the choice nearest to the token target.

Defined results: null or empty texts have size 0 and are taken as any other document
(``taken`` is 0).  A null source is a source of its own and the last one.  Repeated rows
are documents of their own, kept together as one row with a number until the end, so any number
of them is no burden.  An empty table gives an empty result.  Extra columns are
ignored.  The same rows give the same result at any partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, in_arrow, text_chunks

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the mix takes.
SHARE = 1.5
#: No source is taken more often than this, nor any document.
MOST = 2.0
#: Documents of a block, and blocks whose open documents fly together, on average.
BLOCK = 4096
#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text", 1 << 22):
                count = np.diff(Words(chunk.column(2)).first)
                yield pa.record_batch([chunk.column(0), chunk.column(1), pa.array(count, pa.int64())], ["doc_id", "source", "size"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return in_arrow(rows, run, "doc_id long, source string, size long")


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """rows with the sums of columns over all rows before each, in order: ``sums`` has a column's
    name for each new one.  Rows are dealt out by ranges of the order, so no task gets them all;
    the driver gets a sum for each range."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.save(rows.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), name)
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = {new: 0.0 if ranged.schema[c].dataType.simpleString() == "double" else 0 for new, c in sums.items()}
    before = []
    for r in ranged.groupBy("_range").agg(*[F.sum(c).alias(new) for new, c in sums.items()]).orderBy("_range").collect():
        before.append((r["_range"], *total.values()))
        total = {new: total[new] + r[new] for new in sums}
    kinds = ", ".join(f"_{new} {ranged.schema[c].dataType.simpleString()}" for new, c in sums.items())
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, f"_range int, {kinds}"))  # a row for each range
    zero = {new: F.lit(0).cast(ranged.schema[c].dataType) for new, c in sums.items()}
    out = ranged.join(offsets, "_range").withColumns({new: F.col(f"_{new}") + F.coalesce(F.sum(c).over(own), zero[new]) for new, c in sums.items()})
    return out.drop("_range", *[f"_{new}" for new in sums])


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, scratch: Scratch | None = None) -> DataFrame:
    """Targets of sources given as (source, source_size, n_docs): one row for each source.

    Weighted water filling: sources are capped in order of ``most * size / weight`` as long
    as the level that the others would reach is above that ratio.
    """
    scratch = scratch or Scratch(totals.sparkSession, "targets")
    one = totals.withColumn("one", F.lit(1).cast("long"))  # one row a source
    ranked = _running(one, [F.col("source").asc_nulls_last()], {"rank": "one"}, scratch, "ranges").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = scratch.save(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), "ranked")
    size, heavy = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = F.lit(0.0)
    if size is not None:
        filled = _running(ranked, [F.col("ratio"), F.col("rank")], {"caps": "cap", "weights": "weight"}, scratch, "filled")
        rest = (F.lit(float(size) * float(share)) - F.col("caps")) / (F.lit(float(heavy)) - F.col("weights"))
        first = filled.withColumn("level", rest).where("level <= ratio").agg(F.min(F.struct("ratio", "rank", "level"))).first()[0]
        level = F.lit(float("inf")) if first is None else F.lit(first["level"])
    return ranked.select(
        "source", "rank", "source_size", "n_docs", "weight", F.least(F.col("cap"), level * F.col("weight")).alias("target"),
    )


def fly(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: all but at most two entries become 0 or 1; token and document totals stay."""
    x = prob.astype(float).copy()
    draws = iter(rng.random(len(x) + 3).tolist())
    small = 1e-9
    held: list[int] = []
    for i in np.flatnonzero((x > small) & (x < 1 - small)).tolist():
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - x[k]) / v if v > 0 else x[k] / -v for k, v in zip(held, u) if v)
        down = min(x[k] / v if v > 0 else (1 - x[k]) / -v for k, v in zip(held, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for k, v in zip(held, u):
            x[k] += step * v
        held = [k for k in held if small < x[k] < 1 - small]
    x[x <= small] = 0.0
    x[x >= 1 - small] = 1.0
    return x


def land(size: np.ndarray, x: np.ndarray, want: float) -> np.ndarray:
    """Round the at most two open entries so that the token total is nearest to ``want``."""
    out = x.copy()
    open_ = np.flatnonzero((x > 0) & (x < 1))
    base = float((size * np.where((x > 0) & (x < 1), 0, x)).sum())
    best = None
    for code in range(1 << len(open_)):
        bits = [(code >> k) & 1 for k in range(len(open_))]
        gap = abs(base + sum(float(size[i]) * b for i, b in zip(open_, bits)) - want)
        key = (gap, abs(sum(bits) - float(x[open_].sum())), code)
        if best is None or key < best[0]:
            best = (key, bits)
    for i, b in zip(open_, best[1]):
        out[i] = b
    return out


def _flight(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows["source"].iloc[0]
        rows = rows.assign(_h=[zlib.crc32(f"{d}".encode()) for d in rows["doc_id"]])
        rows = rows.sort_values(["size", "_h", "doc_id", "x"], ascending=[False, True, True, True], kind="stable").drop(columns="_h")
        rng = np.random.default_rng([zlib.crc32(str(source).encode()), int(rows["block"].iloc[0]), len(rows)])
        size, prob = rows["size"].to_numpy(float), rows["x"].to_numpy(float)
        x = fly(size, prob, rng)
        if last:
            x = land(size, x, float((size * prob).sum()))
        return rows.assign(x=x)

    return run


_KIND = "doc_id long, source string, rank long, size long, source_size long, target double, rows long, base int, ones long, x double, block long"
#: Equal rows that one task writes out.
RUN = 1_000_000


def _spread(rows: DataFrame) -> DataFrame:
    """Groups of equal rows (rows, ...) written out as rows with their number k; very large groups
    in runs that are dealt out first."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RUN)))
    large = rows.where(F.col("rows") > RUN).withColumn("_run", runs).repartition(count)
    parts = rows.where(F.col("rows") <= RUN).withColumn("_run", F.lit(0).cast("long")).unionByName(large)
    first, last = F.col("_run") * RUN, F.least(F.col("rows"), (F.col("_run") + 1) * RUN) - 1
    return parts.withColumn("k", F.explode(F.sequence(first, last))).drop("_run")


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) for every row of documents
    (doc_id, text, source); ``taken`` is copies * size."""
    scratch = Scratch(documents.sparkSession, "mix")
    # equal rows (a null doc_id may be very common) are one row with their number
    rows = sizes(documents).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    rows = scratch.save(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_docs"))
    plan = scratch.save(targets(totals, weights, share, most, scratch), "plan").withColumnRenamed("source", "name")
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("n_docs") / BLOCK)
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("name"))).withColumn("want", F.least(want, F.lit(float(most))))
    # of equal rows as many get a copy more as their probabilities make whole; one stays open
    joined = joined.withColumn("base", F.floor("want").cast("int")).withColumn("open", F.col("rows") * (F.col("want") - F.col("base")))
    joined = joined.withColumn("ones", F.least(F.floor("open"), F.col("rows") - 1)).select(
        "doc_id", "source", "rank", "size", "source_size", "target", "rows", "base", "ones", F.least(F.col("open") - F.col("ones"), F.lit(1.0)).alias("x"),
        F.pmod(F.xxhash64("doc_id", "size"), F.greatest(blocks, F.lit(1))).alias("block"),
    )
    most_blocks = plan.agg(F.max("n_docs")).first()[0] or 0
    done, level, count = [], 0, -(-most_blocks // BLOCK)
    while True:
        last = count <= 1
        flown = scratch.save(joined.groupBy("rank", "block").applyInPandas(_flight(last), _KIND), f"level{level}")
        if last:
            done.append(flown)
            break
        done.append(flown.where("x = 0 or x = 1"))
        joined = flown.where("x > 0 and x < 1").withColumn("block", F.floor(F.col("block") / (BLOCK // 2)).cast("long"))
        count, level = -(-count // (BLOCK // 2)), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.col("base") + F.when(F.col("k") < F.col("ones") + F.col("x"), 1).otherwise(0)
    out = _spread(out).withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
