"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into two halves with a codebook each; a pair of codewords is a cell.
Every vector is filed in its own cell and visits the cells nearest to it, in the order of
the multi-sequence algorithm: the cells with the smallest sums of half distances.  How
many it visits is set so that a vector at exactly the threshold from it (the hardest
partner there is) is met with the target recall, measured on a sample.  Vectors that meet
in a cell are verified by cosine in double precision, large cells in blocks.

Equal vectors are one class and enter once.  Verification gives counts and smallest ids,
never a row for each pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and keep themselves.  Vectors of another length than most are compared
among their own length, in one cell.  A row with a null vec_id has a null component and no
link.  Rows that repeat a vec_id with equal vectors are one; with different ones each is
compared, and the id has the smallest component and all links of them.  An empty table gives an
empty result.  Labels and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, in_arrow, list_column
from .jaccard import about_classes, by_document

THRESHOLD = 0.95
RECALL = 0.99
#: Vectors that codebooks and recall are fitted on: at least so many, and so many for a codeword.
SAMPLE, PER_CODE = 8000, 16
#: Vectors of a cell, on average.  The codewords of a half grow with the square root of the table.
PER_CELL = 128
#: Vectors of a block of a large cell.
BLOCK = 4096


@dataclass
class MultiIndex:
    """Two codebooks (codes x half width) and the number of cells to visit."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        return tuple(
            (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None, :]
            for part, book in zip((unit[:, :half], unit[:, half:]), self.books, strict=True)
        )

    def home(self, unit: np.ndarray) -> np.ndarray:
        one, two = self.distances(unit)
        return one.argmin(1) * len(self.books[1]) + two.argmin(1)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """The nearest cells, nearest first.  The t-th in multi-sequence order has ranks (a, b)
        in the two sorted half lists with (a + 1) * (b + 1) <= t, so only those are formed."""
        one, two = self.distances(unit)
        a_order, b_order = np.argsort(one, 1, kind="stable"), np.argsort(two, 1, kind="stable")
        a_sorted, b_sorted = np.take_along_axis(one, a_order, 1), np.take_along_axis(two, b_order, 1)
        want = min(self.visits, one.shape[1] * two.shape[1])
        ranks = [(a, b) for a in range(min(want, one.shape[1])) for b in range(min(want // (a + 1), two.shape[1]))]
        ia, ib = np.array([r[0] for r in ranks]), np.array([r[1] for r in ranks])
        sums = a_sorted[:, ia] + b_sorted[:, ib]
        top = np.argsort(sums, 1, kind="stable")[:, :want]
        return np.take_along_axis(a_order, ia[top], 1) * len(self.books[1]) + np.take_along_axis(b_order, ib[top], 1)


def _codebook(points: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    book = points[rng.choice(len(points), codes, replace=len(points) < codes)].copy()
    for _ in range(rounds):
        half = (book**2).sum(1)[None, :] / 2
        near = np.concatenate([(half - points[at : at + 4096] @ book.T).argmin(1) for at in range(0, len(points), 4096)])
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        book[used] = np.add.reduceat(points[order], first, axis=0) / np.diff(np.append(first, len(points)))[:, None]
    return book


def code_count(count: int) -> int:
    """Codewords of a half for a table of so many vectors."""
    return max(4, round((count / PER_CELL) ** 0.5))


def fit(unit: np.ndarray, count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> MultiIndex:
    """Codebooks for about ``count`` vectors from a sample of unit vectors, and the visits that
    reach the recall for partners at the threshold."""
    rng = np.random.default_rng(99)
    half = unit.shape[1] // 2
    codes = min(code_count(count), max(1, len(unit)))
    books = (_codebook(unit[:, :half], codes, rng), _codebook(unit[:, half:], codes, rng))
    index = MultiIndex(books, 1)
    probe = unit[rng.choice(len(unit), min(len(unit), 1500), replace=False)]
    aside = rng.normal(size=probe.shape)
    aside -= (aside * probe).sum(1)[:, None] * probe
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
    other = threshold * probe + (1 - threshold**2) ** 0.5 * aside

    def rank(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        one, two = index.distances(x)
        cell = index.home(y)
        mine = one[np.arange(len(x)), cell // codes] + two[np.arange(len(x)), cell % codes]
        return np.array([np.searchsorted(np.sort(b), m - a, "left").sum() for a, b, m in zip(one, two, mine, strict=True)])

    least = np.minimum(rank(probe, other), rank(other, probe)) + 1
    return MultiIndex(books, int(np.quantile(least, recall, method="higher")))


def unit_vectors(column: pa.Array, width: int) -> np.ndarray:
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    scale = np.abs(raw).max(axis=1, keepdims=True)  # keeps squares of extreme values finite
    raw = raw / scale
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _file(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, width = held.value
        names = ["cell", "id", "copies", "home", "filed", "visits", "vector"]
        for batch in batches:
            size = np.diff(batch.column("vector").offsets.to_numpy())
            for other in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == other)))
                n = part.num_rows
                if other != width or index is None:
                    cell = np.full(n, -1 - int(other))
                    seen = cell[:, None]
                else:
                    unit = unit_vectors(part.column("vector"), width)
                    cell, seen = index.home(unit), index.nearest(unit)
                ids = part.column("id").to_numpy()
                none = [np.zeros(0, np.int64)] * n
                yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(ids), part.column("copies"), pa.array(cell, pa.int64()), pa.array(np.ones(n, bool)), pa.array(list(seen), pa.list_(pa.int64())), part.column("vector")], names)
                row, col = np.nonzero(seen != cell[:, None])
                for at in range(0, len(row), 20_000):
                    r, c = row[at : at + 20_000], col[at : at + 20_000]
                    yield pa.record_batch(
                        [pa.array(seen[r, c], pa.int64()), pa.array(ids[r]), part.column("copies").take(pa.array(r)), pa.array(cell[r], pa.int64()), pa.array(np.zeros(len(r), bool)), pa.array([none[0]] * len(r), pa.list_(pa.int64())), part.column("vector").take(pa.array(r))],
                        names,
                    )

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            table = table.combine_chunks()
            cell, i, j = (table.column(k)[0].as_py() for k in ("component", "i", "j"))
            ids, copies, home, filed, block = (table.column(c).to_numpy() for c in ("id", "copies", "home", "filed", "block"))
            values, bounds = list_column(table, "vector")
            unit = unit_vectors(table.column("vector").combine_chunks(), int(bounds[1] - bounds[0]))
            seen, cuts = list_column(table, "visits")
            add = np.zeros(len(ids), np.int64)
            edges: list[tuple[np.ndarray, np.ndarray]] = []
            own = np.flatnonzero(filed)
            owner = np.repeat(np.arange(len(ids)), np.diff(cuts))
            # (filed vector, cell) pairs: does the filed vector visit the other's home?
            visited = set(zip(owner.tolist(), seen.tolist(), strict=True)) if len(own) else set()
            for at in range(0, len(own), 512):
                rows = own[at : at + 512]
                close = unit[rows] @ unit.T >= threshold
                a, b = np.nonzero(close)
                a = rows[a]
                use = (ids[a] != ids[b]) & (~filed[b] | (ids[a] < ids[b]))
                if i != j:
                    use &= block[a] != block[b]
                a, b = a[use], b[use]
                if not len(a):
                    continue
                # a pair that both cells see is counted in the smaller one
                twice = np.array([not f and h < cell and (x, h) in visited for x, h, f in zip(a.tolist(), home[b].tolist(), filed[b].tolist(), strict=True)], bool)
                a, b = a[~twice], b[~twice]
                np.add.at(add, a, copies[b])
                np.add.at(add, b, copies[a])
                edges.append((a, b))
            if not edges:
                continue
            a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
            root = ids.copy()
            while True:
                low = np.minimum(root[a], root[b])
                step = root.copy()
                np.minimum.at(step, a, low)
                np.minimum.at(step, b, low)
                if (step == root).all():
                    break
                root = step
            use = add > 0
            yield pa.record_batch([pa.array(ids[use]), pa.array(add[use]), pa.array(root[use])], ["id", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector of (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.coalesce(
        (F.size("vector") > 0)
        & F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
        & F.exists("vector", lambda v: v != 0),
        F.lit(False),
    )
    keyed = rows.where("vec_id is not null").withColumn("lone", ~fine)
    keyed = keyed.withColumn("f", F.xxhash64("vector")).withColumn("g", F.xxhash64(F.reverse("vector"), F.lit(5)))
    each = scratch.save(keyed.select("vec_id", "lone", "f", "g").distinct(), "each")
    classes = each.where("not lone").groupBy("f", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # numbered, as an id with several vectors may stand for several classes
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("id"), "f", "g", "least", "copies"), "classes")
    reps = keyed.where("not lone").withColumnRenamed("vec_id", "least").join(classes, ["least", "f", "g"])
    reps = scratch.save(reps.groupBy("id", "copies").agg(F.first("vector").alias("vector")), "reps")
    lengths = reps.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    index, width = None, 0
    if lengths is not None and lengths["width"] >= 2:
        width = lengths["width"]
        size = max(SAMPLE, PER_CODE * code_count(lengths["count"]))
        share = min(1.0, size / lengths["count"])
        near = reps.where(F.size("vector") == width).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        sample = near.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(size).select("vector").toArrow()
        index = fit(unit_vectors(sample.column(0).combine_chunks(), width), lengths["count"], threshold, recall)
    held = spark.sparkContext.broadcast((index, width))  # two codebooks, whose codewords are as many as the square root of the vectors over PER_CELL
    filed = in_arrow(reps, _file(held), "cell long, id long, copies long, home long, filed boolean, visits array<long>, vector array<double>")
    filed = scratch.save(filed, "filed")
    blocks = filed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = scratch.save(blocks, "blocks")  # written, so that a cell of very many is dealt out to several tasks
    members = filed.join(blocks, "cell").withColumnRenamed("cell", "component")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = members.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    pairs = pairs.select("component", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "copies", "block", "home", "filed", "visits", "vector")
    pairs = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = scratch.save(in_arrow(pairs, _verify(threshold), "id long, links long, root long"), "found")
    scratch.drop("filed")
    scratch.drop("reps", "blocks")
    out = by_document(each, ["f", "g"], about_classes(["f", "g"], classes, found, scratch), "vec_id", rows)
    return out.select("vec_id", "n_links", F.col("class_id").alias("component_id"), "kept")
