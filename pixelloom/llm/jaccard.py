"""N-gram Jaccard join by MinHash banding.

A text's set holds its runs of five consecutive words; a text of one to four words has
one run, all of its words.  Texts with equal sets are one class, counted once and
carried by the smallest doc_id.  Class representatives get MinHash signatures, cut into
bands; bands and rows are chosen for a target recall at the threshold.  Representatives
that share a band are candidates.  They are gathered by connected component or, where a
component is large and thin, by band, in blocks, and every pair there is verified on the
full sets.

Verification gives the number of linked documents and the smallest linked doc_id, never
a row for each pair, so the output grows with the documents, not with their pairs.

Defined results: null and empty texts have an empty set and link with nothing.  A row
with a null doc_id is returned with a null class and no link.  Rows that repeat a doc_id
with equal texts are one document; with different texts each text is compared, also with
the others of its document, and the document has the smallest class and all links of them.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, components, grouped, in_arrow, least_labels, list_column, mix, ranged_hash, WORD_BASE, WORD_INV, word_lists

#: Words of an n-gram.
GRAM = 5
THRESHOLD = 0.8
#: Share of pairs at the threshold that get into a common band, by the MinHash model.
RECALL = 0.999
#: At most so many hash functions.
HASHES = 128
#: Documents, and n-grams, of a block of a large candidate component.
BLOCK_DOCS = 512
BLOCK_GRAMS = 1_500_000
#: Columns of the membership matrix that are multiplied at a time.
COLUMNS = 8192


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which the bands that reach the recall fit into the hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def gram_sets(words: Words, n: int = GRAM) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted."""
    hashes = words.hashes()
    first = words.first
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), grams)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams)
    ends = np.minimum(at + n, first[text + 1])
    values = ranged_hash(hashes, at, ends, WORD_BASE, WORD_INV)
    bounds = np.concatenate([[0], np.cumsum(grams)])
    for i in range(len(count)):
        yield np.unique(values[bounds[i] : bounds[i + 1]])


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    return int(mix(grams + U64(0x632BE59BD9B4E019)).sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(grams * U64(0x9FB21C651E98DF25))).astype(np.int64))


def _signatures(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(4177)
        a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)[:, None] | U64(1)
        b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None]
        salt = np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
        for chunk, words in word_lists(batches, "text"):
            size, one, two, lists = [], [], [], []
            for grams in gram_sets(words, n):
                size.append(len(grams))
                if not len(grams):
                    one.append(0), two.append(0), lists.append(np.zeros(0, np.int64))
                    continue
                f = fingerprint(grams)
                one.append(f[0]), two.append(f[1])
                low = None
                for at in range(0, len(grams), 1 << 14):
                    part = (grams[None, at : at + (1 << 14)] * a + b).min(axis=1)
                    low = part if low is None else np.minimum(low, part)
                key = salt.copy()
                for r in low.reshape(bands, rows).T:
                    key = mix(key * U64(0xD1B54A32D192ED03) + r)
                lists.append(key.view(np.int64))
            yield pa.record_batch(
                [chunk.column(0), chunk.column(1), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["doc_id", "p", "n", "f", "g", "bands"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words in word_lists(batches, "text"):
            keep, lists = [], []
            want = chunk.column("f").to_numpy(), chunk.column("g").to_numpy()
            for i, grams in enumerate(gram_sets(words, n)):
                if len(grams) and fingerprint(grams) == (want[0][i], want[1][i]):
                    keep.append(i)
                    lists.append(grams.view(np.int64))
            small = chunk.take(pa.array(keep, pa.int64()))
            yield pa.record_batch(
                [small.column("id"), small.column("copies"), small.column("units"), pa.array(lists, pa.list_(pa.int64()))],
                ["id", "copies", "units", "grams"],
            )

    return run


def common_counts(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left x right, from products of membership matrices."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    use = count[place] > 1  # a value of one set is in no intersection
    row, place = row[use], np.unique(place[use], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(left), len(right)))
    width = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(place, [at, at + COLUMNS])
        member = np.zeros((n, min(COLUMNS, width - at)), np.float32)
        member[row[a:b], place[a:b] - at] = 1
        out += member[left] @ member[right].T
    return out


def _first_common(rows_a: np.ndarray, rows_b: np.ndarray, ks: tuple, keys: tuple, unit: int) -> np.ndarray:
    """For pairs of rows, whether the unit is the first of the units that both are in."""
    (place, at), (value, _) = ks, keys
    table = np.zeros((len(at) - 1, int(place.max()) + 1), np.int64)
    there = np.zeros(table.shape, bool)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    table[row, place], there[row, place] = value, True
    same = (table[rows_a] == table[rows_b]) & there[rows_a] & there[rows_b]
    return table[rows_a, same.argmax(axis=1)] == unit


def _verify(threshold: float):
    ratio = Fraction(threshold).limit_denominator(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            unit, i, j = (table.column(c)[0].as_py() for c in ("unit", "i", "j"))
            values, bounds = list_column(table, "grams")
            ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
            _, once = np.unique(ids, return_index=True)
            left, right = (once, once) if i == j else (once[block[once] == i], once[block[once] == j])
            if not len(left) or not len(right) or i == j and len(once) < 2:
                continue
            both = common_counts(values, bounds, left, right)
            size = np.diff(bounds)
            links = both * ratio.denominator >= ratio.numerator * (size[left][:, None] + size[right][None, :] - both)
            if i == j:
                np.fill_diagonal(links, False)
            keys = list_column(table, "keys")
            if (np.diff(keys[1]) > 1).any():  # each pair counts once
                a, b = np.nonzero(links)
                links[a, b] = _first_common(left[a], right[b], list_column(table, "ks"), keys, unit)
            if i == j:
                nodes, square, add = ids[left], links, links @ copies[right]
            else:
                nodes = np.concatenate([ids[left], ids[right]])
                square = np.zeros((len(nodes), len(nodes)), bool)
                square[: len(left), len(left) :] = links
                square[len(left) :, : len(left)] = links.T
                add = np.concatenate([links @ copies[right], links.T @ copies[left]])
            linked = add > 0
            if linked.any():
                root = least_labels(square, nodes)
                yield pa.record_batch([pa.array(nodes[linked]), pa.array(add[linked].astype(np.int64)), pa.array(root[linked])], ["id", "links", "root"])

    return run


def in_blocks(members: DataFrame, *payload: str) -> DataFrame:
    """Rows of (unit, id, blocks, ...) for each pair of blocks (i <= j) of its unit that a member takes
    part in, the rows of a pair together and in order."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = members.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    pairs = pairs.select("unit", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "copies", "block", *payload)
    return pairs.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")


def _blocks() -> Column:
    """Blocks of a group of (n) grams each."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_GRAMS))


def _units(banded: DataFrame, shared: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Where each candidate is verified: (id, copies, f, g, units), units an array of (k, unit, blocks).

    A component of band collisions is one unit, so that a set moves once.  A component of several
    blocks is cut into its band buckets where that moves fewer sets (a long chain of collisions),
    and stays whole where it does not (a large group of copies); a pair that shares several
    buckets counts in the first.
    """
    edges = banded.join(shared, "band").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    held = scratch.save(components(edges, scratch, "candidates").join(classes.select("id", "n", "copies", "f", "g"), "id"), "held")
    sizes = held.groupBy("component").agg(F.count("*").alias("members"), _blocks().alias("blocks"))
    sizes = scratch.save(sizes, "blocks")
    whole = [F.lit(0).alias("k"), F.col("component").alias("unit"), "blocks"]
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return held.join(sizes, "component").select("id", "copies", "f", "g", F.array(F.struct(*whole)).alias("units"))
    inner = scratch.save(held.join(large.select("component"), "component").select("id", "component", "n"), "inner")
    buckets = banded.join(shared.select("band"), "band").join(inner, "id").select("id", "component", "n", "k", "band")
    buckets = scratch.save(buckets, "buckets")
    bucket_sizes = scratch.save(buckets.groupBy("component", "band").agg(F.count("*").alias("c"), _blocks().alias("blocks")), "bucket-blocks")
    cost = bucket_sizes.groupBy("component").agg(F.sum(F.col("c") * F.col("blocks")).alias("cost"))
    cut = large.join(cost, "component").where("cost < members * blocks").select("component")
    cut = scratch.save(cut, "cut")
    rest = held.join(sizes, "component").join(cut, "component", "left_anti").select("id", "copies", "f", "g", F.array(F.struct(*whole)).alias("units"))
    parts = buckets.join(cut, "component").join(bucket_sizes.select("band", "blocks"), "band").groupBy("id")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("k", F.col("band").alias("unit"), "blocks"))).alias("units"))  # at most one for each band
    return rest.unionByName(held.join(parts, "id").select("id", "copies", "f", "g", "units"))


def _text_classes(documents: DataFrame, threshold: float, n: int, recall: float, hashes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, each, about): (doc_id, p, f, g, n) of every row, p tells its text; the distinct
    (doc_id, f, g, n); and what ``about_classes`` says of every set (f, g, n)."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    bands, rows = choose_bands(threshold, recall, hashes)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("p"), "text").where("doc_id is not null")
    signed = in_arrow(texts, _signatures(bands, rows, n), "doc_id long, p long, n long, f long, g long, bands array<long>")
    signed = scratch.save(signed, "signed")
    each = signed.groupBy("doc_id", "f", "g", "n").agg(F.min("p").alias("p"))
    classes = each.where("n > 0").groupBy("f", "g", "n").agg(F.min(F.struct("doc_id", "p")).alias("r"), F.count("*").alias("copies"))
    # numbered, as a document with several texts may stand for several classes
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "f", "g", "n", F.col("r.doc_id").alias("least"), F.col("r.p").alias("p"), "copies")
    classes = scratch.save(classes, "classes")
    own = classes.select("id", F.col("least").alias("doc_id"), "p", "f", "g", "n")
    banded = signed.join(own, ["doc_id", "p", "f", "g", "n"]).select("id", F.posexplode("bands").alias("k", "band"))
    banded = scratch.save(banded.distinct(), "banded")
    # written like every table that meets its own sums: the join can then deal out a band of very many
    shared = banded.groupBy("band").agg(F.min("id").alias("low"), F.count("*").alias("c")).where("c > 1").select("band", "low")
    shared = scratch.save(shared, "shared")
    units = scratch.save(_units(banded, shared, classes, scratch), "units")
    scratch.drop("banded", "shared", "held", "blocks", "inner", "buckets", "bucket-blocks", "cut")
    place = units.join(classes.select("id", F.col("least").alias("doc_id"), "p"), "id")
    full = texts.join(place, ["doc_id", "p"]).select("text", "id", "copies", "units", "f", "g")
    sets = in_arrow(full, _sets(n), "id long, copies long, units array<struct<k:int,unit:long,blocks:long>>, grams array<long>")
    sets = sets.select("id", "copies", F.col("units.k").alias("ks"), F.col("units.unit").alias("keys"), "grams", F.explode("units").alias("u"))
    sets = sets.select(F.col("u.unit").alias("unit"), "id", "copies", F.col("u.blocks").alias("blocks"), "ks", "keys", "grams")
    found = in_arrow(in_blocks(sets, "ks", "keys", "grams"), _verify(threshold), "id long, links long, root long")
    found = scratch.save(found, "found")
    scratch.drop("units")
    return signed, each, about_classes(["f", "g", "n"], classes, found, scratch)


def join(documents: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, kept), a row for each document (doc_id, text).

    copy_id is the smallest doc_id with the same set; class_id the smallest doc_id that links
    reach; n_links the number of other documents linked directly; kept says doc_id = class_id.
    """
    _, each, about = _text_classes(documents, threshold, n, recall, hashes)
    return by_document(each.withColumn("lone", F.col("n") == 0), ["f", "g", "n"], about, "doc_id", documents)


def about_classes(keys: list[str], classes: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(keys, copy_id, n_links, class_id) of every class (keys, id, least, copies): least is its
    smallest document; ``found`` (id, links, root) has partial results of the verification."""
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch, "linked")
    linked = scratch.save(linked.join(classes.select("id", "least"), "id"), "reached")
    lowest = scratch.save(linked.groupBy("component").agg(F.min("least").alias("class_id")), "lowest")
    reached = linked.join(lowest, "component").select("id", "class_id")
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    about = classes.join(total, "id", "left").join(reached, "id", "left")
    links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    about = about.select(*keys, F.col("least").alias("copy_id"), links.alias("n_links"), F.coalesce("class_id", "least").alias("class_id"))
    return scratch.save(about, "about")


def by_document(each: DataFrame, keys: list[str], about: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """(name, class_id, copy_id, n_links, kept) from the classes of each document's texts.

    ``each`` (name, keys, lone) has a row for each document and class; ``rows`` gives null ids back.
    A document with several texts has the smallest class and copy of them, and all their links.
    """
    own = each.where("not lone").join(about, keys).select(name, "class_id", "copy_id", "n_links")
    lone = each.where("lone").select(name, F.col(name).alias("class_id"), F.col(name).alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    out = own.unionByName(lone).groupBy(name).agg(F.min("class_id").alias("class_id"), F.min("copy_id").alias("copy_id"), F.sum("n_links").alias("n_links"))
    none = F.lit(None).cast("long")
    unnamed = rows.where(F.col(name).isNull()).select(F.col(name).cast("long").alias(name), none.alias("class_id"), none.alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(unnamed).withColumn("kept", F.coalesce(F.col(name) == F.col("class_id"), F.lit(True)))


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents (doc_id, text and others) that stay: of each class of texts those of
    the smallest doc_id, and rows with a null doc_id.  Rows with one doc_id and one text stay or
    go together; rows with one doc_id and different texts are judged each by its own."""
    signed, each, about = _text_classes(documents, threshold, GRAM, RECALL, HASHES)
    keys = ["f", "g", "n"]
    gone = each.join(about, keys).where("doc_id <> class_id").select("doc_id", *keys)
    gone = signed.select("doc_id", "p", *keys).join(gone, ["doc_id", *keys]).select(F.col("doc_id").alias("_gone"), F.col("p").alias("_text")).distinct()
    rows = documents.withColumn("_p", F.xxhash64("text"))
    return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_p") == F.col("_text")), "left_anti").drop("_p")
