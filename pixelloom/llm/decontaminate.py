"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and runs of white space become one space.  An item
of m characters may be matched with floor(ERROR_RATE * m) edits (k).  It is split into
k + 1 pieces; a match with at most k edits leaves one piece unchanged, so an automaton
over all pieces finds every place where a match can be.  Around each hit, Myers'
bit-parallel algorithm decides whether the item occurs with at most k edits.

The items are the stated query set: they go through the documents in blocks of bounded
size, so a benchmark of any size uses bounded memory.  Documents are only read.

An item too short for any edit must stand between characters that are no letters or digits, or
at an end of the text: ``hello`` is not in ``othello``.

Defined results: null and empty texts contain nothing; null or blank items are ignored;
an item with a null id is one like any other and its id in the result is null; equal items all
match.  Repeated rows are judged alike.  Empty tables match nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Scratch, in_arrow

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 8_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces that cover the item, as even as can be."""
    n, m = min(errors + 1, len(item)), len(item)
    cuts = [m * i // n for i in range(n + 1)]
    return [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(n)]


def myers(pattern_bits: dict[str, int], m: int, text: str, most: int) -> int:
    """The least edits with which the pattern ends somewhere in the text, or most + 1.

    ``pattern_bits`` has the places of each character of the pattern as bits.
    """
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, left = mask, 0, m, min(m, most + 1), len(text)
    get = pattern_bits.get
    for ch in text:
        eq = get(ch, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq | mv
        xv = eq | mv
        ph = mv | (mask & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (mask & ~(xv | ph))
        mv = ph & xv
        left -= 1
        if score < best:
            best = score
            if not best:
                break
        elif score - left > most:
            break
    return best


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            errors = int(rate * len(text))
            bits: dict[str, int] = {}
            for i, ch in enumerate(text):
                bits[ch] = bits.get(ch, 0) | 1 << i
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, errors, bits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def match(self, raw: str | None) -> list[tuple[int, int]]:
        """(item, edits) of every item that occurs in the text, least edits each, by item."""
        text = normalise(raw)
        if not text or not self.items:
            return []
        spans: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                spans.setdefault(item, []).append(end + 1 - size - offset)
        out = []
        for item, begins in spans.items():
            item_id, pattern, errors, bits = self.items[item]
            best, m = errors + 1, len(pattern)
            if not errors:
                if any(_alone(text, b, b + m) for b in begins):
                    out.append((item_id, 0))
                continue
            begins.sort()
            at = 0
            while at < len(begins) and best:
                low = high = begins[at]
                while at < len(begins) and begins[at] - high <= errors:  # hits whose regions overlap
                    high = begins[at]
                    at += 1
                region = text[max(0, low - errors) : high + m + errors]
                exact = pattern in region
                best = 0 if exact else min(best, myers(bits, m, region, errors))
            if best <= errors:
                out.append((item_id, best))
        return sorted(out, key=_by_id)


def _by_id(found: tuple[int | None, int]) -> tuple:
    return found[0] is None, found


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on at either end of a stretch."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((row.item_id, row.text))
        chars += len(row.text)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _search(rows: DataFrame, block: list, rate: float) -> DataFrame:
    """rows (text and others) with __item_ids and __edits of one block of items."""
    columns = rows.columns
    held = rows.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_CHARS and one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value, rate)
        for batch in batches:
            found = [matcher.match(text.as_py()) for text in batch.column("text")]
            ids, edits = (pa.array([[f[k] for f in one] for one in found], pa.list_(pa.int64())) for k in (0, 1))
            yield pa.record_batch([*batch.columns, ids, edits], [*columns, "__item_ids", "__edits"])

    schema = rows.schema
    for c in ("__item_ids", "__edits"):
        schema = StructType([*schema.fields, StructField(c, ArrayType(LongType()))])
    return in_arrow(rows, run, schema)


def _matched(rows: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """rows (doc_id, text and others) with __item_ids and __edits.

    One block of items is one pass over the rows.  Of several blocks each is a pass of its own with
    one automaton in memory, which writes only what it finds; rows get that back by id and text.
    """
    blocks = _blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _search(rows, first, rate)
    scratch = Scratch(rows.sparkSession, "decontaminate")
    keyed = rows.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__print"), "text")
    hits = None
    for k, block in enumerate(chain([first, second], blocks)):
        part = _search(keyed, block, rate).where(F.size("__item_ids") > 0).select("__doc", "__print", F.arrays_zip("__item_ids", "__edits").alias("__hits")).distinct()
        part = scratch.save(part, f"pass{k}")
        hits = part if hits is None else hits.unionByName(part)
    order = lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(a["e"] - b["e"]).cast("int")
    every = F.transform(F.flatten(F.collect_list("__hits")), lambda h: F.struct(h["__item_ids"].isNull().alias("n"), h["__item_ids"].alias("i"), h["__edits"].alias("e")))
    hits = hits.groupBy("__doc", "__print").agg(F.array_sort(every, order).alias("__hits"))
    hits = scratch.save(hits, "hits")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__print"))
    none = F.array().cast("array<long>")
    out = rows.join(hits, same, "left")
    return out.select(*rows.columns, F.coalesce("__hits.i", none).alias("__item_ids"), F.coalesce("__hits.e", none).alias("__edits"))


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, contaminated, item_ids, edits) for every row of documents (doc_id, text);
    edits[i] is the least number of edits of item_ids[i] in the text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _matched(rows, benchmark, rate)
    return found.select("doc_id", (F.size("__item_ids") > 0).alias("contaminated"), F.col("__item_ids").alias("item_ids"), F.col("__edits").alias("edits"))


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of documents (text and others) in which no item occurs, unchanged."""
    return _matched(documents, benchmark, rate).where(F.size("__item_ids") == 0).select(documents.columns)
