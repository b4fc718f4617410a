"""Substring deduplication by recompression.

A text is a sequence of words.  Rounds of renaming shorten all texts in the same way:
a run of one word becomes one symbol; then, with the symbols split into a left and a
right half by a bit of their name, every neighbouring pair (left, right) becomes one
symbol.  A symbol's name is a hash of what it stands for, so it is global without any
exchange, and equal stretches of words get equal symbols inside, in every document.

What a symbol depends on is known exactly (its own words and the neighbours that kept it
from joining), so a symbol whose context lies in a window of words is found again in any
equal window of any document.

After many rounds a text is a few long symbols.  A long symbol whose words, and the twelve
after it, are also in an earlier document is settled at once: every window that starts in
it is a repeat.  Equal windows are also in the earlier document, so only symbols that are
not settled are looked into further: of a group of copies, that is one copy.  Among those,
each window chooses the symbol of the highest level among
its consistent ones; every repeat therefore shows as a chosen symbol that two documents share.  Spark
finds the shared symbols, and only windows that chose one are compared, by 96 bits of
their content.

Defined results: null texts have no words.  A row with a null doc_id is returned, but is
neither changed nor compared: it has no order.  Rows that repeat a doc_id are one
document in several rows, which are not compared with each other; what is found in a row's
text is removed from the rows with that doc_id and text.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OTHER_BASE, OTHER_INV, U64, WORD_BASE, WORD_INV, Scratch, Words, in_arrow, mix, ranged_hash, word_lists

#: Words of a window.
WINDOW = 13
#: Rounds of pair renaming: more of them choose more symbols, fewer of them choose commoner ones.
ROUNDS = 2
#: Rounds that make the long symbols, of about 0.75 ** -LONG_ROUNDS words.
LONG_ROUNDS = 10
_FAR = 1 << 40


def _name(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix(a * U64(0xBF58476D1CE4E5B9) + mix(b + U64(0x94D049BB133111EB * (2 * level + 1) % (1 << 64))))


def representatives(words: np.ndarray, first: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The chosen symbol of the window that starts at each word, named by its level and a hash of
    the words that it depends on.

    ``first`` has the word index of each text's start, and the end.  Windows that reach
    over a text's end get a symbol too; the caller leaves them out.
    """
    n = len(words)
    slack = np.zeros((width, n + 1), U64)
    top = U64(60)
    slack[width - 1, :n] = words >> U64(4)
    if n < width:
        return slack[width - 1, :n]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def offer(level: int, low: np.ndarray, high: np.ndarray) -> None:
        use = (high - low <= width) & (low >= 0)
        low, high = low[use], high[use]
        # all words that the symbol depends on: more of them are in one document only
        value = (ranged_hash(words, low, high, WORD_BASE, WORD_INV) >> U64(4)) | (U64(level) << top)
        np.maximum.at(slack.reshape(-1), (width - (high - low)) * (n + 1) + low, value)

    # runs of one word
    fresh = np.ones(n, bool)
    fresh[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], n)
    length = end - start
    name = np.where(length > 1, _name(words[start], length.astype(U64), 0), words[start])
    home = text[start]
    low = np.where(start > first[home], start - 1, -_FAR)
    high = np.where(end < first[home + 1], end + 1, _FAR)
    offer(1, low[length > 1], high[length > 1])
    # pairs
    for level in range(1, rounds + 1):
        if len(name) < 2:
            break
        left = (name >> U64(5 * level)) & U64(1) == 0
        same = home[1:] == home[:-1]
        joins = left[:-1] & ~left[1:] & same
        heads = np.flatnonzero(joins)
        new_low, new_high = low.copy(), high.copy()
        # a left symbol that stays single depends on what follows it, a right one on what precedes it
        after = np.append(np.where(same, high[1:], _FAR), _FAR)
        before = np.insert(np.where(same, low[:-1], -_FAR), 0, -_FAR)
        new_high[left] = np.maximum(high, after)[left]
        new_low[~left] = np.minimum(low, before)[~left]
        new_low[heads] = np.minimum(low[heads], low[heads + 1])
        new_high[heads] = np.maximum(high[heads], high[heads + 1])
        name = name.copy()
        name[heads] = _name(name[heads], name[heads + 1], level)
        offer(level + 1, new_low[heads], new_high[heads])
        keep = np.ones(len(name), bool)
        keep[heads + 1] = False
        name, low, high, home = name[keep], new_low[keep], new_high[keep], home[keep]
    best = slack[width - 1]
    for gap in range(width - 2, -1, -1):
        best[:-1] = np.maximum(best[:-1], best[1:])
        np.maximum(best, slack[gap], out=best)
    return best[:n]


def long_symbols(words: np.ndarray, first: np.ndarray, rounds: int = LONG_ROUNDS) -> np.ndarray:
    """The word indexes where the symbols of the last round start."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    fresh = edge[:n].copy()
    fresh[0] = True
    fresh[1:] |= words[1:] != words[:-1]
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, n)).astype(U64)
    name = np.where(length > 1, _name(words[start], length, 0), words[start])
    for level in range(1, rounds + 1):
        left = (name >> U64(5 * level)) & U64(1) == 0
        heads = np.flatnonzero(left[:-1] & ~left[1:] & ~edge[start[1:]])
        name[heads] = _name(name[heads], name[heads + 1], level)
        keep = np.ones(len(name), bool)
        keep[heads + 1] = False
        name, start = name[keep], start[keep]
    return start


def _double_hash(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for the words of each range."""
    one = ranged_hash(hashes, low, high, WORD_BASE, WORD_INV)
    two = ranged_hash(mix(hashes ^ U64(0x1B873593CC9E2D51)), low, high, OTHER_BASE, OTHER_INV)
    return one.view(np.int64), (two >> U64(32)).astype(np.uint32).view(np.int32)


def _longs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words in word_lists(batches, "text"):
            hashes, first = words.hashes(), words.first
            start = long_symbols(hashes, first)
            text = np.searchsorted(first, start, "right") - 1
            end = np.append(start[1:], len(hashes))
            # windows start in start..end and reach over the end
            stop = np.minimum(end, first[text + 1] - width + 1)
            use = stop > start
            start, stop, text = start[use], stop[use], text[use]
            h, g = _double_hash(hashes, start, stop + width - 1)
            docs, prints = (chunk.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 2))
            base = first[text]
            yield pa.record_batch(
                [pa.array(h), pa.array(g), pa.array(docs, pa.int64()), pa.array(prints, pa.int64()), pa.array((start - base).astype(np.int32)), pa.array((stop - base).astype(np.int32))],
                ["h", "g", "d", "f", "s", "e"],
            )

    return run


def _window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index of every window, its text) of texts that start at ``first``."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return first[text] + inside, text


def _symbols(width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words in word_lists(batches, "text"):
            chosen = representatives(words.hashes(), words.first, width, rounds)
            at, text = _window_starts(words.first, width)
            symbol = chosen[at]
            new = np.ones(len(at), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])
            doc, part = (chunk.column(c).to_numpy(zero_copy_only=False)[text[new]] for c in (0, 2))
            yield pa.record_batch([pa.array(symbol[new].view(np.int64)), pa.array(doc, pa.int64()), pa.array(part, pa.int32())], ["k", "d", "part"])

    return run


def _ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null([]) if column.null_count else column
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _spread(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any range low..high."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.cumsum(step[:n]) > 0


def _windows(width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words in word_lists(batches, "text"):
            hashes, first = words.hashes(), words.first
            chosen = representatives(hashes, first, width, rounds).view(np.int64)
            keys, key_at = _ranges(chunk.column(2))
            low, low_at = _ranges(chunk.column(3))
            high, _ = _ranges(chunk.column(4))
            owner, _ = _ranges(chunk.column(5))
            docs, prints = (chunk.column(c).to_numpy(zero_copy_only=False) for c in (0, 6))
            out = []
            for i in range(chunk.num_rows):
                a, b = first[i], first[i + 1] - width + 1
                shared = keys[key_at[i] : key_at[i + 1]]
                if b > a and len(shared):
                    part = slice(low_at[i], low_at[i + 1])
                    mine = owner[part] == prints[i]
                    settled = _spread(low[part][mine], high[part][mine], b - a)
                    out.append((i, a + np.flatnonzero(~settled & np.isin(chosen[a:b], shared))))
            if not out:
                continue
            at = np.concatenate([x for _, x in out])
            row = np.repeat([i for i, _ in out], [len(x) for _, x in out])
            h, g = _double_hash(hashes, at, at + width)
            # a window that a document has many times is one row with its places
            order = np.lexsort((g, h, row))
            at, row, h, g = at[order], row[order], h[order], g[order]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            bounds = np.append(np.flatnonzero(new), len(at)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(bounds), pa.array((at - first[row]).astype(np.int32)))
            yield pa.record_batch([pa.array(h[new]), pa.array(g[new]), pa.array(docs[row[new]], pa.int64()), pa.array(prints[row[new]], pa.int64()), places], ["h", "g", "d", "f", "s"])

    return run


def _kept(words: Words, lists: list[pa.Array], width: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words, removed words, kept text) of each text, given its (starts, low, high)."""
    count = np.diff(words.first)
    (one, one_at), (low, low_at), (high, _) = (_ranges(x) for x in lists)
    texts, removed = [], np.zeros(len(count), np.int64)
    raw = words.data.tobytes()
    for i, n in enumerate(count.tolist()):
        first = words.first[i]
        at, part = one[one_at[i] : one_at[i + 1]], slice(low_at[i], low_at[i + 1])
        begin = np.concatenate([at, low[part]])
        end = np.concatenate([at + width, high[part] + width - 1])
        keep = ~_spread(begin, end, n)
        removed[i] = n - int(keep.sum())
        a, b = words.starts[first : first + n], words.ends[first : first + n]
        texts.append(b" ".join([raw[x:y] for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]).decode("utf-8"))
    return count, removed, texts


def _shared(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(keys, least) of keys under several d, written: a join with a table that is read can deal
    out a key of very many rows to several tasks, one with an aggregation can't."""
    low = rows.groupBy(*keys).agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    low = scratch.save(low.select(*keys, "least"), name)
    scratch.drop()  # the sums' shuffle files go before the join writes its own
    return low


def _earlier(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of (h, g, d, ...) whose content (h, g) is also under a smaller d."""
    return rows.join(_shared(rows, ["h", "g"], scratch, name), ["h", "g"]).where("d > least")


def _fingerprint() -> Column:
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.xxhash64("text")


def _part(print_: Column) -> Column:
    """Half of a fingerprint.  It deals out the rows of one doc_id where a mix-up does no harm."""
    return F.shiftright(print_, 32).cast("int").alias("part")


def repeats(documents: DataFrame, scratch: Scratch, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Windows whose words also start in a document with a smaller doc_id, as word places:
    (d, f, starts) one by one, and (d, f, low, high) for all windows that start in low..high, of the
    rows with doc_id d and a text of fingerprint f."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    rows = rows.withColumn("f", _fingerprint())
    longs = scratch.save(in_arrow(rows, _longs(width), "h long, g int, d long, f long, s int, e int"), "longs")
    settled = _earlier(longs, scratch, "low-longs").groupBy("d", "f").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    settled = scratch.save(settled.select("d", "f", F.col("x.s").alias("low"), F.col("x.e").alias("high")), "settled")
    scratch.drop("longs", "low-longs")
    parted = rows.select("doc_id", "text", _part(F.col("f")))
    symbols = scratch.save(in_arrow(parted, _symbols(width, rounds), "k long, d long, part int"), "symbols")
    shared = _shared(symbols, ["k"], scratch, "shared").select("k")
    own = symbols.join(shared, "k").groupBy("d", "part").agg(F.collect_set("k").alias("keys"))
    # what is known of a (doc_id, part) meets first, so that the texts move once
    ranges = settled.select("d", _part(F.col("f")), F.explode(F.arrays_zip("low", "high")).alias("x"), "f")
    ranges = ranges.groupBy("d", "part").agg(F.collect_list(F.struct("x.low", "x.high", "f")).alias("x"))
    ranges = ranges.select("d", "part", F.col("x.low").alias("low"), F.col("x.high").alias("high"), F.col("x.f").alias("owner"))
    known = scratch.save(own.join(ranges, ["d", "part"], "left"), "known")
    scratch.drop("symbols", "shared")
    dealt = rows.withColumn("part", _part(F.col("f"))).withColumnRenamed("doc_id", "d")
    found = dealt.join(known, ["d", "part"]).select("d", "text", "keys", "low", "high", "owner", "f")
    windows = scratch.save(in_arrow(found, _windows(width, rounds), "h long, g int, d long, f long, s array<int>"), "windows")
    scratch.drop("known")
    later = _earlier(windows, scratch, "low-windows").groupBy("d", "f").agg(F.flatten(F.collect_list("s")).alias("starts"))
    later = scratch.save(later, "later")
    scratch.drop("windows", "low-windows")
    return later, settled


def _with_repeats(documents: DataFrame, width: int, rounds: int) -> DataFrame:
    """documents with what to remove, as _starts, _low and _high."""
    scratch = Scratch(documents.sparkSession, "substrings")
    later, settled = repeats(documents, scratch, width, rounds)
    later = later.select(F.col("d").alias("_d"), F.col("f").alias("_f"), F.col("starts").alias("_starts"))
    settled = settled.select(F.col("d").alias("_e"), F.col("f").alias("_g"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    rows = documents.withColumn("_print", _fingerprint())
    rows = rows.join(later, (F.col("doc_id") == F.col("_d")) & (F.col("_print") == F.col("_f")), "left")
    rows = rows.join(settled, (F.col("doc_id") == F.col("_e")) & (F.col("_print") == F.col("_g")), "left")
    return rows.drop("_d", "_f", "_e", "_g", "_print")


def dedup(documents: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of documents (doc_id, text): ``kept``
    has the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words in word_lists(batches, "text"):
            count, removed, texts = _kept(words, chunk.columns[2:], width)
            yield pa.record_batch([chunk.column(0), pa.array(count, pa.int64()), pa.array(removed), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = _with_repeats(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, rounds)
    return in_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept string")


def rewrite(documents: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """documents (doc_id, text, n_chars and others) with the words that stay as ``text``; rows
    that lose all their words go, rows that lose none are unchanged."""
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words in word_lists(batches, "text"):
            count, removed, texts = _kept(words, [chunk.column(c) for c in ("_starts", "_low", "_high")], width)
            old = chunk.column("text")
            new = [texts[i] if removed[i] else old[i].as_py() for i in range(chunk.num_rows)]
            chars = chunk.column("n_chars").to_pylist()
            sizes = [len(new[i]) if removed[i] else chars[i] for i in range(chunk.num_rows)]
            fresh = {"text": pa.array(new, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            whole = pa.record_batch([fresh.get(c, chunk.column(c)) for c in columns], columns)
            yield whole.filter(pa.array((removed < count) | (count == 0)))

    return in_arrow(_with_repeats(documents, width, rounds), run, documents.schema)


def digest(documents: DataFrame) -> DataFrame:
    """What ``dedup`` keeps, as (doc_id, n_words, n_removed, kept_sha256)."""
    return dedup(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by definition, for small tables of distinct doc_ids."""
    import re

    texts = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in rows}
    low: dict[tuple, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - width + 1):
            low.setdefault(tuple(texts[d][i : i + width]), d)
    out = {}
    for d, w in texts.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if low[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
