"""URL filters: explicit host and path rules, and association rules mined from labels.

A URL is a set of tokens (host labels, path words, query names).  Spark's FP-growth mines
token combinations of labelled URLs together with the label as one more item; rules
``combination -> label`` that pass the support and confidence bounds (or, for bad, a bound on the
lift over the share of bad rows) are kept, and of those no rule that a smaller combination with at
least its confidence already gives.  Rules are
matched through an inverted index: each is filed under its rarest token, so a URL only looks
at rules filed under its own tokens.  Of the mined rules of both labels that fit, the one with
the highest confidence decides, then the one with most tokens, then bad before good.

Explicit rules come first; among those that fit, the longest wins.

Defined results: a null url, or one without ``://``, has an empty host and path and no token;
it fits no rule and is allowed.  Without labelled rows nothing is mined and all other URLs are
allowed.  Rows are judged one by one, so repeated rows agree.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow

#: Labelled rows that a combination must be in: this share of them, and at least so many.
SUPPORT = 0.002
LEAST_ROWS = 10
CONFIDENCE = 0.7
#: A combination with less confidence is a rule for bad too if it has more than this confidence, this
#: multiple of the share of bad rows, and is above that share by SURE standard errors.  A rule for
#: good must be above the share of good rows by as much: without one a URL is allowed anyway.
LEAST_CONFIDENCE, LIFT, SURE = 0.5, 2.0, 2.6
#: Rules that one pass over the URLs looks for.
BLOCK_RULES = 50_000
BAD, GOOD = "label=bad", "label=good"


@dataclass(frozen=True)
class Rule:
    """Explicit rule: ``verdict`` for host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str


def host_column(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL: host labels, path words, and query names."""
    if url is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    path, _, query = tail.split("#", 1)[0].partition("?")
    out = [f"h:{x}" for x in host.lower().split(".") if x]
    out += [f"p:{x}" for x in re.split(r"[^\w-]+", path.lower()) if x and not x.isdigit()]
    out += [f"q:{x.split('=', 1)[0]}" for x in query.lower().split("&") if x]
    return sorted(set(out))


def _tokens_frame(urls: DataFrame, *keep: str) -> DataFrame:
    schema = ", ".join(f"{c} {urls.schema[c].dataType.simpleString()}" for c in keep) + ", tokens array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([tokens(x.as_py()) for x in batch.column(len(keep))], pa.list_(pa.string()))
            yield pa.record_batch([*batch.columns[: len(keep)], own], [*keep, "tokens"])

    return in_arrow(urls.select(*keep, "url"), run, schema)


def _frequent(rows: DataFrame, least: int) -> list[list[str]]:
    """Frequent tokens of rows (tokens, ...), those that occur in the same rows together.

    At most the mean number of tokens of a row over the support, however many rows there are.
    """
    each = rows.select(F.explode("tokens").alias("t"), *[F.xxhash64("tokens", F.lit(k)).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)])
    seen = each.groupBy("t").agg(F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("n") >= least)
    return [sorted(r.t) for r in seen.groupBy("n", "h1", "h2").agg(F.collect_list("t").alias("t")).collect()]


def significant(n: Column, total: Column, base: float) -> Column:
    """Whether n of total is above a base rate by more than chance: Wilson's lower bound."""
    share, z2 = n / total, SURE**2
    middle = share + F.lit(z2) / (2 * total)
    spread = F.lit(SURE) * F.sqrt(share * (1 - share) / total + F.lit(z2) / (4 * total * total))
    return (middle - spread) / (1 + F.lit(z2) / total) > F.lit(base)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_ROWS) -> DataFrame:
    """Rules (tokens, bad, confidence, n) from labelled URLs (url, bad boolean), each written out."""
    rules = merged_rules(labelled, support, confidence, least)
    none = F.array(F.array().cast("array<string>"))
    longer = lambda done, any_of: F.flatten(F.transform(done, lambda x: F.transform(any_of, lambda t: F.concat(x, F.array(t)))))
    return rules.select(F.explode(F.aggregate("same", none, longer)).alias("tokens"), "bad", "confidence", "n")


def merged_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_ROWS) -> DataFrame:
    """Rules (tokens, same, bad, confidence, n) from labelled URLs (url, bad boolean).

    Tokens that occur in the same rows are mined as one (``tokens`` has the first of them, ``same``
    all, of which any will do), so query names that always come together do not multiply
    combinations.
    """
    spark = labelled.sparkSession
    rows = _tokens_frame(labelled.where("bad is not null and url is not null"), "bad").where("size(tokens) > 0")
    rows = Scratch(spark, "urls").save(rows, "tokens")
    count, bad_rows = rows.agg(F.count("*"), F.count_if("bad")).first()
    schema = "tokens array<string>, same array<array<string>>, bad boolean, confidence double, n long"
    if not count:
        return spark.createDataFrame([], schema)
    share = min(1.0, max(support, least / count))
    groups = {g[0]: g for g in _frequent(rows, math.ceil(share * count - 1e-9))}
    if not groups:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast({t: first for first, g in groups.items() for t in g})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[*dict.fromkeys(held.value[t] for t in ts if t in held.value), BAD if bad else GOOD] for bad, ts in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([pa.array(items, pa.list_(pa.string()))], ["items"])

    items = in_arrow(rows.select("bad", "tokens"), named, "items array<string>")
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(items)
    label = F.when(F.array_contains("items", BAD), F.lit(True)).when(F.array_contains("items", GOOD), F.lit(False))
    plain = F.array_sort(F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD))))
    sets = model.freqItemsets.select(plain.alias("tokens"), label.alias("bad"), F.col("freq").alias("n")).where("size(tokens) > 0")
    whole = sets.where("bad is null").select("tokens", F.col("n").alias("total"))
    rules = sets.where("bad is not null").join(whole, "tokens").withColumn("confidence", F.col("n") / F.col("total"))
    base = bad_rows / count
    sure = F.col("confidence") >= confidence
    raised = (F.col("confidence") > LEAST_CONFIDENCE) & (F.col("confidence") >= LIFT * base) & significant(F.col("n"), F.col("total"), base)
    rules = rules.where(F.when(F.col("bad"), sure | raised).otherwise(sure & significant(F.col("n"), F.col("total"), 1 - base)))
    # a rule says nothing new if one token fewer gives the label with at least its confidence
    parts = rules.where("size(tokens) > 1").select(F.col("tokens").alias("long"), "bad", F.col("confidence").alias("c"), F.explode("tokens").alias("t"))
    parts = parts.withColumn("tokens", F.array_remove("long", F.col("t")))
    known = parts.join(rules.select("tokens", "bad", "confidence"), ["tokens", "bad"]).where("confidence >= c")
    rules = rules.join(known.select(F.col("long").alias("tokens"), "bad").distinct(), ["tokens", "bad"], "left_anti")
    table = F.create_map(*[x for first, g in groups.items() if len(g) > 1 for x in (F.lit(first), F.array(*map(F.lit, g)))]) if any(len(g) > 1 for g in groups.values()) else None
    same = F.transform("tokens", lambda t: F.coalesce(F.try_element_at(table, t), F.array(t)) if table is not None else F.array(t))
    return rules.select("tokens", same.alias("same"), "bad", "confidence", "n")


class Index:
    """Inverted index of rules, each filed under its rarest token.  A rule's token may be a list of
    which any will do."""

    def __init__(self, rules: list[tuple[list, bool, float]]):
        given = [([frozenset([p] if isinstance(p, str) else p) for p in parts], bad, c) for parts, bad, c in rules]
        uses: dict[str, int] = {}
        for parts, _, _ in given:
            for t in frozenset().union(*parts):
                uses[t] = uses.get(t, 0) + 1
        self.filed: dict[str, list[tuple[list[frozenset], bool, float]]] = {}
        for parts, bad, confidence in given:
            for t in min(parts, key=lambda p: (sum(uses[t] for t in p), sorted(p))):
                self.filed.setdefault(t, []).append((parts, bad, confidence))

    def strongest(self, own: list[str]) -> tuple[float, int, bool]:
        """(confidence, tokens, blocks) of the strongest rule that fits; (0, 0, False) without one."""
        have, top = set(own), (0.0, 0, False)
        for t in own:
            for parts, bad, confidence in self.filed.get(t, ()):
                if not any(have.isdisjoint(p) for p in parts):
                    top = max(top, (confidence, len(parts), bad))
        return top

    def best(self, own: list[str]) -> tuple[float, bool]:
        """(confidence, blocks) of the strongest rule that fits; (0, False) without one."""
        confidence, _, blocks = self.strongest(own)
        return confidence, blocks


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, confidence, blocks) for every row of urls (key, url): what the mined rules of both labels say."""
    spark = urls.sparkSession
    same = F.col("same") if "same" in rules.columns else F.transform("tokens", lambda t: F.array(t)).alias("same")
    ordered = rules.select(same, "bad", "confidence")
    start = (F.lit(0.0).alias("confidence"), F.lit(0).alias("size"), F.lit(False).alias("blocks"))
    out = urls.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"), *start)
    block: list = []

    def passed(rows: DataFrame, part: list) -> DataFrame:
        held = spark.sparkContext.broadcast(part)  # at most BLOCK_RULES rules

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(held.value)
            for batch in batches:
                best = [max((c.as_py(), n.as_py(), b.as_py()), index.strongest(tokens(u.as_py()))) for u, c, n, b in zip(*batch.columns[1:], strict=True)]
                found = [pa.array([x[i] for x in best], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.bool_()))]
                yield pa.record_batch([*batch.columns[:2], *found], [key, "url", "confidence", "size", "blocks"])

        return in_arrow(rows, run, f"{key} long, url string, confidence double, size int, blocks boolean")

    for row in ordered.toLocalIterator():
        block.append(([list(p) for p in row.same], bool(row.bad), float(row.confidence)))
        if len(block) >= BLOCK_RULES:
            out, block = passed(out, block), []
    out = passed(out, block) if block else out
    return out.drop("size")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence, decided_by) for every row of pages (page_id,
    url); decided_by is ``rule``, ``mined`` or, where nothing fits, ``default``."""
    judged = judge(pages, merged_rules(labelled))
    host, path = host_column(F.col("url")), path_column(F.col("url"))
    fits = explicit(rules, F.col("host"), F.col("path"))
    judged = judged.withColumn("host", host).withColumn("path", path).withColumn("fits", fits)
    mined = F.when(F.col("blocks"), "block").otherwise("allow")
    decided = F.when(F.col("fits").isNotNull(), "rule").when(F.col("confidence") > 0, "mined").otherwise("default")
    return judged.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", mined).alias("verdict"), "confidence", decided.alias("decided_by"))
