"""Every operator against brute force or fixed answers, and on awkward tables."""

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import chat, decontaminate, embeddings, html, jaccard, language, mixing, queries, substrings, toxicity, urls
from pixelloom.llm.common import Scratch, Words, components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def docs(spark, texts, extra=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + (extra or []), DOC)


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 911}x{i % 7}" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (None, "a b c d e f g h i j k l m n o p", "en", None, 3), (1, None, "en", "s", None), (2, "", None, "s", 0),
        (3, " \t\n ", "en", None, 4), (4, long, "de", "t", 1), (5, long, "de", "t", 1), (6, "one", "en", "s", 3), (7, "one", "en", "s", 3),
        (8, "repeat this row please " * 5, "fr", "s", 9), (8, "repeat this row please " * 5, "fr", "s", 9), (9, "\u00e9\u00e8 \U0001f600 \u4e2d\u6587", "es", "u", 7), (10, "123 456 !!", None, "u", 9),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in ("id", "size", "d", "block", "x", "component", "keys", "low", "high", "starts", "f", "g", "n", "blocks", "copies", "p", "part", "owner", "unit", "units", "band", "k", "ks", "least", "h", "toxic"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# Word tools --------------------------------------------------------------------------------


def test_words_and_components(spark):
    import pyarrow as pa

    texts = ["a  bb\tc", "", None, " x ", "\u00a0y z", "q" * 3000]
    w = Words(pa.array(texts))
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    assert w.hashes()[0] == Words(pa.array(["zz a"])).hashes()[1]
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 1 URL filters -------------------------------------------------------------------------------


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def test_urls_by_brute_force(spark, sf):
    rows = [r.url for r in read(spark, sf, "pages").collect()]
    rows += [None, "", "nothing", "HTTP://A.NET", "x://Sub.EXAMPLE.net/en/a?b", "x://net/", "x://annet/", "x://example.com/de/#f", "x://org/fr/q?://z", "a://b.org/fr", "://org/fr/", "x://a.org\n/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string").withColumn("host", F.lit(1))
    labelled = spark.createDataFrame([(f"http://bad{i % 3}.com/win/{i}", True) for i in range(60)] + [(f"http://ok.com/news/{i}", False) for i in range(60)], "url string, bad boolean")
    got = {r.page_id: r for r in urls.filter_urls(pages, labelled, queries.URL_RULES).collect()}
    mined = [(set(r.tokens), r.confidence) for r in urls.mine(labelled).where("bad").collect()]
    assert ({"p:win"}, 1.0) in mined
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        m = re.match(r"(?s)(?:.*?)://([^/?#]*)([^?#]*)", u or "")
        host = "".join(c.lower() if c < "\x80" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        rule = max((r for r in queries.URL_RULES if fits(r, host, path)), key=lambda r: len(r.host + r.path), default=None)
        say = rule.verdict if rule else "block" if any(s <= set(urls.tokens(u)) for s, _ in mined) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule and rule.host + rule.path, say), u
    assert urls.filter_urls(pages.limit(0), labelled.limit(0), []).count() == 0


def test_url_index_equals_scan():
    rules = [(["a", "b"], True, 0.9), (["b"], True, 0.7), (["c", "d"], True, 0.8)]
    assert urls.Index([([["a", "e"], "b"], True, 0.9)]).best(["b", "e"]) == (0.9, True)
    for own in (["a", "b"], ["b"], ["c"], ["c", "d", "b"], []):
        want = max([(c, bad) for parts, bad, c in rules if set(parts) <= set(own)], default=(0.0, False))
        assert urls.Index(rules).best(own) == want


def test_urls_strongest_rule_of_either_label(spark, monkeypatch):
    rows = [(f"http://x{i}.com/win/{i}", i < 150) for i in range(150)] + [(f"http://ok.com/win/{i}", False) for i in range(49)]
    rows += [("http://ok.com/win/a", True)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = {(tuple(sorted(r.tokens)), r.bad): r.confidence for r in urls.mine(labelled).collect()}
    assert mined[("p:win",), True] == 151 / 200 and mined[("h:ok",), False] == 49 / 50
    pages = spark.createDataFrame([(1, "http://ok.com/win/"), (2, "http://no.com/win/"), (3, "http://ok.com/")], "page_id long, url string")
    for block in (50_000, 1):
        monkeypatch.setattr(urls, "BLOCK_RULES", block)
        got = {r.page_id: (r.verdict, r.confidence) for r in urls.filter_urls(pages, labelled, []).collect()}
        assert got == {1: ("allow", 0.98), 2: ("block", 0.755), 3: ("allow", 0.98)}
    # equal confidence: more tokens decide, then bad before good
    assert urls.Index([(["a"], True, 0.8), (["a", "b"], False, 0.8)]).best(["a", "b"]) == (0.8, False)
    assert urls.Index([(["a"], False, 0.8), (["b"], True, 0.8)]).best(["a", "b"]) == (0.8, True)


def test_urls_rule_of_four_tokens(spark):
    rows = [(f"http://x{i}/p1/p2/p3/p4", True) for i in range(12)]
    for left in range(1, 5):
        path = "/".join(f"p{k}" for k in range(1, 5) if k != left)
        rows += [(f"http://y{left}x{i}/{path}", False) for i in range(12)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    assert [(sorted(r.tokens), r.confidence) for r in urls.mine(labelled).where("bad").collect()] == [(["p:p1", "p:p2", "p:p3", "p:p4"], 1.0)]
    pages = spark.createDataFrame([(1, "http://z/p4/p3/p2/p1"), (2, "http://z/p4/p3/p2")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, labelled, []).collect()} == {1: "block", 2: "allow"}


def rules_by_brute_force(rows, support, confidence, least):
    """All combinations of all tokens, counted one by one; then the bounds and the pruning."""
    from itertools import combinations

    own = [(frozenset(urls.tokens(u)), bad) for u, bad in rows]
    enough = max(support, least / len(own)) * len(own) - 1e-9
    seen = {frozenset(c) for tokens, _ in own for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k)}
    found = {}
    for c in seen:
        total = sum(c <= t for t, _ in own)
        for bad in (True, False):
            n, base = sum(c <= t and b == bad for t, b in own), sum(b == bad for _, b in own) / len(own)
            if n < enough:
                continue
            share, z = n / total, urls.SURE
            low = (share + z * z / (2 * total) - z * (share * (1 - share) / total + z * z / (4 * total * total)) ** 0.5) / (1 + z * z / total)
            raised = share > urls.LEAST_CONFIDENCE and share >= urls.LIFT * base
            if share >= confidence and (bad or low > base) or bad and raised and low > base:
                found[c, bad] = share
    return {(c, bad): s for (c, bad), s in found.items() if not any(found.get((c - {t}, bad), 0) >= s for t in c)}


def test_url_mining_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        path = [p for p in ("win", "news", "shop", "blog") if rng.random() < 0.4]
        host = ["ok", "pills", "mail", "ok", "mail", "mail"][int(rng.integers(6))]
        risk = 0.9 if {"win", "shop"} <= set(path) else 0.62 if host == "pills" else 0.05
        query = "?a=1&b=2&c=3" if rng.random() < 0.2 else ""  # three names that always come together
        rows.append((f"http://{host}.com/{'/'.join(path)}/{i}{query}", bool(rng.random() < risk)))
    want = rules_by_brute_force(rows, 0.02, 0.7, 10)
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"), 0.02, 0.7, 10).collect()
    got = {(frozenset(r.tokens), r.bad): r.confidence for r in mined}
    assert len(got) == len(mined)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert any(bad and c < 0.7 for (_, bad), c in got.items()) and any(not bad for _, bad in got)


def test_url_labels_decide(spark, sf):
    """Labels that follow the URLs decide verdicts of the query's own pages."""
    pages = read(spark, sf, "pages").select("page_id", "url").withColumn("token", F.lit("clash"))
    pages = pages.unionByName(spark.createDataFrame([(None, None, "x"), (None, "http://a.win/x", "y")], pages.schema))
    rows = [(f"http://{h}.win/{i}", True) for i, h in enumerate(["a", "b", "c"] * 20)] + [(f"http://{h}.example/{i}", False) for i, h in enumerate(["a", "b", "c"] * 40)]
    got = urls.filter_urls(pages, spark.createDataFrame(rows, "url string, bad boolean"), []).collect()
    assert len(got) == pages.count()
    assert {(r.verdict, r.decided_by) for r in got if r.host == "a.win"} == {("block", "mined")}
    assert {r.decided_by for r in got if r.host == ""} == {"default"}


# 2 Substring dedup -----------------------------------------------------------------------------


def test_substrings_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(40)]
    texts = []
    for i in range(60):
        t = [base[k] for k in rng.integers(0, 40, rng.integers(0, 80))]
        if i and i % 3 == 0:
            other = words(texts[int(rng.integers(0, i))])
            a = int(rng.integers(0, max(1, len(other))))
            t = t[:20] + other[a : a + int(rng.integers(5, 60))] + t[20:]
        texts.append("  ".join(t))
    texts += ["z " * 40, "z " * 30, "y " + "z " * 13, "", None, "p q " * 30, "q p " * 20, texts[3], texts[3], " ".join(base)]
    want = substrings.brute_force([*enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs(spark, texts)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 500


def test_substrings_awkward(spark, awkward):
    got = substrings.digest(awkward).collect()
    assert len(got) == 13 and len(got[0]) == 4
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[4].n_removed == 0 and by[5].n_removed == by[5].n_words == 60_000
    assert by[5].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[8].n_removed == 0 and by[1].n_words == 0
    assert substrings.digest(awkward.limit(0)).count() == 0


# 3 Decontamination -----------------------------------------------------------------------------


def test_substrings_rows_of_one_doc_id_with_different_texts(spark):
    run = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    first, other = run("a", 40), run("b", 400)
    rows = [(1, first + other), (2, run("c", 5) + first), (2, run("d", 60)), (2, other[:200] + run("e", 30)), (2, run("g", 230) + first[:20]), (2, run("d", 60))]
    kept = [rows[0][1], rows[1][1][:5], rows[2][1], rows[3][1][200:], rows[4][1][:230], rows[5][1]]
    table = spark.createDataFrame([(d, " ".join(t), "en", "s", len(" ".join(t))) for d, t in rows], DOC)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(table).collect())
    assert got == sorted((d, len(t), len(t) - len(k), " ".join(k)) for (d, t), k in zip(rows, kept))
    assert sorted(r.text for r in substrings.rewrite(table).collect()) == sorted(" ".join(k) for k in kept)


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_by_brute_force(spark):
    rng = np.random.default_rng(8)
    letters = list("abcde ")
    items = [(i, "".join(rng.choice(letters, 40 + 7 * i)).strip() + "x") for i in range(6)] + [(9, None), (10, " "), (11, "short")]
    texts = []
    for i in range(40):
        t = list("".join(rng.choice(letters, 150)))
        if i % 2:
            body = list(decontaminate.normalise(items[i % 6][1]))
            for _ in range(i // 6):
                body[int(rng.integers(len(body)))] = "q"
            t[50:50] = body
        texts.append("".join(t))
    texts += ["", None, "SHORT\n", items[2][1].upper().replace(" ", "\n ")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {r.doc_id: dict(zip(r.item_ids, r.edits)) for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    hits = 0
    for d, t in enumerate(texts):
        text, want = decontaminate.normalise(t), {}
        for item, raw in items:
            p = decontaminate.normalise(raw)
            if p and (e := least_edits(p, text)) <= int(decontaminate.ERROR_RATE * len(p)):
                want[item] = e
        assert got[d] == want
        hits += len(want)
    assert 10 < hits
    kept = decontaminate.clean(docs(spark, texts), bench)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(not v for v in got.values())


def test_decontamination_in_blocks(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(1, "one"), (2, "456 !!"), (3, "nothing of the sort")], "item_id long, text string")
    whole = sorted(map(str, decontaminate.matches(awkward, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4)
    assert sorted(map(str, decontaminate.matches(awkward, bench).collect())) == whole and len(whole) == 13
    assert decontaminate.matches(awkward, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean(awkward.limit(0), bench).count() == 0


def test_decontamination_short_items_and_null_ids(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a"), (2, "hello"), (None, "some words of a test"), (3, "some words of a test"), (4, None), (5, " ")], "item_id long, text string")
    texts = ["an othello", "say Hello!", "hello", "a", "b-a", "so some  words of a TEST", None, "", "\u00e9hello"]
    table = docs(spark, texts).withColumn("_hits", F.lit("clash"))
    want = [[], [(2, 0)], [(2, 0)], [(1, 0)], [(1, 0)], [(1, 0), (3, 0), (None, 0)], [], [], []]
    for block in (8_000_000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        got = {r.doc_id: [*zip(r.item_ids, r.edits, strict=True)] for r in decontaminate.matches(table, items).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert sorted(r.doc_id for r in decontaminate.clean(table, items).collect()) == [0, 6, 7, 8]
        assert decontaminate.matches(table, items.limit(0)).where("contaminated").count() == 0


def test_myers_is_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (int(rng.integers(1, 30)), int(rng.integers(0, 60))))
        bits = defaultdict(int)
        for i, c in enumerate(p):
            bits[c] |= 1 << i
        e = least_edits(p, t)
        for most in (0, 2, 5, 30):
            assert min(decontaminate.myers(bits, len(p), t, most), most + 1) == min(e, most + 1)


# 4 Toxicity ------------------------------------------------------------------------------------


def test_toxicity_held_out():
    rng = np.random.default_rng(2)
    plain, rude = ["wala", "mori", "tenu", "sabe", "lino", "karo"], ["grubnik", "zoxfed"]
    make = lambda bad, n: " ".join(rng.choice(plain, n).tolist() + (rng.choice(rude, 1 + n // 20).tolist() if bad else []))
    rows = [(make(i % 4 == 0, int(rng.integers(5, 200))), int(i % 4 == 0)) for i in range(500)]
    model = toxicity.fit([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    hits = [(model.score(t) >= toxicity.THRESHOLD) == bool(y) for t, y in rows[300:]]
    assert np.mean(hits) > 0.97
    again = toxicity.fit([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    assert (again.weights == model.weights).all()


def test_toxicity_long_texts_leave_room(spark, monkeypatch):
    texts = ["long " * 400] * 3 + [f"short text {i}" for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels)))
    toxicity.train(docs(spark, texts), labels)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1500)
    toxicity.train(docs(spark, texts), labels)
    (whole, marks), (cut, same) = seen
    assert sorted(whole) == sorted(texts) and same == marks and sum(marks) == 21
    limit = (1500 - sum(map(len, texts[3:]))) // 3
    assert cut == [t[:limit] for t in whole] and sum(map(len, cut)) <= 1500


def test_toxicity_tables(spark, sf, awkward):
    got = queries.op4_toxicity(spark, sf).collect()
    assert len(got) == read(spark, sf, "documents").count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
    empty = toxicity.train(awkward, spark.createDataFrame([(None, 1), (1, None), (4, 0)], "doc_id long, toxic int"))
    assert {round(r.score, 3) for r in toxicity.score(awkward, empty).collect()} == {0.0}
    assert toxicity.score(awkward.limit(0), empty).count() == 0


# 5 Jaccard join --------------------------------------------------------------------------------


def jaccard_brute(texts, threshold=0.8):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12} for i in sets}
    label = {i: i for i in sets}
    for _ in sets:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in sets}
    return {i: (label[i], len(links[i])) for i in sets}


def test_jaccard_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(14):
        base = [f"t{k}" for k in rng.integers(0, 500, int(rng.integers(30, 150)))]
        for c in range(1 + g):
            t = list(base)
            for _ in range(c // 3):
                t[int(rng.integers(len(t)))] = f"n{rng.integers(10_000)}"
            texts.append(" ".join(t))
    texts += ["", None, "a b", "a  b", "a", "x y z", " "]
    want = jaccard_brute(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == want
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 3)  # large components go in blocks
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs(spark, texts)).collect()} == want
    kept = jaccard.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, v in want.items() if v[0] == i]


def test_jaccard_awkward(spark, awkward):
    got = jaccard.join(awkward).collect()
    by = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in got}
    assert len(got) == 12 and by[5] == (4, 1, False) and by[7] == (6, 1, False) and by[8] == (8, 0, True) and by[2] == (2, 0, True)
    assert [r.kept for r in got if r.doc_id is None] == [True, True]
    assert jaccard.join(awkward.limit(0)).count() == 0
    bands, rows = jaccard.choose_bands(0.8, 0.999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_jaccard_rows_of_one_doc_id_are_judged_each(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda rows: sorted((tuple(r) for r in jaccard.keep_one(table(rows)).collect()), key=str)
    assert kept([(1, b), (2, a), (2, b)]) == [(1, b), (2, a)]
    assert kept([(1, a), (2, a), (2, b)]) == [(1, a), (2, b)]
    alone = [(1, a), (1, a), (None, a), (3, None), (3, "")]
    assert kept(alone) == sorted(alone, key=str)
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in jaccard.join(table([(1, b), (2, a), (2, b), (3, a), (3, None)])).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 2), 3: (2, 2, 1)}


def test_jaccard_long_chain_is_cut_by_bands(spark, monkeypatch):
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join(words[4 * k : 4 * k + 60]) for k in range(200)]  # each is near to the next one only
    want = jaccard_brute(texts)
    assert {v[1] for v in want.values()} == {1, 2}
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 2)
    most, real = [], jaccard._units

    def units(*given):
        out = real(*given)
        most.append(out.agg(F.max(F.size("units"))).first()[0])
        return out

    monkeypatch.setattr(jaccard, "_units", units)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs(spark, texts)).collect()} == want
    assert most[0] > 1


# 6 Chat ----------------------------------------------------------------------------------------


def test_tool_calls(spark):
    call = lambda i, name, args, after=(): {"id": i, "name": name, "arguments": args, "after": list(after)}
    rows = [
        (1, 0, "user", "hi \u00e9\n\"q\""), (1, 1, "assistant", json.dumps({"tool_calls": [call("b", "get", {"z": 1, "a": [1, {"y": 2, "b": None}]}, ["a"]), call("c", "get", {"z": "no"})]})),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("a", "get", {"z": 2})]})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "r1"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "b", "content": "r2"})), (1, 5, "tool", json.dumps({"tool_call_id": "zz", "content": None})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", "get", {"z": 1}, ["q"]), call("q", "get", {"z": 1}, ["p"])]})),
        (2, 1, "tool", json.dumps({"tool_call_id": "p", "content": ""})), (2, 2, "tool", json.dumps({"tool_call_id": "q", "content": ""})), (None, None, None, None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = {"get": {"z": ("BIGINT", True), "a": ("ARRAY<OBJECT<b: VOID, y: BIGINT>>", False)}}
    got = chat.link(chat.tool_events(messages), schemas).collect()
    by = {(r.conv_id, r.call_id, r.role): r for r in got}
    assert len(got) == 12
    assert by[1, "a", "assistant"].linked_turn == 3 and by[1, "a", "tool"].linked_turn == 2
    assert by[1, "c", "assistant"].status == "open" and by[1, "zz", "tool"].status == "orphan"
    assert by[1, "c", "assistant"].valid is False and by[1, "a", "assistant"].valid is True
    place = lambda *k: (by[k].order_turn, by[k].order_depth)
    assert place(1, "a", "assistant") < place(1, "a", "tool") < place(1, "b", "assistant") < place(1, "b", "tool")
    assert by[2, "p", "assistant"].valid is False and place(2, "p", "assistant") == (0, 0)
    line = by[1, "b", "assistant"].line
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False) and '"arguments":{"a":[1,{"b":null,"y":2}],"z":1}' in line


def test_plain_chat_awkward(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 3, "assistant", "y"), (2, 0, None, ""), (None, 1, "user", "u"), (3, None, "user", "w" * 200_000), (4, 0, "user", ""), (4, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit(1)).withColumn("v", F.lit(2))
    got = chat.link(chat.plain_events(df)).collect()
    assert len(got) == len(rows)
    assert sorted(r.status for r in got) == sorted(["linked"] * 3 + ["orphan", "note"] + ["open"] * 4)
    assert all(json.loads(r.line) for r in got)
    assert [r.valid for r in got if r.conv_id == 1 and r.role == "user"] == [False]
    assert chat.link(chat.plain_events(df.limit(0))).count() == 0


def test_chat_places_by_brute_force(spark):
    """Random graphs of calls against a plain longest path."""
    rng = np.random.default_rng(12)
    for most in (1, 3):
        rows, want = [], {}
        for conv in range(6):
            n = 12
            after = {i: sorted({int(x) for x in rng.integers(0, n, int(rng.integers(0, most + 1)))} - {i}) for i in range(n)}
            turn = {i: int(t) for i, t in enumerate(rng.permutation(n))}
            answered = {i: 20 + int(t) if rng.random() < 0.8 else None for i, t in enumerate(rng.permutation(n))}
            for i in range(n):
                rows.append((conv, turn[i], "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "ask", "arguments": "{}", "after": [f"c{j}" for j in after[i]]}]})))
                if answered[i] is not None:
                    rows.append((conv, answered[i], "tool", json.dumps({"tool_call_id": f"c{i}", "content": "x"})))
            needs = {i: [j for j in after[i] if answered[j] is not None] for i in range(n)}

            def place(i, path=()):
                if i in path:
                    return None
                got = [(place(j, (*path, i)), j) for j in needs[i]]
                if any(p is None for p, _ in got):
                    return None
                return max([turn[i], *(max(p[0], answered[j]) for p, j in got)]), max([0, *(p[1] + 2 for p, _ in got)])

            want |= {(conv, f"c{i}"): place(i) for i in range(n)}
        got = chat.link(chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).where("role = 'assistant'").collect()
        for r in got:
            p = want[r.conv_id, r.call_id]
            assert (r.order_turn, r.order_depth) == (p or (r.turn, 0)) and (p is not None or r.valid is False)
        assert len(got) == len(want)


def test_chat_mixes_plain_turns_and_tools(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(40)]
    rows += [(1, 40, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "get", "arguments": "{}", "after": []}]})), (1, 41, "tool", json.dumps({"tool_call_id": "x", "content": "r"})), (1, 42, "tool", "{broken"), (1, 43, "assistant", "{}")]
    got = {r.turn: r for r in chat.link(chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert len(got) == 44 and [got[k].order_depth for k in range(40)] == list(range(40))
    assert got[40].status == got[41].status == "linked" and got[42].status == "note" and got[43].status == "orphan"


# 7 Embeddings ------------------------------------------------------------------------------------


def embeddings_brute(vectors):
    fine = {i: np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in fine if j != i and i in fine and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= 0.95} for i in vectors}
    label = {i: i for i in vectors}
    for _ in range(50):
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in vectors}
    return {i: (len(links[i]), label[i], label[i] == i) for i in vectors}


@pytest.mark.parametrize("block", [4096, 7])
def test_embeddings_by_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PER_CELL", 16)
    vectors = {}
    for i in range(300):
        base = rng.normal(size=16) if i % 3 == 0 else np.array(vectors[i - 1]) + rng.normal(size=16) * 0.15
        vectors[i] = base.astype(np.float32).tolist()
    for i in range(300, 320):
        vectors[i] = vectors[5]
    vectors |= {400: None, 401: [], 402: [0.0] * 16, 403: [None] + [1.0] * 15, 404: [float("nan")] * 16, 405: [1.0, 2.0], 406: [2.0, 4.0], 407: [float("inf")] * 16}
    df = spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    df = df.unionByName(df.where("vec_id = 3"))
    want = embeddings_brute(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got.keys() == want.keys()
    found, true = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert 0.97 * true <= found <= true and all(got[i][0] <= want[i][0] for i in want)
    for i in range(400, 408):
        assert got[i] == want[i]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_rows_of_one_vec_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, b), (2, a), (2, b), (3, a), (3, None), (None, a), (None, None), (4, [0.0, 1.0, 0.0, 0.0])]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (2, 2, 1, False), (3, 1, 2, False), (4, 0, 4, True)]
    none = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id is null").collect()
    assert [tuple(r) for r in none] == [(None, 0, None, True)] * 2


# 8 Language ----------------------------------------------------------------------------------------


def test_language_held_out(spark, sf):
    rows = read(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in queries.op8_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert held and np.mean(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_learns_rare_ones(spark):
    rng = np.random.default_rng(2)
    make = lambda alphabet: " ".join("".join(rng.choice(list(alphabet), 5)) for _ in range(30))
    rows = [(i, make("abcde"), "xx", "s", 1) for i in range(3000)] + [(5000 + i, make("vwxyz"), "yy", "s", 1) for i in range(6)]
    table = spark.createDataFrame(rows, DOC).withColumn("_place", F.lit("clash"))
    model = language.train(table)
    assert model.languages == ["xx", "yy"]
    got = language.identify(spark.createDataFrame([(1, make("vwxyz"), None, None, None), (2, make("abcde"), None, None, None)], DOC), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "yy", 2: "xx"}


def test_language_awkward(spark, awkward):
    model = language.train(awkward)
    got = language.identify(awkward, model).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == 13 and {by[k].lang_pred for k in (1, 2, 3, 10)} == {"und"} and by[1].score == 0
    assert by[9].lang_pred in model.languages
    assert language.identify(awkward, language.train(awkward.limit(0))).where("lang_pred <> 'und'").count() == 0
    kept = language.keep_identified(awkward, model, 0.0)
    assert kept.columns == awkward.columns and kept.count() == 8
    assert language.identify(awkward.limit(0), model).count() == 0


# 9 HTML ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<b>b</b>\n c<br>d</p>", "ab c d"),
        ("<nav><a href=x>Home</a></nav><article><h1>T &lt;1&gt;</h1><p>One<p>Two</article><footer>f</footer>", "T <1> One Two"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>kept</p><!-- <p>no</p> --><form><p>no</p></form>", "kept"),
        ('<div class="post"><p>The long story of the day is here.</p></div><div id="cookie-notice">Cookies!</div><div class="comments"><p>I say no to all of that.</p></div>', "The long story of the day is here."),
        ("<article><p>cut off he", "cut off he"), ("<article><p>x</p><aside><p>no</p></aside><p>y</p></article><div>Advert of a long kind</div>", "x y"),
        ("<p>caf&eacute; &#x41;&#66;</p>", "caf\u00e9 AB"), ("<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>" + "<p>" + "words here " * 20 + "</p>", ("words here " * 20).strip()),
    ],
)
def test_html(page, want):
    assert html.main_text(page) == want


def test_html_article_is_a_hint(monkeypatch):
    body = [f"Paragraph {i} of the story that stands in plain containers of the page." for i in range(6)]
    story = "<div><h1>Headline</h1>" + "".join(f"<p>{p}</p>" for p in body) + "</div>"
    cards = "<div>" + "".join(f"<article><p>Card {i}</p></article>" for i in range(3)) + "</div>"
    for page in (story + cards, cards + story):
        got = html.main_text(page)
        assert " ".join(["Headline", *body]) in got
    # text beside an article stays where it surges, with the parts of its container
    ads = "<div class=ad><p>a</p><p>b</p><p>c</p></div>"
    more = f"<div><h2>More</h2>{ads}<p>{body[0]}</p><p>{body[1]}</p></div>"
    page = "<article>" + "".join(f"<p>{p}</p>" for p in body) + f"</article>{ads}<div>Advert</div>{ads}{more}"
    assert html.main_text(page) == " ".join([*body, "More", *body[:2]])
    monkeypatch.setattr(html, "BLOCK", 1)  # no window reaches the threshold
    assert html.main_text(page) == " ".join(body)


def test_html_divided_article():
    ads = "<div class=ad><p>a</p><p>b</p><p>c</p></div>"
    related = "<ul>" + "".join(f"<li><a href=x>Other story {i}</a></li>" for i in range(4)) + "</ul>"
    parts = ["Headline", "The long middle part of the story. " * 20, "It says:", "the whole report", "The closing words."]
    a, b, c, d, e = (p.strip() for p in parts)
    page = f"<div><h1>{a}</h1>{ads}<p>{b}</p><p>{c}</p><p><a href=x>{d}</a></p>{related}<p>{e}</p></div>"
    assert html.main_text(page) == " ".join((a, b, c, d, e))
    assert html.main_text(page.replace("div>", "section>")) == " ".join((a, b, c, d, e))
    # parts in containers of their own
    page = f"<div><h1>{a}</h1></div>{ads}<div><p>{b}</p></div>{related}<div><p>{e}</p></div>"
    assert html.main_text(page) == " ".join((a, b, e))
    # lists of links: by their container, or as a window of nothing else
    menu = "".join(f"<div><a href=x>Menu {i}</a></div>" for i in range(3))
    assert html.main_text(menu + f"<p>{b}</p>") == b
    assert html.main_text(f"<p><a href=x>{d}</a></p>") == ""


def test_html_blocks_decide_without_article(monkeypatch):
    menu = "<div>" + "".join(f"<p>Item {i}</p>" for i in range(6)) + "</div>"  # no tag, no name, no link
    story = "<div><h1>Head</h1>" + "".join(f"<p>Paragraph {i} of the story, which is long enough to surge in its window of lines.</p>" for i in range(5)) + "<p>a</p><p>b</p><p>c</p><p>d</p></div>"
    want = " ".join(["Head", *(f"Paragraph {i} of the story, which is long enough to surge in its window of lines." for i in range(5)), "a b c d"])
    assert html.main_text(menu + story) == html.main_text(story + menu) == want
    with monkeypatch.context() as m:  # without the windows the menu is text
        m.setattr(html, "_flat", lambda length, *_: length)
        assert html.main_text(menu + story) != want
    short = "<div>" + "".join(f"<p>line {i}</p>" for i in range(9)) + "</div>"  # a poem is no menu
    assert html.main_text(short) == " ".join(f"line {i}" for i in range(9))


def test_html_wrapper_names_are_void():
    text = "The article of the page in its only container. " * 5
    for name in ("content with-sidebar", "no-sidebar", "has-menu", "page-header", "layout-widget main-menu"):
        for inner in (f"<p>{text}</p>", f"<article><p>{text}</p></article>", f'<div class="sidebar"><p>Other things</p></div><p>{text}</p>'):
            assert html.main_text(f'<div class="{name}">{inner}</div><div class="footer">f</div>') == text.strip()
    comments = '<div class="comments">' + "<p>I say no to all of that, and again no.</p>" * 30 + "</div>"
    assert html.main_text(f"<div><p>{text}</p></div>{comments}") == text.strip()


def test_html_deep_nesting_takes_linear_time():
    import time

    for page in ("<div>" * 50_000 + "x", "<div class=ad>" * 50_000 + "x", "<b>" * 50_000 + "x" + "</b>" * 50_000, "</p><a>" * 50_000 + "x"):
        began = time.process_time()
        assert html.main_text(page) in ("x", "")
        assert time.process_time() - began < 3


def test_html_pages(spark, sf):
    import html as entities

    rows = read(spark, sf, "pages").collect()
    got = {r.page_id: r for r in html.extract(read(spark, sf, "pages").withColumn("text", F.lit("clash"))).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(None, None, None), (1, None, "<p>" * 30_000 + "deep"), (1, None, "x" * 500_000)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html.extract(odd).collect()) == [0, 4, 500_000]


# 10 Mixing ------------------------------------------------------------------------------------------


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, rest, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def check_mix(rows, near):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = fill({s: sum(r.size for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert all(r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in v)
        assert abs(sum(r.taken for r in v) - want[s]) <= near * max(r.size for r in v) + 1e-6


def test_mixing(spark, sf, awkward, monkeypatch):
    rows = queries.op10_mixing(spark, sf).collect()
    source = {r.doc_id: r for r in read(spark, sf, "documents").collect()}
    assert len(rows) == len(source) and all(r.size == len(words(source[r.doc_id].text)) and r.source == source[r.doc_id].source for r in rows)
    check_mix(rows, 1)
    again = mixing.mix(read(spark, sf, "documents").repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    check_mix(mixing.mix(read(spark, sf, "documents")).collect(), 1)
    got = mixing.mix(awkward).collect()
    assert len(got) == 13
    check_mix(got, 1)
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_mixing_many_sources_and_equal_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", f"s{int(rng.integers(0, 80)):02d}", 1) for i in range(900)]
    rows += [(None, "a b c", "en", "s00", 5)] * 400 + [(None, "a b c", "en", None, 5)] * 70 + [(7, "x y", "en", "s01", 3)] * 31
    docs_ = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(mixing, "RUN", 50)  # large groups are written out in runs
    got = mixing.mix(docs_).collect()
    assert got and got[0].__fields__[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(d), len(words(t)), str(s)) for d, t, _, s, _ in rows)
    check_mix(got, 1)
    assert sorted(map(str, mixing.mix(docs_.repartition(3)).collect())) == sorted(map(str, got))
    per = [r.copies for r in got if r.doc_id is None and r.source == "s00"]
    want = next(r.target / r.source_size for r in got if r.source == "s00")
    assert abs(np.mean(per) - want) < 2 / 400


def test_flight_keeps_totals():
    rng = np.random.default_rng(6)
    size = rng.integers(1, 100, 500).astype(float)
    x = mixing.fly(size, np.full(500, 0.37), rng)
    assert ((x > 0) & (x < 1)).sum() <= 2
    assert x.sum() == pytest.approx(185) and (x * size).sum() == pytest.approx(0.37 * size.sum())
    many = np.mean([mixing.fly(size, np.full(500, 0.37), np.random.default_rng(k)) for k in range(60)], axis=0)
    assert abs(many.mean() - 0.37) < 1e-6 and many.min() > 0.1


# The pipeline ----------------------------------------------------------------------------------------


def test_pipeline_awkward(spark, sf, awkward):
    import corpus_pipeline as p

    for table, many in ((awkward, True), (awkward.limit(0), False)):
        docs_ = table
        for k, (name, stage) in enumerate(p.STAGES):
            docs_ = Scratch(spark, "test").save(stage(spark, docs_, sf), name)
            assert k == 4 or docs_.columns == awkward.columns
        rows = docs_.collect()
        if many:  # of equal texts the first; nothing without a letter
            assert {4, 6, 8} <= {r.doc_id for r in rows} <= {None, 4, 6, 8, 9}
            check_mix(rows, 1)
        else:
            assert rows == []


def test_pipeline_leaves_nothing_behind(spark, sf, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from pixelloom.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = p.run(spark, sf)
    assert out.count() > 0
    assert [x.name for x in tmp_path.iterdir()] == [common.Scratch.live[-1].rsplit("/", 1)[1]]
    common.release(spark)
    assert not list(tmp_path.iterdir())
    monkeypatch.undo()
    other = type("Other", (), {"conf": type("Conf", (), {"get": lambda self, *a: None})(), "sparkContext": type("Context", (), {"master": "yarn", "applicationId": "a"})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(other)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    start = read(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in start.collect()}
    docs, seen = start, []
    for k, (name, stage) in enumerate(p.STAGES):
        docs = Scratch(spark, "test").save(stage(spark, docs, sf), name)
        if k < 4:
            assert docs.columns == start.columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
    lang, near, sub, clean = seen
    assert set(lang) == {d for d, t in texts.items() if re.search(r"[^\W\d_]", t or "")} or len(lang) > 0.97 * len(texts)
    order = sorted(lang)
    want = jaccard_brute([lang[d] for d in order])
    assert set(near) == {order[i] for i, v in want.items() if v[0] == i}
    brute = substrings.brute_force([*near.items()])
    assert set(sub) == {d for d, v in brute.items() if v[1] < v[0]}
    for d, t in sub.items():
        assert hashlib.sha256(" ".join(words(t)).encode()).hexdigest() == brute[d][2]
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    matcher = decontaminate.Matcher(items)
    assert set(clean) == {d for d, t in sub.items() if not matcher.match(t)}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(clean)
    check_mix(rows, 1)
