"""Queries that SQL can express give the rows of their SQL."""

import duckdb
import pytest

from pixelloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    pick = lambda names, rows: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert pick(got.columns, got.collect()) == pick(columns, want.fetchall())


def test_sql_of_the_parts_that_have_it(spark, sf):
    """Explicit URL rules, sizes and targets of the mix, and verbatim benchmark passages, in SQL."""
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(r"""
WITH cut AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS u FROM pages),
parts AS (SELECT page_id, translate(u.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.p AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM parts LEFT JOIN fits USING (page_id) ORDER BY page_id""").fetchall()
    got = QUERIES["op1_url_filters"](spark, sf).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.path, r.rule) for r in got] == [w[:4] for w in want]
    assert all(r.verdict == w[4] for r, w in zip(got, want, strict=True) if w[4])

    # targets by trying every number of sources at their cap
    want = con.execute(r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
tot AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS w FROM tot), r AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w, k) AS place FROM w),
lv AS (SELECT m.place, (1.5 * (SELECT sum(n) FROM r) - coalesce((SELECT sum(2 * n) FROM r x WHERE x.place < m.place), 0)) / (SELECT sum(w) FROM r x WHERE x.place >= m.place) AS level, 2 * m.n / m.w AS most FROM r m),
best AS (SELECT arg_min(level, place) AS level FROM lv WHERE level <= most)
SELECT s.doc_id, s.size, CAST(r.n AS BIGINT), least(2 * r.n, (SELECT level FROM best) * r.w) FROM sized s JOIN r ON s.source IS NOT DISTINCT FROM r.source ORDER BY s.doc_id""").fetchall()
    got = QUERIES["op10_mixing"](spark, sf).orderBy("doc_id").collect()
    assert [(r.doc_id, r.size, r.source_size) for r in got] == [w[:3] for w in want]
    assert all(r.target == pytest.approx(w[3]) for r, w in zip(got, want, strict=True))

    exact = con.execute("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(b.text) > 12 AND contains(d.text, b.text)").fetchall()
    found = {(r.doc_id, i) for r in QUERIES["op3_benchmark_decontamination"](spark, sf).collect() for i, e in zip(r.item_ids, r.edits, strict=True) if e == 0}
    assert exact and found >= set(exact)
