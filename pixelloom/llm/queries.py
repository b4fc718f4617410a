"""The queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, html, jaccard, language, mixing, substrings, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """The fold that no model sees: crc32 of the decimal doc_id, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


#: The explicit rules of the URL filter.
URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, bad): a page is the document whose number ends the path of its url and has its label;
    low quality or toxic is bad."""
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    labels = _table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(bad.alias("bad"))
    number = F.regexp_extract(urls.path_column(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    pages = _table(spark, sf_dir, "pages").select("url", F.nullif(number, F.lit("")).cast("long").alias("doc_id")).where("doc_id is not null")
    return pages.join(labels, "doc_id").select("url", "bad")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir), URL_RULES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.events(_table(spark, sf_dir, "conversations")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = language.train(documents, ~held_out())
    return language.identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_substring_dedup,
        op3_benchmark_decontamination,
        op4_toxicity,
        op5_ngram_jaccard_join,
        op6_chat_formatting,
        op7_embedding_near_dedup,
        op8_language_id,
        op9_html_extraction,
        op10_mixing,
    )
}

OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words WHERE len(ws) >= 13)
), low AS (
  SELECT k, min(doc_id) AS low FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS place
  FROM (SELECT w.doc_id, w.i, unnest(range(0, 13)) AS j FROM windows w JOIN low USING (k) WHERE low.low < w.doc_id)
), placed AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM words
), marked AS (
  SELECT p.doc_id, p.word, p.place, g.place IS NOT NULL AS removed
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place
), kept AS (
  SELECT doc_id, CAST(count(*) FILTER (removed) AS BIGINT) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (NOT removed) AS kept
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""

#: Five-word runs as sets, Jaccard by counting common runs, classes by recursion over the links.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE c * 5 >= 4 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen
), classes AS (
  SELECT id, min(seen) AS class_id FROM reach GROUP BY id
), copies AS (
  SELECT w.doc_id, least(w.doc_id, coalesce(min(l.b), w.doc_id)) AS copy_id
  FROM sizes w LEFT JOIN (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c = x.n AND c = y.n
  ) l ON l.a = w.doc_id GROUP BY w.doc_id
), degrees AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT d.doc_id, k.class_id, coalesce(c.copy_id, d.doc_id) AS copy_id,
       CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links, d.doc_id = k.class_id AS kept
FROM documents d JOIN classes k ON k.id = d.doc_id
LEFT JOIN copies c ON c.doc_id = d.doc_id LEFT JOIN degrees g ON g.a = d.doc_id
"""

#: A user's turn waits for the assistant's before it, which answers the user's turn before that.
OP6_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, conv_id || '-' || turn AS own, conv_id || '-' || (turn - 1) AS before FROM conversations
), linked AS (
  SELECT t.*, r.turn AS answer, c.turn AS asked
  FROM turns t
  LEFT JOIN turns r ON t.role = 'user' AND r.role = 'assistant' AND r.conv_id = t.conv_id AND r.turn = t.turn + 1
  LEFT JOIN turns c ON t.role = 'assistant' AND c.role = 'user' AND c.conv_id = t.conv_id AND c.turn = t.turn - 1
), waits AS (
  SELECT u.conv_id, u.turn, q.turn AS earlier FROM conversations u
  JOIN conversations r ON u.role = 'user' AND r.role = 'assistant' AND r.conv_id = u.conv_id AND r.turn = u.turn - 1
  LEFT JOIN conversations q ON q.role = 'user' AND q.conv_id = u.conv_id AND q.turn = u.turn - 2
), deep AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS d FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM waits w WHERE w.conv_id = c.conv_id AND w.turn = c.turn)
  UNION
  SELECT conv_id, turn, CAST(2 AS BIGINT) FROM waits WHERE earlier IS NULL
  UNION
  SELECT w.conv_id, w.turn, p.d + 2 FROM deep p JOIN waits w ON w.conv_id = p.conv_id AND w.earlier = p.turn
), named AS (
  SELECT *, CASE role WHEN 'user' THEN own WHEN 'assistant' THEN before END AS call_id,
         CASE role WHEN 'user' THEN answer WHEN 'assistant' THEN asked END AS linked_turn,
         CASE WHEN role = 'user' THEN CASE WHEN answer IS NULL THEN 'open' ELSE 'linked' END
              WHEN role = 'assistant' THEN CASE WHEN asked IS NULL THEN 'orphan' ELSE 'linked' END
              ELSE 'note' END AS status
  FROM linked
)
SELECT conv_id, turn, role, call_id, status, linked_turn, turn AS order_turn,
       CASE role WHEN 'user' THEN (SELECT max(d) FROM deep p WHERE p.conv_id = named.conv_id AND p.turn = named.turn)
                 WHEN 'assistant' THEN 1 + coalesce((SELECT max(d) FROM deep p WHERE p.conv_id = named.conv_id AND p.turn = named.turn - 1), 0) ELSE 0 END AS order_depth,
       CASE WHEN role = 'user' THEN text IS NOT NULL END AS valid,
       CASE WHEN role = 'user' THEN
         '{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"id":"' || call_id || '","name":"ask","role":"user","status":"' || status || '"}'
       WHEN role = 'assistant' THEN
         '{"call":"' || call_id || '","content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"assistant","status":"' || status || '"}'
       ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS line
FROM named
"""

#: Every pair of vectors in double precision, components by recursion over the links.
OP7_SQL = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95
), reach AS (
  SELECT vec_id AS id, vec_id AS seen FROM embeddings
  UNION
  SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.seen
), least AS (
  SELECT id, min(seen) AS component_id FROM reach GROUP BY id
), degrees AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
}
