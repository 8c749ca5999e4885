"""Corpus preparation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shoal.catalog.common import (
    SQL_META, SQL_TITLE, documents, meta, sql_bits, sql_spaces, sql_strip, sql_strip_code, table, titles, vectors,
)
from shoal.functions.text import (
    TOKEN, first_line, strip_markup, strip_markup_and_code_spans, strip_markup_dropping_code, tokens,
)
from shoal.operators import documents as docs
from shoal.operators.encode import embed, hashed_tfidf
from shoal.operators.ordering import with_row_id
from shoal.operators.sampling import head
from shoal.session import scratch_path, spread
from shoal.sources import schemas, tables

DIMS = 64


def required_fields(spark, sf_dir):
    kept = docs.require_fields(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return kept.select("doc_id", "source", "n_chars")


def min_length(spark, sf_dir):
    kept = docs.longer_than(table(spark, sf_dir, "documents"), "text")
    return kept.select("doc_id", F.length("text").cast("long").alias("text_length"))


def nonempty_titles(spark, sf_dir):
    return docs.with_title(titles(spark, sf_dir))


def page_text_without_code(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", strip_markup_dropping_code(F.col("html")).alias("text"))


def page_text_without_spans(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", strip_markup_and_code_spans(F.col("html")).alias("text"))


def page_text_light(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", strip_markup(F.col("html")).alias("text"))


def _corpus(spark, sf_dir):
    """Documents as nested questions: line 1 title, line 2 body, two comment lines, further lines are answers whose
    first sentence is the answer and whose other sentences are its comments. Built row by row, without a shuffle."""
    lines = F.split("text", "\n")
    as_body = lambda x: F.struct(x.alias("body"))

    def answer(line):
        sentences = F.split(line, r"\. ")
        replies = F.transform(F.slice(sentences, 2, 1 << 30), as_body)
        return F.struct(sentences[0].alias("body"), replies.alias("comments"))

    return documents(spark, sf_dir).select(F.col("doc_id").alias("question_id"), lines.alias("lines")).select(
        "question_id", F.get("lines", F.lit(0)).alias("title"), F.get("lines", F.lit(1)).alias("body"),
        F.transform(F.slice("lines", 3, 2), as_body).alias("comments"),
        F.transform(F.slice("lines", 5, 1 << 30), answer).alias("answers"),
    )


def clean_corpus(spark, sf_dir):
    return docs.clean_corpus(_corpus(spark, sf_dir))


def combined_documents(spark, sf_dir):
    text = docs.combine_nested(F.col("title"), F.col("body"), F.col("comments"), F.col("answers"))
    return _corpus(spark, sf_dir).select("question_id", text.alias("text"))


def full_documents(spark, sf_dir):
    return docs.full_documents(_corpus(spark, sf_dir)).select(
        "question_id", "title", F.col("answer_count").cast("long"), F.col("text_length").cast("long"), "full_text")


def document_metadata(spark, sf_dir):
    return docs.metadata(docs.full_documents(_corpus(spark, sf_dir))).select(
        "question_id", "title", F.col("answer_count").cast("long"), F.col("text_length").cast("long"))


def corpus_statistics(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    stats = docs.corpus_statistics(corpus, docs.metadata(docs.full_documents(corpus)))
    return stats.withColumn("mean_length", F.round("mean_length", 6))


def truncated_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("title", strip_markup(first_line(F.col("text"))))
    return rows.select("doc_id", docs.truncate(F.col("text"), F.col("title")).alias("with_title"),
                       docs.truncate(F.col("text")).alias("without_title"))


def flat_conversations(spark, sf_dir):
    number = (F.col("turn") + 1).cast("string")
    prefix = F.when(F.col("role") == "assistant", F.concat(F.lit("回答"), number)).otherwise(
        F.concat(F.lit("问题评论"), number))
    text = strip_markup_and_code_spans(F.col("text"))
    part = F.when(text != "", F.concat(prefix, F.lit(": "), text)).otherwise("")
    parts = spread(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", part.alias("part"))
    return docs.combine_flat(parts, "conv_id", "turn", "part")


def corpus_json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    tables.write_corpus(_corpus(spark, sf_dir), path)
    text = docs.combine_nested(F.col("title"), F.col("body"), F.col("comments"), F.col("answers"))
    return tables.read_corpus(spark, path, lines=True).select("question_id", text.alias("text"))


def metadata_csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    tables.write_csv(meta(spark, sf_dir), path)
    return tables.read_csv(spark, path, schemas.METADATA)


def vectors_round_trip(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    tables.write_vectors(vectors(spark, sf_dir), path)
    return tables.read_vectors(spark, path).select("id", F.posexplode("vec").alias("j", "x")).select(
        "id", (F.col("j") + 1).cast("long").alias("j"), F.round("x", 6).alias("x"))


def generated_row_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return with_row_id(rows, ["n_chars", "doc_id"], "row_id")


def first_documents(spark, sf_dir):
    return head(meta(spark, sf_dir), 5000, "question_id")


def _letters():
    """A stand-in encoder: counts of the letters a to h; it refuses texts of up to 10 characters."""
    def encode(texts):
        if any(len(t) <= 10 for t in texts):
            raise ValueError("text too short")
        return np.array([[t.count(c) for c in "abcdefgh"] for t in texts])
    return encode


def embedded_documents(spark, sf_dir):
    rows = embed(table(spark, sf_dir, "documents"), _letters, "text", "doc_id")
    return rows.select("id", F.col("error").isNotNull().alias("failed"), F.round(F.col("vec")[0], 6).alias("first"),
                       F.round(F.col("vec")[4], 6).alias("fifth"))


def hashed_document_vectors(spark, sf_dir):
    words = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), tokens(F.col("text"), []).alias("words"))
    return hashed_tfidf(words, DIMS).select("id", F.posexplode("vec").alias("j", "x")).select(
        "id", F.col("j").cast("long"), F.round("x", 6).alias("x"))


QUERIES = {f.__name__: f for f in (
    required_fields, min_length, nonempty_titles, page_text_without_code, page_text_without_spans, page_text_light,
    clean_corpus, combined_documents, full_documents, document_metadata, corpus_statistics, truncated_documents,
    flat_conversations, corpus_json_round_trip, metadata_csv_round_trip, vectors_round_trip, generated_row_ids,
    first_documents, embedded_documents, hashed_document_vectors,
)}


def _sql_without_code(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "code", "pre"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    decoded = rf"""array_to_string(list_transform(regexp_extract_all({out}, '&#?[0-9a-zA-Z]+;|[^&]+|&'), lambda t: CASE
      WHEN regexp_matches(t, '^&#[0-9]{{1,6}};$') THEN chr(CAST(regexp_extract(t, '^&#([0-9]+);$', 1) AS INT))
      WHEN regexp_matches(t, '^&#[xX][0-9a-fA-F]{{1,5}};$')
        THEN chr(CAST('0x' || regexp_extract(t, '^&#[xX]([0-9a-fA-F]+);$', 1) AS INT))
      WHEN t = '&amp;' THEN '&' WHEN t = '&lt;' THEN '<' WHEN t = '&gt;' THEN '>' WHEN t = '&quot;' THEN '"'
      WHEN t = '&apos;' THEN '''' WHEN t = '&nbsp;' THEN ' ' ELSE t END), '')"""
    return sql_spaces(decoded)


_CORPUS = """corpus AS (
  SELECT doc_id AS question_id, lines[1] AS title, lines[2] AS body, lines[3:4] AS comments, lines[5:] AS answers
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""


def _sql_part(prefix: str, x: str) -> str:
    clean = sql_strip_code(x)
    return f"CASE WHEN {clean} <> '' THEN {prefix} || {clean} ELSE '' END"


_SQL_COMBINED = f"""array_to_string(list_filter(list_concat(list_concat(
    [{_sql_part("'标题: '", "title")}, {_sql_part("'问题: '", "body")}],
    list_transform(comments, lambda c, i: {_sql_part("'问题评论' || i || ': '", "c")})),
    flatten(list_transform(answers, lambda a, j: list_transform(string_split(a, '. '), lambda s, k:
      {_sql_part("CASE WHEN k = 1 THEN '回答' || j || ': ' ELSE '回答' || j || '评论' || (k - 1) || ': ' END", "s")})))
  ), lambda p: p <> ''), ' ')"""
_SQL_COMBINED_ROWS = f"""combined AS (
  SELECT question_id, {sql_strip_code("title")} AS title, len(answers) AS answer_count, {_SQL_COMBINED} AS text FROM corpus)"""


def _sql_truncate(text: str, title: str | None) -> str:
    if title is None:
        return f"CASE WHEN length({text}) > 4000 THEN substr({text}, 1, 4000) ELSE {text} END"
    prefix = f"('标题: ' || {title} || ' ')"
    return f"""CASE WHEN length({text}) <= 4000 THEN {text} WHEN length({title}) = 0 THEN substr({text}, 1, 4000)
      ELSE {prefix} || substr({text}, length({prefix}) + 1, greatest(4000 - 2 * length({prefix}), 0)) END"""


_SQL_FULL = f"""WITH {_CORPUS}, {_SQL_COMBINED_ROWS},
cut AS (SELECT question_id, title, answer_count, {_sql_truncate("text", "title")} AS full_text FROM combined),
docs AS (SELECT question_id, title, CAST(answer_count AS BIGINT) AS answer_count,
  CAST(length(full_text) AS BIGINT) AS text_length, full_text FROM cut WHERE length(full_text) > 10)
"""

SQL = {
    "required_fields": "SELECT doc_id, source, n_chars FROM documents "
                       "WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL",
    "min_length": "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents WHERE length(text) > 10",
    "nonempty_titles": f"SELECT * FROM (SELECT doc_id AS id, {SQL_TITLE} AS title FROM documents) WHERE title <> ''",
    "page_text_without_code": f"SELECT page_id, {_sql_without_code('html')} AS text FROM pages",
    "page_text_without_spans": f"SELECT page_id, {sql_strip_code('html')} AS text FROM pages",
    "page_text_light": f"SELECT page_id, {sql_strip('html')} AS text FROM pages",
    "clean_corpus": f"""WITH {_CORPUS} SELECT question_id AS id, title || ' [SEP] ' || {_sql_without_code('body')} AS text,
      title FROM corpus WHERE question_id IS NOT NULL AND title IS NOT NULL AND body IS NOT NULL""",
    "combined_documents": f"WITH {_CORPUS} SELECT question_id, {_SQL_COMBINED} AS text FROM corpus",
    "full_documents": _SQL_FULL + "SELECT * FROM docs",
    "document_metadata": _SQL_FULL + "SELECT question_id, title, answer_count, text_length FROM docs",
    "corpus_statistics": _SQL_FULL + """SELECT (SELECT count(*) FROM corpus) AS row_count, count(*) AS valid_count,
      round(avg(text_length), 6) AS mean_length FROM docs""",
    "truncated_documents": f"""WITH t AS (SELECT doc_id, text, {SQL_TITLE} AS title FROM documents)
      SELECT doc_id, {_sql_truncate('text', 'title')} AS with_title, {_sql_truncate('text', None)} AS without_title FROM t""",
    "flat_conversations": f"""WITH parts AS (
      SELECT conv_id, turn, {_sql_part(
          "CASE WHEN role = 'assistant' THEN '回答' ELSE '问题评论' END || (turn + 1) || ': '", "text")} AS part
      FROM conversations),
    whole AS (SELECT conv_id, string_agg(part, ' ' ORDER BY turn) AS text FROM parts WHERE part <> '' GROUP BY conv_id)
    SELECT conv_id, CAST(length(text) AS BIGINT) AS full_length, {_sql_truncate('text', None)} AS text FROM whole""",
    "corpus_json_round_trip": f"WITH {_CORPUS} SELECT question_id, {_SQL_COMBINED} AS text FROM corpus",
    "metadata_csv_round_trip": f"WITH {SQL_META} SELECT * FROM meta",
    "vectors_round_trip": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
      SELECT id, generate_subscripts(e, 1) AS j,
        round(unnest(list_transform(e, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)), 6) AS x FROM n""",
    "generated_row_ids": "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS row_id FROM documents",
    "first_documents": f"WITH {SQL_META} SELECT * FROM meta ORDER BY question_id LIMIT 5000",
    "embedded_documents": """WITH c AS (SELECT doc_id AS id, length(text) <= 10 AS failed,
        list_transform(string_split('abcdefgh', ''), lambda l: CAST(length(text) - length(replace(text, l, '')) AS DOUBLE)) AS v
      FROM documents),
      n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c)
      SELECT id, failed, CASE WHEN NOT failed THEN round(v[1] / CASE WHEN n > 0 THEN n ELSE 1 END, 6) END AS first,
        CASE WHEN NOT failed THEN round(v[5] / CASE WHEN n > 0 THEN n ELSE 1 END, 6) END AS fifth FROM n""",
    "hashed_document_vectors": f"""WITH words AS (
      SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents),
    tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term),
    cells AS (SELECT id, {sql_bits("md5(term)")} % {DIMS} AS j,
        sum(CASE WHEN {sql_bits("substr(md5(term), 9, 8)")} % 2 = 0 THEN tf * idf ELSE -tf * idf END) AS w
      FROM tf JOIN idf USING (term) GROUP BY ALL),
    norms AS (SELECT id, sqrt(sum(w * w)) AS n FROM cells GROUP BY id)
    SELECT d.doc_id AS id, g.j, round(coalesce(w / CASE WHEN n > 0 THEN n ELSE 1 END, 0), 6) AS x
    FROM documents d CROSS JOIN range({DIMS}) g(j) LEFT JOIN cells c ON c.id = d.doc_id AND c.j = g.j
    LEFT JOIN norms s ON s.id = d.doc_id""",
}
