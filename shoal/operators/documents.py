"""Corpus preparation: field filters, text combination, truncation, metadata and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.text import strip_markup_and_code_spans, strip_markup_dropping_code
from shoal.session import computed_once

# Separator of title and body, part prefixes of a combined document, length limits.
TITLE_BODY_SEPARATOR = " [SEP] "
TITLE_PREFIX = "标题: "
BODY_PREFIX = "问题: "
COMMENT_PREFIX = "问题评论{n}: "
ANSWER_PREFIX = "回答{n}: "
ANSWER_COMMENT_PREFIX = "回答{n}评论{m}: "
MAX_LENGTH = 4000
MIN_LENGTH = 10

_SALTS = 64


def require_fields(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which every named field is present."""
    keep = F.lit(True)
    for name in names:
        keep = keep & F.col(name).isNotNull()
    return df.filter(keep)


def longer_than(df: DataFrame, text: str = "full_text", length: int = MIN_LENGTH) -> DataFrame:
    return df.filter(F.length(text) > length)


def with_title(df: DataFrame, title: str = "title") -> DataFrame:
    return df.filter(F.col(title) != "")


def title_and_body(title: Column, body: Column) -> Column:
    """`title [SEP] body`; null when either is null."""
    return F.concat(title, F.lit(TITLE_BODY_SEPARATOR), body)


def clean_corpus(corpus: DataFrame) -> DataFrame:
    """(id, text, title) with code-free bodies, for rows that have id, title and body."""
    return require_fields(corpus, "question_id", "title", "body").select(
        F.col("question_id").alias("id"),
        title_and_body(F.col("title"), strip_markup_dropping_code(F.col("body"))).alias("text"),
        "title",
    )


def _numbered(template: str, *numbers: Column) -> Column:
    """A prefix with its `{n}` and `{m}` replaced by numbers."""
    out, rest = [], template
    for mark, number in zip(("{n}", "{m}"), numbers):
        before, rest = rest.split(mark)
        out += [F.lit(before), number.cast("string")]
    return F.concat(*out, F.lit(rest))


def _labelled(texts: Column, prefix) -> Column:
    """Prefix every non-empty text; `prefix(i)` gives the prefix of 0-based position i."""
    return F.transform(texts, lambda t, i: F.when(t != "", F.concat(prefix(i), t)).otherwise(F.lit("")))


def combine_nested(title: Column, body: Column, comments: Column, answers: Column, clean=strip_markup_and_code_spans) -> Column:
    """All text of a nested document: title, body, comments, each answer followed by its comments.

    Numbers are the original 1-based positions, so an empty part leaves a gap; empty parts are dropped. Every text
    is cleaned once, in a first pass over the arrays; the second pass only adds the prefixes.
    """
    no_parts = F.array().cast("array<string>")

    def answer(texts: Column, j: Column) -> Column:
        def prefix(m: Column) -> Column:
            return F.when(m == 0, _numbered(ANSWER_PREFIX, j + 1)).otherwise(
                _numbered(ANSWER_COMMENT_PREFIX, j + 1, m))

        return _labelled(texts, prefix)

    heads = _labelled(F.array(clean(title), clean(body)), lambda i: F.when(i == 0, TITLE_PREFIX).otherwise(BODY_PREFIX))
    cleaned_comments = F.transform(comments, lambda c: clean(c["body"]))
    cleaned_answers = F.transform(answers, lambda a: F.concat(
        F.array(clean(a["body"])), F.coalesce(F.transform(a["comments"], lambda c: clean(c["body"])), no_parts)))
    parts = F.concat(
        heads,
        F.coalesce(_labelled(cleaned_comments, lambda i: _numbered(COMMENT_PREFIX, i + 1)), no_parts),
        F.coalesce(F.flatten(F.transform(cleaned_answers, answer)), no_parts),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def truncate(text: Column, title: Column | None = None, limit: int = MAX_LENGTH) -> Column:
    """Texts over the limit are cut; with a title the result is `limit` minus the title prefix characters long."""
    plain = F.substring(text, 1, limit)
    if title is None:
        return F.when(F.length(text) > limit, plain).otherwise(text)
    prefix = F.concat(F.lit(TITLE_PREFIX), title, F.lit(" "))
    width = F.length(prefix)
    kept = F.substring(text, width + 1, F.greatest(F.lit(limit) - width * 2, F.lit(0)))
    cut = F.when(F.length(title) > 0, F.concat(prefix, kept)).otherwise(plain)
    return F.when(F.length(text) > limit, cut).otherwise(text)


def full_documents(corpus: DataFrame) -> DataFrame:
    """(question_id, title, answer_count, text_length, full_text) of every document long enough to encode."""
    docs = computed_once(
        corpus,
        title=strip_markup_and_code_spans(F.col("title")),
        answer_count=F.greatest(F.coalesce(F.size("answers"), F.lit(0)), F.lit(0)),
        combined=combine_nested(F.col("title"), F.col("body"), F.col("comments"), F.col("answers")),
    )
    docs = computed_once(docs, full_text=truncate(F.col("combined"), F.col("title")))
    return longer_than(docs).select(
        "question_id", "title", "answer_count", F.length("full_text").alias("text_length"), "full_text")


def metadata(documents: DataFrame) -> DataFrame:
    return documents.select("question_id", "title", "answer_count", "text_length")


def combine_flat(parts: DataFrame, id_col: str, order_col: str, part_col: str, limit: int = MAX_LENGTH) -> DataFrame:
    """(id, full_length, text): the non-empty parts of each id, in order, joined by one space and cut at `limit`.

    Each kept part adds a character and a space, so no more than `limit` parts can reach the cut text. Only those
    are gathered; the full length comes from a plain sum. An id with very many parts is first ranked in `_SALTS`
    separate groups, whose leading parts include its leading parts, so neither its rows nor its text meet in one task.
    """
    kept = computed_once(parts.select(id_col, order_col, part_col), _part=F.col(part_col)).filter("_part <> ''")
    lengths = kept.groupBy(id_col).agg((F.sum(F.length("_part") + 1) - 1).alias("full_length"))
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64(id_col, order_col), F.lit(_SALTS)))
    in_group = Window.partitionBy(id_col, "_salt").orderBy(order_col)
    near = salted.withColumn("_rn", F.row_number().over(in_group)).filter(F.col("_rn") <= limit)
    over_all = Window.partitionBy(id_col).orderBy(order_col)
    leading = near.withColumn("_rn", F.row_number().over(over_all)).filter(F.col("_rn") <= limit)
    gathered = leading.groupBy(id_col).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_part"))), lambda p: p["_part"]), " "
        ).alias("_text")
    )
    cut = F.substring("_text", 1, limit)
    return lengths.join(gathered, id_col).select(
        id_col, "full_length", F.when(F.col("full_length") > limit, cut).otherwise(F.col("_text")).alias("text")
    )


def corpus_statistics(all_rows: DataFrame, valid: DataFrame, length_col: str = "text_length") -> DataFrame:
    """One row: rows read, rows kept, mean text length of the kept ones."""
    read = all_rows.select(F.lit(1).alias("r"), F.lit(0).alias("v"), F.lit(None).cast("double").alias("n"))
    kept = valid.select(F.lit(0).alias("r"), F.lit(1).alias("v"), F.col(length_col).cast("double").alias("n"))
    return read.unionByName(kept).agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("v"), F.lit(0)).alias("valid_count"),
        F.avg("n").alias("mean_length"))
