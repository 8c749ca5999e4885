"""Input tables of the registered queries, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.text import SPACES, first_line, strip_markup
from shoal.functions.vectors import normalise
from shoal.session import spread

KS = [5, 10, 20]
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), for the text-heavy queries."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec) of the embeddings, unit length."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return normalise(raw)


def given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that come with the embeddings, as a labeling."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("question_id"), F.lit(10).alias("k"), F.lit("kmeans").alias("variant"),
        F.col("label").cast("int").alias("cluster_id"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title): the first line of each document."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), strip_markup(first_line(F.col("text"))).alias("title"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title): the whole text of each document, for word statistics."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), strip_markup(F.col("text")).alias("title"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, title, answer_count, text_length) of the documents."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("question_id"), strip_markup(first_line(F.col("text"))).alias("title"),
        F.size(F.split("text", "\n")).alias("answer_count"), F.length("text").alias("text_length"))


# -- SQL ------------------------------------------------------------------------------------------------------


def sql_spaces(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return sql_spaces(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')")


def sql_strip_code(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)```.*?```', ' ', 'g')"
    return sql_spaces(f"regexp_replace({out}, '`[^`]*`', ' ', 'g')")


def sql_bits(x: str) -> str:
    return f"CAST('0x' || substr({x}, 1, 8) AS BIGINT)"


SQL_TITLE = sql_strip("split_part(text, chr(10), 1)")
SQL_TEXT = sql_strip("text")
SQL_META = f"""meta AS (
  SELECT doc_id AS question_id, {SQL_TITLE} AS title,
         CAST(len(string_split(text, chr(10))) AS INT) AS answer_count, CAST(length(text) AS INT) AS text_length
  FROM documents)"""
SQL_VECTORS = """raw AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
norms AS (SELECT id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM raw),
vectors AS (SELECT id, label, CASE WHEN n > 0 THEN list_transform(e, lambda x: x / n) ELSE e END AS vec FROM norms),
dims AS (SELECT id, label, generate_subscripts(vec, 1) AS j, unnest(vec) AS x FROM vectors)"""
SQL_GIVEN = "given AS (SELECT vec_id AS question_id, 10 AS k, 'kmeans' AS variant, label AS cluster_id FROM embeddings)"
_KS = ", ".join(f"({k})" for k in KS)
SQL_UNIFORM = f"""uniform_random AS (
  SELECT vec_id AS question_id, k, 'baseline_uniform_random' AS variant,
         CAST({sql_bits(f"md5(vec_id || ':{SEED}:' || k)")} % k AS INT) AS cluster_id
  FROM embeddings, (VALUES {_KS}) AS g(k))"""


def sql_buckets(name: str, source: str, order: str, variant: str) -> str:
    """Equal-count buckets of `source(question_id, ...)`, the remainder in the last."""
    return f"""{name}_n AS (
  SELECT question_id, row_number() OVER (ORDER BY {order}, question_id) AS rn, count(*) OVER () AS n FROM {source}),
{name} AS (
  SELECT question_id, k, '{variant}' AS variant,
         CAST(CASE WHEN n // k = 0 THEN k - 1 ELSE least((rn - 1) // (n // k), k - 1) END AS INT) AS cluster_id
  FROM {name}_n, (VALUES {_KS}) AS g(k))"""


SQL_LENGTHS = "lengths AS (SELECT vec_id AS question_id, n_chars AS text_length FROM embeddings JOIN documents ON doc_id = vec_id)"
SQL_LENGTH_BUCKETS = SQL_LENGTHS + ",\n" + sql_buckets("length_buckets", "lengths", "text_length", "baseline_length_buckets")
SQL_ASSIGNMENTS = f"""{SQL_GIVEN},
{SQL_UNIFORM},
{SQL_LENGTH_BUCKETS},
assignments AS (SELECT * FROM given UNION ALL SELECT * FROM uniform_random UNION ALL SELECT * FROM length_buckets)"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels, uniform random labels and length buckets of the embedded documents."""
    from shoal.plans import baselines

    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"))
    lengths = emb.join(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("n_chars").alias("text_length")), "question_id")
    return (
        given_labels(spark, sf_dir)
        .unionByName(baselines.uniform_random(emb.withColumnRenamed("question_id", "id"), KS, SEED))
        .unionByName(baselines.length_buckets(lengths, KS))
    )
