"""Metric queries. All labelings are evaluated on unit vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.catalog.common import SEED, SQL_ASSIGNMENTS, SQL_VECTORS, assignments, vectors
from shoal.plans import kmeans, report
from shoal.plans.metrics import HIGHER_IS_BETTER, METRICS, SILHOUETTE_SAMPLE, Evaluation, evaluate, main_only

SAMPLE = SILHOUETTE_SAMPLE


def _evaluation(spark, sf_dir):
    return Evaluation(vectors(spark, sf_dir), assignments(spark, sf_dir))


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _one(name, make):
    def query(spark, sf_dir):
        ev = _evaluation(spark, sf_dir)
        return _rounded(ev.named(make(ev)).select("k", "variant", name), name)

    query.__name__ = f"metric_{name}"
    return query


def metric_table(spark, sf_dir):
    table = evaluate(vectors(spark, sf_dir), assignments(spark, sf_dir), SAMPLE, SEED)
    return _rounded(table, *METRICS)


def main_metrics(spark, sf_dir):
    return main_only(metric_table(spark, sf_dir))


def within_cluster_pairs(spark, sf_dir):
    ev = _evaluation(spark, sf_dir)
    pairs = ev.named(ev.within_pairs()).select("k", "variant", "cluster_id", "n", "pair_sum", "pair_max")
    return _rounded(pairs, "pair_sum", "pair_max")


def metrics_scaled(spark, sf_dir):
    table = evaluate(vectors(spark, sf_dir), assignments(spark, sf_dir), None, SEED)  # the silhouette of all rows
    return _rounded(report.scaled(_rounded(table, *METRICS)), "scaled")


def metrics_ranked(spark, sf_dir):
    return report.ranked(metric_table(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def metrics_rank_table(spark, sf_dir):
    table = report.rank_table(metric_table(spark, sf_dir))
    return table.select("k", "variant", *[F.col(m).cast("long") for m in METRICS])


def metrics_wins(spark, sf_dir):
    return report.wins(metric_table(spark, sf_dir))


def _dbi_by_k(spark, sf_dir):
    labels = assignments(spark, sf_dir).filter(F.col("variant") == "baseline_length_buckets")
    ev = Evaluation(vectors(spark, sf_dir), labels)
    return ev.named(ev.dbi()).select("k", F.round("dbi", 6).alias("dbi"))


def running_best(spark, sf_dir):
    return kmeans.running_best(_dbi_by_k(spark, sf_dir))


def best_k(spark, sf_dir):
    return kmeans.best_by_dbi(_dbi_by_k(spark, sf_dir))


def chosen_model(spark, sf_dir):
    table = report.unpivot(metric_table(spark, sf_dir)).select(
        F.concat_ws("/", F.col("k").cast("string"), "variant").alias("name"), "metric", F.col("value").alias("score"))
    return kmeans.choose(table, "chi").unionByName(kmeans.choose(table, "dbi"))


QUERIES = {
    "metric_silhouette": _one("silhouette", lambda ev: ev.silhouette(SAMPLE, SEED)),
    "metric_dbi": _one("dbi", lambda ev: ev.dbi()),
    "metric_chi": _one("chi", lambda ev: ev.chi()),
    "metric_dunn": _one("dunn", lambda ev: ev.dunn()),
    "metric_cohesion": _one("cohesion", lambda ev: ev.cohesion()),
    "metric_separation": _one("separation", lambda ev: ev.separation()),
    "metric_cosine_intra": _one("cosine_intra", lambda ev: ev.cosine_intra()),
    "metric_cosine_inter": _one("cosine_inter", lambda ev: ev.cosine_inter()),
    "metric_singleton_ratio": _one("singleton_ratio", lambda ev: ev.singleton_ratio()),
    **{f.__name__: f for f in (
        metric_table, main_metrics, within_cluster_pairs, metrics_scaled, metrics_ranked, metrics_rank_table,
        metrics_wins, running_best, best_k, chosen_model,
    )},
}

_BASE = f"""WITH {SQL_VECTORS},
{SQL_ASSIGNMENTS},
points AS (SELECT a.k, a.variant, a.cluster_id, v.id, v.vec FROM assignments a JOIN vectors v ON v.id = a.question_id),
mean_dims AS (SELECT k, variant, cluster_id, j, avg(x) AS x FROM assignments JOIN dims ON id = question_id
  GROUP BY k, variant, cluster_id, j),
sizes AS (SELECT k, variant, cluster_id, count(*) AS n FROM assignments GROUP BY ALL),
means AS (SELECT k, variant, cluster_id, n, list(x ORDER BY j) AS m FROM mean_dims JOIN sizes USING (k, variant, cluster_id)
  GROUP BY k, variant, cluster_id, n),
around AS (SELECT k, variant, cluster_id, list_distance(vec, m) AS d, list_cosine_similarity(vec, m) AS c
  FROM points JOIN means USING (k, variant, cluster_id)),
spread AS (SELECT k, variant, cluster_id, avg(d) AS s FROM around GROUP BY ALL),
centre_pairs AS (SELECT a.k, a.variant, a.cluster_id AS ca, b.cluster_id AS cb, a.n AS na, b.n AS nb,
    list_distance(a.m, b.m) AS d, list_cosine_similarity(a.m, b.m) AS c
  FROM means a JOIN means b ON a.k = b.k AND a.variant = b.variant AND a.cluster_id <> b.cluster_id),
totals AS (SELECT k, variant, count(*) AS clusters, sum(n) AS rows FROM sizes GROUP BY ALL),
m_dbi AS (SELECT k, variant, round(avg(worst), 6) AS dbi FROM (
  SELECT p.k, p.variant, p.ca, max((sa.s + sb.s) / p.d) AS worst FROM centre_pairs p
  JOIN spread sa ON sa.k = p.k AND sa.variant = p.variant AND sa.cluster_id = p.ca
  JOIN spread sb ON sb.k = p.k AND sb.variant = p.variant AND sb.cluster_id = p.cb GROUP BY ALL) GROUP BY ALL),
overall AS (SELECT k, variant, j, avg(x) AS g FROM assignments JOIN dims ON id = question_id GROUP BY ALL),
between_ss AS (SELECT k, variant, sum(n * (x - g) * (x - g)) AS b FROM mean_dims JOIN sizes USING (k, variant, cluster_id)
  JOIN overall USING (k, variant, j) GROUP BY ALL),
within_ss AS (SELECT k, variant, sum(d * d) AS w FROM around GROUP BY ALL),
m_chi AS (SELECT k, variant, round((b / (clusters - 1)) / (w / (rows - clusters)), 6) AS chi
  FROM between_ss JOIN within_ss USING (k, variant) JOIN totals USING (k, variant)),
pairs AS (SELECT a.k, a.variant, a.cluster_id, sum(list_distance(a.vec, b.vec)) AS pair_sum,
    max(list_distance(a.vec, b.vec)) AS pair_max, any_value(n) AS n
  FROM points a JOIN points b ON a.k = b.k AND a.variant = b.variant AND a.cluster_id = b.cluster_id
  JOIN sizes s ON s.k = a.k AND s.variant = a.variant AND s.cluster_id = a.cluster_id
  WHERE n > 1 GROUP BY a.k, a.variant, a.cluster_id),
m_cohesion AS (SELECT k, variant, round(sum(pair_sum) / sum(n * n), 6) AS cohesion, max(pair_max) AS widest
  FROM pairs GROUP BY ALL),
m_dunn AS (SELECT k, variant, round(min(d) FILTER (na > 1 AND nb > 1) / any_value(widest), 6) AS dunn
  FROM centre_pairs JOIN m_cohesion USING (k, variant) GROUP BY k, variant),
m_separation AS (SELECT k, variant, round(avg(d), 6) AS separation FROM centre_pairs GROUP BY ALL),
m_cosine_intra AS (SELECT k, variant, round(avg(c), 6) AS cosine_intra FROM around GROUP BY ALL),
m_cosine_inter AS (SELECT k, variant, round(avg(c), 6) AS cosine_inter FROM centre_pairs GROUP BY ALL),
m_singleton_ratio AS (SELECT k, variant, round(count(*) FILTER (n = 1) / count(*), 6) AS singleton_ratio FROM sizes GROUP BY ALL),
sampled AS (SELECT id FROM vectors ORDER BY md5(id || ':{SEED}'), id LIMIT {SAMPLE}),
sp AS (SELECT p.* FROM points p JOIN sampled USING (id)),
to_cluster AS (SELECT a.k, a.variant, a.id, a.cluster_id AS own, b.cluster_id AS other, count(*) AS n,
    sum(CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.vec, b.vec) END) AS d
  FROM sp a JOIN sp b ON a.k = b.k AND a.variant = b.variant GROUP BY ALL),
ab AS (SELECT k, variant, id, max(CASE WHEN own = other THEN n END) AS n_own,
    max(CASE WHEN own = other THEN d / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b
  FROM to_cluster GROUP BY ALL),
m_silhouette AS (SELECT k, variant, round(avg(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
  FROM ab GROUP BY ALL),
metrics AS (SELECT silhouette, dbi, chi, dunn, cohesion, separation, cosine_intra, cosine_inter, singleton_ratio, k, variant
  FROM m_silhouette JOIN m_dbi USING (k, variant) JOIN m_chi USING (k, variant) JOIN m_dunn USING (k, variant)
  JOIN m_cohesion USING (k, variant) JOIN m_separation USING (k, variant) JOIN m_cosine_intra USING (k, variant)
  JOIN m_cosine_inter USING (k, variant) JOIN m_singleton_ratio USING (k, variant)),
long AS (UNPIVOT metrics ON {", ".join(METRICS)} INTO NAME metric VALUE value),
signed AS (SELECT *, CASE WHEN metric IN ({", ".join(f"'{m}'" for m, up in HIGHER_IS_BETTER.items() if up)}) THEN value
  ELSE -value END AS s FROM long),
ranked AS (SELECT k, variant, metric, value, rank() OVER (PARTITION BY k, metric ORDER BY s DESC) AS rank FROM signed)
"""
_SAMPLED = f"sampled AS (SELECT id FROM vectors ORDER BY md5(id || ':{SEED}'), id LIMIT {SAMPLE})"
assert _SAMPLED in _BASE
_WHOLE = _BASE.replace(_SAMPLED, "sampled AS (SELECT id FROM vectors)")
_DBI_BY_K = _BASE + ", by_k AS (SELECT k, dbi FROM m_dbi WHERE variant = 'baseline_length_buckets')"

SQL = {
    **{f"metric_{m}": _BASE + f"SELECT k, variant, {m} FROM m_{m}" for m in METRICS},
    "metric_table": _BASE + "SELECT * FROM metrics",
    "main_metrics": _BASE + "SELECT * FROM metrics WHERE variant = 'kmeans'",
    "within_cluster_pairs": _BASE + """SELECT k, variant, cluster_id, n, round(pair_sum, 6) AS pair_sum,
      round(pair_max, 6) AS pair_max FROM pairs""",
    "metrics_scaled": _WHOLE + """SELECT k, variant, metric, round((s - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled
      FROM (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM signed WINDOW w AS (PARTITION BY k, metric))""",
    "metrics_ranked": _BASE + "SELECT * FROM ranked",
    "metrics_rank_table": _BASE + "SELECT k, variant, " + ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN rank END) AS {m}" for m in METRICS) + " FROM ranked GROUP BY k, variant",
    "metrics_wins": _BASE + "SELECT metric, variant, count(*) AS wins FROM ranked WHERE rank = 1 GROUP BY metric, variant",
    "running_best": _DBI_BY_K + """SELECT k, dbi, dbi < coalesce(min(dbi) OVER (ORDER BY k ROWS BETWEEN
      UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS is_new_best FROM by_k""",
    "best_k": _DBI_BY_K + "SELECT k AS best_k, dbi AS best_dbi FROM by_k ORDER BY dbi, k LIMIT 1",
    "chosen_model": _BASE + """(SELECT k || '/' || variant AS name, metric, value AS score FROM long WHERE metric = 'chi'
      ORDER BY value DESC, name LIMIT 1) UNION ALL
      (SELECT k || '/' || variant AS name, metric, value AS score FROM long WHERE metric = 'dbi' ORDER BY value, name LIMIT 1)""",
}
