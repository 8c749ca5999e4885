"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the parquet tables, BENCH_CPUS: local threads, BENCH_QUERIES: comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoal import catalog  # noqa: E402
from shoal.session import build_session  # noqa: E402

HEADLINE = [
    "kmeans_labels", "k_search", "metric_table", "metric_dbi", "nearest_centroid", "kmeanspp_one_shot", "pca1_buckets",
    "shuffle_size", "document_length_buckets", "reduced_vectors", "full_documents", "page_text_without_code",
    "flat_conversations", "hashed_document_vectors", "title_tfidf", "extracted_subtopics", "small_cluster_members",
    "cluster_of_question", "k_distance_euclidean", "dbscan_euclidean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")
    spark = build_session("shoal-bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    registered = catalog.queries()
    registered["unit_vectors"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM and workers
    times = {}
    for name in chosen:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
