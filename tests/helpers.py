import numpy as np


def vectors(spark, points):
    rows = [(i, [float(x) for x in np.atleast_1d(p)]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def labels(spark, clusters, k=2, variant="kmeans"):
    rows = [(i, k, variant, int(c)) for i, c in enumerate(clusters)]
    return spark.createDataFrame(rows, "question_id long, k int, variant string, cluster_id int")
