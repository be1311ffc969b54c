"""K-means with bounds from the triangle inequality: the same answer with fewer distances (``bounds``)."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators import bounds as B
from pairforge.operators import kmeans as K


def fit(points: DataFrame, start: DataFrame, cut: float = 0.001, extra: int = 11, most: int = 100, width: int = B.WIDTH, dim: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(assigned, centers, iterations), as ``kmeans.fit`` from the same starting centers (k, y).

    ``assigned`` is (id, x, k, d, computed) under the last centers, with how many distances each point took
    in all; its state holds 2 x ``width`` bounds a point. More than ``bounds.MOST_VALUES`` numbers of centers
    or of distances between them raise; ``kmeans.fit`` has no such limit.
    """
    spark = points.sparkSession
    size = start.agg(F.count("*").alias("n"), F.sum(F.size("y")).alias("values")).first()
    if max((size["values"] or 0), size["n"] ** 2) > B.MOST_VALUES:
        raise ValueError(f"more than {B.MOST_VALUES} numbers of centers")
    rows = sorted(start.collect(), key=lambda r: r["k"])
    names, y = [r["k"] for r in rows], np.array([r["y"] for r in rows], float)
    # Clusters are numbered by place until the end.
    search, left = B.Search(points, width=width), None
    for iteration in range(1, most + 1):
        state, new = search.at(y), y.copy()
        for r in K.means(state, dim=dim).collect():
            new[r["k"]] = r["y"]
        moved, y = B.distances(new, y), new
        if left is not None:
            left -= 1
        else:
            radius = K.center_stats(state).agg(F.avg("radius")).first()[0]
            if radius is None or moved.mean() < cut * radius or moved.mean() == 0:
                left = extra
        if left == 0:
            break
    else:
        warnings.warn(f"K-means did not converge in {most} iterations", RuntimeWarning, stacklevel=2)
    state = search.at(y)
    named = spark.createDataFrame(list(enumerate(names)), "k long, name long")
    centers = spark.createDataFrame([(int(n), v.tolist()) for n, v in zip(names, y)], "k long, y array<double>")
    # As many rows as centers, which were counted.
    return state.join(F.broadcast(named), "k").select("id", "x", F.col("name").alias("k"), "d", "computed"), centers, iteration
