"""K-means by Lloyd's iterations; the k centers travel as one small row set."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions import vector as V
from pairforge.operators import pairs as P
from pairforge.operators import reductions as R
from pairforge.session import discard, stage

#: Numbers of centers that are broadcast at once.
MOST_CENTER_VALUES = 5_000_000


def means(points: DataFrame, k_col: str = "k", dim: int | None = None) -> DataFrame:
    """(k, y): the mean position of each cluster of (id, x, k); with a known ``dim`` a point stays one row."""
    per = R.elementwise(points, "x", "mean", (k_col,), dim)
    return per.groupBy(F.col(k_col).alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("y"))


def assign(points: DataFrame, centers: DataFrame, dim: int | None = None, most_values: int = MOST_CENTER_VALUES) -> DataFrame:
    """(id, x, k, d): the nearest center of each row, the lowest number on ties; repeated ids are rows of their own.

    Centers are gathered into rows of at most about ``most_values`` numbers, which are broadcast one after
    the other; each point looks through one in an expression and keeps the best so far, so points are
    neither multiplied nor moved. With several rows the state is written after each.
    """
    size = centers.agg(F.sum(F.size("y"))).first()[0] or 0
    parts = max(1, -(-size // most_values))
    at = points.select("id", "x", F.lit(None).cast(f"struct<d:double,k:{centers.schema['k'].dataType.simpleString()}>").alias("best"))
    for part in range(parts):
        some = centers if parts == 1 else centers.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == part)
        rows = some.agg(F.sort_array(F.collect_list(F.struct("k", "y"))).alias("some_centers"))
        measured = F.transform("some_centers", lambda c: F.struct(V.distance(F.col("x"), c["y"], dim).alias("d"), c["k"].alias("k")))
        before, at = at, at.join(F.broadcast(rows)).select("id", "x", F.least("best", F.array_min(measured)).alias("best") if part else F.array_min(measured).alias("best"))
        if parts > 1:
            at = stage(points.sparkSession, at, "nearest")
            discard(before if part else None)
    return at.select("id", "x", F.col("best.k").alias("k"), F.col("best.d").alias("d"))


def center_stats(assigned: DataFrame) -> DataFrame:
    """(k, n, radius, width): size, largest distance and sum of squared distances of each cluster."""
    return assigned.groupBy("k").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.sum(F.col("d") * F.col("d")).alias("width"))


def initial_assignment(index: F.Column, n: int, k: int, mode: int, seed: int = 10101010) -> F.Column:
    """Cluster of point number ``index`` (from 0): random (-1), random but the first k their own number (-2),
    random but each (n div k)-th line opens a cluster (-3), or line div (n div k) (-4)."""
    step = max(1, n // k)
    random = F.pmod(F.xxhash64(index, F.lit(seed)), F.lit(k))
    if mode == -1:
        return random
    if mode == -2:
        return F.when(index < k, index).otherwise(random)
    if mode == -3:
        return F.when((index % step == 0) & (F.floor(index / step) < k), F.floor(index / step)).otherwise(random)
    if mode == -4:
        return F.least(F.floor(index / step), F.lit(k - 1))
    raise ValueError(f"no mode {mode}")


def fit(points: DataFrame, start: DataFrame, cut: float = 0.001, extra: int = 11, most: int = 100, dim: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(assigned, centers, iterations) from starting centers (k, y).

    Stops ``extra`` iterations after the first in which centers moved by less than ``cut`` of the mean
    radius on average; warns if ``most`` iterations end first. An empty cluster keeps its last center.
    """
    spark, centers, left, before = points.sparkSession, start, None, None
    for step in range(1, most + 1):
        assigned = stage(spark, assign(points, centers, dim), f"assigned{step}")
        new = means(assigned, dim=dim)
        moved = centers.join(new.withColumnRenamed("y", "new"), "k", "left").select("k", F.coalesce("new", "y").alias("y"), V.distance(F.col("y"), F.coalesce("new", "y")).alias("moved"))
        moved = stage(spark, moved, f"centers{step}")
        change = moved.agg(F.avg("moved")).first()[0]
        radius = center_stats(assigned).agg(F.avg("radius")).first()[0]
        centers = moved.select("k", "y")
        discard(assigned)
        discard(before)
        before = moved
        if left is not None:
            left -= 1
        elif change is None or radius is None or change < cut * radius or change == 0:
            left = extra
        if left == 0:
            break
    else:
        warnings.warn(f"K-means did not converge in {most} iterations", RuntimeWarning, stacklevel=2)
    return assign(points, centers, dim), centers, step


def center_pairs(centers: DataFrame) -> DataFrame:
    """(a, b, d): each center with every other, over a grid of blocks."""
    half = P.half_pairs(centers.select("k", "y"), ["y"], "k").select("i", "j", V.distance(F.col("y_i"), F.col("y_j")).alias("d"))
    return P.mirrored(half).select(F.col("i").alias("a"), F.col("j").alias("b"), "d")


def nearest_centers(centers: DataFrame, k: int) -> DataFrame:
    """(a, b, d, rank): the k nearest other centers of each."""
    pairs = center_pairs(centers)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b")).cast("long")).where(F.col("rank") <= k)
