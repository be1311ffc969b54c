"""Comparison and quality of clusterings; -1 and null mean that a point has no cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds ``name``: the place of each row in the order of a whole-number column, from 0; ranges are numbered apart.

    Rows are dealt to ranges of the column; only the sizes of ranges pass through one task.
    """
    span = rows.agg(F.min(order).alias("low_"), F.max(order).alias("high_"))
    place = F.least(F.floor((F.col(order) - F.col("low_")) / F.greatest((F.col("high_") - F.col("low_") + 1) / buckets, F.lit(1e-9))), F.lit(buckets - 1))
    dealt = rows.join(F.broadcast(span)).withColumn("range_", place).drop("low_", "high_")
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("range_", F.coalesce(before, F.lit(0)).alias("begins_"))
    number = F.row_number().over(Window.partitionBy("range_").orderBy(order)) - 1
    return dealt.withColumn("own_", number).join(F.broadcast(begins), "range_").withColumn(name, (F.col("begins_") + F.col("own_")).cast("long")).drop("range_", "own_", "begins_")


def reindex(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, dense, n): cluster ids numbered densely in ascending order, with their sizes."""
    sizes = labels.where((F.col(cluster) >= 0)).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    return numbered(sizes, "cluster", "dense").select("cluster", "dense", "n")


def size_histogram(sizes: DataFrame) -> DataFrame:
    """(size, clusters, points)"""
    return sizes.groupBy(F.col("n").alias("size")).agg(F.count("*").alias("clusters"), F.sum("n").alias("points"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(base, target, overlap) of two clusterings (id, cluster); points without a cluster in either are left out."""
    x = a.where("cluster >= 0").select("id", F.col("cluster").alias("base"))
    y = b.where("cluster >= 0").select("id", F.col("cluster").alias("target"))
    return x.join(y, "id").groupBy("base", "target").agg(F.count("*").alias("overlap"))


def best_overlap(a: DataFrame, b: DataFrame, limit: int = 0) -> DataFrame:
    """(base, n, target, major, stray): each base cluster of more than ``limit`` points and the target that shares most."""
    sizes = a.where("cluster >= 0").groupBy(F.col("cluster").alias("base")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    first = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("overlap"), "target"))
    top = contingency(a, b).withColumn("place", first).where("place = 1")
    return sizes.join(top, "base").select("base", "n", "target", F.col("overlap").alias("major"), (F.col("n") - F.col("overlap")).alias("stray"))


def cut_center(points: DataFrame, radius: float, passes: int = 10) -> DataFrame:
    """(grp, cx, cy, inside): a center moved to the mean of its points within ``radius``, again and again."""
    centers = points.groupBy("grp").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    for _ in range(passes):
        near = points.join(centers, "grp").where((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= radius * radius)
        moved = near.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("inside"))
        centers = centers.select("grp", "cx", "cy").join(moved, "grp", "left").select("grp", F.coalesce("mx", "cx").alias("cx"), F.coalesce("my", "cy").alias("cy"), F.coalesce("inside", F.lit(0)).alias("inside"))
    return centers


def trimmed(histogram: DataFrame, bin_col: str = "bin", count: str = "n") -> DataFrame:
    """A histogram without the empty bins after its last full one."""
    last = histogram.where(F.col(count) > 0).agg(F.max(bin_col).alias("last"))
    return histogram.join(F.broadcast(last)).where(F.col(bin_col) <= F.col("last")).drop("last")


def singletons_for_noise(labels: DataFrame, noise: int = 0) -> DataFrame:
    """Noise points become clusters of their own, numbered after the others in order of their ids."""
    top = labels.agg(F.max("cluster").alias("top"))
    alone = numbered(labels.where(F.col("cluster") == noise).select("id"), "id", "number")
    own = alone.join(F.broadcast(top)).select("id", (F.col("top") + F.col("number") + 1).alias("cluster"))
    return labels.where(F.col("cluster").isNull() | (F.col("cluster") != noise)).select("id", "cluster").unionByName(own)


def offset_histograms(points: DataFrame, least: int, sigma: tuple[float, float], one: tuple[float, int], two: tuple[float, int]) -> DataFrame:
    """(which, bin, n): offsets of points (grp, x, y) from their cluster's mean, over clusters of more than ``least`` points.

    x and y: in units of sigma[0] times the mean x, and of sigma[1]; xy: the sum of their squares. ``one``
    and ``two`` are (interval, bins) for these; the last bin takes what is beyond.
    """
    means = points.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("size")).where(F.col("size") > least)
    both = points.join(means, "grp").select(((F.col("x") - F.col("mx")) / (F.lit(sigma[0]) * F.col("mx"))).alias("u"), ((F.col("y") - F.col("my")) / F.lit(sigma[1])).alias("v"))
    place = lambda v, how: F.least(F.floor(v / how[0]), F.lit(how[1] - 1))
    bins = F.array(F.struct(F.lit("x").alias("which"), place(F.abs("u"), one).alias("bin")), F.struct(F.lit("y").alias("which"), place(F.abs("v"), one).alias("bin")), F.struct(F.lit("xy").alias("which"), place(F.col("u") * F.col("u") + F.col("v") * F.col("v"), two).alias("bin")))
    return both.select(F.explode(bins).alias("b")).groupBy("b.which", "b.bin").agg(F.count("*").alias("n"))


def golden_comparison(golden: DataFrame, methods: dict[str, DataFrame], limit: int = 0) -> DataFrame:
    """(method, base, n, target, major, stray, target_n): each golden cluster's best match in every method, and that one's size."""
    out = None
    for name, found in methods.items():
        sizes = found.where("cluster >= 0").groupBy(F.col("cluster").alias("target")).agg(F.count("*").alias("target_n"))
        one = best_overlap(golden, found, limit).join(sizes, "target").select(F.lit(name).alias("method"), "base", "n", "target", "major", "stray", "target_n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no method to compare")
    return out
