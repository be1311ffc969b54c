"""Filters and transforms of distances (i, j, d); an undefined distance is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.session import discard, stage


def cut(d: Column, longest: float) -> Column:
    """Distances above ``longest`` are undefined; equal ones stay."""
    return F.when(d <= longest, d)


def powered(d: Column, p: float) -> Column:
    return F.pow(F.least(d, F.lit(1.0)), F.lit(p))


def complement_powered(d: Column, p: float) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - F.least(d, F.lit(1.0)), F.lit(p))


def logged(d: Column, p: float, most: float = 0.975) -> Column:
    x = F.least(d, F.lit(most))
    return F.log(F.lit(1.0) - F.pow(x, F.lit(p))) / F.log(F.lit(1.0) - F.pow(F.lit(most), F.lit(p)))


def four_dimensional(d: Column, root: bool = False) -> Column:
    """The distance in four dimensions of the probability ``d``: the fixed point of E = -log d + log(1 + E), to 1e-5 in 50 steps at most."""
    first = -F.log(d)
    step = lambda s: F.struct((first + F.log1p(s["e"])).alias("e"), (F.abs(first + F.log1p(s["e"]) - s["e"]) < 1e-5).alias("done"))
    start = F.struct(first.alias("e"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s)))["e"]
    return F.sqrt(found) if root else found


TRANSFORMS = {8: lambda d, p: four_dimensional(d), 9: lambda d, p: four_dimensional(d, True), 10: powered, 11: complement_powered, 12: logged}


def transform(d: Column, method: int, p: float) -> Column:
    if method not in TRANSFORMS:
        raise ValueError(f"no distance transform {method}")
    return TRANSFORMS[method](d, p)


def prune_sparse(edges: DataFrame, links: int, rounds: int | None = None) -> DataFrame:
    """Drop points that have ``links`` or fewer defined distances, again and again until none is left to drop.

    Each round is written to the shared folder; only counts reach the driver.
    """
    at, done = edges.where(F.col("d").isNotNull()), 0
    before = last = None
    while rounds is None or done < rounds:
        keep = at.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > links).select("i")
        at = at.join(keep, "i", "left_semi").join(keep.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "d")
        done += 1
        if rounds is None:
            at = stage(edges.sparkSession, at, "linked")
            discard(last)
            last, now = at, at.count()
            if now == before:
                break
            before = now
    return at


def bin_weights(edges: DataFrame, cuts: list[float]) -> DataFrame:
    """Adds ``bin`` and ``w``, so that each distance bin has the same total weight: sqrt(pairs / (bins * pairs in the bin))."""
    number = reduce(lambda a, c: a + F.when(F.col("d") >= c, 1).otherwise(0), sorted(cuts), F.lit(0)).cast("long")
    binned = edges.where(F.col("d").isNotNull()).withColumn("bin", number)
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("pairs"))
    # As many rows as there are bins, and one total.
    weights = counts.join(F.broadcast(total)).select("bin", F.sqrt(F.col("pairs") / (F.lit(len(cuts) + 1) * F.col("n"))).alias("w"))
    return binned.join(F.broadcast(weights), "bin")


def parse_selection(text: str) -> list[tuple[int, int]]:
    """Inclusive ranges of a selection such as "1,5-9"; spaces and empty parts are ignored."""
    out = []
    for part in text.replace(" ", "").split(","):
        if part:
            low, _, high = part.partition("-")
            out.append((int(low), int(high or low)))
            if out[-1][0] > out[-1][1]:
                raise ValueError(f"empty range {part!r}")
    return out


def selected(value: Column, selection: str) -> Column:
    return reduce(lambda a, r: a | value.between(*r), parse_selection(selection), F.lit(False))


def classify_points(points: DataFrame, varied: str, fixed: str, id_col: str = "id") -> DataFrame:
    """Adds ``role``: varied, fixed or ignored; a point in both selections is fixed."""
    return points.withColumn("role", F.when(selected(F.col(id_col), fixed), "fixed").when(selected(F.col(id_col), varied), "varied").otherwise("ignored"))


def normalised_weights(points: DataFrame, weight: str) -> DataFrame:
    """Adds ``w``: the weights scaled to mean one over the rows in use."""
    total = points.agg(F.avg(weight).alias("mean_weight"))
    return points.join(F.broadcast(total)).withColumn("w", F.col(weight) / F.col("mean_weight")).drop("mean_weight")


def relabelled(points: DataFrame, by: DataFrame, id_col: str = "id") -> DataFrame:
    """Replace the cluster column by that of ``by`` (id, cluster) where it has one."""
    new = by.select(F.col(id_col), F.col("cluster").alias("new_cluster"))
    return points.join(new, id_col, "left").withColumn("cluster", F.coalesce("new_cluster", "cluster")).drop("new_cluster")


def family_by_cuts(index: Column, cuts: list[int]) -> Column:
    """The number of the interval between index cuts, from 0."""
    return reduce(lambda a, c: a + F.when(index >= c, 1).otherwise(0), sorted(cuts), F.lit(0)).cast("long")


def rank_of(value: str, index: str, by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(value, index))
