"""Representative centers of groups, by several measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions import vector as V
from pairforge.operators import block_distances as B
from pairforge.operators import reductions as R
from pairforge.operators.joins import split_join
from pairforge.session import stage


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, i, j, d): distances within groups; ``groups`` is (id, grp)."""
    a = groups.select(F.col("id").alias("i"), "grp")
    b = groups.select(F.col("id").alias("j"), F.col("grp").alias("grp_j"))
    return edges.join(a, "i").join(b, "j").where("grp = grp_j").select("grp", "i", "j", "d")


def position_edges(points: DataFrame, dim: int | None = None) -> DataFrame:
    """(grp, i, j, d): Euclidean distances within groups of (id, grp, x), both ways; positions may be those of a scaling.

    Pairs are made within groups only, over a grid of blocks of each group, so a large group is many keys.
    """
    once = B.distances(points, (dim or _dim(points),), within="grp")
    both = F.array(F.struct("i", "j", "d"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return once.select("grp", F.explode(both).alias("e")).select("grp", "e.i", "e.j", "e.d")


def _dim(points: DataFrame) -> int:
    return points.agg(F.max(F.size("x"))).first()[0] or 1


def _of_points(slices: Iterator[B.Slice], measured: Callable, names: tuple[str, ...]) -> Iterator[dict]:
    """Sums over the partners of each point, of either block: ``measured`` gives matrices for a slice, -inf for what has a maximum instead."""
    whole = None
    for s in slices:
        found, b = measured(s), s.b
        fold = [(np.maximum.reduce, np.maximum) if name == "top" else (np.add.reduce, np.add) for name in names]
        yield {"grp": s.a["grp"], "id": s.a["id"]} | {n: _folded(f[0](m, axis=1)) for n, m, f in zip(names, found, fold)}
        rows = [f[0](m, axis=0) for m, f in zip(found, fold)]
        whole = rows if whole is None else [f[1](w, r) for w, r, f in zip(whole, rows, fold)]
    if whole is not None:
        yield {"grp": b["grp"], "id": b["id"]} | {n: _folded(w) for n, w in zip(names, whole)}


def _folded(v: np.ndarray) -> pa.Array:
    return pa.array(v, mask=v == -np.inf) if v.dtype.kind == "f" else pa.array(v)


def _made(s: B.Slice) -> np.ndarray:
    return np.ones(s.d[0].shape, bool) if s.keep is None else s.keep


def _there(s: B.Slice) -> np.ndarray:
    return _made(s) if s.defined is None else _made(s) & s.defined


def position_scores(points: DataFrame, fractions: tuple[float, ...], dim: int, least: float = 0.0, bins: int = 1000) -> list[DataFrame]:
    """``mean_distance`` and ``neighbours_in_buckets`` for positions (id, grp, size, x), of groups that have pairs.

    Pairs are measured three times, for means, bins and neighbours, and never leave their tasks: a row for each
    point and pair of blocks does.
    """
    spark = points.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    key = f"grp {kind['grp']}, id {kind['id']}, "

    def means(s: B.Slice) -> list[np.ndarray]:
        d, there = s.d[0], _there(s)
        above = there & (d > least)
        return [np.where(above, d, 0.0), above.astype("i8"), _made(s).astype("i8"), np.where(there, d, -np.inf)]

    names = ("sum", "n", "pairs", "top")
    found = B.reduced(points, (dim,), lambda slices: _of_points(slices, means, names), key + "sum double, n long, pairs long, top double", within="grp")
    sums = stage(spark, found.groupBy("grp", "id").agg(*(F.sum(n).alias(n) for n in names[:3]), F.max("top").alias("top")), "sums")
    scores = [sums.where("n > 0").select("grp", "id", (F.col("sum") / F.col("n")).alias("score"))]
    tops = sums.groupBy("grp").agg(F.max("top").alias("top"), F.sum("pairs").alias("total")).where("top is not null")

    def counts(slices: Iterator[B.Slice]) -> Iterator[dict]:
        n, grp = np.zeros(bins, np.int64), None
        for s in slices:
            grp, top = s.a["grp"].slice(0, 1), s.a["top"][0].as_py()
            d, there = s.d[0], _there(s)
            place = np.minimum(np.floor(d[there] / top * bins), bins - 1).astype(np.int64) if top > 0 else np.full(there.sum(), bins - 1)
            n += 2 * np.bincount(place, minlength=bins)
            n[bins - 1] += 2 * (_made(s) & ~there).sum()
        if grp is not None:
            at = np.flatnonzero(n)
            yield {"grp": grp.take(pa.array(np.zeros(len(at), np.int64))), "bin": at, "n": n[at]}

    topped = split_join(points, tops, ["grp"], "id")
    binned = B.reduced(topped, (dim,), counts, f"grp {kind['grp']}, bin long, n long", ("top",), "grp").groupBy("grp", "bin").agg(F.sum("n").alias("n"))
    running = stage(spark, binned.join(tops, "grp").withColumn("upto", F.sum("n").over(Window.partitionBy("grp").orderBy("bin"))), "running")
    radii = tops.select("grp")
    for n, f in enumerate(fractions):
        radii = radii.join(bucket_radius(running, f, bins).withColumnRenamed("radius", f"radius{n}"), "grp", "left")

    def near(s: B.Slice) -> list[np.ndarray]:
        there = _there(s)
        reach = [s.a[f"radius{n}"][0].as_py() for n in range(len(fractions))]
        return [(there & (s.d[0] <= r)).astype("i8") if r is not None else np.zeros(there.shape, "i8") for r in reach]

    names_near = tuple(f"n{n}" for n in range(len(fractions)))
    reached = split_join(points, stage(spark, radii, "radii"), ["grp"], "id")
    found = B.reduced(reached, (dim,), lambda slices: _of_points(slices, near, names_near), key + ", ".join(f"{n} long" for n in names_near), tuple(f"radius{n}" for n in range(len(fractions))), "grp")
    sized = found.groupBy("grp", "id").agg(*(F.sum(n).alias(n) for n in names_near)).join(points.select("grp", "id", "size").distinct(), ["grp", "id"])
    sized = stage(spark, sized, "neighbours")
    return scores + [sized.where(F.col(n) > 0).select("grp", "id", (F.col("size") - F.col(n)).cast("double").alias("score")) for n in names_near]


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k lowest scores of each group: (grp, id, score, rank)."""
    order = Window.partitionBy("grp").orderBy("score", "id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def mean_distance(within: DataFrame, least: float = 0.0, links: int = 1) -> DataFrame:
    """Scores by the mean distance to the others of the group, over distances above ``least``."""
    means = within.where(F.col("d") > least).groupBy("grp", F.col("i").alias("id")).agg(F.avg("d").alias("score"), F.count("*").alias("n"))
    return means.where(F.col("n") >= max(1, links)).select("grp", "id", "score")


def to_centroid(points: DataFrame, dim: int | None = None) -> DataFrame:
    """Scores by the distance to the group's mean position; ``points`` is (id, grp, x)."""
    means = R.elementwise(points, "x", "mean", ("grp",), dim).groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("y"))
    return split_join(points, means, ["grp"], "id").select("grp", "id", V.distance(F.col("x"), F.col("y"), dim).alias("score"))


def running_counts(within: DataFrame, bins: int = 1000) -> DataFrame:
    """(grp, top, total, bin, n, upto): each group's distances in ``bins`` bins up to its largest, and how many lie in a bin or before it."""
    top = within.groupBy("grp").agg(F.max("d").alias("top"), F.count("*").alias("total"))
    counts = split_join(within, top, ["grp"], "i").groupBy("grp", "top", "total", F.least(F.floor(F.col("d") / F.col("top") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy("grp").orderBy("bin")))


def bucket_radius(running: DataFrame, fraction: float, bins: int = 1000) -> DataFrame:
    """(grp, radius): the middle of the first bin of ``running_counts`` before which at least ``fraction`` of a group's pairs lie."""
    # The bin after the one whose running count reaches the fraction; empty bins count too.
    reached = running.where(F.col("upto") >= F.col("total") * fraction).groupBy("grp").agg(F.min("bin").alias("bin"), F.first("top").alias("top"))
    return reached.select("grp", ((F.least(F.col("bin") + 1, F.lit(bins - 1)) + 0.5) * F.col("top") / bins).alias("radius"))


def neighbours_in_buckets(within: DataFrame, sizes: DataFrame, fractions: tuple[float, ...], running: DataFrame | None = None) -> list[DataFrame]:
    """For each fraction, scores by group size less neighbours within the bucket's radius; points without any are left out.

    One pass over the distances counts the neighbours of all fractions.
    """
    running = running_counts(within) if running is None else running
    radii = sizes
    for n, f in enumerate(fractions):
        radii = radii.join(bucket_radius(running, f).withColumnRenamed("radius", f"radius{n}"), "grp", "left")
    counts = [F.count_if(F.col("d") <= F.col(f"radius{n}")).alias(f"n{n}") for n in range(len(fractions))]
    near = stage(within.sparkSession, split_join(within, radii, ["grp"], "i").groupBy("grp", "size", F.col("i").alias("id")).agg(*counts), "neighbours")
    return [near.where(F.col(f"n{n}") > 0).select("grp", "id", (F.col("size") - F.col(f"n{n}")).cast("double").alias("score")) for n in range(len(fractions))]


def overall(rankings: list[tuple[DataFrame, float]], k: int, least_weight: float = 0.6) -> DataFrame:
    """Combine (ranking, weight) pairs: the weighted sum of ranks over the sum of weights, lowest first."""
    parts = [r.select("grp", "id", (F.col("rank") * F.lit(w)).alias("r"), F.lit(w).alias("w")) for r, w in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    rated = union.groupBy("grp", "id").agg(F.sum("r").alias("r"), F.sum("w").alias("w")).where(F.col("w") > least_weight)
    # Rounded, so that equal ratings tie whatever the order in which their parts were added.
    return ranked(rated.select("grp", "id", F.round(F.col("r") / F.col("w"), 9).alias("score")), k)


def group_centers(edges: DataFrame | None, points: DataFrame, k: int = 8, fractions: tuple[float, ...] = (0.15, 0.4, 0.75), dim: int | None = None) -> DataFrame:
    """All measures for each group of more than k members of (id, grp, x): (grp, method, id, score, rank).

    ``edges`` is (i, j, d), or (grp, i, j, d) if it has only distances within groups (``position_edges``), and is
    written; without it distances are those of the positions, and pairs are not written.
    """
    spark = points.sparkSession
    sizes = points.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > k)
    if edges is None:
        kept = split_join(points, sizes, ["grp"], "id")
        mean, *near = position_scores(kept, fractions, dim or _dim(points))
    else:
        kept = points.join(sizes.select("grp"), "grp", "left_semi")
        own = edges.join(sizes.select("grp"), "grp", "left_semi") if "grp" in edges.columns else group_edges(edges, kept.select("id", "grp"))
        within = stage(spark, own, "within")
        mean, near = mean_distance(within), neighbours_in_buckets(within, sizes, fractions, stage(spark, running_counts(within), "running"))
    rankings = {"mean_distance": ranked(mean, k), "to_centroid": ranked(to_centroid(kept.select("id", "grp", "x"), dim), k)}
    for f, scores in zip(fractions, near):
        rankings[f"bucket_{f}"] = ranked(scores, k)
    methods = {name: stage(spark, r, "ranking") for name, r in rankings.items()}
    weights = [1.0, 1.0] + [1.0 / len(fractions)] * len(fractions)
    methods["overall"] = overall(list(zip(methods.values(), weights)), k)
    out = None
    for name, m in methods.items():
        m = m.select("grp", F.lit(name).alias("method"), "id", "score", "rank")
        out = m if out is None else out.unionByName(m)
    return out
