"""What steers deterministic annealing: schedules of temperature-bound parameters, convergence, restarts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators import reductions as R


def annealed(value: Column, final: float, temperature: Column, final_temperature: float, ratio: float) -> Column:
    """A parameter's next value when the temperature falls by ``ratio``: on a power law to ``final`` at ``final_temperature``, never below it."""
    fall = F.least(F.log(F.lit(final_temperature)) - F.log(temperature), F.log(F.lit(ratio)))
    factor = F.exp(F.log(F.lit(ratio)) * (F.log(F.lit(final)) - F.log(value)) / fall)
    at_end = (value <= final) | (temperature <= final_temperature)
    return F.when(value <= final, value).when(at_end, F.lit(final)).otherwise(F.greatest(F.lit(final), value * factor))


def sponge_factor(value: Column, first: float, final: float, temperature: Column, first_temperature: float, final_temperature: float) -> Column:
    """The sponge's distance: linear in the temperature between its two ends; negative ends leave it as it is."""
    if final < 0 or final_temperature < 0:
        return value
    line = F.lit(final) + (first - final) * (temperature - final_temperature) / (first_temperature - final_temperature)
    return F.when(value <= final, value).when(temperature <= final_temperature, F.lit(final)).otherwise(F.greatest(F.lit(final), line))


def membership_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """(k, change): how much the memberships (id, k, m) of each cluster changed, summed over points; missing ones are zero."""
    both = old.select("id", "k", F.col("m").alias("m0")).join(new.select("id", "k", F.col("m").alias("m1")), ["id", "k"], "full")
    return both.groupBy("k").agg(F.sum(F.abs(F.coalesce("m0", F.lit(0.0)) - F.coalesce("m1", F.lit(0.0)))).alias("change"))


def center_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """(k, moved2): squared movement of each center (k, y) that is in both."""
    both = old.select("k", F.col("y").alias("y0")).join(new.select("k", F.col("y").alias("y1")), "k")
    return both.select("k", F.aggregate(F.zip_with("y0", "y1", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b).alias("moved2"))


@dataclass(frozen=True)
class Verdict:
    """code: 0 go on, 1 converged, 2 converged and done."""

    code: int
    reason: str


def convergence(change: float, limit: float, step: int, most_steps: int, moved2: float = 0.0, width: float = 0.0, moved_share: float = 0.0, final: bool = False, clusters: int = 0, most_clusters: int = 1 << 30, temperature: float = 1.0, least_temperature: float = 0.0, split_failures: int = 0) -> Verdict:
    """Whether steps at a temperature may end: mean change of memberships, and in the final loop that of centers too.

    ``change`` is per point; ``moved2`` is compared with ``moved_share`` of the mean ``width``. Beyond
    ``most_steps`` it counts as converged. What cannot go on annealing is done.
    """
    why = []
    if change > limit:
        why.append(f"memberships change by {change:.3g}, above {limit:.3g}")
    if final and moved2 > moved_share * width:
        why.append(f"centers move by {moved2:.3g}, above {moved_share * width:.3g}")
    if why and step <= most_steps:
        return Verdict(0, "; ".join(why))
    reason = "too many steps: " + "; ".join(why) if why else "memberships and centers settled" if final else "memberships settled"
    if final:
        return Verdict(2, reason)
    ends = [x for x, met in (("as many clusters as may be", clusters >= most_clusters), ("the lowest temperature", temperature < least_temperature), ("too many failed splits", split_failures > 1)) if met]
    return Verdict(2, "; ".join(ends)) if ends else Verdict(1, reason)


def restart(points: DataFrame, labels: DataFrame, dim: int | None = None) -> DataFrame:
    """(k, y, p): centers and priors from points (id, x) and the labels (id, cluster) of a former run; -1 is the sponge, which has no center."""
    both = points.join(labels.where(F.col("cluster").isNotNull()), "id")
    n = both.agg(F.count("*").alias("all"))
    share = both.groupBy("cluster").agg(F.count("*").alias("n")).join(F.broadcast(n)).select("cluster", (F.col("n") / F.col("all")).alias("p"))
    means = R.elementwise(both.where("cluster >= 0"), "x", "mean", ("cluster",), dim)
    y = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("y"))
    return share.join(y, "cluster", "left").select(F.col("cluster").alias("k"), "y", "p")

