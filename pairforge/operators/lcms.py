"""Runs over the peaks of a mass spectrometer: a clustering made anew, taken up again, or only reported on.

A run begins with one center or with the labels of former runs, puts points to clusters and to noise (the
"sponge") in the way its mode says, and ends with labels, centers and reports.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators import annealing_control as N
from pairforge.operators import comparison as L
from pairforge.operators import soft_clusters as S
from pairforge.operators import vector_da as D
from pairforge.session import stage


@dataclass(frozen=True)
class Mode:
    """restart: from labels; anneal: clusters split while it cools; settle: centers move; sponge: with noise; change: its distance falls."""

    restart: bool
    anneal: bool
    settle: bool
    sponge: bool
    change: bool = False


MODES = {
    "fresh": Mode(restart=False, anneal=True, settle=True, sponge=True),
    "sponge_again": Mode(restart=True, anneal=False, settle=False, sponge=True),
    "join": Mode(restart=True, anneal=False, settle=True, sponge=False),
    "sponge_change": Mode(restart=True, anneal=False, settle=True, sponge=True, change=True),
    "analyse": Mode(restart=True, anneal=False, settle=False, sponge=False),
}


@dataclass
class Run:
    """labels: (id, cluster), SPONGE for noise; centers: (k, y, p); history and reason as in ``vector_da.Solution``."""

    points: DataFrame
    labels: DataFrame
    centers: DataFrame
    history: list
    reason: str

    def clusters(self) -> DataFrame:
        """(cluster, dense, n, width): each cluster's place, size and mean squared distance from its points' mean; the sponge has no place nor width."""
        own = self.labels.join(self.points, "id").where(F.col("cluster") >= 0)
        pos = own.select("cluster", F.posexplode("x").alias("pos", "v")).groupBy("cluster", "pos").agg(F.var_pop("v").alias("v"))
        widths = pos.groupBy("cluster").agg(F.sum("v").alias("width"))
        real = L.reindex(self.labels).join(widths, "cluster")
        noise = self.labels.where(F.col("cluster") == S.SPONGE).groupBy("cluster").agg(F.count("*").alias("n"))
        return real.select("cluster", "dense", "n", "width").unionByName(noise.select("cluster", F.lit(None).cast("long").alias("dense"), "n", F.lit(None).cast("double").alias("width")))

    def sizes(self) -> DataFrame:
        """(size, clusters, points), with points of the sponge as clusters of one."""
        alone = L.singletons_for_noise(self.labels, S.SPONGE)
        return L.size_histogram(L.reindex(alone))


def run(points: DataFrame, mode: str, labels: DataFrame | None = None, schedule: D.Schedule | None = None, temperature: float | None = None, most: int = 8, nearest: int = S.NEAREST, dim: int | None = None) -> Run:
    """A run of one of MODES over points (id, x); modes that restart need ``labels`` (id, cluster), -1 for noise.

    ``schedule`` has the sponge's distance, where the mode has one. ``fresh`` anneals from one center.
    ``sponge_again`` leaves clusters where they are and deals points between them and the sponge.
    ``join`` takes labels of several runs whose clusters may be near to each other: it lets centers settle at
    ``temperature`` and makes one cluster of those that are too close. ``sponge_change`` starts with the
    sponge at ``sponge_first`` and cools to ``final`` of ``temperature`` while it falls. ``analyse`` moves
    nothing. Points without a label have none afterwards in ``analyse``; the other modes label all points.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
    how, s = MODES[mode], schedule or D.Schedule()
    if how.restart and labels is None:
        raise ValueError(f"{mode} restarts from labels")
    if how.sponge and s.sponge is None:
        raise ValueError(f"{mode} needs the distance of the sponge")
    points = S.staged_points(points)
    if not how.restart:
        got = D.anneal(points, most=most, dim=dim, nearest=nearest, temperature=temperature, schedule=s)
        return Run(points, got.labels(), got.centers, got.history, got.reason)
    start = stage(points.sparkSession, N.restart(points, labels, dim), "restart")
    if mode == "analyse":
        return Run(points, points.select("id").join(labels, "id", "left"), start, [], "analysed as it is")
    _, y, p, noise = D.collected(start)
    if not len(y):
        raise ValueError("no labelled cluster to restart from")
    t0 = temperature or float(D.initial_state(points, dim).first()["t0"])
    sponge = (s.sponge_first if how.change and s.sponge_first else s.sponge) if how.sponge else None
    model = S.Model(y, p, t0, sponge, noise if sponge is not None else 0.0)
    at = D.Annealing(points, replace(s, widths=None, sponge=s.sponge if how.sponge else None), nearest, model, points.count())
    if not how.settle:
        at.lists.rebuilt(at.model)
        return Run(points, S.labels(at.lists.frame, at.model), at.solution("").centers, [], "dealt once")
    while True:
        reason = at.settle()
        while at.clean():
            reason = at.settle()
        at.history.append((at.model.temperature, len(at.model.y), at.energy(), at.steps, reason))
        if not how.change or at.model.temperature <= s.final * t0 * (1 + 1e-9):
            break
        at.cool()
    got = at.solution(at.settle(final=True))
    return Run(points, got.labels(), got.centers, got.history, got.reason)
