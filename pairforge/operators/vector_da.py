"""Deterministic annealing on vectors, with an optional noise cluster ("sponge") at constant distance.

Points stay in a DataFrame (id, x); the k x D centers live on the driver, where their size is checked, and
travel with the tasks, so a step is a map over the points and one grouped sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions import vector as V
from pairforge.operators import annealing_control as N
from pairforge.operators import bounds as B
from pairforge.operators import pairs as P
from pairforge.operators import reductions as R
from pairforge.operators import soft_clusters as S
from pairforge.operators.bounds import MOST_VALUES
from pairforge.operators.soft_clusters import CUT, LEAST_PRIOR, LEAST_SIZE, SPONGE
from pairforge.session import ship


def collected(centers: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(numbers, positions, priors, the sponge's prior) of centers (k, y, p), whose size is checked first."""
    size = centers.agg(F.coalesce(F.sum(F.size("y")), F.lit(0))).first()[0]
    if size > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} numbers of centers")
    rows = sorted(centers.collect(), key=lambda r: r["k"])
    own = [r for r in rows if r["k"] != SPONGE]
    noise = next((float(r["p"] or 0) for r in rows if r["k"] == SPONGE), 0.0)
    return np.array([r["k"] for r in own], np.int32), np.array([r["y"] for r in own], float), np.array([r["p"] or 0 for r in own], float), noise


def memberships(points: DataFrame, centers: DataFrame, temperature: float, sponge: float | None = None, cut: float = CUT, dim: int | None = None, with_x: bool = True) -> DataFrame:
    """(id, x, k, t, m) from points (id, x) and centers (k, y, p), a row for every cluster; the sponge has k = -1.

    m is in proportion to max(1e-7, p) exp(-(t - t_min) / 2) with t the squared distance over the temperature.
    ``x`` is left out unless ``with_x``. ``anneal`` carries short lists instead (``soft_clusters``).
    """
    names, y, p, noise = collected(centers)
    model = S.Model(y, p, temperature, sponge, noise, cut)
    if sponge is not None:
        names = np.r_[names, np.int32(SPONGE)]
    schema = f"id {points.schema['id'].dataType.simpleString()}, {'x array<double>, ' if with_x else ''}k int, t double, m double"

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = B._matrix(batch["x"], "f8")
                t = np.stack([((x - c) ** 2).sum(1) for c in y], axis=1) / temperature
                m, rest = S.soften(t, p, model)
                if sponge is not None:
                    t, m = np.c_[t, np.full(len(x), sponge * sponge / temperature)], np.c_[m, rest]
                rows = pa.array(np.repeat(np.arange(len(x)), len(names)))
                columns = [batch["id"].take(rows), *([batch["x"].take(rows)] if with_x else []), pa.array(np.tile(names, len(x))), pa.array(t.ravel()), pa.array(m.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(["x"] if with_x else []), "k", "t", "m"])

    ship(points.sparkSession)
    return points.select("id", "x").mapInArrow(run, schema)


def cluster_sums(members: DataFrame, temperature: float) -> DataFrame:
    """(k, c, width): expected size and mean squared distance of each cluster."""
    s = members.groupBy("k").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("t") * temperature).alias("w"))
    return s.select("k", "c", F.when(F.col("c") > 0, F.col("w") / F.col("c")).otherwise(F.lit(0.0)).alias("width"))


def weighted_means(members: DataFrame) -> DataFrame:
    """(k, y): membership-weighted means of all but the sponge, where there is enough of a cluster."""
    own = members.where((F.col("k") != SPONGE) & (F.col("m") > 0))
    pos = own.select("k", "m", F.posexplode("x").alias("pos", "v")).groupBy("k", "pos").agg(F.sum(F.col("m") * F.col("v")).alias("s"), F.sum("m").alias("c")).where(F.col("c") > LEAST_SIZE)
    return pos.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("s") / F.col("c")).alias("v")))), lambda e: e["v"]).alias("y"))


def covariances(members: DataFrame, centers: DataFrame) -> DataFrame:
    """(k, i, j, v): membership-weighted sums of products of deviations."""
    both = members.where(F.col("k") != SPONGE).join(F.broadcast(centers.select("k", "y")), "k")
    dev = both.select("k", "m", F.zip_with("x", "y", lambda a, b: a - b).alias("z"))
    first = dev.select("k", "m", "z", F.posexplode("z").alias("i", "zi"))
    return first.select("k", "m", "i", "zi", F.posexplode("z").alias("j", "zj")).where("i <= j").groupBy("k", "i", "j").agg(F.sum(F.col("m") * F.col("zi") * F.col("zj")).alias("v"))


def eigenpair_2x2(a: Column, b: Column, d: Column) -> tuple[Column, Column, Column]:
    """The least eigenvalue of [[a, b], [b, d]] and its unit vector, in closed form."""
    root = F.sqrt((a - d) * (a - d) + 4 * b * b)
    value = 0.5 * (a + d - root)
    x, y = F.when(b != 0, b).otherwise(F.when(a <= d, F.lit(1.0)).otherwise(F.lit(0.0))), F.when(b != 0, value - a).otherwise(F.when(a <= d, F.lit(0.0)).otherwise(F.lit(1.0)))
    norm = F.sqrt(x * x + y * y)
    return value, x / norm, y / norm


def nearest_clusters(members: DataFrame, n: int, exponent: float) -> DataFrame:
    """The ``n`` nearest clusters of each point within an exponent of the nearest, always the sponge; memberships rescaled.

    Where less than a fifth of the membership survives, it is spread evenly.
    """
    by = Window.partitionBy("id")
    ranked = members.withColumn("place", F.row_number().over(by.orderBy("t", "k"))).withColumn("low", F.min("t").over(by))
    kept = ranked.where(((F.col("place") <= n) & (F.col("t") - F.col("low") <= 2 * exponent)) | (F.col("k") == SPONGE))
    total, count = F.sum("m").over(by), F.count("*").over(by)
    return kept.select("id", "x", "k", "t", F.when(total < 0.2, 1.0 / count).otherwise(F.col("m") / total).alias("m"))


def occupation(members: DataFrame) -> DataFrame:
    """(k, n): points whose largest membership is in k, the lowest number on ties."""
    best = members.groupBy("id").agg(F.min(F.struct((-F.col("m")).alias("m"), F.col("k"))).alias("b"))
    return best.groupBy(F.col("b.k").alias("k")).agg(F.count("*").alias("n"))


def close_centers(centers: DataFrame, cut: float) -> DataFrame:
    """(a, b, d2): pairs of centers nearer than the cut, a < b."""
    half = P.half_pairs(centers.select("k", "y"), ["y"], "k")
    near = half.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), V.squared_distance(F.col("y_i"), F.col("y_j")).alias("d2"))
    return near.where(F.col("d2") < cut)


def initial_state(points: DataFrame, dim: int | None = None) -> DataFrame:
    """(y, spread, t0): the centre of mass, the mean squared distance to it, and one and a half of that."""
    mean = R.elementwise(points, "x", "mean", (), dim).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("y"))
    d = points.join(F.broadcast(mean)).groupBy("y").agg(F.avg(V.squared_distance(F.col("x"), F.col("y"))).alias("spread"))
    return d.select("y", "spread", (1.5 * F.col("spread")).alias("t0"))


@dataclass
class Solution:
    """What an annealing ends with: centers (k, y, p), lists of each point and their model, and what happened.

    ``history`` has (temperature, clusters, energy, steps, reason) for every temperature.
    """

    centers: DataFrame
    lists: DataFrame
    model: S.Model
    unit: np.ndarray
    temperature: float
    history: list[tuple[float, int, float, int, str]] = field(default_factory=list)
    reason: str = ""

    @property
    def members(self) -> DataFrame:
        """(id, k, t, m), memberships above zero."""
        return S.members(self.lists, self.model)

    def labels(self) -> DataFrame:
        return S.labels(self.lists, self.model)


@dataclass(frozen=True)
class Schedule:
    """How an annealing cools and what it anneals along with the temperature.

    Temperatures are shares of the first. ``inner`` steps at a temperature at most, until memberships change
    by less than ``limit`` a point; in the last loop centers must also move by less than ``moved`` of the mean
    width. ``sponge`` is the distance of the noise cluster, which joins below ``sponge_from``; with
    ``sponge_first`` it starts that much wider and falls in line with the temperature. ``widths`` are
    (first, final) variances by which all dimensions are divided, on a power law.
    """

    cooling: float = 0.8
    final: float = 0.2
    inner: int = 30
    limit: float = 1e-3
    moved: float = 1e-4
    sponge: float | None = None
    sponge_from: float = 0.5
    sponge_first: float | None = None
    widths: tuple[float, float] | None = None
    #: Least expected size and points of a cluster; squared distance of two, in temperatures, below which they are one.
    least: float = 2.0
    least_occupied: int = 1
    close: float = 0.01
    #: Share of clusters that may split at once.
    splits: float = 0.25


class Annealing:
    """One annealing: the model, the lists and the best valid solution so far."""

    def __init__(self, points: DataFrame, schedule: Schedule, nearest: int, start: S.Model, n: int):
        self.points, self.schedule, self.nearest, self.n = points, schedule, nearest, n
        self.width = schedule.widths[0] if schedule.widths else 1.0
        self.t0 = start.temperature
        self.model = replace(start, y=start.y / np.sqrt(self.width), temperature=start.temperature / self.width)
        self.history, self.best, self.lists = [], None, self._new_lists()
        self.sums: S.Sums | None = None

    def _new_lists(self) -> S.Lists:
        unit = None if self.width == 1.0 else np.full(self.model.y.shape[1], math.sqrt(self.width))
        return S.Lists(self.points if unit is None else S.staged_points(self.points, unit), self.nearest)

    def settle(self, final: bool = False) -> str:
        """Steps until memberships (and centers, in the last loop) settle; lists are made once before."""
        s, frame, before = self.schedule, self.lists.rebuilt(self.model), None
        for step in range(1, s.inner + 2):
            sums = S.em_sums(frame, self.model, before)
            if abs(sums.c.sum() - self.n) > 0.5:
                raise RuntimeError("memberships don't add up to the number of points")
            change = math.inf if before is None else float(sums.change.max()) / self.n
            moved2 = float(((sums.means - self.model.y) ** 2).sum(1).mean())
            verdict = N.convergence(change, s.limit, step, s.inner, moved2, float(sums.width[:-1].mean()), s.moved, final)
            self.sums = sums
            if verdict.code:
                break
            before, self.model = self.model, replace(self.model, y=sums.means, p=sums.c[:-1] / self.n, noise=sums.c[-1] / self.n if self.model.sponge is not None else 0.0)
        self.steps = step
        return verdict.reason

    def energy(self) -> float:
        return 0.5 * float((self.sums.c * self.sums.width).sum()) * self.width

    def clean(self) -> bool:
        """Drop clusters that are no good; whether any were."""
        s = self.schedule
        gone = S.invalid(self.model, self.sums.c, S.occupations(self.lists.frame, self.model), s.least, s.least_occupied, s.close)
        if not gone.any() or gone.all():
            return False
        self.model = S.without(self.model, gone)
        return True

    def split(self, most: int) -> bool:
        """Split the clusters whose largest variance is furthest above the temperature, along its direction."""
        k, s = len(self.model.y), self.schedule
        large = self.sums.c[:k] > 2 * s.least
        if k >= most or not large.any():
            return False
        value, v = S.leading_variance(self.lists.frame, self.model, large)
        ready = [j for j in np.argsort(-value) if large[j] and value[j] > self.model.temperature][: min(most - k, max(1, int(k * s.splits)))]
        if not ready:
            return False
        y, p = self.model.y.copy(), self.model.p.copy()
        move = 0.1 * np.sqrt(value[ready])[:, None] * v[ready]
        p[ready] /= 2
        self.model = replace(self.model, y=np.r_[np.where(np.isin(np.arange(k), ready)[:, None], y - _at(move, ready, k), y), y[ready] + move], p=np.r_[p, p[ready]])
        return True

    def solution(self, reason: str) -> Solution:
        m, unit = self.model, np.full(self.model.y.shape[1], math.sqrt(self.width))
        rows = [(k, (c * unit).tolist(), float(q)) for k, (c, q) in enumerate(zip(m.y, m.p))] + ([(SPONGE, None, float(m.noise))] if m.sponge is not None else [])
        centers = self.points.sparkSession.createDataFrame(rows, "k int, y array<double>, p double")
        return Solution(centers, self.lists.frame, m, unit, m.temperature * self.width, self.history, reason)

    def cool(self) -> None:
        s, m = self.schedule, self.model
        share = m.temperature * self.width / self.t0
        t = max(share * s.cooling, s.final) * self.t0
        if s.widths:
            ratio = t / (share * self.t0)
            width = _annealed(self.width, s.widths[1], share, s.final, ratio)
            if width != self.width:
                y = m.y * math.sqrt(self.width / width)
                self.width = width
                self.model = m = replace(m, y=y)
                self.lists = self._new_lists()
        sponge = m.sponge
        if s.sponge is not None and (sponge is not None or t <= s.sponge_from * self.t0):
            first = s.sponge_first or s.sponge
            sponge = _sponge(first, s.sponge, t / self.t0, s.sponge_from, s.final) / math.sqrt(self.width)
        self.model = replace(m, temperature=t / self.width, sponge=sponge, noise=m.noise if m.sponge is not None else LEAST_PRIOR if sponge is not None else 0.0)


def _at(move: np.ndarray, ready: list[int], k: int) -> np.ndarray:
    out = np.zeros((k, move.shape[1]))
    out[ready] = move
    return out


def _annealed(value: float, final: float, share: float, last: float, ratio: float) -> float:
    """``annealing_control.annealed`` for one number."""
    if value <= final or share <= last:
        return min(value, final) if value <= final else final
    fall = min(math.log(last) - math.log(share), math.log(ratio))
    return max(final, value * math.exp(math.log(ratio) * (math.log(final) - math.log(value)) / fall))


def _sponge(first: float, final: float, share: float, begin: float, end: float) -> float:
    """``annealing_control.sponge_factor`` for one number."""
    if first <= final or share <= end or begin <= end:
        return final
    return max(final, final + (first - final) * (min(share, begin) - end) / (begin - end))


def anneal(
    points: DataFrame, most: int = 8, cooling: float = 0.8, final: float = 0.2, sponge: float | None = None, sponge_from: float = 0.5, inner: int = 30, least: float = 2.0, dim: int | None = None,
    nearest: int = S.NEAREST, start: DataFrame | None = None, temperature: float | None = None, schedule: Schedule | None = None,
) -> Solution:
    """Anneal from one center, or from centers ``start`` (k, y, p), to at most ``most``.

    Begins at ``temperature``, or where one center can first split: the largest variance of all points (or one
    and a half of the mean squared distance, if that is lower). At each temperature steps run until
    memberships settle; clusters that are too small, of too few points or too close are dropped; those whose
    largest variance exceeds the temperature split along it. A split whose outcome is no good is undone from
    the best solution, and then the temperature falls first. The last temperature ends when centers
    have settled too. Memberships are short lists of the ``nearest`` clusters that can matter.

    ``schedule`` states more; the other arguments are short for some of its fields. Points that are null are
    an error; no points give no solution and raise.
    """
    s = schedule or Schedule(cooling=cooling, final=final, inner=inner, sponge=sponge, sponge_from=sponge_from, least=least)
    points = S.staged_points(points)
    n = points.count()
    if not n:
        raise ValueError("no points")
    if start is None:
        first = initial_state(points, dim).first()
        y, p, noise = np.array([first["y"]], float), np.ones(1), 0.0
        whole = S.Model(y, p, 1.0)
        one = points.withColumn("ks", F.array(F.lit(0)))
        t0 = temperature or min(float(first["t0"]), 0.99 * float(S.leading_variance(one, whole)[0][0])) or float(first["t0"]) or 1.0
        begin = S.Model(y, p, t0)
    else:
        _, y, p, noise = collected(start)
        t0 = temperature or 1.5 * float(initial_state(points, dim).first()["spread"]) or 1.0
        begin = S.Model(y, p, t0, s.sponge if noise else None, noise)
    run, failures = Annealing(points, s, nearest, begin, n), 0
    while True:
        reason = run.settle()
        while run.clean():
            if run.best is not None and len(run.model.y) < len(run.best.y):
                # The last split came to nothing: back to what was good at this temperature.
                failures += 1
                run.model = replace(run.best, temperature=run.model.temperature, sponge=run.model.sponge)
                run.best = None
            reason = run.settle()
        run.history.append((run.model.temperature * run.width, len(run.model.y), run.energy(), run.steps, reason))
        if run.model.temperature * run.width <= s.final * t0 * (1 + 1e-9):
            if not failures and run.split(most):
                failures += 1
                continue
            reason = run.settle(final=True)
            return run.solution(reason)
        before = run.model
        if not failures and run.split(most):
            run.best = before
            continue
        failures, run.best = 0, None
        run.cool()
