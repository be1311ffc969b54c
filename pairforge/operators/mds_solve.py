"""Scaling by Levenberg-Marquardt with all its controls: fixed points, damping between bounds, descent, line search, starts.

A fixed point pulls on the others and never moves: its rows of gradient, diagonal and steps are zero, so the
system that is solved is that of the varied points.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators import mds as X
from pairforge.operators import mds_control as M
from pairforge.session import discard, stage

#: Reasons to stop, by code.
REASONS = {0: "the change is within the tolerance", 1: "damping has reached its bound", 2: "all rounds are done", 3: "chi-squared is zero", 4: "no point varies"}
#: Share of the predicted decrease under which a step is searched along; factors by which damping falls and grows.
POOR, EASE, PRESS = 0.25, 4.0, 8.0


@dataclass
class Solved:
    """Positions (id, x, free) of the best start; chi-squared after each accepted step of all starts, and what each step was."""

    positions: DataFrame
    chi: float
    reason: str
    start: int
    histories: list[list[float]] = field(default_factory=list)
    moves: list[list[str]] = field(default_factory=list)


def _masked(name: str, dim: int) -> Column:
    return F.array(*(F.get(name, k) * F.col("free") for k in range(dim)))


class _Solver:
    def __init__(self, edges: DataFrame, fit: X.Fit, steps: int):
        self.edges, self.fit, self.steps, self.spark = edges, fit, steps, edges.sparkSession

    def at(self, positions: DataFrame) -> tuple[DataFrame, float]:
        """(id, x, free, g, h) with the gradient and diagonal of varied points, and chi-squared."""
        both = positions.select("id", "x", "free").join(X.gradient(self.edges, positions, self.fit), "id", "left")
        zero = F.array(*(F.lit(0.0) for _ in range(self.fit.dim)))
        both = both.withColumn("g", F.coalesce("g", zero)).withColumn("h", F.coalesce("h", zero))
        state = stage(self.spark, both.select("id", "x", "free", "chi", _masked("g", self.fit.dim).alias("g"), _masked("h", self.fit.dim).alias("h")), "solve")
        return state, float(state.agg(F.sum("chi")).first()[0] or 0)

    def product(self, state: DataFrame, vector: str) -> DataFrame:
        """``state`` with ``hv``: the Hessian of the varied points times ``vector``, which is zero for fixed ones."""
        zero = F.array(*(F.lit(0.0) for _ in range(self.fit.dim)))
        both = state.join(X.hessian_product(self.edges, state, self.fit, vector), "id", "left").withColumn("hv", F.coalesce("hv", zero))
        return both.withColumn("hv", _masked("hv", self.fit.dim))

    def newton(self, state: DataFrame, damping: float) -> DataFrame:
        """``state`` with ``s``: an approximate solution of (H + damping * diagonal) s = -g by conjugate gradients."""
        dim = self.fit.dim
        minus = F.array(*(-F.get("g", k) for k in range(dim)))
        zero = F.array(*(F.lit(0.0) for _ in range(dim)))
        held = state.columns
        at = stage(self.spark, state.select(*held, zero.alias("s"), minus.alias("r"), minus.alias("v")), "cg")
        rr = first = float(at.agg(F.sum(X._dot("r", "r", dim))).first()[0] or 0)
        for _ in range(self.steps):
            if rr <= 1e-6 * first or rr == 0:
                break
            damped = F.array(*(F.get("hv", k) + F.lit(damping) * F.get("h", k) * F.get("v", k) for k in range(dim)))
            hv = stage(self.spark, self.product(at, "v").withColumn("hv", damped), "cg")
            curve = float(hv.agg(F.sum(X._dot("v", "hv", dim))).first()[0] or 0)
            if curve <= 0:
                break
            alpha = rr / curve
            hv2 = hv.withColumn("s", X._mix("s", alpha, "v", dim)).withColumn("r", X._mix("r", -alpha, "hv", dim))
            new = float(hv2.agg(F.sum(X._dot("r", "r", dim))).first()[0] or 0)
            before, at = at, stage(self.spark, hv2.withColumn("v", X._mix("r", new / rr, "v", dim)).drop("hv"), "cg")
            discard(before)
            discard(hv)
            rr = new
        return at.select(*held, "s")

    def descent(self, state: DataFrame) -> DataFrame:
        """``state`` with ``s``: the best multiple of the scaled gradient."""
        dim = self.fit.dim
        s = F.array(*(-F.get("g", k) / F.when(F.get("h", k) > 0, F.get("h", k)).otherwise(F.lit(1.0)) for k in range(dim)))
        at = stage(self.spark, state.withColumn("s", s), "descent")
        got = self.product(at, "s").agg(F.sum(X._dot("g", "s", dim)).alias("gs"), F.sum(X._dot("s", "hv", dim)).alias("curve")).first()
        factor = -(got["gs"] or 0.0) / got["curve"] if got["curve"] else 0.0
        return at.withColumn("s", F.array(*(F.lit(factor) * F.get("s", k) for k in range(dim))))

    def moved(self, step: DataFrame, factor: float) -> DataFrame:
        return step.select("id", "free", X._mix("x", factor, "s", self.fit.dim).alias("x"))

    def slope(self, step: DataFrame, state: DataFrame) -> float:
        """The derivative of chi-squared over ordered pairs along ``s`` at ``state``."""
        dim = self.fit.dim
        both = state.select("id", "g").join(step.select("id", "s"), "id")
        return 2 * float(both.agg(F.sum(X._dot("g", "s", dim))).first()[0] or 0)

    def search(self, step: DataFrame, start: DataFrame, chi: float, tried: tuple[DataFrame, float], most: int = 3) -> tuple[DataFrame, float, str]:
        """The best point found along a step: by secants of the derivative, and by golden sections if these find nothing lower."""
        best, low, how = (tried[0], tried[1], "step") if tried[1] < chi else (start, chi, "none")
        a, slope_a, b, slope_b = 0.0, self.slope(step, start), 1.0, self.slope(step, tried[0])
        if slope_a < 0:
            for _ in range(most):
                if slope_b == slope_a:
                    break
                t = min(max(b - slope_b * (b - a) / (slope_b - slope_a), 0.05), 3.0)
                if abs(t - b) < 0.05:
                    break
                state, value = self.at(self.moved(step, t))
                a, slope_a, b, slope_b = b, slope_b, t, self.slope(step, state)
                if value < low:
                    best, low, how = state, value, "derivative search"
            if how == "none":
                f = lambda t: M.chi_squared(self.edges, self.moved(step, t), self.fit)
                t, value, _ = M.golden_section(f, 0.0, 1.0, 8)
                if value < chi:
                    best, low = self.at(self.moved(step, t))
                    how = "golden section"
        return best, low, how


def _run(solver: _Solver, positions: DataFrame, rounds: int, tolerance: float) -> tuple[DataFrame, float, int, list[float], list[str]]:
    fit, edges = solver.fit, solver.edges
    state, chi = solver.at(positions)
    history, moves = [chi], []
    if not state.where("free > 0").head(1):
        return state, chi, 4, history, moves
    # Damping is a share of the diagonal, between the eigenvalues' bounds in its units.
    bound = M.trace_and_norm(edges, positions, fit).first()
    unit = max(bound["trace"] / max(1, state.count() * fit.dim), 1e-300)
    highest, lowest = max(10.0, min(bound["trace"], bound["norm"]) / unit), 1e-6
    damping, reason = 0.1, 2
    for _ in range(rounds):
        if chi == 0:
            reason = 3
            break
        step = solver.newton(state, damping)
        step = stage(solver.spark, step, "step")
        tried = solver.at(solver.moved(step, 1.0))
        got = solver.product(step, "s").agg(F.sum(X._dot("g", "s", fit.dim)).alias("gs"), F.sum(X._dot("s", "hv", fit.dim)).alias("curve")).first()
        predicted = -2 * (got["gs"] or 0.0) - (got["curve"] or 0.0)
        best, value, how = tried[0], tried[1], "step"
        if chi - value < POOR * predicted:
            best, value, how = solver.search(step, state, chi, tried)
        if value >= chi:
            down = stage(solver.spark, solver.descent(state), "descent")
            best, value = solver.at(solver.moved(down, 1.0))
            how = "steepest descent"
        if value >= chi:
            damping *= PRESS
            if damping > highest:
                reason = 1
                break
            continue
        done = chi - value <= tolerance * chi
        discard(state)
        state, chi = best, value
        history.append(chi)
        moves.append(how)
        damping = max(damping / EASE, lowest) if how == "step" else min(damping * 2, highest)
        if done:
            reason = 0
            break
    return state, chi, reason, history, moves


def solve(edges: DataFrame, fit: X.Fit = X.Fit(), positions: DataFrame | None = None, fixed: DataFrame | None = None, starts: int = 4, rounds: int = 80, steps: int = 8, tolerance: float = 1e-3, seed: int = 1) -> Solved:
    """The best of ``starts`` solutions of pairs (i, j, d), both directions.

    Points begin at ``positions`` (id, x), which may be of some of them, and else at random; with positions
    for all points there is one start. ``fixed`` (id) must have positions and keep them. Points that occur in
    no defined pair stay where they begin. No pairs, or no point that varies, end at once with that reason.
    """
    spark = edges.sparkSession
    edges = stage(spark, edges.select("i", "j", "d"), "edges")
    average = float(edges.where("i <> j").agg(F.avg("d")).first()[0] or 1.0)
    fit = replace(fit, average=average)
    ids = edges.select(F.col("i").alias("id")).distinct()
    if positions is not None:
        ids = ids.unionByName(positions.select("id")).distinct()
    ids = stage(spark, ids, "ids")
    free = F.lit(1.0)
    if fixed is not None:
        ids = stage(spark, ids.join(fixed.select("id").distinct().withColumn("held", F.lit(True)), "id", "left"), "roles")
        free = F.when(F.col("held"), 0.0).otherwise(1.0)
        known = ids.where("held") if positions is None else ids.where("held").join(positions.where("x is not null"), "id", "left_anti")
        if known.head(1):
            raise ValueError("fixed points need positions")
    roles = ids.select("id", free.alias("free"))
    given = None if positions is None else positions.where("x is not null").select("id", F.col("x").alias("given"))
    all_given = given is not None and not ids.join(given, "id", "left_anti").head(1)
    solver, best = _Solver(edges, fit, steps), None
    out = Solved(None, 0.0, "", 0)
    for k in range(1 if all_given else starts):
        begin = X.start(ids, fit.dim, average / 2, seed + k).join(roles, "id")
        if given is not None:
            begin = begin.join(given, "id", "left").select("id", "free", F.coalesce("given", "x").alias("x"))
        state, chi, reason, history, moves = _run(solver, stage(spark, begin, "begin"), rounds, tolerance)
        out.histories.append(history)
        out.moves.append(moves)
        if best is None or chi < out.chi:
            best, out.chi, out.reason, out.start = state, chi, REASONS[reason], k
    out.positions = best.select("id", "x", "free")
    return out


def position_lines(positions: DataFrame) -> DataFrame:
    """Lines of id and coordinates, from which ``positions`` of a later run are read (``positions_of``)."""
    return positions.select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.transform("x", lambda v: v.cast("string")), "\t")).alias("value"))


def positions_of(lines: DataFrame) -> DataFrame:
    """(id, x) from lines of id and coordinates; lines without coordinates are left out."""
    cells = F.split(F.trim("value"), r"[\s,]+")
    return lines.where(F.size(cells) > 1).select(cells[0].cast("long").alias("id"), F.transform(F.slice(cells, 2, F.size(cells)), lambda v: v.cast("double")).alias("x"))
