"""Soft clusters as short lists: (id, x, ks), the clusters that can matter to each point.

Lists are made anew at major steps, by bounds (``bounds``): a membership is zero where a cluster's exponent is
``CUT`` above the nearest one's, and of the others the ``nearest`` come in. Between major steps nothing is
written: memberships follow from a point, its list and the centers, so a step of expectation and maximisation
is one pass that returns sums over clusters. Those k x (D + 3) numbers are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators import bounds as B
from pairforge.session import ship, stage

SPONGE = -1
#: Least prior in a membership, least size for a center to move, exponent beyond which a membership is zero.
LEAST_PRIOR, LEAST_SIZE, CUT = 1e-7, 1e-3, 20.0
#: Clusters in a point's list.
NEAREST = 8


@dataclass(frozen=True)
class Model:
    """Centers, priors and temperature; ``sponge`` is the distance of the noise cluster, ``noise`` its prior."""

    y: np.ndarray
    p: np.ndarray
    temperature: float
    sponge: float | None = None
    noise: float = 0.0
    cut: float = CUT

    @property
    def excess(self) -> float:
        """By how much squared distances may exceed the least one's before a membership is zero."""
        return 2 * self.cut * self.temperature


def soften(t: np.ndarray, p: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(memberships, sponge's) of squared distances over the temperature, infinite for clusters that are not in the list."""
    low = t.min(1, initial=np.inf)
    if model.sponge is not None:
        ts = model.sponge**2 / model.temperature
        low = np.minimum(low, ts)
        noise = np.where(ts - low < 2 * model.cut, max(model.noise, LEAST_PRIOR) * np.exp(-0.5 * (ts - low)), 0.0)
    else:
        noise = np.zeros(len(t))
    with np.errstate(invalid="ignore"):
        gap = t - low[:, None]
        e = np.where(gap < 2 * model.cut, np.maximum(p, LEAST_PRIOR) * np.exp(-0.5 * np.minimum(gap, 2 * model.cut)), 0.0)
    total = e.sum(1) + noise
    return e / total[:, None], noise / total


def listed(x: np.ndarray, ks: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, m, sponge's m) of each point over its list; -1 in a list is no cluster."""
    t = np.full(ks.shape, np.inf)
    for s in range(ks.shape[1]):
        rows = np.flatnonzero(ks[:, s] >= 0)
        t[rows, s] = ((x[rows] - model.y[ks[rows, s]]) ** 2).sum(1) / model.temperature
    m, noise = soften(t, np.where(ks >= 0, model.p[np.maximum(ks, 0)], 0.0), model)
    return t, m, noise


def grouped(keys: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Sums of rows of ``values`` by key, 0 to k - 1; negative keys are left out."""
    out = np.zeros((k, values.shape[1]))
    order = np.argsort(keys, kind="stable")
    order = order[keys[order] >= 0]
    if len(order):
        sorted_keys = keys[order]
        starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
        out[sorted_keys[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def short_list(known: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest centers of each row whose distances are known, in order of distance and number, filled with -1."""
    width = min(nearest, known.shape[1])
    order = np.argsort(known, axis=1, kind="stable")[:, :width].astype(np.int32)
    order[np.isinf(np.take_along_axis(known, order, 1))] = -1
    return order


class Lists:
    """Points with their short lists, from one major step to the next."""

    def __init__(self, points: DataFrame, nearest: int = NEAREST, width: int = B.WIDTH):
        self.nearest, self.search, self.frame = nearest, B.Search(points, width=max(width, nearest)), None
        ship(points.sparkSession)

    def rebuilt(self, model: Model) -> DataFrame:
        """(id, x, ks) for the centers of ``model``."""
        nearest = self.nearest

        def found(x: np.ndarray, known: np.ndarray) -> list[pa.Array]:
            # What was computed beyond the exponent's cut has no membership and needs no place.
            reach = np.sqrt(known.min(1) ** 2 + model.excess)
            return [B._lists(short_list(np.where(known <= reach[:, None], known, np.inf), nearest), pa.int32())]

        self.frame = self.search.at(model.y, model.excess, ", ks array<int>", found).select("id", "x", "ks", "computed")
        return self.frame


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 16_384):
            batch = whole.slice(at, 16_384)
            yield batch, B._matrix(batch["x"], "f8"), B._matrix(batch["ks"], "i4")


def _summed(lists: DataFrame, shape: tuple[int, int], values) -> np.ndarray:
    """Sums over all points of the array that ``values(x, ks)`` gives for some."""
    rows, columns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x, ks in _slices(batches):
            total += values(x, ks)
        k, pos = np.divmod(np.arange(total.size), columns)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(pos), pa.array(total.ravel())], names=["k", "pos", "value"])

    if rows * columns > B.MOST_VALUES:
        raise ValueError(f"more than {B.MOST_VALUES} numbers of centers")
    out = np.zeros(shape)
    parts = lists.select("x", "ks").mapInArrow(run, "k long, pos long, value double")
    for r in parts.groupBy("k", "pos").agg(F.sum("value").alias("value")).collect():
        out[r["k"], r["pos"]] = r["value"]
    return out


@dataclass
class Sums:
    """Of each cluster, the sponge last: expected size, mean squared distance, change of memberships; and means."""

    c: np.ndarray
    width: np.ndarray
    change: np.ndarray
    means: np.ndarray


def em_sums(lists: DataFrame, model: Model, before: Model | None = None) -> Sums:
    """One pass over the points; ``change`` is what memberships differ from those of ``before``, summed."""
    k, dim = model.y.shape

    def values(x: np.ndarray, ks: np.ndarray) -> np.ndarray:
        t, m, noise = listed(x, ks, model)
        change, noise_change = np.zeros_like(m), np.zeros_like(noise)
        if before is not None:
            _, was, noise_was = listed(x, ks, before)
            change, noise_change = np.abs(m - was), np.abs(noise - noise_was)
        square = np.where(m > 0, m * np.where(np.isinf(t), 0, t) * model.temperature, 0.0)
        out = np.zeros((k + 1, dim + 3))
        for s in range(ks.shape[1]):
            out[:k] += grouped(ks[:, s], np.c_[m[:, s], square[:, s], change[:, s], m[:, s, None] * x], k)
        out[k, :3] = noise.sum(), noise.sum() * (model.sponge or 0.0) ** 2, noise_change.sum()
        return out

    got = _summed(lists, (k + 1, dim + 3), values)
    c = got[:, 0]
    safe = np.maximum(c, 1e-300)
    means = np.where(c[:k, None] > LEAST_SIZE, got[:k, 3:] / safe[:k, None], model.y)
    return Sums(c, np.where(c > 0, got[:, 1] / safe, 0.0), got[:, 2], means)


def leading_variance(lists: DataFrame, model: Model, which: np.ndarray | None = None, most: int = 15, tolerance: float = 0.02, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(variances, directions): the largest membership-weighted variance of each cluster and its unit direction.

    By power iteration on all clusters at once, a pass over the points a step; no D x D table is made.
    Clusters not in ``which`` keep a variance of zero.
    """
    k, dim = model.y.shape
    v = np.random.default_rng(seed).normal(size=(k, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    value = np.zeros(k)
    asked = np.ones(k, bool) if which is None else which
    for _ in range(most):

        def values(x: np.ndarray, ks: np.ndarray, v=v) -> np.ndarray:
            _, m, _ = listed(x, ks, model)
            out = np.zeros((k, dim + 1))
            for s in range(ks.shape[1]):
                own = np.where((ks[:, s] >= 0) & asked[np.maximum(ks[:, s], 0)], ks[:, s], -1)
                z = x - model.y[np.maximum(own, 0)]
                along = (z * v[np.maximum(own, 0)]).sum(1)
                out += grouped(own, np.c_[m[:, s], (m[:, s] * along)[:, None] * z], k)
            return out

        got = _summed(lists, (k, dim + 1), values)
        product = got[:, 1:] / np.maximum(got[:, 0], 1e-300)[:, None]
        size = np.linalg.norm(product, axis=1)
        last, value = value, size
        v = np.where(size[:, None] > 0, product / np.maximum(size, 1e-300)[:, None], v)
        if np.all(np.abs(value - last) <= tolerance * np.maximum(value, 1e-12)):
            break
    return value, v


def occupations(lists: DataFrame, model: Model) -> np.ndarray:
    """Points whose largest membership is in each cluster, the sponge last; the lowest number on ties, the sponge before all."""
    k = len(model.y)

    def values(x: np.ndarray, ks: np.ndarray) -> np.ndarray:
        return np.bincount(_best(x, ks, model) % (k + 1), minlength=k + 1)[:, None].astype(float)

    return _summed(lists, (k + 1, 1), values)[:, 0]


def _best(x: np.ndarray, ks: np.ndarray, model: Model) -> np.ndarray:
    """The cluster of the largest membership, SPONGE for the noise."""
    _, m, noise = listed(x, ks, model)
    top = m.max(1, initial=0.0)
    best = np.where((m == top[:, None]) & (ks >= 0), ks, len(model.y)).min(1)
    return np.where((noise >= top) & (model.sponge is not None), SPONGE, best)


def members(lists: DataFrame, model: Model) -> DataFrame:
    """(id, k, t, m): the memberships above zero, the sponge's always."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"id {lists.schema['id'].dataType.simpleString()}, k int, t double, m double"
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, ks in _slices(batches):
            t, m, noise = listed(x, ks, model)
            if model.sponge is not None:
                ks, t, m = np.c_[ks, np.full(len(x), SPONGE, np.int32)], np.c_[t, np.full(len(x), model.sponge**2 / model.temperature)], np.c_[m, noise]
                keep = m > 0
                keep[:, -1] = True
            else:
                keep = m > 0
            rows, places = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows)), pa.array(ks[rows, places].astype(np.int32)), pa.array(t[rows, places]), pa.array(m[rows, places])], schema=out)

    return lists.select("id", "x", "ks").mapInArrow(run, schema)


def labels(lists: DataFrame, model: Model) -> DataFrame:
    """(id, cluster): the largest membership."""
    schema = f"id {lists.schema['id'].dataType.simpleString()}, cluster int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, ks in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(_best(x, ks, model).astype(np.int32))], names=["id", "cluster"])

    return lists.select("id", "x", "ks").mapInArrow(run, schema)


def without(model: Model, gone: np.ndarray) -> Model:
    """The model without some clusters; what remains is numbered anew, priors again add to one."""
    stay = ~gone
    share = model.p[stay].sum() + model.noise
    return replace(model, y=model.y[stay], p=model.p[stay] / share, noise=model.noise / share)


def invalid(model: Model, c: np.ndarray, occupied: np.ndarray, least: float, least_occupied: int, close: float) -> np.ndarray:
    """Clusters too small, of too few points, or within ``close`` temperatures of a larger one (the lower number on ties)."""
    k = len(model.y)
    gone = (c[:k] < least) | (occupied[:k] < least_occupied)
    if gone.all():
        gone[np.argmax(c[:k])] = False
    near = B.between(model.y) ** 2 < close * model.temperature
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        if not gone[a] and not gone[b]:
            gone[b if c[a] >= c[b] else a] = True
    return gone


def staged_points(points: DataFrame, unit: np.ndarray | None = None) -> DataFrame:
    """(id, x) once, each dimension divided by ``unit``."""
    x = F.col("x") if unit is None else F.zip_with("x", F.array(*(F.lit(float(u)) for u in unit)), lambda a, u: a / u)
    return stage(points.sparkSession, points.select("id", x.alias("x")), "points")
