"""Which centers can matter to a point, by lower bounds of few numbers a point.

A point carries the nearest ``width`` centers with a lower bound to each, and one bound for all others, for
two generations of center positions: those of the last step, and an older one that is renewed when centers
have drifted far. A bound shrinks by what its center moved since its generation, so the old one is the better
where centers wander back and forth. Distances between centers bound the rest: a center farther from one that
was measured than the point's reach allows is out, whatever was known of it (the backward test).

Hard assignment reaches as far as the nearest center; soft clusters as far as memberships are not zero.
The tables of centers are of k x D and k x k numbers, whose size is checked; the state is of bounded width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.session import discard, ship, stage

#: Numbers of centers, and of distances between them, that a task may hold; numbers of a slice of points x centers.
MOST_VALUES, SLICE_VALUES = 5_000_000, 1 << 21
#: Bounds that a point keeps; share of the mean nearest distance between centers after which the old generation is renewed.
WIDTH, DRIFT = 16, 0.5
#: Bounds are sums and differences of rounded numbers.
SLACK = 1e-9


def between(y: np.ndarray) -> np.ndarray:
    """Distances between all centers."""
    if max(y.size, len(y) ** 2) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} numbers of centers")
    square = (y * y).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * y @ y.T, 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row."""
    return np.sqrt(((x - y) ** 2).sum(1))


@dataclass(frozen=True)
class Centers:
    """Positions now, at the last step, and at the old generation; ``excess`` is what squared distances may exceed the nearest one's."""

    now: np.ndarray
    last: np.ndarray | None = None
    old: np.ndarray | None = None
    excess: float = 0.0
    width: int = WIDTH


def drifted(y: np.ndarray, old: np.ndarray) -> bool:
    """Whether centers are so far from where they were that bounds of that time say little."""
    if len(y) < 2:
        return False
    nearest = (between(old) + np.where(np.eye(len(old), dtype=bool), np.inf, 0)).min(1)
    return bool(distances(y, old).mean() > DRIFT * nearest.mean())


@dataclass
class Held:
    """Bounds of some points in one generation: centers ``near`` (-1: none), bounds ``low`` to them, ``rest`` to all others."""

    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray

    def spread(self, moved: np.ndarray) -> np.ndarray:
        """Lower bounds to all centers, which have moved so far since."""
        out = self.rest[:, None] - moved[None, :]
        rows, places = np.nonzero(self.near >= 0)
        centers = self.near[rows, places]
        out[rows, centers] = self.low[rows, places] - moved[centers]
        return out


def shortest(low: np.ndarray, width: int) -> Held:
    """The ``width`` least bounds of each row, and the least of the others."""
    n, k = low.shape
    if k <= width:
        near = np.tile(np.arange(k, dtype=np.int32), (n, 1))
        return Held(near, low.copy(), np.full(n, np.inf))
    order = np.argpartition(low, width, axis=1)
    near = order[:, :width].astype(np.int32)
    return Held(near, np.take_along_axis(low, near, 1), low[np.arange(n), order[:, width]])


def measure(x: np.ndarray, rows: np.ndarray, centers: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of pairs of points and centers, some at a time."""
    out, step = np.empty(len(rows)), max(1, SLICE_VALUES // max(1, x.shape[1]))
    for at in range(0, len(rows), step):
        out[at : at + step] = distances(x[rows[at : at + step]], y[centers[at : at + step]])
    return out


def search(x: np.ndarray, k: np.ndarray | None, last: Held | None, old: Held | None, c: Centers, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances, bounds, computed) of points to centers.

    Distances are infinite where they were not computed, which is only where they are beyond the point's
    reach: the root of its nearest squared distance and ``excess``. ``k`` is a guess of the nearest center.
    """
    n, all_rows, y = len(x), np.arange(len(x)), c.now
    if last is None or k is None:
        known = measure(x, np.repeat(all_rows, len(y)), np.tile(np.arange(len(y)), n), y).reshape(n, len(y))
        return known, known.copy(), np.full(n, len(y), np.int64)
    low = last.spread(distances(y, c.last))
    if old is not None:
        np.maximum(low, old.spread(distances(y, c.old)), out=low)
    known, computed = np.full((n, len(y)), np.inf), np.zeros(n, np.int64)

    def look(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
        d = measure(x, rows, centers, y)
        known[rows, centers] = low[rows, centers] = d
        np.add.at(computed, rows, 1)
        return d

    def backward(rows: np.ndarray, centers: np.ndarray, d: np.ndarray) -> None:
        low[rows] = np.maximum(low[rows], gaps[centers] - d[:, None])

    best = look(all_rows, k)
    backward(all_rows, k, best)
    low[all_rows, k] = best
    reach = lambda: np.sqrt(best * best + c.excess) * (1 + SLACK) + SLACK
    # The likeliest other center first: it may be nearer, and its own neighbours rule out more.
    open_low = np.where(np.isinf(known), low, np.inf)
    second = open_low.argmin(1)
    rows = np.flatnonzero(open_low[all_rows, second] <= reach())
    d = look(rows, second[rows])
    best[rows] = np.minimum(best[rows], d)
    backward(rows, second[rows], d)
    low[rows, second[rows]] = d
    low[all_rows, k] = known[all_rows, k]
    rows, centers = np.nonzero(np.isinf(known) & (low <= reach()[:, None]))
    look(rows, centers)
    return known, low, computed


_STATE = "id {kind}, x array<double>, k long, d double, near array<int>, low array<double>, rest double, old_near array<int>, old_low array<double>, old_rest double, computed long"


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if values.shape[1] else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def step(state: DataFrame, c: Centers, first: bool, renew: bool, extra: str = "", found=None) -> DataFrame:
    """One search over the rows of ``state``: (id, x) at ``first``, afterwards what this returned.

    ``extra`` are columns in DDL that ``found(x, distances)`` gives, as Arrow arrays, besides the state.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(state.sparkSession)
    schema = _STATE.format(kind=state.schema["id"].dataType.simpleString()) + extra
    out, gaps = to_arrow_schema(T.StructType.fromDDL(schema)), between(c.now)
    rows_at_once = max(1, SLICE_VALUES // max(1, len(c.now)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                x, before = _matrix(batch["x"], "f8"), 0
                if first:
                    known, low, computed = search(x, None, None, None, c, gaps)
                else:
                    held = [Held(_matrix(batch[f"{g}near"], "i4"), _matrix(batch[f"{g}low"], "f8"), batch[f"{g}rest"].to_numpy()) for g in ("", "old_")]
                    known, low, computed = search(x, batch["k"].to_numpy(), held[0], held[1], c, gaps)
                    before = batch["computed"].to_numpy()
                k = known.argmin(1)
                new = shortest(low, c.width)
                older = new if first or renew else held[1]
                columns = [batch["id"], batch["x"], pa.array(k.astype(np.int64)), pa.array(known[np.arange(len(x)), k]), _lists(new.near, pa.int32()), _lists(new.low, pa.float64()), pa.array(new.rest)]
                columns += [_lists(older.near, pa.int32()), _lists(older.low, pa.float64()), pa.array(older.rest), pa.array(computed + before)]
                yield pa.RecordBatch.from_arrays([*columns, *(found(x, known) if found else ())], schema=out)

    names = ["id", "x"] if first else [f.name for f in out][: len(_STATE.split(", "))]
    return state.select(*names).mapInArrow(run, schema)


class Search:
    """A bounded search that is carried from step to step; the state is one written table at a time."""

    def __init__(self, points: DataFrame, excess: float = 0.0, width: int = WIDTH):
        self.state, self.width, self.excess = points.select("id", "x"), width, excess
        self.made: DataFrame | None = None
        self.last: np.ndarray | None = None
        self.old: np.ndarray | None = None

    def at(self, y: np.ndarray, excess: float | None = None, extra: str = "", found=None) -> DataFrame:
        """The state under centers ``y``; a change of their number starts anew."""
        self.excess = self.excess if excess is None else excess
        first = self.last is None or len(self.last) != len(y)
        renew = first or drifted(y, self.old)
        c = Centers(y, None if first else self.last, None if first else self.old, self.excess, self.width)
        before, self.made = self.made, stage(self.state.sparkSession, step(self.state, c, first, renew, extra, found), "bounds")
        discard(before)
        self.state, self.last, self.old = self.made, y, y if renew else self.old
        return self.made


def counted(state: DataFrame) -> int:
    """Distances computed so far."""
    return int(state.agg(F.sum("computed")).first()[0] or 0)
