"""Euclidean distances of all pairs, one task for each pair of blocks.

Points are dealt to blocks, each chosen pair of blocks is a group of a shuffle, and a task measures its
two blocks in slices: NumPy adds the squares one dimension after the other, so a distance has the digits
that the same sum in an expression or in SQL has. An expression over 64 dimensions compiles to a method
too long for the JVM's compiler and takes a thousand times as long.

``distances`` gives the pairs themselves, ``reduced`` what a function makes of each slice, so that pairs
never leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.operators.joins import split_join
from pairforge.operators.pairs import chosen_block
from pairforge.session import ship

#: Points of a block at most, about; fewer where there would be less than LEAST_BLOCKS, but not below FEW_POINTS.
BLOCK_POINTS, LEAST_BLOCKS, FEW_POINTS = 8192, 12, 128
#: Pairs of a slice, which lie in a processor's cache; tasks that pairs of blocks are dealt to.
SLICE_PAIRS, MOST_TASKS = 1 << 17, 2000


def _dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``dim`` numbers of each list, and whether they are all there."""
    if not column.null_count and len(column):
        sizes, values = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten()
        if not values.null_count and sizes.min() == sizes.max() >= dim:
            return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)[:, :dim].astype("f8"), np.ones(len(column), bool)
    lists = [v if v is not None and len(v) >= dim and None not in v[:dim] else None for v in column.to_pylist()]
    return np.array([v[:dim] if v is not None else [0.0] * dim for v in lists], float).reshape(-1, dim), np.array([v is not None for v in lists], bool)


class Slice:
    """Some points of one block with all of another: distances by each of ``dims`` and the rows' places.

    ``keep`` marks pairs that are made here, or is None if all are; ``defined`` those whose points have all
    numbers, likewise. ``a`` and ``b`` are the columns of the points of either side.
    """

    def __init__(self, d: list[np.ndarray], keep: np.ndarray | None, defined: np.ndarray | None, a: pa.Table, b: pa.Table):
        self.d, self.keep, self.defined, self.a, self.b = d, keep, defined, a, b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the kept pairs in ``a`` and ``b``."""
        if self.keep is None:
            n, m = self.d[0].shape
            return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        return np.nonzero(self.keep)

    def kept(self, values: np.ndarray) -> np.ndarray:
        return values.ravel() if self.keep is None else values[self.keep]


def _slices(a: pa.Table, b: pa.Table, same: bool, dims: tuple[int, ...]) -> Iterator[Slice]:
    a, b = a.combine_chunks(), b.combine_chunks()
    one = lambda t: _dense(pa.concat_arrays(t["x"].chunks), max(dims))
    (x, x_there), (y, y_there) = one(a), one(b)
    across, whole = np.ascontiguousarray(y.T), x_there.all() and y_there.all()
    a, b = a.drop_columns(["x"]), b.drop_columns(["x"])
    if same:
        # Comparable places of the ids, equal for equal ones.
        rank = pc.rank(pa.concat_arrays([c for t in (a, b) for c in t["id"].chunks]), tiebreaker="dense").to_numpy().astype("i8")
        first, second = np.split(rank, [len(x)])
    rows = max(1, SLICE_PAIRS // max(1, len(y)))
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        total, step, d = np.zeros((len(part), len(y))), np.empty((len(part), len(y))), {}
        for k in range(max(dims)):
            np.subtract(part[:, k, None], across[k], out=step)
            np.multiply(step, step, out=step)
            total += step
            if k + 1 in dims:
                d[k + 1] = np.sqrt(total)
        yield Slice([d[k] for k in dims], first[at : at + rows, None] > second if same else None, None if whole else x_there[at : at + rows, None] & y_there, a.slice(at, rows), b)


def _dealt(points: DataFrame, columns: list[str], within: str | None) -> tuple[DataFrame, list[str]]:
    """Rows (keys, side, id, x, columns) with each point once for each chosen pair of blocks that its own is in; no id, no pair."""
    points = points.where("id is not null")
    keys = ([within] if within else []) + ["row_block", "col_block"]
    if within:
        sizes = points.groupBy(within).agg(F.ceil(F.count("*") / BLOCK_POINTS).alias("blocks_"))
        named = split_join(points, sizes, [within], "id")
        blocks, tasks = F.col("blocks_"), None
    else:
        n = points.count()
        least = max(4, min(LEAST_BLOCKS, n // FEW_POINTS))
        count = max(least, -(-n // BLOCK_POINTS))
        named, blocks, tasks = points, F.lit(count), min(count * (count + 1) // 2, MOST_TASKS)
    own = F.pmod(F.xxhash64("id"), blocks)
    sides = F.array(*(F.struct(F.lit(side).alias("side"), row.alias("row_block"), col.alias("col_block")) for side, row, col in ((True, own, F.col("other_")), (False, F.col("other_"), own))))
    rows = named.withColumn("other_", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))).withColumn("e_", F.explode(sides))
    rows = rows.select(*([within] if within else []), "e_.row_block", "e_.col_block", "e_.side", "id", "x", *columns).where(chosen_block(F.col("row_block"), F.col("col_block")))
    return (rows.repartition(tasks, *keys) if tasks else rows), keys


def reduced(points: DataFrame, dims: tuple[int, ...], of: Callable[[Iterator[Slice]], Iterator[dict]], schema: str, columns: tuple[str, ...] = (), within: str | None = None) -> DataFrame:
    """What ``of`` gives, as columns of ``schema``, for the slices of each pair of blocks of points (id, x, ...).

    Each unordered pair of distinct ids is in one slice. ``columns`` come along; with ``within`` pairs are of
    one value of that column, which comes along too. ``of`` runs in tasks and sees one pair of blocks at a time.
    """
    ship(points.sparkSession)
    along = list(dict.fromkeys(columns))
    rows, keys = _dealt(points, along, within)
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        side = whole["side"]
        held = whole.select(([within] if within else []) + ["id", "x", *along])
        a, b = held.filter(side), held.filter(pc.invert(side))
        if len(a) and len(b):
            for made in of(_slices(a, b, key[-2].as_py() == key[-1].as_py(), dims)):
                yield from pa.table([pa.array(made[f.name], f.type) if isinstance(made[f.name], np.ndarray) else made[f.name].cast(f.type) for f in out], schema=out).to_batches()

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy(*keys).applyInArrow(run, schema)


def distances(points: DataFrame, dims: tuple[int, ...] = (3,), names: tuple[str, ...] = ("d",), columns: tuple[str, ...] = (), within: str | None = None) -> DataFrame:
    """(within, i, j, names, column_i, column_j): each unordered pair of distinct ids of points (id, x, ...) once.

    There is a distance for each of ``dims``, over so many first dimensions; they are null where a point lacks a number of the most.
    """
    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    ends = ("id", *columns)
    called = [("i", "j"), *((f"{c}_i", f"{c}_j") for c in columns)]
    schema = ([f"`{within}` {kind[within]}"] if within else []) + [f"`{n}` {kind[c]}" for c, pair in zip(ends, called) for n in pair] + [f"`{n}` double" for n in names]

    def of(slices: Iterator[Slice]) -> Iterator[dict]:
        for s in slices:
            i, j = s.pairs()
            rows, cols = pa.array(i), pa.array(j)
            made = {within: s.a[within].take(rows)} if within else {}
            for c, (left, right) in zip(ends, called):
                made |= {left: s.a[c].take(rows), right: s.b[c].take(cols)}
            for n, d in zip(names, s.d):
                made[n] = pa.array(s.kept(d), mask=None if s.defined is None else ~s.kept(s.defined))
            yield made

    return reduced(points, dims, of, ", ".join(schema), columns, within)
