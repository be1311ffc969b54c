"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments; a table for each segment maps its value to the codes that
have it. A query probes all segments at radius 0, 1, 2, ...: after radius t every code at distance
m * (t + 1) - 1 or less has been seen, as one of its segments must differ in t bits or fewer. The
query is finished once its k-th verified distance is within that. Segments are sized by the number of
distinct codes, so that a bucket holds a few hundred on average.

The table of a segment is dealt out in cells: runs of values with the same leading bits, of a bounded
number of codes (a cell with more is split). In a round each open query is sent once to every cell that
its flips can reach, and the flips of the other bits are looked up there, in arrays; only candidates
within the query's k-th distance so far come back, k at most from a cell.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage

#: Neighbours of a query; codes that a bucket should hold on average.
K, BUCKET = 10, 256
#: Codes of a cell, and pairs that are verified at once.
CELL, PAIRS = 1 << 16, 1 << 19
BITS = 64


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 components as a long: bit i is 1 if component i is above zero. More are an error."""
    vector = F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a sign code has {BITS} components at most"))).otherwise(vector)
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segment_widths(codes: int, bucket: int = BUCKET) -> list[int]:
    """Widths of the segments, as even as can be, from the number of distinct codes."""
    width = min(32, max(4, round(math.log2(max(codes, 1) / bucket)))) if codes > bucket else 4
    m = -(-BITS // width)
    return [BITS // m + (i < BITS % m) for i in range(m)]


@lru_cache(maxsize=256)
def flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits that have ``radius`` ones."""
    return np.array([sum(1 << b for b in x) for x in combinations(range(width), radius)], np.int64)


class Layout:
    """Where the segments lie, and how many leading bits of each name its cells."""

    def __init__(self, codes: int, bucket: int = BUCKET, cell: int = CELL):
        self.widths = segment_widths(codes, bucket)
        self.starts = [sum(self.widths[:i]) for i in range(len(self.widths))]
        lead = max(0, math.ceil(math.log2(max(codes, 1) / cell)))
        self.leads = [min(lead, w) for w in self.widths]

    def cells(self, code: Column) -> Column:
        """The cell of a code in each segment."""
        out = []
        for i, (at, w, lead) in enumerate(zip(self.starts, self.widths, self.leads)):
            value = F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << w) - 1))
            out.append(F.shiftright(value, w - lead).bitwiseOR(F.lit(i << 40)))
        return F.array(*out)

    def asks(self, code: Column, radius: int) -> Column:
        """(cell, near): the cells that exactly ``radius`` flips of a segment reach, ``near`` of them outside the leading bits."""
        own = self.cells(code)
        out = []
        for i, (w, lead) in enumerate(zip(self.widths, self.leads)):
            for far in range(min(radius, lead) + 1):
                if radius - far <= w - lead:
                    out += [F.struct(own[i].bitwiseXOR(F.lit(m)).alias("cell"), F.lit(radius - far).alias("near")) for m in flips(lead, far).tolist()]
        return F.array(*out)


def _search(layout: Layout, k: int):
    """The k nearest codes of a cell to each query that is sent to it: (q, code, low, n, d)."""
    out = pa.schema([("q", pa.int64()), ("code", pa.int64()), ("low", pa.int64()), ("n", pa.int32()), ("d", pa.int32())])

    def work(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return out.empty_table()
        segment = index["cell"][0].as_py() >> 40
        at, inner = np.uint64(layout.starts[segment]), layout.widths[segment] - layout.leads[segment]
        code = index["code"].to_numpy().view(np.uint64)
        value = (code >> at) & np.uint64((1 << inner) - 1)
        order = np.argsort(value, kind="stable")
        code, value = code[order], value[order].astype(np.int64)
        low, n = index["low"].to_numpy()[order], index["n"].to_numpy()[order]
        found = []
        for near in sorted(set(asked["near"].to_pylist())):
            mine = asked.filter(pa.array(asked["near"].to_numpy() == near))
            queries, bounds = mine["q"].to_numpy().view(np.uint64), mine["bound"].to_numpy()
            masks = flips(inner, near)
            own = ((queries >> at) & np.uint64((1 << inner) - 1)).astype(np.int64)
            step = max(1, PAIRS // max(len(masks), 1))
            for a in range(0, len(queries), step):
                probes = (own[a : a + step, None] ^ masks[None, :]).ravel()
                who = np.repeat(np.arange(a, min(a + step, len(queries))), len(masks))
                first = np.searchsorted(value, probes, "left")
                sizes = np.searchsorted(value, probes, "right") - first
                ends = np.cumsum(sizes)
                begin = 0
                while begin < len(probes):  # as many probes as have PAIRS candidates, one at least
                    stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                    c = sizes[begin:stop]
                    pick = np.repeat(first[begin:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    q = np.repeat(who[begin:stop], c)
                    d = np.bitwise_count(code[pick] ^ queries[q]).astype(np.int32)
                    keep = d <= bounds[q]
                    found.append((queries[q[keep]].view(np.int64), code[pick[keep]].view(np.int64), low[pick[keep]], n[pick[keep]], d[keep]))
                    if sum(len(x[0]) for x in found) > 4 * PAIRS:
                        found = [_nearest(found, k)]
                    begin = stop
        if not found:
            return out.empty_table()
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(_nearest(found, k), out)], schema=out)

    return work


def _nearest(found: list[tuple], k: int) -> tuple:
    """The k nearest of each query, ties by the smallest id of a code."""
    q, code, low, n, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((code, low, d, q))
    q, code, low, n, d = (x[order] for x in (q, code, low, n, d))
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return tuple(x[keep] for x in (q, code, low, n, d))


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", code_col: str = "code", k: int = K, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """The k nearest rows of each row of ``df`` for which ``queries`` holds: (query_id, rank, neighbor_id, distance).

    Against all rows, the query's own included; ties by the smaller id; fewer rows where there are fewer
    than k. Ids and codes are longs. Rows with a null id or code are neither queries nor neighbours;
    rows with the same id and code count as often as they come. Other columns are not read. Rows with
    equal codes are searched for once, and a code's k smallest ids stand for all of its rows: no other
    can be among the k nearest. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(df[id_col].cast("long").alias("id"), df[code_col].cast("long").alias("code"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = stage(spark, rows.where("id is not null and code is not null"), "codes")
    in_code = Window.partitionBy("code").orderBy("id")
    members = rows.select("code", "id", F.row_number().over(in_code).alias("place")).where(F.col("place") <= k)
    index = stage(spark, members.groupBy("code").agg(F.min("id").alias("low"), F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")), "index")
    layout = Layout(index.count(), bucket, cell)
    m = len(layout.widths)

    keyed = index.select("code", "low", "n", F.explode(layout.cells(F.col("code"))).alias("cell"))
    # Cells with more codes than most may have are split; queries go to all parts of a cell, and to no empty one.
    parts = keyed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("parts"))
    split = keyed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("code"), F.col("parts")).alias("part"), "code", "low", "n")
    cells, parts = stage(spark, split, "cells"), stage(spark, parts, "parts")

    asked = rows.where("asks").select("id", "code")
    open_queries = stage(spark, asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), "queries")
    nearest = Window.partitionBy("q").orderBy("d", "low", "code")
    found: DataFrame | None = None
    for radius in range(max(layout.widths) + 1):
        sent = open_queries.select("q", "bound", F.explode(layout.asks(F.col("q"), radius)).alias("to")).select("q", "bound", "to.cell", "to.near")
        sent = sent.join(parts, "cell").select("cell", "q", "bound", "near", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
        # Cells that nobody asks stay where they are.
        asked_cells = cells.join(sent.select("cell", "part").distinct(), ["cell", "part"], "left_semi")
        got = asked_cells.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(_search(layout, k), "q long, code long, low long, n int, d int")
        if found is not None:
            got = got.union(found.join(open_queries, "q", "left_semi"))
        best = got.dropDuplicates(["q", "code"]).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place")
        best = stage(spark, best, f"best{radius}")
        # What earlier rounds finished stays as it is.
        found = best if found is None else stage(spark, found.join(open_queries, "q", "left_anti").union(best), f"found{radius}")
        reach = best.withColumn("upto", F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
        kth = reach.where(F.col("upto") >= k).groupBy("q").agg(F.min("d").alias("kth"))
        covered = m * (radius + 1) - 1
        now = open_queries.join(kth, "q", "left").select("q", F.coalesce("kth", F.lit(BITS)).alias("bound"), F.coalesce(F.col("kth") <= covered, F.lit(False)).alias("done"))
        open_queries = stage(spark, now.where("not done").drop("done"), f"open{radius}")
        if covered >= BITS or open_queries.isEmpty():
            break

    listed = found.join(index.select("code", "ids"), "code").select("q", "d", F.explode("ids").alias("neighbor_id"))
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "neighbor_id"))).where(F.col("rank") <= k)
    out = asked.join(ranked, asked.code == ranked.q)
    return out.select(F.col("id").alias("query_id"), F.col("rank").cast("long").alias("rank"), "neighbor_id", F.col("d").cast("long").alias("distance"))
