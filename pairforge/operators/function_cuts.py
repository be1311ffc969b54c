"""Functions of points: how they follow the points' positions, and cuts of each into equal parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.operators import pairs as P
from pairforge.session import ship, stage

#: Parts that a function is cut into; share of the mean absolute value under which a value counts as zero.
DIVISIONS, NEAR_ZERO = 10, 0.1


def statistics(positions: DataFrame, functions: DataFrame, dim: int, weights: DataFrame | None = None) -> DataFrame:
    """(name, n, weight, mean, sigma, correlation, direction) of functions (id, name, value) over positions (id, x).

    ``direction`` is the unit vector along which a linear function follows the values best, ``correlation`` the
    weighted correlation of the two; both are null where positions or values do not vary. ``weights`` is
    (id, w). Moments are summed by Spark; of each function one row of them is solved.
    """
    w = F.lit(1.0) if weights is None else F.col("w")
    both = functions.where(F.col("value").isNotNull()).join(positions.select("id", "x"), "id")
    both = both if weights is None else both.join(weights.select("id", "w"), "id")
    at = [F.get("x", k) for k in range(dim)]
    sums = [F.sum(w).alias("weight"), F.sum(w * F.col("value")).alias("g"), F.sum(w * F.col("value") * F.col("value")).alias("gg"), F.array(*(F.sum(w * a) for a in at)).alias("m")]
    sums += [F.array(*(F.sum(w * a * F.col("value")) for a in at)).alias("c"), F.array(*(F.sum(w * a * b) for a in at for b in at)).alias("v")]
    moments = both.groupBy("name").agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                total, mean = r["weight"], r["g"] / r["weight"]
                m, variance = np.array(r["m"]) / total, max(r["gg"] / total - mean * mean, 0.0)
                c, v = np.array(r["c"]) / total - mean * m, np.array(r["v"]).reshape(dim, dim) / total - np.outer(m, m)
                scale = np.sqrt(np.maximum(np.diag(v), 0))
                direction, correlation = None, None
                if variance > 0 and scale.all():
                    a = np.linalg.lstsq(v / np.outer(scale, scale), c / scale, rcond=None)[0] / scale
                    size = np.linalg.norm(a)
                    if size > 0:
                        a = a / size
                        direction, correlation = a.tolist(), float(a @ c / np.sqrt(variance * (a @ v @ a)))
                out.append({"name": r["name"], "n": r["n"], "weight": total, "mean": mean, "sigma": variance**0.5, "correlation": correlation, "direction": direction})
            yield pa.RecordBatch.from_pylist(out, schema=batch_schema)

    batch_schema = pa.schema([("name", pa.string()), ("n", pa.int64()), ("weight", pa.float64()), ("mean", pa.float64()), ("sigma", pa.float64()), ("correlation", pa.float64()), ("direction", pa.list_(pa.float64()))])
    ship(positions.sparkSession)
    return moments.mapInArrow(solve, "name string, n long, weight double, mean double, sigma double, correlation double, direction array<double>")


def placed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``place``: the number of each row among those of its ``by``, from 0, in ``order``.

    Rows are dealt to ranges of (by, order), so no task holds a whole group; sizes of ranges are summed.
    """
    dealt = stage(rows.sparkSession, rows.repartitionByRange(by, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(by, "range_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(by, "range_", F.coalesce(before, F.lit(0)).alias("begins_"))
    own = F.row_number().over(Window.partitionBy(by, "range_").orderBy(*order)) - 1
    return dealt.withColumn("own_", own).join(begins, [by, "range_"]).withColumn("place", F.col("begins_") + F.col("own_")).drop("range_", "own_", "begins_")


def divided(functions: DataFrame, parts: int = DIVISIONS) -> DataFrame:
    """(id, name, value, division, division_nz): each function cut into ``parts`` parts of equal size by value, the lower id first on ties.

    Divisions are numbered from 1, the first ones get one more where sizes differ. ``division_nz`` is 0 where
    the absolute value is below NEAR_ZERO of the function's mean one. Null values are in no division.
    """
    rows = functions.where(F.col("value").isNotNull()).select("id", "name", "value")
    sizes = rows.groupBy("name").agg(F.count("*").alias("n"), F.avg(F.abs("value")).alias("size"))
    at = placed(rows, "name", ["value", "id"]).join(sizes, "name")
    division = P.range_of(F.col("place"), F.col("n"), parts) + 1
    return at.select("id", "name", "value", division.alias("division"), F.when(F.abs("value") < NEAR_ZERO * F.col("size"), F.lit(0)).otherwise(division).cast("long").alias("division_nz"))


def division_statistics(cuts: DataFrame, positions: DataFrame, dim: int) -> DataFrame:
    """(name, division, n, low, high, mean, center): the values and the mean position of each division."""
    both = cuts.join(positions.select("id", "x"), "id")
    center = F.array(*(F.avg(F.get("x", k)) for k in range(dim)))
    return both.groupBy("name", "division").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), center.alias("center"))
