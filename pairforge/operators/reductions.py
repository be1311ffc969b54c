"""Global reductions; all are partial and final hash aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ELEMENTWISE = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}


def elementwise(df: DataFrame, vector: str, how: str, by: tuple[str, ...] = (), dim: int | None = None) -> DataFrame:
    """(by ..., pos, value): ``how`` over each position of the vectors, over all rows or per group.

    With a known ``dim`` one aggregate for each position, so that a row stays a row; else the positions are rows.
    """
    if dim:
        wide = df.groupBy(*by).agg(*(ELEMENTWISE[how](F.get(vector, i)).alias(f"p{i}") for i in range(dim)))
        return wide.select(*by, F.posexplode(F.array(*(f"p{i}" for i in range(dim)))).alias("pos", "value"))
    return df.select(*by, F.posexplode(vector).alias("pos", "value")).groupBy(*by, "pos").agg(ELEMENTWISE[how]("value").alias("value"))


def histogram(df: DataFrame, bin_col: str) -> DataFrame:
    return df.groupBy(bin_col).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x_bin: str, y_bin: str) -> DataFrame:
    return df.groupBy(x_bin, y_bin).agg(F.count("*").alias("n"))


def mean_sigma(df: DataFrame, value: str) -> DataFrame:
    """Mean and population sigma, the variance not below zero."""
    return df.agg(F.avg(value).alias("mean"), F.sqrt(F.greatest(F.var_pop(value), F.lit(0.0))).alias("sigma"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_pop(x).alias("sigma_x"), F.stddev_pop(y).alias("sigma_y"), F.corr(x, y).alias("corr"))


def extreme_with_index(df: DataFrame, value: str, index: str, largest: bool = False) -> DataFrame:
    """(value, index) of the extreme; the lowest index wins ties."""
    v = -F.col(value) if largest else F.col(value)
    return df.agg(F.min(F.struct(v.alias("v"), F.col(index).alias("i"))).alias("e")).select((-F.col("e.v") if largest else F.col("e.v")).alias("value"), F.col("e.i").alias("index"))


def smallest(df: DataFrame, value: str, index: str, k: int) -> DataFrame:
    """The k smallest values in order with their indices: (rank, value, index), rank from 1."""
    top = df.select(F.col(value).alias("value"), F.col(index).alias("index")).orderBy("value", "index").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("value", "index")).cast("long"))


def smallest_with_remainder(df: DataFrame, value: str, index: str, k: int) -> DataFrame:
    """The k smallest and the least value left out, marked ``kept`` false."""
    return smallest(df, value, index, k + 1).withColumn("kept", F.col("rank") <= k)
