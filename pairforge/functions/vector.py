"""Column functions on vectors stored as array<double>. All of them stay on the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def squared_distance(x: Column, y: Column, dim: int | None = None) -> Column:
    """Sum of squared differences; with a known ``dim`` one expression that code generation can unroll."""
    if dim:
        return reduce(add, ((F.get(x, i) - F.get(y, i)) * (F.get(x, i) - F.get(y, i)) for i in range(dim)))
    return _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def distance(x: Column, y: Column, dim: int | None = None) -> Column:
    return F.sqrt(squared_distance(x, y, dim))


def scaled_squared_distance(x: Column, y: Column, sigma: Column) -> Column:
    """Squared differences, each divided by its dimension's variance ``sigma``."""
    diff = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return _sum(F.zip_with(diff, sigma, lambda d, s: d / s))


def scaled_distance(x: Column, y: Column, sigma: Column) -> Column:
    return F.sqrt(scaled_squared_distance(x, y, sigma))


def position_sigma(x: Column, base: list[float], method: int) -> Column:
    """Variances per dimension: all one (0), ``base`` (1), or ``base`` with the first relative to x[0] (2, 3)."""
    if method == 0:
        return F.transform(x, lambda v: F.lit(1.0))
    fixed = F.array(*map(F.lit, base))
    if method == 1:
        return fixed
    return F.transform(fixed, lambda s, i: F.when(i == 0, (s * x[0]) * (s * x[0])).otherwise(s))


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def linear_combination(a: float, x: Column, b: float, y: Column) -> Column:
    return F.zip_with(x, y, lambda u, v: F.lit(a) * u + F.lit(b) * v)


def stored_distance(raw: Column, full_scale: int = 32767, squared: bool = False) -> Column:
    """A quantised distance as a number; negative or full-scale values are undefined (null)."""
    d = F.when((raw >= 0) & (raw < full_scale), raw / F.lit(float(full_scale)))
    return d * d if squared else d


def quantised(d: Column, full_scale: int = 32767) -> Column:
    """A distance as a 16-bit number, clipped to its range."""
    return F.floor(F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)) * full_scale).cast("smallint")


def matrix_blocks(cells: DataFrame, rows: int, cols: int, transposed: bool = False) -> DataFrame:
    """(row_block, col_block, i, j, v): the cells (i, j, v) of a matrix with the numbers of their blocks, transposed on demand."""
    i, j = (F.col("j"), F.col("i")) if transposed else (F.col("i"), F.col("j"))
    height, width = (cols, rows) if transposed else (rows, cols)
    return cells.select(F.floor(i / height).alias("row_block"), F.floor(j / width).alias("col_block"), i.cast("long").alias("i"), j.cast("long").alias("j"), "v")
