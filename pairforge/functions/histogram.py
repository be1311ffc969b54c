"""Histogram ranges, bin sizes and bin numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded_bin_size(size: Column) -> Column:
    """A bin size rounded up to two digits; sizes of at most 1e-9 or above 1e10 stay."""
    power = F.pow(F.lit(10.0), F.lit(1) - F.floor(F.log10(size)))
    return F.when((size <= 1e-9) | (size > 1e10), size).otherwise(F.ceil(F.least(size * power, F.lit(100.0))) / power)


def pretty_range(low: Column, high: Column, bins: int) -> tuple[Column, Column]:
    """(start, bin size): the least value with its amount rounded up to two digits, and a rounded bin size from there.

    A positive start may lie above ``low``: values below it are in bin 0. With high <= low: (low, 0).
    """
    amount = rounded_bin_size(F.abs(low))
    start = F.when(high <= low, low).when(F.abs(low) < 1e-9, F.lit(0.0)).when(low < 0, -amount).otherwise(amount)
    return start, F.when(high <= low, F.lit(0.0)).otherwise(rounded_bin_size((high - start) / bins))


def bin_number(value: Column, low: Column, size: Column, bins: int) -> Column:
    """Bins 1 to ``bins``; 0 holds what is below, bins + 1 what is beyond."""
    return F.greatest(F.lit(0), F.least(F.lit(bins + 1), F.floor((value - low) / size) + 1)).cast("long")


def closed_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins 0 to bins - 1 of [low, high], the last one closed."""
    return F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")


def marginals(cells: DataFrame, within: str) -> DataFrame:
    """(part, axis, bin, n) of a matrix (cx, cy, within, n): its sums over either axis, whole and for the cells with ``within`` true (intra) or false (inter)."""
    part = F.explode(F.array(F.lit("whole"), F.when(F.col(within), "intra").otherwise("inter")))
    axes = F.array(F.struct(F.lit("x").alias("axis"), F.col("cx").alias("bin")), F.struct(F.lit("y").alias("axis"), F.col("cy").alias("bin")))
    return cells.select(part.alias("part"), axes.alias("axes"), "n").select("part", F.explode("axes").alias("e"), "n").groupBy("part", "e.axis", "e.bin").agg(F.sum("n").alias("n"))
