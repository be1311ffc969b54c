"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are split, whatever the table's size.
HOT_KEYS = 10_000


def split_join(big: DataFrame, small: DataFrame, keys: list[str], each: str, hot: int = 100_000) -> DataFrame:
    """Inner join on ``keys``; a key with more than ``hot`` rows of ``big`` is dealt by ``each`` to parts, and its rows of ``small`` are repeated for them.

    The keys to split are broadcast: they are fewer than HOT_KEYS, as the limit rises with the table.
    """
    sizes = big.groupBy(*keys).agg(F.count("*").alias("n_"))
    limit = sizes.agg(F.greatest(F.lit(hot), F.ceil(F.sum("n_") / HOT_KEYS)).alias("limit_"))
    many = F.broadcast(sizes.join(F.broadcast(limit)).where("n_ > limit_").select(*keys, F.ceil(F.col("n_") / F.col("limit_")).alias("parts_")))
    parts = F.coalesce(F.col("parts_"), F.lit(1))
    left = big.join(many, keys, "left").withColumn("part_", F.pmod(F.xxhash64(each), parts)).drop("parts_")
    right = small.join(many, keys, "left").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts_")
    return left.join(right, [*keys, "part_"]).drop("part_")
