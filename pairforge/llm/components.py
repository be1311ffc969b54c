"""Connected components of a link table that may be as large as the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.session import discard

from .common import stage


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a long, b long): root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder, so a lost
    executor costs one round, and nothing but two counters reaches the driver. Self links and nulls are
    ignored; an empty table gives no rows.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(spark, edges, "links")
    seen = _mark(edges)
    for _ in range(max_rounds):
        before, edges = edges, stage(spark, _small_star(_large_star(edges)), "links")
        discard(before)
        if (now := _mark(edges)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own)


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the smallest node around u; links may come twice."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(others).distinct()
