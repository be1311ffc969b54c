"""All-pairs enumeration over a grid of blocks.

Every pair of blocks is one key of an equi-join, so pairs are made by a shuffled hash or sort-merge join
over blocks x blocks keys: no nested-loop join, no broadcast, and each task holds two blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_of(index: Column, n: Column, k: int) -> Column:
    """Number of the range that ``index`` (0 to n-1) lies in when n items are split in k; the first n mod k get one more."""
    q, r = F.floor(n / k), n % k
    wide = r * (q + 1)
    return F.when(index < wide, F.floor(index / (q + 1))).otherwise(r + F.floor((index - wide) / F.greatest(q, F.lit(1)))).cast("long")


def ranges(n: int, k: int) -> list[tuple[int, int]]:
    """Inclusive (start, end) of each range; empty ones have end = start - 1."""
    q, r = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = q + (i < r)
        out.append((at, at + size - 1))
        at += size
    return out


def length_range_of(index: Column, longest: int, start: int = 0) -> Column:
    return F.floor((index - start) / longest).cast("long")


def chosen_block(row: Column, col: Column) -> Column:
    """Whether a block is computed: the diagonal, below it where row + col is even, above it where odd."""
    even = (row + col) % 2 == 0
    return (row == col) | ((row > col) & even) | ((row < col) & ~even)


def block_pairs(left: DataFrame, right: DataFrame, blocks: int, condition: Column | None = None) -> DataFrame:
    """Join two frames that each have ``block`` (0 to blocks-1), over the grid of block pairs that ``condition`` keeps.

    ``condition`` is over row_block and col_block.
    """
    grid = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    a = left.withColumnRenamed("block", "row_block").withColumn("col_block", F.explode(grid))
    b = right.withColumnRenamed("block", "col_block").withColumn("row_block", F.explode(grid))
    if condition is not None:
        a, b = a.where(condition), b.where(condition)
    return a.join(b, ["row_block", "col_block"])


#: Points of a block, and the least number of blocks.
BLOCK_POINTS, LEAST_BLOCKS = 1000, 4


def half_pairs(points: DataFrame, payload: list[str], id_col: str = "id", blocks: int | None = None) -> DataFrame:
    """Each unordered pair of distinct ids once: (row_block, col_block, i, j, payload_i, payload_j).

    There are as many blocks as keep each at about BLOCK_POINTS points, whatever their number.
    """
    if blocks is None:
        blocks = max(LEAST_BLOCKS, -(-points.count() // BLOCK_POINTS))
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block")
    a = points.select(block, F.col(id_col).alias("i"), *(F.col(p).alias(f"{p}_i") for p in payload))
    b = points.select(block, F.col(id_col).alias("j"), *(F.col(p).alias(f"{p}_j") for p in payload))
    keep = chosen_block(F.col("row_block"), F.col("col_block"))
    pairs = block_pairs(a, b, blocks, keep)
    return pairs.where((F.col("row_block") != F.col("col_block")) | (F.col("i") > F.col("j")))


def mirrored(edges: DataFrame) -> DataFrame:
    """Half a symmetric matrix (i, j, d) with its transpose; each row is made once and gives both."""
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return edges.select("d", F.explode(both).alias("e")).select("e.i", "e.j", "d")


def remaining_blocks(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """Blocks that a restart still has to compute."""
    return blocks.join(done, ["row_block", "col_block"], "left_anti")


def matrix_rows(edges: DataFrame) -> DataFrame:
    """(i, row): the distances of each row in order of j."""
    sorted_pairs = F.sort_array(F.collect_list(F.struct("j", "d")))
    return edges.groupBy("i").agg(F.transform(sorted_pairs, lambda e: e["d"]).alias("row"))


def intersection(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> tuple[Column, Column, Column]:
    """(overlaps, start, end) of two inclusive ranges."""
    start, end = F.greatest(start_a, start_b), F.least(end_a, end_b)
    return start <= end, start, end


def membership_sums(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(i, k, b): for every point and cluster the sum over j of d(i, j) times the membership of j in k."""
    return edges.join(members.withColumnRenamed("id", "j"), "j").groupBy("i", "k").agg(F.sum(F.col("d") * F.col("m")).alias("b"))
