"""All-pairs runs that can be taken up again: blocks of pairs are computed some at a time and kept with what they cover.

A folder holds results, one sub-folder a job, and a manifest of finished blocks with their metadata. A block is
finished when the manifest says so, which is written after its job's results; what a lost job left behind
is in no manifest and is never read. A run that starts again computes the blocks that are missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import pairs as P

#: Blocks that a job computes at once.
AT_ONCE = 64
_MANIFEST = "job string, project string, row_block long, col_block long, row_first long, row_last long, row_first_name string, row_last_name string, col_first long, col_last long, col_first_name string, col_last_name string, pairs long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each finished block: its job, and index and name of the first and last row and column."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest") if _exists(spark, f"{path}/manifest") else spark.createDataFrame([], _MANIFEST)


def results(spark: SparkSession, path: str) -> DataFrame:
    """The values of all finished blocks."""
    done = manifest(spark, path).select("job", "row_block", "col_block")
    kept = spark.read.option("basePath", f"{path}/results").parquet(f"{path}/results")
    # As many rows as blocks.
    return kept.join(done, ["job", "row_block", "col_block"], "left_semi")


def blocked(points: DataFrame, blocks: int, id_col: str = "id") -> DataFrame:
    """Adds ``block``: ``blocks`` ranges of consecutive ids of equal width."""
    span = points.agg(F.min(id_col).alias("low_"), F.max(id_col).alias("high_"))
    place = F.floor((F.col(id_col) - F.col("low_")) * blocks / (F.col("high_") - F.col("low_") + 1))
    return points.join(F.broadcast(span)).withColumn("block", place.cast("long")).drop("low_", "high_")


def run(
    points: DataFrame, payload: list[str], compute: Callable[[DataFrame], DataFrame], path: str, blocks: int, name: str = "id", id_col: str = "id",
    at_once: int = AT_ONCE, jobs: int | None = None, project: str = "",
) -> int:
    """Compute the blocks that ``path`` lacks, ``at_once`` a job, ``jobs`` jobs at most; returns how many are still missing.

    ``compute`` gets the pairs (row_block, col_block, i, j, payload_i, payload_j), each unordered pair once, and
    returns columns with row_block and col_block among them. The folder belongs to one table and number of
    blocks: with another number it is an error.
    """
    spark = points.sparkSession
    dealt = blocked(points, blocks, id_col)
    numbers = [(r, c) for r in range(blocks) for c in range(blocks) if r == c or (r > c) == ((r + c) % 2 == 0)]
    done = {(x["row_block"], x["col_block"]) for x in manifest(spark, path).select("row_block", "col_block").collect()}
    if done - set(numbers):
        raise ValueError(f"{path} holds blocks of another grid")
    left = [b for b in numbers if b not in done]
    ends = dealt.groupBy("block").agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"), F.min_by(F.col(name).cast("string"), id_col).alias("first_name"), F.max_by(F.col(name).cast("string"), id_col).alias("last_name"), F.count("*").alias("n"))
    while left and (jobs is None or jobs > 0):
        now, job = left[:at_once], uuid.uuid4().hex
        asked = spark.createDataFrame(now, "row_block long, col_block long")
        # ``at_once`` rows of two numbers.
        of = lambda side, other: dealt.select(F.col("block").alias(side), F.col(id_col).alias("i" if side == "row_block" else "j"), *(F.col(p).alias(f"{p}_{'i' if side == 'row_block' else 'j'}") for p in payload)).join(F.broadcast(asked), side)
        pairs = of("row_block", "col_block").join(of("col_block", "row_block"), ["row_block", "col_block"])
        pairs = pairs.where((F.col("row_block") != F.col("col_block")) | (F.col("i") > F.col("j")))
        compute(pairs).write.mode("errorifexists").parquet(f"{path}/results/job={job}")
        row, col = (ends.select(F.col("block").alias(f"{s}_block"), *(F.col(c).alias(f"{s}_{c}") for c in ("first", "last", "first_name", "last_name", "n"))) for s in ("row", "col"))
        n = F.when(F.col("row_block") == F.col("col_block"), F.col("row_n") * (F.col("row_n") - 1) / 2).otherwise(F.col("row_n") * F.col("col_n"))
        rows = asked.join(row, "row_block", "left").join(col, "col_block", "left").select(F.lit(job).alias("job"), F.lit(project).alias("project"), *_columns(), F.coalesce(n, F.lit(0)).cast("long").alias("pairs"))
        rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        left = left[len(now) :]
        jobs = None if jobs is None else jobs - 1
    return len(left)


def _columns() -> list[str]:
    return [x.split()[0] for x in _MANIFEST.split(", ")][2:-1]


def whole(spark: SparkSession, path: str) -> DataFrame:
    """Both halves of the matrix (i, j, d) of a finished run."""
    return P.mirrored(results(spark, path).select("i", "j", "d"))
