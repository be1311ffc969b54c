"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.session import shared_dir, ship, stage, table

__all__ = ["crc_fold", "documents", "map_arrow", "shared_dir", "ship", "slices", "stage", "table"]

#: Rows and bytes that a Python operator turns into Python objects at once; keeps memory flat on very long texts.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def slices(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
    """The batch as dicts of Python lists, SLICE_ROWS rows or about SLICE_BYTES bytes at a time."""
    rows = batch.num_rows
    each = max(1, batch.nbytes // max(rows, 1))
    step = max(1, min(SLICE_ROWS, SLICE_BYTES // each))
    for at in range(0, rows, step):
        yield batch.slice(at, step).to_pydict()


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Apply ``make()(columns) -> columns`` slice by slice, map-side; ``make`` runs once per task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(work(part), schema=out)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
