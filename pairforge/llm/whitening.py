"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Vectors become integers, so that counts, sums and deviations are exact. Each distinct integer vector is one
row of the fit. Tasks centre their rows by the exact means and compress them block by block to an upper
triangle R (TSQR); triangles are stacked FAN at a time and compressed again until one is left. Plane
rotations then make the columns of that R orthogonal, all disjoint pairs of a round at once: the lengths of
the columns are the singular values, the accumulated rotations the components. No covariance is formed, so
small standard deviations keep their accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stage

#: Rows of a block of the QR decomposition; triangles that are stacked at once; sweeps of rotations at most.
BLOCK_ROWS, FAN, SWEEPS = 2048, 16, 60
#: A component whose singular value is under this share of the largest is rounding, and is left out.
RANK = 1e-12


def integers(values: pa.ListArray, scale: int) -> tuple[np.ndarray, list[bytes]]:
    """Which rows have a whole finite vector, and of these floor(scale * c) as packed integers.

    Packed is little-endian, in the smallest of 2, 4 and 8 bytes that holds the row, so that equal vectors
    are equal bytes. Entries beyond 64-bit integers are an error.
    """
    starts = values.offsets.to_numpy()
    flat = values.values.cast(pa.float64())
    # Nulls turn to NaN here; rows that hold any non-finite number fall out together.
    entries = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    whole = np.asarray(values.is_valid()) & (bad[starts[1:]] == bad[starts[:-1]])
    packed = []
    for k in np.flatnonzero(whole):
        x = np.floor(scale * entries[starts[k] : starts[k + 1]])
        top = np.abs(x).max(initial=0.0)
        if top >= 2.0**62:
            raise ValueError("an entry is too large for 64-bit integers")
        packed.append(x.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8").tobytes())
    return whole, packed


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """The integer vectors as rows; another length than ``dim`` is an error."""
    out = np.empty((len(packed), dim), np.int64)
    for i, raw in enumerate(packed):
        out[i] = np.frombuffer(raw, f"<i{len(raw) // dim}")
    return out


def triangle(blocks: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """R of all rows of the blocks, each compressed together with the R before it."""
    r = np.zeros((0, dim))
    for block in blocks:
        for at in range(0, len(block), BLOCK_ROWS):
            r = np.linalg.qr(np.vstack([r, block[at : at + BLOCK_ROWS]]), mode="r")
    return r


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns as rounds of disjoint pairs (a round-robin tournament)."""
    ring, found = [*range(n), *([-1] if n % 2 else [])], []
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], ring[half:][::-1]) if a >= 0 <= b]
        found.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return found


def one_sided_jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of ``r``."""
    u, dim = np.array(r, float), r.shape[1]
    v = np.eye(dim)
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds(dim):
            alpha, beta = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0)
            gamma = (u[:, p] * u[:, q]).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            off = np.abs(gamma) > 1e-15 * size
            worst = max(worst, float((np.abs(gamma[off]) / size[off]).max(initial=0.0)))
            p, q, alpha, beta, gamma = p[off], q[off], alpha[off], beta[off], gamma[off]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (u, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if worst < 1e-15:
            break
    values = np.sqrt((u**2).sum(0))
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): rows with a whole finite vector, as packed integers."""
    kind = df.schema[id_col].dataType.simpleString()
    out = _arrow(f"id {kind}, x binary, dim int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            whole, packed = integers(vectors, scale)
            lengths = np.diff(vectors.offsets.to_numpy())[whole].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(whole)).cast(out[0].type), pa.array(packed, pa.binary()), pa.array(lengths)], schema=out)

    ship(df.sparkSession)
    return df.select(df[id_col].alias("id"), df[vector_col].alias("v")).mapInArrow(run, f"id {kind}, x binary, dim int")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """One row per row of ``df`` and component: (id, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null or holds null or non-finite entries are dropped. The fit takes each distinct
    integer vector ``floor(scale * c)`` once, whatever the number of rows that hold it: n vectors with exact
    sums S. ``deviation`` is the exact sum of ``(n * x - S) ** 2``; null where it needs more than 64 bits. Components
    are numbered from 1 by falling variance; those of equal variance are any orthogonal ones of their space;
    those without variance are left out, so one distinct vector, and an empty table, give no rows. Null and
    repeated ids and repeated rows each keep their rows; other columns are not read. Vectors of different
    lengths are an error. What reaches the driver is one triangle of dim x dim numbers and rows of dim sums.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = stage(spark, integer_vectors(df, id_col, vector_col, scale), "integers")
    fit = stage(spark, rows.groupBy("x").agg(F.max("dim").alias("dim")), "distinct")
    n, low, high = fit.agg(F.count(F.lit(1)), F.min("dim"), F.max("dim")).first()
    if n and low != high:
        raise ValueError(f"vectors of {low} and of {high} entries")
    dim, output = high or 0, f"id {kind}, component int, n long, deviation long, whitened double, explained double"
    if n < 2 or not dim:
        empty = spark.createDataFrame([], f"{output}, identity_error double")
        return empty.withColumnRenamed("id", id_col)

    part_sums = _arrow("place int, total decimal(38,0)")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total = np.zeros(dim, object)
        for batch in batches:
            x = unpack(batch.column("x").to_pylist(), dim)
            total += x.sum(0) if len(x) * float(np.abs(x).max(initial=0)) < 2.0**62 else x.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], schema=part_sums)

    totals = fit.select("x").mapInArrow(add, "place int, total decimal(38,0)").groupBy("place").agg(F.sum(F.col("total")).cast("decimal(38,0)").alias("total"))
    sums = [int(r["total"]) for r in totals.orderBy("place").collect()]
    # Whole and fractional parts of the means apart, so that large means cost no digits.
    base = np.array([s // n for s in sums], np.int64)
    share = np.array([(s % n) / n for s in sums])

    def centred(packed: list[bytes]) -> np.ndarray:
        return (unpack(packed, dim) - base) - share

    triangles = _arrow("part long, r binary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = triangle((centred(b.column("x").to_pylist()) for b in batches), dim)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], schema=triangles)

    def stack(table: pa.Table) -> pa.Table:
        held = sorted(zip(table["part"].to_pylist(), table["r"].to_pylist()))
        r = triangle((np.frombuffer(raw).reshape(-1, dim) for _, raw in held), dim)
        return pa.table([pa.array([held[0][0] // FAN]), pa.array([r.tobytes()], pa.binary())], schema=triangles)

    level = stage(spark, fit.select("x").mapInArrow(compress, "part long, r binary"), "triangles")
    while level.count() > 1:
        level = stage(spark, level.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(stack, "part long, r binary"), "triangles")
    values, axes = one_sided_jacobi(np.frombuffer(level.first()["r"]).reshape(-1, dim))
    keep = min(components, int((values > RANK * values[0]).sum()) if values[0] else 0)
    total, axes, deviations = float((values**2).sum()), axes[:, :keep], values[:keep] / np.sqrt(n)

    def project(packed: list[bytes]) -> np.ndarray:
        return centred(packed) @ axes / deviations

    moments = _arrow("place int, total double")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(keep), np.zeros((keep, keep))
        for batch in batches:
            z = project(batch.column("x").to_pylist())
            first += z.sum(0)
            second += z.T @ z
        both = [*first, *second.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array(both, pa.float64())], schema=moments)

    error = 0.0
    if keep:
        got = fit.select("x").mapInArrow(measure, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
        flat = np.array([r["total"] for r in got]) / n
        # The rows are centred before they are multiplied; what the centring left is taken out as well.
        error = float(np.abs(flat[keep:].reshape(keep, keep) - np.outer(flat[:keep], flat[:keep]) - np.eye(keep)).max())
    out, wrapped = _arrow(output), np.array([s % 2**64 for s in sums], np.uint64).view(np.int64)
    explained = values[:keep] ** 2 / total if keep else values[:0]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("x").to_pylist()
            x, z = unpack(packed, dim), project(packed)
            # 64-bit arithmetic wraps, so what fits in the end is exact; the estimate tells what does not fit.
            gaps = n * x - wrapped
            squares, estimate = (gaps * gaps).sum(1), n * n * (((x - base) - share) ** 2).sum(1)
            for k in np.flatnonzero(np.abs(estimate - 2.0**63) < 2.0**44):
                whole = sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums))
                estimate[k] = 0 if whole < 2**63 else 2.0**64
            deviation = pa.array(squares, mask=estimate >= 2.0**63)
            at = np.repeat(np.arange(len(x)), keep)
            columns = [
                batch.column("id").take(pa.array(at)),
                pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n, np.int64)),
                deviation.take(pa.array(at)),
                pa.array(z.ravel()),
                pa.array(np.tile(explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.select("id", "x").mapInArrow(apply, output).withColumn("identity_error", F.lit(error)).withColumnRenamed("id", id_col)
