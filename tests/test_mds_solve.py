import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import mds, mds_solve


def edges_of(spark, x, skip=()):
    n = len(x)
    return spark.createDataFrame([(i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(n) for j in range(n) if i != j and i not in skip and j not in skip], "i long, j long, d double").coalesce(1)


def test_fixed_points_pull_and_stay(spark):
    rnd = np.random.default_rng(2)
    x = rnd.random((9, 2)) * 3
    edges = edges_of(spark, x)
    held = [0, 1, 2]
    lines = mds_solve.position_lines(spark.createDataFrame([(i, x[i].tolist()) for i in held], "id long, x array<double>"))
    given = mds_solve.positions_of(lines)
    got = mds_solve.solve(edges, mds.Fit(norm=3, dim=2, least=1e-4), given, spark.createDataFrame([(i,) for i in held], "id long"), starts=1, rounds=12, tolerance=1e-6)
    at = {r.id: np.array(r.x) for r in got.positions.collect()}
    assert all(at[i].tolist() == x[i].tolist() for i in held)
    history = got.histories[0]
    assert all(b < a for a, b in zip(history, history[1:])) and got.chi < 1e-2 * history[0] and got.reason in mds_solve.REASONS.values()
    # Three points fix the plane: the others are found where they were.
    assert max(np.linalg.norm(at[i] - x[i]) for i in range(9)) < 0.1
    slopes = mds.gradient(edges, got.positions, mds.Fit(norm=3, dim=2, least=1e-4, average=float(edges.agg(F.avg("d")).first()[0]))).where("id > 2")
    assert slopes.agg(F.max(F.array_max(F.transform("g", lambda v: F.abs(v))))).first()[0] < 0.2


def test_nothing_to_solve(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0]])
    edges, given = edges_of(spark, x), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    all_fixed = mds_solve.solve(edges, mds.Fit(dim=2), given, given.select("id"))
    assert all_fixed.reason == "no point varies" and len(all_fixed.histories) == 1
    with pytest.raises(ValueError, match="need positions"):
        mds_solve.solve(edges, mds.Fit(dim=2), None, given.select("id"))
    assert [tuple(r) for r in mds_solve.positions_of(spark.createDataFrame([("3, 1.5 2",), ("4",), ("",)], "value string")).collect()] == [(3, [1.5, 2.0])]
