import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import annealing_control as N
from pairforge.operators import kmeans as K
from pairforge.operators import mds as X
from pairforge.operators import mds_control as M
from pairforge.operators import triangle as B
from pairforge.sources import fasta, matrix, points


def scattered(spark, n=300, k=6, seed=0):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(0, 5, (k, 4))
    rows = [(i, (middles[i % k] + rnd.normal(0, 1, 4)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>")


def test_bounds_change_nothing_but_the_work(spark):
    pts = scattered(spark)
    first = pts.where("id < 6").select(F.col("id").alias("k"), F.col("x").alias("y"))
    plain, _, steps = K.fit(pts, first, extra=2)
    bounded, _, same = B.fit(pts, first, extra=2)
    assert steps == same
    want = {r.id: (r.k, pytest.approx(r.d)) for r in plain.collect()}
    got = bounded.collect()
    assert {r.id: (r.k, r.d) for r in got} == want
    assert sum(r.computed for r in got) < 0.7 * 300 * 6 * (steps + 1)
    with pytest.raises(ValueError):
        B.fit(pts, spark.range(3000).select(F.col("id").alias("k"), F.array(F.lit(0.0)).alias("y")))


def test_assignment_keeps_repeated_ids_at_any_number_of_centers(spark):
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [9.0, 9.0]), (None, [4.0, 4.0])], "id long, x array<double>")
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [5.0, 5.0]), (3, [5.0, 5.0])], "k long, y array<double>")
    for most in (1000, 4, 2):
        got = sorted(((r.id or 0, r.x, r.k) for r in K.assign(pts, centers, most_values=most).collect()))
        assert got == [(0, [4.0, 4.0], 2), (1, [0.0, 0.0], 0), (1, [5.0, 5.0], 2), (2, [9.0, 9.0], 1)]


def test_convergence_verdicts():
    assert N.convergence(0.5, 0.1, 3, 10).code == 0
    assert N.convergence(0.5, 0.1, 11, 10).code == 1
    assert N.convergence(0.05, 0.1, 3, 10).code == 1
    assert N.convergence(0.05, 0.1, 3, 10, clusters=4, most_clusters=4).reason == "as many clusters as may be"
    assert N.convergence(0.05, 0.1, 3, 10, final=True, moved2=1.0, width=1.0, moved_share=0.1).code == 0
    assert N.convergence(0.05, 0.1, 3, 10, final=True).code == 2


def test_golden_section_and_starts(spark):
    x, value, n = M.golden_section(lambda t: (t - 1.3) ** 2 + 2, 0.0, 4.0, 40, 1e-6)
    assert x == pytest.approx(1.3, abs=1e-3) and value == pytest.approx(2) and n <= 40
    rnd = np.random.default_rng(1)
    p = rnd.random((12, 2))
    edges = spark.createDataFrame([(i, j, float(np.hypot(*(p[i] - p[j])))) for i in range(12) for j in range(12) if i != j], "i long, j long, d double")
    got = M.best_of(edges, X.Fit(dim=2), starts=2, rounds=2, steps=2)
    assert len(got.histories) == 2 and got.chi == min(h[-1] for h in got.histories)
    assert all(a >= b for h in got.histories for a, b in zip(h, h[1:]))
    assert M.REASONS[got.reason]


def test_eigenvalue_bounds(spark):
    rnd = np.random.default_rng(3)
    p = rnd.random((8, 2))
    edges = spark.createDataFrame([(i, j, 0.5) for i in range(8) for j in range(8) if i != j], "i long, j long, d double")
    state = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, x array<double>")
    fit = X.Fit(dim=2)
    h = np.zeros((16, 16))
    for i in range(8):
        for j in range(8):
            if i != j:
                d = p[i] - p[j]
                block = 2 * np.outer(d, d) / (d @ d + fit.least**2)
                h[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] += block
                h[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] -= block
    value, steps = M.power_iterate(edges, state, fit, change=1e-2)
    assert steps > 0 and value == pytest.approx(np.linalg.eigvalsh(h)[-1], rel=5e-2)
    bound = M.trace_and_norm(edges, state, fit).first()
    assert (bound["trace"], bound["norm"]) == pytest.approx((np.trace(h), np.abs(h).sum(axis=1).max()))


def test_text_rows_keep_the_order_of_files(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(i, [float(i)] * (1 + i * 7 % 50)) for i in range(200)], "i long, row array<double>")
    matrix.write_text(rows.repartition(5), path)
    assert all(r.row[0] == r.i for r in matrix.read_text(spark, path).collect())
    fasta.write_fasta(spark.createDataFrame([(f"s{i}", "ACGT" * (1 + i % 9)) for i in range(50)], "label string, residues string").repartition(4), str(tmp_path / "f"))
    assert sorted(r.label for r in fasta.read_fasta(spark, str(tmp_path / "f")).collect()) == sorted(f"s{i}" for i in range(50))


def test_styles_and_old_files(spark):
    df = spark.createDataFrame([(0, 1.5, -2.0, 0.25, 4)], "index long, x double, y double, z double, cluster int")
    assert points.style_lines(df, "cluster").first()[0].split("\t") == ["0", "1.5000E+00", "-2.0000E+00", "2.5000E-01", "4"]
    assert points.style_lines(df, "group").first()[0].endswith("\t1")
    for wrong in ("family1", "color"):
        with pytest.raises(ValueError):
            points.style_lines(df, wrong)
    got = points.old_clusters(spark.createDataFrame([(" 3  1.0\t2.0 3.0 7.0",), ("x",), ("1 2 3",)], "value string"), 3).collect()
    assert [tuple(r) for r in got] == [(3, "3\t1.0\t2.0\t3.0", 7)]
    lines = points.center_lines(spark.createDataFrame([(5, 0.5, "MDS", 2)], "point long, measure double, method string, grp int"))
    assert points.centers(lines).first().asDict() == {"point": 5, "measure": 0.5, "method": "MDS", "grp": 2}
    assert math.isclose(matrix.density_lines(spark.createDataFrame([(0, 1, 3)], "cx long, cy long, n long"), (0.0, 1.0), (0.5, 2.0)).first()[0].count("\t"), 2)
