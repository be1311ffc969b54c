import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import block_runs as B
from pairforge.operators import function_cuts as C


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, [float(i * i % 17), float(i)], f"p{i}") for i in range(23)], "id long, x array<double>, label string").repartition(3)


def gap(pairs):
    return pairs.select("row_block", "col_block", "i", "j", F.abs(F.get("x_i", 0) - F.get("x_j", 0)).alias("d"))


def test_a_run_goes_on_after_a_lost_job(spark, points, tmp_path):
    path, asked = str(tmp_path / "run"), []

    def counted(pairs):
        got = gap(pairs)
        asked.append({tuple(r) for r in got.select("row_block", "col_block").distinct().collect()})
        return got

    def lost(pairs):
        gap(pairs).limit(3).write.parquet(f"{path}/results/job=lost")  # what a dead job may leave
        raise RuntimeError("lost")

    assert B.run(points, ["x"], counted, path, 4, name="label", at_once=3, jobs=1) == 7
    with pytest.raises(RuntimeError):
        B.run(points, ["x"], lost, path, 4, name="label", at_once=3)
    assert B.run(points, ["x"], counted, path, 4, name="label", at_once=4, project="demo") == 0
    assert B.run(points, ["x"], counted, path, 4, name="label") == 0 and len(asked) == 3
    assert sum(map(len, asked)) == len(set().union(*asked)) == 10
    got = {(r.i, r.j): r.d for r in B.results(spark, path).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in range(23) for b in range(a + 1, 23)} and len(got) == 253
    assert all(d == abs(i * i % 17 - j * j % 17) for (i, j), d in got.items())
    kept = B.manifest(spark, path).collect()
    assert sum(r.pairs for r in kept) == 253 and len(kept) == 10 and {r.project for r in kept} == {"", "demo"}
    first = next(r for r in kept if (r.row_block, r.col_block) == (0, 0))
    assert (first.row_first, first.row_last, first.row_first_name, first.col_last_name) == (0, 5, "p0", "p5")
    assert B.whole(spark, path).count() == 506
    with pytest.raises(ValueError, match="another grid"):
        B.run(points, ["x"], gap, path, 2)


def test_function_statistics_against_numpy(spark):
    rnd = np.random.default_rng(4)
    x, w = rnd.normal(size=(80, 3)) * [1, 4, 0.2], rnd.random(80) + 0.1
    g = {"linear": x @ [1.0, -2.0, 3.0] + 5, "noise": rnd.normal(size=80), "constant": np.full(80, 2.0)}
    pos = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    fun = spark.createDataFrame([(i, n, float(v[i])) for n, v in g.items() for i in range(80)] + [(3, "linear", None)], "id long, name string, value double")
    wts = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "id long, w double")
    got = {r.name: r for r in C.statistics(pos, fun, 3, wts).collect()}
    assert got["linear"].correlation == pytest.approx(1) and np.allclose(got["linear"].direction, np.array([1, -2, 3]) / 14**0.5)
    assert got["constant"].correlation is None and got["constant"].direction is None and got["constant"].mean == pytest.approx(2)
    design = np.c_[np.ones(80), x] * np.sqrt(w)[:, None]
    a = np.linalg.lstsq(design, g["noise"] * np.sqrt(w), rcond=None)[0][1:]
    assert np.allclose(got["noise"].direction, a / np.linalg.norm(a))
    fit = x @ a
    c = lambda u, v: (w * (u - (w * u).sum() / w.sum()) * (v - (w * v).sum() / w.sum())).sum()
    assert got["noise"].correlation == pytest.approx(c(fit, g["noise"]) / (c(fit, fit) * c(g["noise"], g["noise"])) ** 0.5)


def test_divisions(spark):
    rows = [(i, "a", float(i % 4)) for i in range(23)] + [(i, "b", -float(i)) for i in range(9)] + [(50, "b", None)]
    df = spark.createDataFrame(rows, "id long, name string, value double").repartition(5)
    got = C.divided(df, 10).collect()
    for name in "ab":
        own = sorted((r.value, r.id) for r in got if r.name == name)
        n = len(own)
        want = {i: next(p for p in range(10) if k < sum(n // 10 + (q < n % 10) for q in range(p + 1))) + 1 for k, (_, i) in enumerate(own)}
        assert {r.id: r.division for r in got if r.name == name} == want
    assert {r.division_nz == 0 for r in got if r.value == 0} == {True}
    means = {(r.name, r.division): r for r in C.division_statistics(C.divided(df, 10), df.where("name = 'a'").select("id", F.array("value").alias("x")).distinct(), 1).collect()}
    assert means["a", 1].low == 0 and sum(r.n for (n, _), r in means.items() if n == "a") == 23
    assert C.divided(df.limit(0)).count() == 0
