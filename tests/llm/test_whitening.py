import math

import numpy as np
import pytest

from pairforge.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, components=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return x, n, sums, values, ((x - sums / n) @ axes[:, :components]) / np.sqrt(values[:components])


def compared(df, vectors, ids, components=4):
    got = df.toPandas()
    x, n, sums, values, white = brute(vectors, components)
    assert set(got.n) == {n} and len(got) == len(ids) * components and got.identity_error.max() < 1e-9
    for c in range(components):
        own = got[got.component == c + 1].set_index("vec_id").loc[ids]
        sign = np.sign((own.whitened.to_numpy() * white[:, c]).sum())
        np.testing.assert_allclose(own.whitened * sign, white[:, c], atol=1e-8)
        np.testing.assert_allclose(own.explained, values[c] / values.sum(), rtol=1e-10)
        assert own.deviation.tolist() == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whitening_equals_numpy(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    table = df.toPandas()
    compared(whitening.whiten(df.repartition(40)), np.stack(table.embedding).tolist(), table.vec_id.tolist())


def test_odd_rows(spark):
    rnd = np.random.default_rng(3)
    good = [[float(np.float32(v)) for v in row] for row in rnd.normal(size=(60, 5)) * [5, 1, 1e-2, 3, 2] + [1e4, 0, 0, -7, 0]]
    good += good[:20] + [[-0.0, 0.0, 0.0, 0.0, 0.0]] * 30
    rows = [(i, v) for i, v in enumerate(good)]
    bad = [(None, None), (900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [math.nan] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    for name in ("id", "x", "dim", "n", "component"):
        df = df.withColumn(name, df.vec_id)
    compared(whitening.whiten(df.repartition(7)), good, list(range(len(good))))
    twice = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [0.0, 4.0]), (5, [0.0, 4.0])], SCHEMA)
    got = whitening.whiten(twice).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and {abs(round(r.whitened, 9)) for r in got} == {1.0}
    assert sorted(str(r.vec_id) for r in got) == ["5", "5", "None", "None"]


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(1, [3e6, 0.0]), (2, [0.0, 0.0]), (3, [-3e6, 0.0]), (4, [3e6, 5.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).where("component = 1").collect()}
    x = [[int(256 * v) for v in vector] for _, vector in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(rows, x)}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}


@pytest.mark.parametrize("dim", [1, 2, 5, 64])
def test_rotations_give_the_decomposition(dim):
    rnd = np.random.default_rng(dim)
    a = rnd.normal(size=(200, dim)) * 10.0 ** -rnd.uniform(0, 9, dim)
    values, axes = whitening.one_sided_jacobi(whitening.triangle(iter([a[:90], a[90:]]), dim))
    np.testing.assert_allclose(values, np.linalg.svd(a, compute_uv=False), rtol=1e-6)
    np.testing.assert_allclose(axes.T @ axes, np.eye(dim), atol=1e-13)
    np.testing.assert_allclose(np.linalg.norm(a @ axes, axis=0), values, rtol=1e-9)
    met = {(int(p), int(q)) for a, b in whitening.rounds(dim) for p, q in zip(a, b)}
    assert met == {(p, q) for q in range(dim) for p in range(q)}
