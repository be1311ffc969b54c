import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import histogram as H
from pairforge.operators import kmeans, mds, pairs, pairwise_da, rotation, transforms, vector_da


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(c, 0.3, (25, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, v.tolist(), i // 25) for i, v in enumerate(x)], "id long, x array<double>, blob int")
    return x, df.coalesce(2)


def edges_of(spark, x):
    n = len(x)
    rows = [(i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(n) for j in range(n) if i != j]
    return spark.createDataFrame(rows, "i long, j long, d double").coalesce(2)


def pure(labels, blob):
    return len({(a, b) for a, b in zip(labels, blob)}) == len(set(blob)) == len(set(labels))


def test_block_grid_takes_each_pair_once(spark):
    df = spark.range(40).withColumnRenamed("id", "id")
    for blocks in (1, 3, 6):
        got = sorted(tuple(sorted((r.i, r.j))) for r in pairs.half_pairs(df, [], blocks=blocks).collect())
        assert got == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_ranges():
    assert [b - a + 1 for a, b in pairs.ranges(10, 3)] == [4, 3, 3]
    assert [b - a + 1 for a, b in pairs.ranges(2, 4)] == [1, 1, 0, 0]


def test_kmeans_finds_blobs_and_keeps_empty_centers(spark, blobs):
    x, df = blobs
    start = spark.createDataFrame([(0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 5.0]), (3, [500.0, 500.0])], "k long, y array<double>")
    assigned, centers, steps = kmeans.fit(df, start, extra=2)
    got = {r.id: r.k for r in assigned.collect()}
    assert pure([got[i] for i in range(75)], [i // 25 for i in range(75)])
    kept = {r.k: r.y for r in centers.collect()}
    assert kept[3] == [500.0, 500.0] and steps < 20
    assert np.allclose(kept[0], x[:25].mean(0))


def test_large_center_sets_give_the_same(spark, blobs, monkeypatch):
    _, df = blobs
    centers = df.where("id < 5").select(F.col("id").alias("k"), F.col("x").alias("y"))
    one = sorted(map(str, kmeans.assign(df, centers).collect()))
    monkeypatch.setattr(kmeans, "MOST_CENTER_VALUES", 1)
    assert sorted(map(str, kmeans.assign(df, centers).collect())) == one


def test_pairwise_annealing_finds_blobs(spark, blobs):
    x, _ = blobs
    s = pairwise_da.anneal(edges_of(spark, x), most=3, cooling=0.5, final=0.2, inner=2)
    got = {r.id: r.cluster for r in s.labels().collect()}
    assert pure([got[i] for i in range(75)], [i // 25 for i in range(75)])
    sums = s.members.groupBy("id").agg(F.sum("m").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    assert s.clusters.agg(F.sum("c")).first()[0] == pytest.approx(75)


def test_vector_annealing_finds_blobs_and_noise(spark, blobs):
    x, df = blobs
    far = spark.createDataFrame([(100, [40.0, -30.0]), (101, [-50.0, 40.0])], "id long, x array<double>")
    s = vector_da.anneal(df.select("id", "x"), most=3, cooling=0.5, final=0.05, inner=3)
    got = {r.id: r.cluster for r in s.labels().collect()}
    assert pure([got[i] for i in range(75)], [i // 25 for i in range(75)])
    centers = spark.createDataFrame([(0, [0.0, 0.0], 0.4), (1, [6.0, 0.0], 0.3), (2, [0.0, 6.0], 0.3), (vector_da.SPONGE, None, 0.01)], "k int, y array<double>, p double")
    m = vector_da.memberships(df.select("id", "x").union(far), centers, 0.5, sponge=4.0)
    best = {r.id: r.k for r in m.where("m > 0.5").collect()}
    assert best[100] == best[101] == vector_da.SPONGE and best[0] == 0


def test_scaling_recovers_distances(spark):
    rnd = np.random.default_rng(5)
    x = rnd.random((12, 2))
    e = edges_of(spark, x)
    near = spark.createDataFrame([(i, (v + rnd.normal(0, 0.05, 2)).tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    r = mds.scale(e, mds.Fit(norm=3, dim=2, least=1e-4), near, rounds=6, steps=6, damping=0.01)
    assert all(b < a for a, b in zip(r.history, r.history[1:])) and r.chi < 0.05 * r.history[0]


def test_gradient_is_the_derivative(spark):
    rnd = np.random.default_rng(6)
    x, d = rnd.random((6, 2)), rnd.random((6, 6)) + 0.5
    d = (d + d.T) / 2
    e = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(6) for j in range(6) if i != j], "i long, j long, d double").coalesce(1)
    for formula in (1, 2):
        fit = mds.Fit(norm=2, formula=formula, dim=2)
        frame = lambda p: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, x array<double>").coalesce(1)
        got = {r.id: r.g for r in mds.gradient(e, frame(x), fit).collect()}
        # The table holds each pair twice; the gradient is that of the sum over unordered pairs.
        chi = lambda p: mds.gradient(e, frame(p), fit).agg(F.sum("chi")).first()[0] / 2
        step = np.zeros_like(x)
        step[2, 1] = 1e-5
        assert got[2][1] == pytest.approx((chi(x + step) - chi(x - step)) / 2e-5, rel=1e-4)


def test_rotation_recovers_a_copy(spark):
    rnd = np.random.default_rng(7)
    x = rnd.random((20, 3))
    for inverted in (False, True):
        m, t = rotation.total([0.3, 1.2, -2.0], 0.6, inverted), np.array([1.0, 2.0, -3.0])
        a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        b = spark.createDataFrame([(i, (m @ v + t).tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        fit = rotation.fit(a, b)
        assert fit.residual == pytest.approx(0, abs=1e-9) and fit.inverted == inverted and fit.scale == pytest.approx(1 / 0.6)
        if inverted:
            assert rotation.fit(a, b, inversion=False).residual > 0.01
    assert np.allclose(rotation.elementary(3, 0, 1, 0.4, True), (rotation.elementary(3, 0, 1, 0.4 + 1e-6) - rotation.elementary(3, 0, 1, 0.4 - 1e-6)) / 2e-6, atol=1e-6)


def test_histogram_helpers(spark):
    row = spark.range(1).select(H.rounded_bin_size(F.lit(0.0123)), rotation.proper_angle(F.lit(1.5 * math.pi)), H.rounded_bin_size(F.lit(0.0))).first()
    assert row[0] == pytest.approx(0.013) and row[1] == pytest.approx(-math.pi / 2) and row[2] == 0


def test_pruning_reaches_its_fixed_point(spark):
    rnd = random.Random(2)
    links = {(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(120)) if a != b}
    links |= {(b, a) for a, b in links}
    e = spark.createDataFrame([(a, b, 0.5) for a, b in links], "i long, j long, d double").coalesce(2)
    alive = set(range(30))
    while True:
        deg = {a: sum((a, b) in links for b in alive) for a in alive}
        less = {a for a in alive if deg[a] > 5}
        if less == alive:
            break
        alive = less
    assert {r.i for r in transforms.prune_sparse(e, 5).select("i").distinct().collect()} == alive


def test_selection():
    assert transforms.parse_selection("1, 5-9,") == [(1, 1), (5, 9)]
    with pytest.raises(ValueError):
        transforms.parse_selection("9-5")
