import math
import random

import numpy as np
import pytest

from pairforge.functions import special
from pairforge.operators import centers as C
from pairforge.operators import cluster_quality as Q
from pairforge.operators.joins import split_join

CUT = 1.5


def planted(seed=3, n=300, k=12):
    r = random.Random(seed)
    centers = [(c, [r.uniform(50, 150), r.uniform(-20, 20)], [r.uniform(0.5, 6), r.uniform(0.5, 3)]) for c in range(k)]
    points = [(i, [r.uniform(45, 155), r.uniform(-22, 22)], r.choice([-1, None, *range(k)])) for i in range(n)]
    return points, centers


def far(x, c):
    return sum(((a - b) / s) ** 2 for a, b, s in zip(x, c[1], c[2]))


def frames(spark, points, centers):
    return spark.createDataFrame(points, "id long, x array<double>, cluster long"), spark.createDataFrame(centers, "k long, y array<double>, s array<double>")


@pytest.mark.parametrize("hot", [5, 100_000])
def test_within_cut_is_all_pairs(spark, hot):
    points, centers = planted()
    p, c = frames(spark, points, centers)
    got = {(r.id, r.k) for r in Q.within_cut(p, c, CUT, hot=hot).collect()}
    assert got == {(i, z[0]) for i, x, _ in points for z in centers if far(x, z) <= CUT}
    assert got


def test_split_join_of_a_hot_key(spark):
    big = spark.range(1000).selectExpr("id", "case when id < 900 then 1 else id end as key")
    small = big.select("key").distinct().selectExpr("key", "key * 2 as twice")
    got = split_join(big, small, ["key"], "id", hot=50).collect()
    assert sorted((r.id, r.twice) for r in got) == [(i, 2 if i < 900 else 2 * i) for i in range(1000)]
    assert split_join(big.where("false"), small, ["key"], "id").count() == 0


@pytest.mark.parametrize("sponge", [True, False])
def test_fates_of_points(spark, sponge):
    points, centers = planted()
    p, c = frames(spark, points, centers)
    rows, clusters = Q.point_statistics(p, p, c, CUT, sponge)
    want, strangers = {}, {z[0]: 0 for z in centers}
    for i, x, label in points:
        near = sorted((far(x, z), z[0]) for z in centers if far(x, z) < CUT)
        noise = label is None or label < 0
        k = (near[0][1] if near else None) if noise else label
        d = None if k is None else far(x, centers[k])
        illegal = d is not None and d > CUT
        assigned = -1 if k is None or (illegal and sponge) else k
        others = [n for _, n in near if n != assigned]
        for n in others:
            strangers[n] += 1
        want[i] = (label, assigned, noise and bool(near), illegal, len(others))
    assert {r.id: (r.cluster, r.assigned, r.rescued, r.illegal, r.others) for r in rows.collect()} == want
    assert {r.k: r.strangers for r in clusters.collect()} == strangers
    assert any(w[2] for w in want.values()) and any(w[3] for w in want.values()) and sum(strangers.values())


def test_no_points_and_clashing_names(spark):
    points, centers = planted()
    p, c = frames(spark, points, centers)
    rows, clusters = Q.point_statistics(p.where("false"), p.where("false"), c, CUT)
    assert rows.count() == 0 and {(r.n, r.widest) for r in clusters.collect()} == {(0, None)}
    named = p.withColumn("k", p.id).withColumn("d", p.id).withColumn("part_", p.id)
    assert Q.point_statistics(named, named, c, CUT)[0].count() == len(points)


def test_cluster_statistics(spark):
    _, centers = planted(k=60)
    _, c = frames(spark, [(0, [1.0, 1.0], 0)], centers)
    sizes = spark.createDataFrame([(k, k) for k in range(50)], "k long, n long")
    close, distances, occupancy = Q.cluster_statistics(c, sizes, 3.0, 8, 20)
    d = {(a[0], b[0]): far(b[1], a) for a in centers for b in centers if a[0] != b[0]}
    assert {r.k: r.close for r in close.collect()} == {a[0]: sum(v < 3 for (x, _), v in d.items() if x == a[0]) for a in centers}
    want = [0] * 8
    for v in d.values():
        if v <= 8:
            want[min(7, math.floor(v + 0.5))] += 1
    assert {r.bin: r.n for r in distances.collect()} == {i: n for i, n in enumerate(want) if n}
    assert {r.bin: r.n for r in occupancy.collect()} == {0: 11} | {i: 1 for i in range(1, 19)} | {19: 31}


def test_size_categories_and_energies(spark):
    rows = [(c, 100.0 + i, float(i * c), i % 2 == 0) for c, n in enumerate((1, 1, 3, 7, 12, 40)) for i in range(n)] + [(-1, 5.0, 5.0, True)]
    got = Q.scatter(spark.createDataFrame(rows, "cluster long, x double, y double, golden boolean"), (0.01, 2.0))
    sizes = {r.category: (r.clusters, r.points) for r in Q.size_categories(got, (5, 10, 20, 30)).collect()}
    assert sizes == {-1: (2, 2), 0: (1, 3), 1: (1, 7), 2: (1, 12), 4: (1, 40)}
    golden = {r.category: (r.clusters, r.points) for r in Q.size_categories(got, (5, 15), "golden").collect()}
    assert golden == {-1: (2, 2), 0: (2, 6), 1: (1, 6), 2: (1, 20)}
    y = [float(i * 2) for i in range(3)]
    three = next(r for r in Q.size_categories(got, (5, 10, 20, 30)).collect() if r.category == 0)
    assert three.y_width == pytest.approx(sum((v - np.mean(y)) ** 2 for v in y) / 4 / 3)
    one = Q.size_energies(got, 3.0).first()
    assert (one.singletons, one.single_energy, one.real, one.real_points, one.mean_size) == (2, 9.0, 4, 62, 15.5)


def test_edges_within_groups_are_all_pairs_of_groups(spark, monkeypatch):
    monkeypatch.setattr(C.P, "BLOCK_POINTS", 7)
    r = random.Random(1)
    rows = [(i, 0 if i < 40 else i % 3, [r.random(), r.random(), r.random()]) for i in range(70)]
    got = C.position_edges(spark.createDataFrame(rows, "id long, grp long, x array<double>"), 3).collect()
    want = {(a[1], a[0], b[0]): math.dist(a[2], b[2]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1]}
    assert len(got) == len(want)
    for e in got:
        assert e.d == pytest.approx(want[e.grp, e.i, e.j])


def test_special_functions_of_arrays(spark):
    x = np.array([0.01, 0.2, 1.0, 2.4, 10.0, 75.0, 300.0])
    for n in range(4):
        cross = special.bessel_j(n + 1, x) * special.bessel_y(n, x) - special.bessel_j(n, x) * special.bessel_y(n + 1, x)
        assert cross * math.pi * x / 2 == pytest.approx(np.ones(7), rel=1e-8)
    assert special.bessel_j(0, x)[4] == pytest.approx(-0.2459357644513483, abs=1e-12)
    assert np.isneginf(special.bessel_y(0, 0.0)) and np.isnan(special.bessel_y(0, -1.0)) and np.isnan(special.bessel_j(0, np.inf))
    a, b, t = np.array([2.0, 5.0, 3.0, 1.0]), np.array([3.0, 2.0, 3.0, 1.0]), np.array([0.4, 0.9, 0.0, 1.0])
    assert special.ibeta(a, b, t) == pytest.approx([sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)), sum(math.comb(6, k) * 0.9**k * 0.1 ** (6 - k) for k in range(5, 7)), 0, 1])
    u = special.udfs()
    got = spark.createDataFrame([(2.0, 3.0, 0.4), (None, 3.0, 0.4)], "a double, b double, x double").select(u["ibeta"]("a", "b", "x").alias("v"), u["j0"]("a").alias("j")).collect()
    assert got[0].v == pytest.approx(0.5248) and got[1].v is None and got[1].j is None
