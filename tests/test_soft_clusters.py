import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import bounds, lcms
from pairforge.operators import soft_clusters as S
from pairforge.operators import vector_da as D


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(c, 0.3, (25, 2)) for c in ((0, 0), (6, 0), (0, 6))] + [np.array([[40.0, -30.0], [-50.0, 40.0]])])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").coalesce(2).cache()


def brute(x, y, p, temperature, sponge=None, noise=0.0, cut=S.CUT):
    t = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2) / temperature
    q = np.maximum(p, S.LEAST_PRIOR)
    if sponge is not None:
        t, q = np.c_[t, np.full(len(x), sponge**2 / temperature)], np.r_[q, max(noise, S.LEAST_PRIOR)]
    gap = t - t.min(1)[:, None]
    e = np.where(gap < 2 * cut, q * np.exp(-0.5 * gap), 0)
    return t, e / e.sum(1)[:, None]


@pytest.mark.parametrize("sponge", [None, 3.0])
def test_lists_give_the_memberships_with_few_distances(spark, sponge):
    rnd = np.random.default_rng(5)
    middles = rnd.uniform(-30, 30, (120, 2))
    x = np.concatenate([rnd.normal(m, 0.5, (10, 2)) for m in middles])
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    y, p = middles + rnd.normal(0, 0.2, middles.shape), np.full(120, 1 / 120)
    lists, computed = S.Lists(pts, nearest=12), []
    for step in range(3):
        model = S.Model(y, p, 0.2, sponge, 0.05 if sponge else 0.0)
        frame = lists.rebuilt(model)
        computed.append(frame.agg(F.sum("computed")).first()[0])
        t, m = brute(x, y, p, 0.2, sponge, model.noise)
        got = np.zeros_like(m)
        for r in S.members(frame, model).collect():
            got[r.id, r.k] = r.m
            assert r.t == pytest.approx(t[r.id, r.k])
        np.testing.assert_allclose(got, m, atol=1e-9)
        y = y + rnd.normal(0, 0.02, y.shape)
    assert frame.agg(F.max(F.size("ks"))).first()[0] == 12
    # All distances once; afterwards under a twentieth of them, where half was asked.
    assert computed[0] == len(x) * 120 and computed[-1] - computed[0] < 0.05 * 2 * computed[0]


def test_sums_of_a_pass(spark, blobs):
    x, pts = blobs
    y, p = np.array([[0.5, 0.5], [5.0, 1.0], [1.0, 5.0]]), np.array([0.5, 0.3, 0.1])
    model, before = S.Model(y, p, 2.0, 5.0, 0.1), S.Model(y + 0.1, p, 2.0, 5.0, 0.1)
    frame = S.Lists(pts).rebuilt(model)
    sums = S.em_sums(frame, model, before)
    t, m = brute(x, y, p, 2.0, 5.0, 0.1)
    _, was = brute(x, y + 0.1, p, 2.0, 5.0, 0.1)
    np.testing.assert_allclose(sums.c, m.sum(0), atol=1e-9)
    np.testing.assert_allclose(sums.width, (m * t * 2.0).sum(0) / m.sum(0), rtol=1e-9)
    np.testing.assert_allclose(sums.change, np.abs(m - was).sum(0), atol=1e-6)
    np.testing.assert_allclose(sums.means, (m[:, :3].T @ x) / m[:, :3].sum(0)[:, None], atol=1e-9)
    value, v = S.leading_variance(frame, model, tolerance=1e-7, most=60)
    for k in range(3):
        z = x - y[k]
        w, vectors = np.linalg.eigh((m[:, k, None] * z).T @ z / m[:, k].sum())
        assert value[k] == pytest.approx(w[-1], rel=1e-4) and abs(v[k] @ vectors[:, -1]) == pytest.approx(1, abs=1e-3)
    own = m.argmax(1)
    assert S.occupations(frame, model).tolist() == [(own == k).sum() for k in range(4)]
    assert {r.id: r.cluster for r in S.labels(frame, model).collect()} == {i: (k if k < 3 else S.SPONGE) for i, k in enumerate(own)}


def test_bad_clusters():
    model = S.Model(np.array([[0.0], [0.1], [5.0], [9.0]]), np.array([0.3, 0.4, 0.2, 0.1]), 1.0)
    gone = S.invalid(model, np.array([30.0, 40.0, 20.0, 0.5]), np.array([30, 40, 20, 0]), 2.0, 1, 0.05)
    assert gone.tolist() == [True, False, False, True]
    left = S.without(model, gone)
    assert left.y.ravel().tolist() == [0.1, 5.0] and left.p.sum() == pytest.approx(1)
    assert S.invalid(model, np.zeros(4), np.zeros(4), 2.0, 1, 0.0).tolist() == [False, True, True, True]


def test_memberships_of_an_empty_table_and_of_null_ids(spark):
    centers = spark.createDataFrame([(0, [0.0], 0.5), (4, [3.0], 0.5)], "k int, y array<double>, p double")
    none = spark.createDataFrame([], "id long, x array<double>")
    assert D.memberships(none, centers, 1.0).count() == 0
    got = D.memberships(spark.createDataFrame([(None, [1.0]), (None, [1.0])], "id long, x array<double>"), centers, 1.0, with_x=False).collect()
    assert sorted(r.k for r in got) == [0, 0, 4, 4] and sum(r.m for r in got) == pytest.approx(2)
    with pytest.raises(ValueError, match="no points"):
        D.anneal(none)


def test_annealing_with_all_its_controls(spark, blobs):
    x, pts = blobs
    s = D.Schedule(cooling=0.3, final=0.005, inner=8, sponge=4.0, sponge_first=8.0, sponge_from=0.05, widths=(2.0, 1.0))
    got = D.anneal(pts, most=6, schedule=s)
    labels = {r.id: r.cluster for r in got.labels().collect()}
    assert labels[75] == labels[76] == S.SPONGE
    groups = [{labels[i] for i in range(b, b + 25)} for b in (0, 25, 50)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and S.SPONGE not in set.union(*groups)
    temperatures = [h[0] for h in got.history]
    assert temperatures == sorted(temperatures, reverse=True) and temperatures[-1] == pytest.approx(0.005 * temperatures[0], rel=1e-6)
    energies = [h[2] for h in got.history]
    assert energies[-1] < 0.01 * energies[0] and "settled" in got.reason
    # Again from its own end: nothing moves.
    again = D.anneal(pts, start=got.centers, temperature=got.temperature, schedule=D.Schedule(final=1.0, sponge=4.0, sponge_from=2.0), most=3)
    centers = lambda f: np.array(sorted(r.y for r in f.collect() if r.k >= 0))
    np.testing.assert_allclose(centers(again.centers), centers(got.centers), atol=0.02)


def test_schedules_are_those_of_the_controls(spark):
    from pairforge.operators import annealing_control as N

    for share in (1.0, 0.5, 0.21, 0.1):
        row = spark.range(1).select(N.annealed(F.lit(2.0), 0.5, F.lit(share), 0.1, 0.8), N.sponge_factor(F.lit(9.0), 5.0, 1.0, F.lit(share), 0.9, 0.1)).first()
        assert D._annealed(2.0, 0.5, share, 0.1, 0.8) == pytest.approx(row[0])
        if share <= 0.9:
            assert D._sponge(5.0, 1.0, share, 0.9, 0.1) == pytest.approx(row[1])


def test_runs_of_every_mode(spark, blobs):
    _, pts = blobs
    # Two former runs: one cut the first blob in two, and left out a point; outliers were taken for the third.
    labels = pts.select("id", F.when(F.col("id") == 3, None).when(F.col("id") < 12, 7).when(F.col("id") < 25, 1).when(F.col("id") < 50, 2).otherwise(4).cast("int").alias("cluster"))
    of = lambda run: {r.id: r.cluster for r in run.labels.collect()}
    joined = lcms.run(pts, "join", labels.where("id < 75"), D.Schedule(close=3.0, final=1.0), 1.0)
    got = of(joined)
    assert len({got[i] for i in range(25)}) == 1 and len(set(got.values())) == 3 and joined.reason
    again = of(lcms.run(pts, "sponge_again", labels.where("id < 75"), D.Schedule(sponge=4.0), 0.5))
    assert again[75] == again[76] == S.SPONGE and len(set(again.values())) == 5 and again[3] >= 0
    change = lcms.run(pts, "sponge_change", labels.where("id < 75"), D.Schedule(sponge=2.0, sponge_first=200.0, sponge_from=1.0, cooling=0.5, final=0.2), 1.0)
    assert of(change)[75] == S.SPONGE and len(change.history) >= 3
    analysed = lcms.run(pts, "analyse", labels)
    assert of(analysed)[3] is None and [(r.cluster, r.dense, r.n) for r in analysed.clusters().orderBy("cluster").collect()] == [(1, 0, 13), (2, 1, 25), (4, 2, 27), (7, 3, 11)]
    assert sorted(map(tuple, analysed.sizes().collect())) == [(11, 1, 11), (13, 1, 13), (25, 1, 25), (27, 1, 27)]
    fresh = lcms.run(pts, "fresh", schedule=D.Schedule(cooling=0.3, final=0.005, inner=8, sponge=4.0, sponge_from=0.05))
    assert of(fresh)[75] == S.SPONGE and sorted(r.n for r in fresh.clusters().where("cluster >= 0").collect()) == [25, 25, 25]
    for wrong in (("fresh", None, D.Schedule()), ("join", None, None), ("again", labels, None), ("sponge_again", labels, D.Schedule())):
        with pytest.raises(ValueError):
            lcms.run(pts, *wrong)


def test_centers_are_of_checked_size(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_VALUES", 3)
    with pytest.raises(ValueError, match="numbers of centers"):
        D.collected(spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], "k int, y array<double>").withColumn("p", F.lit(0.5)))
    assert bounds.MOST_VALUES > 3
