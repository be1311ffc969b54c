import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import bounds as B
from pairforge.operators import kmeans as K
from pairforge.operators import triangle


def held(low, width):
    return B.shortest(low, width)


@pytest.mark.parametrize("k,width,excess", [(1, 4, 0.0), (7, 16, 0.0), (200, 5, 0.0), (200, 5, 2.0), (60, 1, 0.3)])
def test_search_finds_all_within_reach(k, width, excess):
    rnd = np.random.default_rng(k + width)
    x = rnd.normal(size=(500, 4)) * 5
    y = rnd.normal(size=(k, 4)) * 5
    x[:20], y[k // 2] = y[0], y[0]  # ties
    c = B.Centers(y, excess=excess, width=width)
    known, low, computed = B.search(x, None, None, None, c, B.between(y))
    last = old = held(low, width)
    old_y, total = y, 0
    for step in range(6):
        k_of, before, y = known.argmin(1), y, y + rnd.normal(size=y.shape) * (0.05 if step % 2 else -0.05)
        known, low, computed = B.search(x, k_of, last, old, B.Centers(y, before, old_y, excess, width), B.between(y))
        true = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2))
        assert np.all(low <= true * (1 + 1e-12) + 1e-12) and np.all(np.isinf(known) | (known == true))
        within = true**2 <= true.min(1)[:, None] ** 2 + excess
        assert not np.isinf(known[within]).any() and (known.argmin(1) == true.argmin(1)).all()
        assert (computed == np.isfinite(known).sum(1)).all()
        last, total = held(low, width), total + computed.sum()
        assert last.near.shape[1] <= width
    if k == 200 and not excess:
        assert total < 0.3 * 6 * 500 * k


def test_bounds_shrink_by_the_movement():
    h = B.shortest(np.array([[3.0, 1.0, 5.0, 2.0]]), 2)
    assert sorted(h.near[0]) == [1, 3] and h.rest.tolist() == [3.0]
    assert h.spread(np.array([0.5, 0.25, 1.0, 0.0]))[0].tolist() == [2.5, 0.75, 2.0, 2.0]


def test_kmeans_with_a_thousand_centers(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(6000, 3)) + rnd.integers(0, 30, (6000, 3))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4).cache()
    first = pts.where("id < 1000").select((F.col("id") * 3).alias("k"), F.col("x").alias("y"))
    plain, plain_centers, steps = K.fit(pts, first, extra=1, most=4, dim=3)
    bounded, centers, same = triangle.fit(pts, first, extra=1, most=4, width=8, dim=3)
    assert steps == same
    want = {r.id: (r.k, r.d) for r in plain.collect()}
    got = {r.id: (r.k, r.d) for r in bounded.collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert {r.k: np.round(r.y, 9).tolist() for r in centers.collect()} == {r.k: np.round(r.y, 9).tolist() for r in plain_centers.collect()}
    # The first search computes all; the others a small part.
    assert bounded.agg(F.sum("computed")).first()[0] < 6000 * 1000 * (1 + 0.1 * same)


def test_state_is_of_bounded_width(spark):
    rnd = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(300, 2)))], "id long, x array<double>")
    y = rnd.normal(size=(100, 2))
    search = B.Search(pts, width=6)
    for step in range(3):
        state = search.at(y + 0.01 * step)
    sizes = state.select(F.max(F.size("near")), F.max(F.size("low")), F.max(F.size("old_near"))).first()
    assert tuple(sizes) == (6, 6, 6) and B.counted(state) < 300 * 100 * 1.6
    assert search.at(y[:50]).agg(F.max("k")).first()[0] < 50


def test_too_many_centers():
    with pytest.raises(ValueError, match="numbers of centers"):
        B.between(np.zeros((2300, 1)))
