"""Ranges and cells of two distances, against brute force."""

from collections import Counter

import numpy as np

from pairforge.operators import block_distances as B
from pairforge.operators import density
from pairforge.plans import clustering


def test_cells_and_ranges_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_POINTS", 16)
    x = np.random.default_rng(4).normal(size=(70, 4))
    label = [None if i % 11 == 0 else i % 2 for i in range(70)]
    points = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(70)] + [(70, None, 1)], "id long, x array<double>, label int")
    pairs = [(*(float(np.sqrt(((x[i, :n] - x[j, :n]) ** 2).sum())) for n in (4, 2)), None if None in (label[i], label[j]) else label[i] == label[j]) for i in range(70) for j in range(i)]
    got = {r.intra: r for r in density.ranges(points, (4, 2)).collect()}
    for kind in (True, False, None):
        own = [p for p in pairs if p[2] is kind]
        lone = sum((None if c is None else c == 1) is kind for c in label)
        assert got[kind].n == len(own) + lone
        assert np.allclose([got[kind].low0, got[kind].high0, got[kind].low1, got[kind].high1], [f(p[at] for p in own) for at in (0, 1) for f in (min, max)])
    (a0, a1), (b0, b1) = ((min(p[at] for p in pairs), max(p[at] for p in pairs)) for at in (0, 1))
    cell = lambda v, low, high: min(int((v - low) / ((high - low) / 5)), 4)
    want = Counter((cell(a, a0, a1), cell(b, b0, b1), kind) for a, b, kind in pairs)
    found = {(r.cx, r.cy, r.intra): r.n for r in density.cells(points, (4, 2), 5).collect()}
    assert {k: n for k, n in found.items() if k[0] is not None} == dict(want)
    assert sum(n for k, n in found.items() if k[0] is None) == 70


def test_pairs_are_not_written(spark, monkeypatch):
    """The density of both axes leaves counts, not pairs."""
    monkeypatch.setattr(clustering, "stage", None)
    assert clustering.density_marginals(spark, "/root/testdata/sf0.001").count() > 200
