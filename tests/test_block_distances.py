"""Distances of all pairs by blocks, against brute force, and their cost."""

import math
import time

import numpy as np

from pairforge.operators import block_distances as B
from pairforge.operators import pairwise_da as C
from pairforge.plans import catalog

FAR = "/root/testdata/sf0.1"


def test_pairs_as_by_brute_force(spark, monkeypatch):
    """Small blocks, an id twice, no id, names for ids, vectors that lack numbers."""
    monkeypatch.setattr(B, "BLOCK_POINTS", 10)
    monkeypatch.setattr(B, "SLICE_PAIRS", 20)
    x = np.random.default_rng(3).normal(size=(60, 5))
    rows = [(f"n{i}", x[i].tolist(), i % 3) for i in range(57)] + [("n0", x[57].tolist(), 0), (None, x[58].tolist(), 1), ("none", None, 1), ("short", [1.0, 2.0], 1), ("hole", [1.0, None, 3.0, 4.0, 5.0], 1)]
    points = spark.createDataFrame(rows, "id string, x array<double>, grp int")

    def far(a, b, dim):
        if None in (a, b) or len(a) < dim or len(b) < dim or None in a[:dim] or None in b[:dim]:
            return None
        total = 0.0
        for u, v in zip(a[:dim], b[:dim]):
            total += (u - v) * (u - v)
        return math.sqrt(total)

    want = [(*sorted((a[0], b[0])), d := far(a[1], b[1], 5), None if d is None else far(a[1], b[1], 2)) for n, a in enumerate(rows) for b in rows[:n] if None not in (a[0], b[0]) and a[0] != b[0]]
    got = [(*sorted((r.i, r.j)), r.d, r.e) for r in B.distances(points, (5, 2), ("d", "e")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    grp = {r[0]: r[2] for r in rows}
    within = B.distances(points, (5,), within="grp").collect()
    assert sorted(((*sorted((r.i, r.j)), r.d, None) for r in within), key=str) == sorted(((a, b, d, None) for a, b, d, _ in want if grp[a] == grp[b]), key=str)
    assert all(grp[r.i] == r.grp for r in within)


def test_two_thousand_points_take_seconds(spark):
    """Two million pairs; as one expression over 64 dimensions they took most of a minute on eight cores."""
    queries = catalog.queries()
    queries["da_clusters"](spark, "/root/testdata/sf0.001").collect()
    began = time.time()
    assert len(queries["da_clusters"](spark, FAR).collect()) == 2
    assert time.time() - began < 20


def test_sums_over_pairs_are_made_once(spark):
    """Both results of a step of annealing read the written sums."""
    edges = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(6) for j in range(6) if i != j], "i long, j long, d double")
    members = spark.createDataFrame([(i, k, 0.5) for i in range(6) for k in (0, 1)], "id long, k int, m double")
    eps, clusters = C.m_step(edges, members)
    assert all("means" in eps.inputFiles()[0] and any("means" in f for f in df.inputFiles()) for df in (eps, clusters))
    assert {(r.k, round(r.a, 6)) for r in clusters.collect()} == {(0, round(-0.5 * 70 / 36, 6)), (1, round(-0.5 * 70 / 36, 6))}


def test_pairs_are_not_broadcast(spark):
    """Positions joined with roles were estimated as larger than the pairs, which were then sent to the driver."""
    plan = catalog.queries()["mds_components"](spark, FAR)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and plan.count("Join") == 2
