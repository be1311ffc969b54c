"""Centers of groups by positions write no pairs and find what they find over written pairs."""

import numpy as np

from pairforge.operators import centers as C


def test_positions_as_over_written_pairs(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(40, 3))
    points = spark.createDataFrame([(i, i % 3, x[i].tolist()) for i in range(40)], "id long, grp long, x array<double>")
    rows = lambda f: sorted((r.grp, r.method, r["rank"], r.id, round(r.score, 9)) for r in f.collect())
    want = rows(C.group_centers(C.position_edges(points, 3), points, 3, (0.4,), 3))
    written, stage = [], C.stage
    monkeypatch.setattr(C, "stage", lambda spark, df, name, *more: written.append(name) or stage(spark, df, name, *more))
    assert rows(C.group_centers(None, points, 3, (0.4,), 3)) == want
    assert len(want) == 3 * 4 * 3 and "within" not in written
