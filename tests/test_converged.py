import duckdb
import numpy as np
import pytest

from pairforge.operators import kmeans as K
from pairforge.plans import catalog
from pairforge.plans.basics import DIM, points

SF = "/root/testdata/sf0.001"


def test_kmeans_converged_is_a_fixed_point(spark):
    got = {r.id: r.k for r in catalog.queries()["kmeans_converged"](spark, SF).collect()}
    pts = points(spark, SF).toPandas().sort_values("id")
    x, ids = np.array(pts.x.tolist()), pts.id.tolist()
    y, old = x[[ids.index(i) for i in range(4)]], None
    while True:
        near = ((x[:, None] - y[None]) ** 2).sum(axis=2).argmin(axis=1)
        if old is not None and (near == old).all():
            break
        old, y = near, np.array([x[near == k].mean(axis=0) for k in range(4)])
    assert got == dict(zip(ids, near.tolist()))


def test_kmeans_tells_that_it_ran_out(spark):
    pts = points(spark, SF)
    with pytest.warns(RuntimeWarning, match="converge"):
        K.fit(pts, pts.where("id < 4").selectExpr("id AS k", "x AS y"), most=1, dim=DIM)


def test_bounded_kmeans_tells_what_bounds_saved(spark):
    got = catalog.queries()["kmeans_bounded_converged"](spark, SF)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = db.execute(catalog.oracle_sql()["kmeans_bounded_converged"])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
    assert got.columns == names == ["id", "k", "d", "saved"]
    assert sorted(map(tuple, got.collect())) == sorted(rows)
