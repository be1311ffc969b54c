"""K-means goes on to its fixed point where centers still creep after the stop rule of a small move."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pairforge.plans import catalog


@pytest.mark.parametrize("name", ["kmeans_converged", "kmeans_bounded_converged"])
def test_settles_at_the_fixed_point(spark, tmp_path, name):
    """An outlier makes radii large: the stop rule would end after 19 updates of the 22 that are needed."""
    x = np.zeros((3000, 64), np.float32)
    rng = np.random.default_rng(12)
    rng.random((3000, 3))
    x[:, :3] = rng.normal(size=(3000, 3))
    x[5, :3] = 30
    pq.write_table(pa.table({"vec_id": np.arange(3000), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": np.arange(3000, dtype=np.int32) % 10}), tmp_path / "embeddings.parquet")
    got = {r.id: (r.k, r.d) for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    y, old = x[:4].astype(float), None
    while True:
        d = np.sqrt(((x[:, None].astype(float) - y[None]) ** 2).sum(axis=2))
        near = d.argmin(axis=1)
        if old is not None and (near == old).all():
            break
        old, y = near, np.array([x[near == k].astype(float).mean(axis=0) for k in range(4)])
    assert {i: k for i, (k, _) in got.items()} == dict(enumerate(near.tolist()))
    assert np.allclose([got[i][1] for i in range(3000)], d.min(axis=1), atol=1e-6)
