from pairforge.plans import clustering


def test_close_clusters_counts_beyond_a_thousand(spark, monkeypatch):
    centers = spark.createDataFrame([(k, [k / 1e6, 0.0]) for k in range(1005)], "k long, y array<double>")
    monkeypatch.setattr(clustering, "points", lambda spark, sf: None)
    monkeypatch.setattr(clustering, "label_means", lambda pts: centers)
    got = clustering.close_clusters(spark, "").collect()
    assert len(got) == 1005 and {r.close for r in got} == {1004}
