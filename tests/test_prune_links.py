from pairforge.plans import clustering


def test_prune_links_goes_on_until_nothing_falls(spark, monkeypatch):
    # Five points all linked, and a strip from whose one end one or two points fall a round.
    links = {(100 + a, 100 + b) for a in range(5) for b in range(5) if a != b}
    links |= {(a, b) for a in range(30) for b in range(30) if 0 < abs(a - b) <= 2}
    links = spark.createDataFrame([(a, b, 1.0) for a, b in links], "i long, j long, d double")
    monkeypatch.setattr(clustering, "distances", lambda spark, sf: links)
    assert {(r.i, r.n) for r in clustering.prune_links(spark, "").collect()} == {(100 + a, 4) for a in range(5)}
