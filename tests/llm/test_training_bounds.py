import numpy as np
from pyspark.sql import functions as F

from pairforge.llm import language_id, license_scan, quality_gam

LABELLED = "doc_id long, text string, lang string"


def test_language_rows_of_one_id_are_bounded_not_dropped(spark):
    for same_text in (False, True):
        rows = [(1, "one and the same text" if same_text else f"text number {i} of the same document id", "en") for i in range(1000)]
        for doc in (1, 2, 3, 4):
            df = spark.createDataFrame([(doc, t, c) for _, t, c in rows], LABELLED).repartition(4)
            got = language_id.fit_profiles(df, fit_rows=100, order_col="doc_id")
            assert list(got) == ["en"] and len(got["en"]) > 5


def test_quality_labels_meet_documents_before_they_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y, **_: seen.append((len(x), y.tolist())) or None)
    docs = spark.createDataFrame([(i, f"document {i} " * (1 + i % 5)) for i in range(200)], "doc_id long, text string").repartition(3)
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    for fit_rows, want in ((200, 200), (50, 50), (5000, 200)):
        quality_gam.train(docs, labels, fit_rows=fit_rows)
        assert seen[-1][0] == want and set(seen[-1][1]) == {0.0, 1.0}
    quality_gam.train(docs, labels.where("doc_id > 500"))
    assert seen[-1] == (0, [])
    # One id for all documents, and equal documents: the bound holds, and no row of one is dropped for the other.
    same = spark.createDataFrame([(7, "the same text")] * 300, "doc_id long, text string")
    quality_gam.train(same, labels, fit_rows=100)
    assert seen[-1] == (100, [1.0] * 100)


def test_boosting_lowers_the_loss():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, len(quality_gam.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    model = quality_gam.fit(x, y)
    p = np.clip(model.score(x), 1e-9, 1 - 1e-9)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert loss < 0.5 * np.log(2) and ((p >= 0.5) == (y == 1)).mean() > 0.95


def test_scan_is_the_same_at_any_stretch(spark):
    mit = license_scan.TEMPLATES["MIT"][0]
    text = " ".join([mit, "some words between the notices " * 200, mit, mit])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [sorted(map(tuple, license_scan.scan(df, stretch=s).collect())) for s in (64, 1024, 1 << 16)]
    assert got[0] == got[1] == got[2] and any(r[1] == "MIT" for r in got[0])
