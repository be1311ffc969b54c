import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pairforge.llm import jaccard, simhash
from pairforge.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def plain(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(texts):
    sets, ids = {i: plain(t) for i, t in texts.items()}, sorted(texts)
    root = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            s, t = sets[a], sets[b]
            if s == t or s and t and len(s & t) / len(s | t) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return root


def planted(spark):
    """The small table with copies in which single words are replaced: some within the similarity, some beyond."""
    rnd = random.Random(5)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    line = "this very common line of words stands in many a short text"
    for i, t in list(texts.items())[:60]:
        words = (t or "").split()
        for c in range(3):
            changed = list(words)
            for _ in range(rnd.randint(0, 1 + len(words) // 25)):
                changed[rnd.randrange(len(words))] = f"new{rnd.random()}"
            texts[10_000 + 10 * i + c] = " ".join(changed)
    texts |= {50_000 + i: f"{line} a{i} b{i} c{i % 4}" for i in range(90)} | {60_000: None, 60_001: "", 60_002: "two words", 60_003: "Two  WORDS"}
    return texts


def test_bitmaps_bound_the_difference():
    rnd = np.random.default_rng(2)
    for m, n in ((0, 5), (3, 300), (256, 257), (1000, 5000), (700, 900)):
        s, t = (np.unique(rnd.integers(0, 1 << 63, k, np.uint64)) for k in (m, n))
        t = np.unique(np.r_[t, s[::2]])
        got = jaccard.differing(jaccard.bitmap(s), jaccard.bitmap(t))
        small = [x.tobytes() for x in map(jaccard.folded, map(jaccard.bitmap, (s, t)))]
        assert len(small[0]) == jaccard.LEAST_BITS // 8 and jaccard.differing(*small) <= got
        assert got <= len(np.setxor1d(s, t)) and jaccard.differing(jaccard.bitmap(t), jaccard.bitmap(t)) == 0
        assert got == jaccard.differing(jaccard.bitmap(t), jaccard.bitmap(s))


def test_bucket_levels_count_every_row(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 5)),) for k in range(50)] * 200 + [("the one very common line",)] * 5000, "text string").repartition(7)
    levels = jaccard.bucket_levels(df, 5)
    common = int(jaccard.shingles("the one very common line")[0] >> np.uint64(64 - jaccard.BUCKET_BITS))
    assert levels[common] == levels.max() > levels[int(jaccard.shingles("w1 w2 w3 w4 w5")[0] >> np.uint64(64 - jaccard.BUCKET_BITS))] > 0
    assert not jaccard.bucket_levels(df.limit(0), 5).any()


def test_near_groups_equal_brute_force(spark):
    texts = planted(spark)
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    want = groups_of(texts)
    assert any(want[i] != i and plain(texts[i]) != plain(texts[want[i]]) for i in want)
    for bits in (20, 4):
        got = {r.id: r.root for r in jaccard.near_groups(df, "id", bucket_bits=bits).collect()}
        assert got.keys() == want.keys()
        assert len({(got[i], want[i]) for i in want}) == len(set(got.values())) == len(set(want.values()))


def test_near_groups_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.withColumn("key", F.monotonically_increasing_id())
    kept = {r.key: r.doc_id for r in rows.collect()}
    of = {}
    for r in simhash.similar_groups(rows, "key").collect():
        of.setdefault(r.root, []).append(kept[r.key])
    assert sorted(str(sorted(x, key=str)) for x in of.values()) == sorted(map(str, [[1, 2, 2], [3, 4, 5, None], [6], [7], [None], [8], [9]]))
    assert simhash.similar_groups(no_docs, "doc_id").count() == 0


def test_stage_drops_near_copies(spark):
    texts = planted(spark)
    rows = [(i, t, "en", "x", len(t or ""), 7, i) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, row_ long")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert found.columns == docs.columns
    kept = found.collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups_of(texts).values()))
    assert all(r.row == 7 and r.row_ == r.doc_id for r in kept)


def test_wide_links_equal_brute_force(spark):
    rnd = random.Random(8)
    values = {rnd.getrandbits(64) for _ in range(40)} | {0}
    for _ in range(2):
        values |= {v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))) for v in list(values) for _ in range(2)}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    root = {v: v for v in signed}
    for a in signed:
        for b in signed:
            if (signed[a] ^ signed[b]).bit_count() <= simhash.WIDE and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {v: new if r == old else r for v, r in root.items()}
    want = sorted((v, r) for v, r in root.items() if list(root.values()).count(r) > 1)
    table = spark.createDataFrame([(v,) for v in signed], "fp long").withColumn("c", simhash.coordinates(F.col("fp")))
    for block in (simhash.WIDE_BLOCK, 1):
        assert sorted(map(tuple, connected_components(simhash.wide_links(table, block=block)).collect())) == want


def test_stage_takes_fingerprints_and_pivots_first(spark, monkeypatch):
    texts, seen, search = planted(spark), {}, simhash.wide_links

    def watched(table):
        seen["table"] = {r.fp: list(r.c) for r in table.collect()}
        found = search(table)
        seen["links"] = [(r.a, r.b) for r in found.collect()]
        return found

    monkeypatch.setattr(simhash, "wide_links", watched)
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    prints = {i: simhash.fingerprint_of(t, simhash.WIDE_WORDS) for i, t in texts.items() if plain(t)}
    pivots = simhash.pivots().tolist()
    assert {fp % (1 << 64) for fp in seen["table"]} <= set(prints.values())
    assert len(seen["table"]) <= len({frozenset(plain(texts[i])) for i in prints})
    assert all(c == [((fp % (1 << 64)) ^ p).bit_count() for p in pivots] for fp, c in seen["table"].items())
    assert len(seen["links"]) > 20 and all(((a ^ b) % (1 << 64)).bit_count() <= simhash.WIDE for a, b in seen["links"])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups_of(texts).values()))


def test_given_pairs_change_no_group(spark):
    texts = planted(spark)
    df, want = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3), groups_of(texts)
    every = lambda nodes: nodes.select(F.col("node").alias("b")).where("b > 0").select(F.lit(1).cast("long").alias("a"), "b")
    got = {r.id: r.root for r in jaccard.near_groups(df, "id", near=every).collect()}
    assert got.keys() == want.keys()
    assert len({(got[i], want[i]) for i in want}) == len(set(got.values())) == len(set(want.values()))
