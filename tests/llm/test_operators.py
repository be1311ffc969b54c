import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pairforge.llm import hamming_topk, iso_media, katz_lm, language_id, license_scan, queries, quality_gam, simhash, token_counts
from pairforge.llm.common import crc_fold
from pairforge.llm.components import connected_components

from test_jaccard import groups_of  # noqa: I001

SF = "/root/testdata/sf0.001"


def lowest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components_of_random_and_long_graphs(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(300)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == lowest({n for x in real for n in x}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {i + 10_000: f"{t} {i % 3}" for i, t in list(texts.items())[:60] if t}
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(prints[a] ^ prints[b]).count("1") <= 2]
    assert {i: r.component_id for i, r in got.items()} == lowest(ids, links)
    odd = simhash.near_duplicates(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {r.component_id for r in odd if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in odd if r.fingerprint == "0" * 16} == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_large_blocks_are_split_without_losing_links(spark):
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(40)}
    values |= {v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in list(values) for _ in range(6)}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").withColumn("c", simhash.coordinates(F.col("fp")))
    pivots = simhash.pivots().tolist()
    assert all(list(r.c) == [bin((r.fp % (1 << 64)) ^ p).count("1") for p in pivots] for r in fps.collect())
    roots = lambda block: sorted(map(tuple, connected_components(simhash.near_links(fps, block)).collect()))
    assert roots(1) == roots(1024)


def test_pivots_discard_most_pairs_and_no_near_one():
    rnd, tally = np.random.default_rng(4), Counter()
    values = rnd.integers(0, 1 << 63, 600, np.uint64)
    values[300:] = values[:300] ^ np.uint64(5)
    coords = np.bitwise_count(values[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    links = list(simhash.link_blocks(values, np.array([600]), coords, tally=tally))
    assert len(links) == 300 and tally["near"] == 300 and tally["met"] == 600 * 599 // 2
    assert tally["left"] < 0.001 * tally["met"] + 300


def test_more_components_than_bits_are_an_error(spark):
    df = spark.range(1).select(F.array_repeat(F.lit(1.0), 65).alias("v"), F.array_repeat(F.lit(-1.0), 64).alias("w"))
    assert df.select(hamming_topk.sign_code(F.col("w"))).first()[0] == 0
    with pytest.raises(Exception, match="64 components"):
        df.select(hamming_topk.sign_code(F.col("v"))).collect()


@pytest.mark.parametrize("bucket,cell", [(256, 1 << 16), (4, 8), (64, 16)])
def test_hamming_top_k_equals_brute_force(spark, bucket, cell):
    rnd = random.Random(bucket)
    base = [rnd.getrandbits(63) for _ in range(60)]
    rows = [(i, base[i % 60] ^ (1 << rnd.randrange(63)) if i % 3 else base[i % 60]) for i in range(400)] + [(400 + i, base[0]) for i in range(100)]
    df = spark.createDataFrame([*rows, (None, 5), (900, None), (20, rows[20][1])], "vec_id long, code long").withColumn("q", F.lit(1)).withColumn("d", F.lit(1))
    got = defaultdict(list)
    for r in hamming_topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, bucket=bucket, cell=cell).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbor_id))
    every = [*rows, (20, rows[20][1])]
    for i, code in rows:
        if i % 20 == 0:
            want = sorted((bin(code ^ c).count("1"), j) for j, c in every)[:5]
            assert got[i][:5] == want if i != 20 else sorted(got[i]) == sorted(want * 2), i
    assert hamming_topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_few_codes_give_fewer_neighbours(spark):
    df = spark.createDataFrame([(1, 0), (2, -1)], "vec_id long, code long")
    assert sorted(map(tuple, hamming_topk.top_k(df, F.lit(True)).collect())) == [(1, 1, 1, 0), (1, 2, 2, 64), (2, 1, 2, 0), (2, 2, 1, 64)]


def test_license_scan_finds_planted_notices(spark, odd_docs, no_docs):
    filler = " ".join(f"word{i}" for i in range(300))
    rows, want = [], set()
    for k, (name, texts) in enumerate(license_scan.TEMPLATES.items()):
        for j, t in enumerate(texts):
            key = 100 * k + j
            rows.append((key, f"{filler[: 37 * (k + j)]} {t.upper()}! {filler}"))
            want.add((key, name))
    rows += [(9000, filler), (9001, "Released under the"), (9002, None), (9003, ""), (None, "x Released under the MIT License y"), (9004, "Released under the MIT Licence")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want | {(None, "MIT")} <= {(r.doc_id, r.license) for r in got}
    assert all(r.containment >= 0.8 for r in got)
    assert not {r.doc_id for r in got} & {9000, 9001, 9002, 9003, 9004}
    assert license_scan.scan(odd_docs).count() == license_scan.scan(no_docs).count() == 0


def test_license_scan_needs_no_python(spark, odd_docs):
    plan = license_scan.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan


def test_license_scan_of_stretches_equals_the_whole(spark):
    rnd = random.Random(6)
    texts = [t for x in license_scan.TEMPLATES.values() for t in x]
    rows = [(i, " ".join(rnd.choice(texts) if rnd.random() < 0.1 else f"filler{rnd.randrange(9)} word" for _ in range(60))) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string")
    whole = sorted(map(str, license_scan.scan(df).collect()))
    assert len(whole) > 20 and len(whole) > len(set(whole))
    for stretch in (7, 100, 331):
        assert sorted(map(str, license_scan.scan(df, stretch=stretch).collect())) == whole


def test_license_scan_of_many_templates(spark):
    rnd = random.Random(7)
    many = {f"L{i}": [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(5, 90)))] for i in range(300)}
    df = spark.createDataFrame([(i, f"a b c {many[f'L{i}'][0]} d e") for i in range(300)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in license_scan.scan(df, templates=many).collect()}
    assert {(i, f"L{i}") for i in range(300)} <= got


def katz(texts, held):
    """Score of each text by the textbook formulas, over dictionaries."""
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    train = [t for t, h in zip(tokens, held) if not h]
    uni = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    total, cut = sum(uni.values()), katz_lm.CUT
    of = lambda c: [Counter(c.values())[k] for k in range(cut + 2)]
    du, db = katz_lm.discounts(of(uni)), katz_lm.discounts(of(pairs))
    left = sum((1 - du[c]) * c for c in uni.values() if c <= cut)
    scale_u, unknown = (1, left / total) if left else (total / (total + 1), 1 / (total + 1))
    p1 = {w: scale_u * du[min(c, cut + 1)] * c / total for w, c in uni.items()}
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c
    model = {}
    for h, seen in after.items():
        n = sum(seen.values())
        freed = sum((1 - db[c]) * c for c in seen.values() if c <= cut)
        scale, beta = (1, freed / n) if freed else (n / (n + 1), 1 / (n + 1))
        p2 = {w: scale * db[min(c, cut + 1)] * c / n for w, c in seen.items()}
        alpha = beta / max(1 - sum(p1[w] for w in seen), unknown)
        model[h] = p2, alpha
        rest = sum(p for w, p in p1.items() if w not in seen) + unknown
        assert sum(p2.values()) + alpha * rest == pytest.approx(1)
    out = []
    for t in tokens:
        s = 0.0
        for h, w in zip(["<s>", *t[:-1]], t):
            p2, alpha = model.get(h, ({}, 1.0))
            s += math.log10(p2[w] if w in p2 else alpha * p1.get(w, unknown))
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1))) for w in t)
        out.append((len(t), sum(w in uni for w in t), total, base, s))
    return out


@pytest.mark.parametrize("block,bucket", [(8 << 20, 24 << 20), (3000, 5000)])
def test_katz_equals_the_textbook(spark, odd_docs, block, bucket):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150).unionByName(odd_docs.select("doc_id", "text")).coalesce(2)
    rows = [(i, r.doc_id, r.text) for i, r in enumerate(docs.collect())]
    held = [crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = katz_lm.score(df, crc_fold("doc_id", 10) == 0, block_bytes=block, bucket_bytes=bucket).orderBy("doc_id").collect()
    for r, h, want in zip(got, held, katz([t for _, _, t in rows], held), strict=True):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *want[:3])
        assert (r.base_score, r.score) == pytest.approx(want[3:])


def test_katz_on_odd_rows(spark, odd_docs, no_docs):
    assert katz_lm.score(odd_docs, F.lit(False)).count() == odd_docs.count()
    assert katz_lm.score(no_docs, F.lit(False)).count() == 0
    untrained = katz_lm.score(odd_docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in untrained)


def test_language_profiles_equal_plain_counts():
    def plain(text):
        s = " " + "".join(c if c.isalpha() else " " for c in (x.lower() if len(x.lower()) == 1 else x for x in text)) + " "
        grams = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
        return {sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))): v for g, v in grams.items() if g.strip() and "  " not in g}

    old = language_id.CHARS
    try:
        for language_id.CHARS in (old, 5, 7):
            for t in ("ΑΣ ΣΑΣ i̇", "ΑΣ İ", "Hello, World! straße ÉÉ  x", "a", "!!", " a b cc", "İx yİ", "漢字 and" * 3):
                codes, counts = language_id.profile_counts(t)
                assert dict(zip(codes.tolist(), counts.tolist())) == plain(t)
    finally:
        language_id.CHARS = old


def test_out_of_place_distances_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language_id.fit_profiles(docs, size=60)
    assert len(profiles) > 1 and all(len(x) == 60 for x in profiles.values())
    tied = {**profiles, "zz": profiles[min(profiles)]}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.identify(docs, tied, size=60).collect():
        codes, counts = language_id.profile_counts(texts[r.doc_id] or "")
        own = [c for _, c in sorted(zip((-counts).tolist(), codes.tolist()))][:60]
        away = {k: sum(abs(i - x.index(c)) if c in x else 60 for i, c in enumerate(own)) for k, x in tied.items()}
        best = min(away, key=lambda k: (away[k], k)) if own else "und"
        assert (r.lang_pred, r.score) == (best, pytest.approx(1 - away[best] / (60 * len(own)) if own else 0))


def test_language_id_is_right_on_held_out_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    profiles = language_id.fit_profiles(docs, fit_rows=300)
    odd = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd_docs, profiles).collect() if r.doc_id in (3, 4, 5, 9)}
    assert odd == {(i, "und") for i in (3, 4, 5, 9)}
    assert language_id.fit_profiles(no_docs) == {}
    assert language_id.identify(no_docs, {}).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs, {}).collect()} == {"und"}


def test_media_round_trip(spark, odd_docs, no_docs):
    read = iso_media.read_media(iso_media.store_media(odd_docs), with_payload=True).collect()
    for r, doc in zip(read, odd_docs.collect(), strict=True):
        raw = (doc.text or "").encode()
        assert r.payload == raw + b" " * (-len(raw) % 192 if raw else 192)
        (track,) = r.tracks
        assert (r.brand, track.codec, track.n_samples, track.duration, r.error) == ("isom", "raw ", len(r.payload) // 192, len(r.payload) // 192, None)
        for key in track.keyframes:
            at = (key.sample - 1) * 192
            assert r.media[key.offset : key.offset + key.length] == r.payload[at : at + 192] and (key.sample - 1) % iso_media.GOP == 0
    assert iso_media.store_media(no_docs).count() == 0


def test_media_tables_with_sizes_and_several_chunks():
    one = iso_media.write_media(bytes(range(192)) * 70, chunk=16)
    brand, (track,) = iso_media.parse_media(one)
    assert len(track.offsets) == 70 and len(track.runs()) == 1
    # Sizes of their own, plain and compact, a version 1 media header, and user data with its four-byte end.
    def put(data, kind, new):
        at = data.index(kind) - 4
        size = int.from_bytes(data[at : at + 4], "big")
        grown = len(new) - size
        out = bytearray(data[:at] + new + data[at + size :])
        for outer in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            k = data.index(outer) - 4
            if k < at < k + int.from_bytes(data[k : k + 4], "big"):
                out[k : k + 4] = (int.from_bytes(out[k : k + 4], "big") + grown).to_bytes(4, "big")
        k = out.index(b"stco") + 12
        for i in range(int.from_bytes(out[k - 4 : k], "big")):
            old = int.from_bytes(out[k + 4 * i : k + 4 * i + 4], "big")
            out[k + 4 * i : k + 4 * i + 4] = (old + grown).to_bytes(4, "big")
        return bytes(out)

    word = lambda x, n=4: x.to_bytes(n, "big")
    sizes = iso_media.full(b"stsz", 0, word(0), word(70), word(192) * 70)
    compact = [iso_media.full(b"stz2", 0, word(bits), word(70), word(192, bits // 8) * 70) for bits in (8, 16)]
    header = iso_media.full(b"mdhd", 0, word(0, 8) * 2, word(24), word(70, 8), word(0), version=1)
    for changed in (put(one, b"stsz", sizes), *(put(one, b"stsz", x) for x in compact), put(one, b"mdhd", header), put(one, b"vmhd", iso_media.box(b"udta", iso_media.box(b"name", b"x"), bytes(4)))):
        (got,) = iso_media.parse_media(changed)[1]
        assert b"".join(changed[a:b] for a, b in got.runs()) == bytes(range(192)) * 70
        assert (got.timescale, got.duration, got.keyframes.tolist()) == (24, 70, list(range(0, 70, 12)))
    nibbles = put(one, b"stsz", iso_media.full(b"stz2", 0, word(4), word(70), bytes([0x12] * 35)))
    assert iso_media.parse_media(nibbles)[1][0].sizes.tolist() == [1, 2] * 35


def test_media_fragments():
    word = lambda x, n=4: x.to_bytes(n, "big")
    full, box = iso_media.full, iso_media.box
    table = box(b"stbl", full(b"stsd", 0, word(1), box(b"avc1", bytes(8))), *(full(k, 0, word(0)) for k in (b"stts", b"stsc", b"stco")), full(b"stsz", 0, word(0), word(0)))
    media = box(b"mdia", full(b"mdhd", 0, word(0) * 2, word(90), word(0), word(0)), box(b"minf", table))
    track = box(b"trak", full(b"tkhd", 3, word(0) * 2, word(5), word(0) * 2), media)
    init = box(b"ftyp", b"iso5", word(0)) + box(b"moov", track, box(b"mvex", full(b"trex", 0, word(5), word(1), word(3), word(10), word(0x10000))))
    data, at, want, keys = init, len(init), [], []
    for k, (flags, rows) in enumerate([(0x5, [10] * 4), (0x205, [7, 8, 9]), (0x601, [5, 6])]):
        own = b"".join(word(n) + (word(0 if i == 1 else 0x10000) if flags & 0x400 else b"") for i, n in enumerate(rows)) if flags & 0x200 else b""
        size = 8 + 8 + 16 + 16 + len(own) + 4 + 4 * (flags >> 2 & 1) + 4 - 4
        head = [word(size + 8)] + ([word(0)] if flags & 4 else [])
        moof = box(b"moof", box(b"traf", full(b"tfhd", 0x20000, word(5)), full(b"trun", flags, word(len(rows)), *head, own)))
        head[0] = word(len(moof) + 8)
        moof = box(b"moof", box(b"traf", full(b"tfhd", 0x20000, word(5)), full(b"trun", flags, word(len(rows)), *head, own)))
        keys.append(len(want) + (1 if flags & 0x400 else 0))
        place = len(data) + len(moof) + 8
        for n in rows:
            want.append((place, n))
            place += n
        data += moof + box(b"mdat", bytes(sum(rows)))
    (got,) = iso_media.parse_media(data)[1]
    assert list(zip(got.offsets.tolist(), got.sizes.tolist())) == want
    assert got.keyframes.tolist() == keys and (got.codec, got.duration) == ("avc1", 27)


def test_media_query_equals_brute_force(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_media_columns(spark, SF).collect():
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = iso_media.write_media(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == crc32(payload[-16:]) and r.n_keyframes == len(r.keyframes) == -(-len(payload) // 192 // 12)
        assert all(media[k.offset : k.offset + k.length] == payload[2304 * i : 2304 * i + 192] for i, k in enumerate(r.keyframes))
        assert r.feature == f"isom;raw ;{len(payload) // 192}/24;{len(r.keyframes)} keyframes;{r.keyframes[0].offset}+192;{r.keyframes[-1].offset}+192"


def test_malformed_media_is_reported(spark):
    good = iso_media.write_media(bytes(192 * 40))
    rnd = random.Random(4)
    bad = [b"", b"abc", good[:300], good[:-5], good.replace(b"stsz", b"xxxx"), good.replace(b"stco", b"xxxx"), *(bytes(b if rnd.random() > 0.01 else rnd.randrange(256) for b in good) for _ in range(60))]
    got = iso_media.read_media(spark.createDataFrame([(i, x) for i, x in enumerate([*bad, None])], "doc_id long, media binary")).collect()
    assert len(got) == len(bad) + 1
    assert all(r.error for r in got[1:6]) and got[0].tracks == [] and got[-1].tracks is None


def test_quality_model_on_held_out_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op10_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert (got.predicted == got.quality).mean() > 0.98
    model = quality_gam.train(odd_docs, labels.limit(0))
    assert {r.score for r in quality_gam.classify(odd_docs, model).collect()} == {0.5}
    assert quality_gam.classify(no_docs, model).count() == 0


def test_gam_sees_a_feature_that_is_mostly_zero():
    rnd = np.random.default_rng(1)
    x = np.zeros((4000, 2))
    x[:100, 0] = rnd.random(100)
    x[:, 1] = rnd.random(4000)
    y = (x[:, 0] > 0).astype(float)
    model = quality_gam.fit(x, y, rounds=60, pairs=1)
    assert ((model.score(x) > 0.5) == y).all()
    y = (x[:, 0] > 0.5).astype(float)
    assert ((quality_gam.fit(x, y, rounds=60, pairs=1).score(x) > 0.5) == y).mean() > 0.999


def test_gam_trains_on_odd_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 7), (1, 0, 7), (2, 0, 7), (6, None, 7), (None, 1, 7), (9, 0, 7)], "doc_id long, quality int, label_id int")
    model = quality_gam.train(odd_docs, labels)
    assert {0 < r.score < 1 for r in quality_gam.classify(odd_docs, model).collect()} == {True}
    a, b = (quality_gam.train(odd_docs, labels, fit_rows=2).intercept for _ in range(2))
    assert a == b


def test_gam_learns_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=40, pairs=2)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    table = model.logits(x[:5])
    manual = [model.intercept + sum(t[np.searchsorted(c, v, "right")] for c, t, v in zip(model.cuts, model.tables, row)) + sum(t[np.searchsorted(ca, row[a], "right"), np.searchsorted(cb, row[b], "right")] for a, b, ca, cb, t in model.pairs) for row in x[:5]]
    assert table == pytest.approx(manual)


def test_pipeline_stages_decide(spark, odd_docs, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(5000 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(docs.where("length(text) > 300").limit(20).collect())] + [(6000, None, "en", "x", 0), (6001, "12 34 !!", "en", "x", 8)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    sizes, at = [docs.count()], docs
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, at, SF)
        if name != "packing":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        if name == "simhash_dedup":
            groups = groups_of({r.doc_id: r.text for r in at.collect()})
            assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == sorted(set(groups.values()))
        at = spark.read.parquet(path)
        sizes.append(at.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    empty = docs.limit(0)
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, empty, SF).count() == 0
    odd = odd_docs
    for _, work in corpus_pipeline.STAGES[:3]:
        odd = work(spark, odd, SF)
        assert odd.columns == odd_docs.columns
        odd.count()
    assert corpus_pipeline.drop_near_duplicates(spark, odd_docs, SF).count() == 7
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, odd_docs, SF).collect()} == {r.doc_id for r in odd_docs.collect()}


def test_pipeline_packs_what_its_stages_keep(spark):
    kept = corpus_pipeline.documents(spark, SF)
    for _, work in corpus_pipeline.STAGES[:3]:
        kept = work(spark, kept, SF)
    lengths = dict(zip((r.doc_id for r in kept.collect()), (r.n_tokens + 1 for r in token_counts.count_tokens(kept).collect())))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append((r.start, r.length))
    assert got.keys() == lengths.keys()
    for i, pieces in got.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == lengths[i]
