import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pairforge.llm import bestfit_packing, grouping_ga, queries
from pairforge.llm.bytecodec import ByteCodec

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", " a\n b \t c ", "don't I'll we've  ", "x" * 3000, "12 345, 6!? --  z", "Zażółć gęślą 漢字 😀", "one<|endoftext|> two <|endoftext|>", "a  b \x1c c\x85 d", "end. \n\n  Next ​z ﻿q", "tail "]


@pytest.fixture(scope="module")
def codec():
    return ByteCodec()


def test_codec_equals_the_library(codec, spark):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(" \n\tab.,'9é漢 ​<|>") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    assert codec.splits
    want = [x.ids for x in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert codec.merge is not None and [list(memoryview(x).cast("I")) for x in codec.encode(texts)] == want
    codec.merge, merge = None, codec.merge
    assert [list(memoryview(x).cast("I")) for x in codec.encode(texts[:50])] == want[:50]
    codec.merge = merge
    # Plain and other chunks in one text meet at any of their bounds.
    mixed = [" ".join(rnd.choice(("plain", "Ab1.", "漢字", "x\n", "\n", "", "é", "<|endoftext|>", "<|end", "it's", "٣x")) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    assert [list(memoryview(x).cast("I")) for x in codec.encode(mixed)] == [x.ids for x in codec.library.encode_batch(mixed, add_special_tokens=False)]


def placed(rows, codec, texts, capacity, end=2):
    """Checks every rule of the result; gives the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        ids = codec.encode([texts[doc]])[0] + end.to_bytes(4, "little")
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(-(-len(ids) // 4 // capacity)))
        at = 0
        for r in found:
            assert r.start == at and r.ids_crc32 == crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4 and all(r.length == capacity for r in found[1:])
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("items,release,merge", [(8192, 128, 64), (16, 6, 3)])
def test_packing_of_whole_documents(spark, codec, monkeypatch, items, release, merge):
    monkeypatch.setattr(bestfit_packing, "BLOCK_ITEMS", items)
    monkeypatch.setattr(bestfit_packing, "RELEASE", release)
    monkeypatch.setattr(bestfit_packing, "MERGE", merge)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bestfit_packing.pack_best_fit(docs).collect()
    made = placed(rows, codec, texts, 1024)
    lengths = [r.length for r in rows]
    assert made <= grouping_ga.least_bins(lengths, 1024) * (1.02 if items > 100 else 1.08) + 1
    assert all(crc32(r.ids) == r.ids_crc32 for r in rows)


def test_odd_documents_and_none(spark, odd_docs, no_docs):
    rows = bestfit_packing.pack_best_fit(odd_docs, capacity=64).collect()
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    assert sorted(r.length for r in rows if r.doc_id in (3, 4)) == [1, 1]
    assert bestfit_packing.pack_best_fit(no_docs).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000), (2, None)], "doc_id long, text string")
    assert bestfit_packing.pack_best_fit(long, with_ids=False).agg(F.sum("length")).first()[0] == ByteCodec().encode(["word " * 200_000])[0].__len__() // 4 + 2


def least_by_search(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for b in range(len(rooms)):
            if rooms[b] >= lengths[k]:
                place(k + 1, [*rooms[:b], rooms[b] - lengths[k], *rooms[b + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_evolved_packings_against_exhaustive_search():
    rnd = random.Random(5)
    for _ in range(40):
        lengths = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 9))]
        packings = grouping_ga.evolve(grouping_ga.founders(lengths, 60, 5, rnd), lengths, 60, 30, rnd)
        want = least_by_search(lengths, 60)
        assert grouping_ga.least_bins(lengths, 60) <= want == len(packings[0][0])
        for bins, fills in packings:
            assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
            assert fills == [sum(lengths[i] for i in b) for b in bins] and max(fills) <= 60


def test_crossover_injects_whole_bins_and_improves():
    rnd = random.Random(6)
    lengths = [rnd.randint(150, 500) for _ in range(400)]
    start = grouping_ga.founders(lengths, 1000, 5, rnd)
    child = grouping_ga.crossover(start[0], start[1], lengths, 1000, rnd)
    whole = {frozenset(b) for b in start[1][0]}
    assert any(frozenset(b) in whole for b in child[0])
    evolved = grouping_ga.evolve(start, lengths, 1000, 60, rnd)
    assert grouping_ga.fitness(evolved[0]) > max(map(grouping_ga.fitness, start)) or len(evolved[0][0]) == grouping_ga.least_bins(lengths, 1000)


def test_query(spark):
    got = queries.op11_bestfit(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
