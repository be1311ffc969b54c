import random
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairforge.llm import packing, sentencepiece_codec, token_counts
from pairforge.llm.wordcodec import WordCodec

PIECES = ["the ", "and", " ", "\n", "don't ", "é", "12 3", "<|endoftext|>", "  ", ", ", "T̈", "İ.", "\x85", "\x1c", "　", "漢", "Σς", "'s", "|", "̈", "x y"]


@pytest.fixture(scope="module")
def codec():
    return WordCodec()


def test_word_cache_equals_the_library(codec):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=25).map("".join))
    def run(text):
        text = text.encode("utf-8", "ignore").decode()
        assert codec.encode([text]) == codec._library([text])

    run()


def test_word_cache_is_emptied_never_wrong():
    small = WordCodec(max_words=20)
    texts = [" ".join(f"w{i * 7 % 50}x{i}" for i in range(k)) for k in range(60)]
    assert small.encode(texts) == small._library(texts)
    assert small.encode(texts[::-1]) == small._library(texts[::-1])


def test_chunked_encoding_equals_the_whole(codec):
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice([*PIECES, "x" * rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 120)))
        got = [t for run in token_counts.encode_long(codec, text, chunk=rnd.choice([20, 50, 90]), overlap=rnd.choice([4, 8, 16])) for t in run]
        whole = codec.library.encode(text, add_special_tokens=False)
        assert [t[2] for t in got] == whole.ids
        assert [(a, b) for a, b, _ in got] == whole.offsets


def test_long_texts_without_white_space_take_time_in_proportion(codec):
    rnd = random.Random(8)
    asked = []
    real = token_counts.encode_with_offsets
    for alphabet in ("漢字仮名交文章語", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ab,1 "):
        text = "".join(rnd.choices(alphabet, k=300_000))
        asked.clear()
        token_counts.encode_with_offsets = lambda c, t, at: asked.append(len(t)) or real(c, t, at)
        try:
            n = sum(map(len, token_counts.encode_long(codec, text)))
        finally:
            token_counts.encode_with_offsets = real
        assert n == len(codec.library.encode(text, add_special_tokens=False).ids)
        assert sum(asked) < 3 * len(text)


def test_count_tokens_on_odd_rows(spark, odd_docs, no_docs, codec):
    got = token_counts.count_tokens(odd_docs, chunk_chars=1000, overlap_chars=64).collect()
    texts = [r.text for r in odd_docs.collect()]
    assert [r.n_tokens for r in got] == [len(codec.library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [r.n_tokens > 2048 for r in got]
    assert any(r.n_chunked for r in got)
    assert token_counts.count_tokens(no_docs).count() == 0


def packed(df):
    rows = [r.asDict() for r in packing.pack(df).collect()]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
        assert crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["tier"] <= 2048
        assert at & (at - 1) == 0
    return rows


def test_packing_loses_no_id(spark, odd_docs, no_docs, codec):
    rows = packed(odd_docs.coalesce(1))
    want = sorted(((r.doc_id is None, r.doc_id or 0), codec._library([r.text or ""])[0] + (1).to_bytes(4, "little")) for r in odd_docs.collect())
    total = sum(len(ids) // 4 for _, ids in want)
    assert sum(r["length"] for r in rows) == total
    unique = {k: v for k, v in want if [x for x, _ in want].count(k) == 1}
    for (null, key), ids in unique.items():
        own = sorted((r for r in rows if r["doc_id"] == key and not null), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == ids
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert all(r["doc_tokens"] == len(ids) // 4 for r in own)
    assert packing.pack(no_docs).count() == 0


def test_steps_are_balanced_over_all_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8)
    rows = packed(docs)
    steps, short = {}, 0
    for s in {(r["sequence_id"], r["tier"], r["step_group"]) for r in rows}:
        steps.setdefault((s[1] if s[1] >= 256 else 0, s[2]), []).append(s[1])
        short += s[1] < 256
    assert all(sum(x) <= 32_768 for x in steps.values())
    assert len({s for _, s in steps}) == len(steps)
    for tier in (256, 512, 1024, 2048):
        sums = sorted(sum(x) for (t, _), x in steps.items() if t == tier)
        assert all(x == 32_768 for x in sums[1:])
    assert short <= 8
    assert "ids" not in packing.pack(docs, with_ids=False).columns


def test_packer_fills_windows_and_balances_steps():
    rnd, total, sizes = random.Random(1), 0, []
    packer = packing.Packer(pool_tokens=1 << 15)
    for doc in range(2000):
        n = rnd.choice([1, 5, 300, 700, 1500, 5000, 2047, 2048, 2049])
        total += n
        sizes += [sum(len(p[2]) for p in w) // 4 for w in packer.add(doc, b"\1\0\0\0" * n)]
        assert packer.pool.tokens < (1 << 15) + 2048
    sizes += [sum(len(p[2]) for p in w) // 4 for w in packer.rest()]
    assert sum(sizes) == total
    assert sum(s < 256 for s in sizes) <= 8


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces as a unigram model; scores that float32 can add exactly."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for x in proto.pieces:
        if x.score < -1e6:
            x.score = -40000
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


def brute(model, text):
    n = len(text)
    best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for a in range(n):
        for b in range(a + 1, min(n, a + model.longest) + 1):
            v = model.scores.get(text[a:b])
            if v is not None and best[a] + v > best[b]:
                best[b], back[b] = best[a] + v, a
        if text[a] not in model.scores and best[a] + model.worst > best[a + 1]:
            best[a + 1], back[a + 1] = best[a] + model.worst, a
    out, at = [], n
    while at:
        out.append(text[back[at] : at])
        at = back[at]
    return [i for x in reversed(out) for i in model.piece_ids(x)]


def test_viterbi_equals_the_library_and_brute_force(unigram):
    path, library = unigram
    codec = sentencepiece_codec.Codec(path)
    rnd = random.Random(5)
    for _ in range(150):
        text = "".join(rnd.choice(["the", "ing", "a", "b", " ", "tion", "er", "qx", "zz", "é", ".", ","]) for _ in range(rnd.randint(0, 60)))
        got = np.frombuffer(codec.encode(text), "<i4").tolist()
        assert got == library.encode(text)
        odd = text + rnd.choice(["\n", "  ", "漢", "😀"]) + text[:20]
        ids = np.frombuffer(codec.encode(odd), "<i4").tolist()
        assert ids == brute(codec.model, codec.model.spelled(odd))
        assert codec.decode(ids) == odd


def test_viterbi_streams_in_a_bounded_window():
    codec = sentencepiece_codec.Codec("piece_bpe_32k.model")
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefghij▁.qé") for _ in range(20000))
    stream, got, held = sentencepiece_codec.StreamingViterbi(codec.model), [], 0
    for at in range(0, len(text), 50):
        got += stream.feed(text[at : at + 50])
        held = max(held, len(stream.text))
    got += stream.end()
    assert got == brute(codec.model, text)
    assert held < 500


def test_sentencepiece_frames(spark, odd_docs, no_docs):
    ids = sentencepiece_codec.encode(odd_docs)
    back = [r.decoded for r in sentencepiece_codec.decode(ids).collect()]
    assert back == [r.text or "" for r in odd_docs.collect()]
    assert sentencepiece_codec.encode(no_docs).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-1, 999_999_999])], "doc_id long, ids array<int>")
    assert [r.decoded for r in sentencepiece_codec.decode(odd).collect()] == [None, "", "⁇  ⁇ "]
