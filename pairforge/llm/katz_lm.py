"""Language-model scores by Katz back-off over bigrams, unigrams and an unknown word.

Counts are Good-Turing discounted; a history's back-off weight is the mass its seen successors leave,
over the unigram mass of the others, so every distribution sums to one. A token's probability is
looked up recursively: bigram, else back-off weight times unigram, else the unknown word's share.

Rows never travel token by token. Documents are gathered map-side into blocks of a few megabytes; a
block sends its distinct words, later its distinct bigrams, as sorted compressed arrays to the buckets
of a count table, and each bucket answers with arrays in the same order. Buckets are many in
proportion to the text; a history with more than a bucket's share of all tokens is dealt over several
by its successor. Each table is written, partitioned by kind, to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stage

#: Bytes of text of a block and of a bucket; counts up to CUT are discounted; pseudo-count of the base model.
BLOCK_BYTES, BUCKET_BYTES, CUT, PSEUDO = 8 << 20, 24 << 20, 5, 0.1
#: Kinds of rows: a block's tokens, its words for a bucket, the answers, totals, parts of split histories.
TOKENS, WORDS, WORD_ANSWER, WORD_TOTAL, PAIRS, PAIR_ANSWER, PAIR_TOTAL, SPLIT = range(8)
END = xxhash.xxh64_intdigest(b" end", seed=0)  # no word holds a blank

_FIELDS = [("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
_SCHEMA = "block long, bucket long, kind int, a binary, b binary, c binary, d binary"


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes of the least width that holds them."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:], max_output_size=1 << 31) if len(raw) > 1 else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    x = x.astype(np.uint64)
    return pack(np.r_[x[:1], x[1:] - x[:-1]])


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], schema=pa.schema(_FIELDS))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads ids over the buckets."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def discounts(n: list[int], cut: int = CUT) -> np.ndarray:
    """Good-Turing factors d[r] for counts up to ``cut`` (1 beyond, at d[cut + 1]) from n[r], how many have count r.

    From the first r whose factor is not between 0 and 1, as copies of texts make them, a log-log line through
    the counts of counts takes their place (simple Good-Turing). Where that does not fall faster than 1 / r, as
    in very small tables, (r - 1/2) / r stands in.
    """
    d = np.ones(cut + 2)
    r = np.arange(1, cut + 1)
    d[1 : cut + 1] = (r - 0.5) / r
    known = [x for x in range(1, cut + 2) if n[x] > 0]
    slope = np.polyfit(np.log(known), np.log([n[x] for x in known]), 1)[0] if len(known) > 1 else 0.0
    if slope < -1:
        high = (cut + 1) ** (slope + 1)
        d[1 : cut + 1] = ((1 + 1 / r) ** (slope + 1) - high) / (1 - high)
    high = (cut + 1) * n[cut + 1] / n[1] if n[1] else 1
    for x in r if high < 1 else []:
        good = ((x + 1) * n[x + 1] / n[x] / x - high) / (1 - high) if n[x] else 0
        if not 0 < good < 1:
            break
        d[x] = good
    return d


def _histogram(c: np.ndarray, cut: int = CUT) -> np.ndarray:
    return np.bincount(np.minimum(c[c > 0], cut + 2).astype(np.int64), minlength=cut + 3)[: cut + 2]


def _blocks(df: DataFrame, held_out: Column, id_col: str, text_col: str, buckets: int, block_bytes: int) -> DataFrame:
    """Rows of kind TOKENS (with the ids of a block's documents) and WORDS."""
    from pyspark import TaskContext
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{_SCHEMA}, ids array<{kind}>, held array<boolean>"
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    edges = np.array([i * (1 << 64) // buckets for i in range(buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, words, lengths, size, number = [], [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            name = TaskContext.get().partitionId() << 32 | number
            encoded = pa.array(words, pa.binary()).dictionary_encode()
            distinct = encoded.dictionary.to_pylist()
            digest = xxhash.xxh64_intdigest
            own = np.array([*(digest(w) for w in distinct), END], np.uint64)
            vocabulary, at = np.unique(own, return_inverse=True)
            local = at[encoded.indices.to_numpy()] if words else np.zeros(0, np.int64)
            sizes = np.array(lengths, np.int64)
            # Each document's words, then one end.
            tokens = np.insert(local, np.cumsum(sizes), at[-1])
            trained = np.repeat(~np.array(held, bool), sizes + 1)
            counts = np.bincount(tokens[trained], minlength=len(vocabulary))
            rows = [(name, None, TOKENS, pack(tokens), pack(sizes + 1), None, None, ids, held)]
            cuts = np.r_[np.searchsorted(vocabulary, edges), len(vocabulary)]
            for b in range(buckets):
                x = slice(cuts[b], cuts[b + 1])
                if cuts[b] < cuts[b + 1]:
                    rows.append((name, b, WORDS, pack_sorted(vocabulary[x]), pack(counts[x]), None, None, None, None))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

        for batch in batches:
            for part in slices(batch):
                for key, apart, text in zip(part["id"], part["held"], part["text"]):
                    found = words_of(text)
                    ids.append(key)
                    held.append(apart)
                    words += found
                    lengths.append(len(found))
                    size += len(text or "")
                    if size >= block_bytes:
                        yield block()
                        ids, held, words, lengths, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield block()

    picked = df.select(df[id_col].alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), df[text_col].alias("text"))
    return picked.mapInArrow(run, schema)


def _count_words(table: pa.Table) -> pa.Table:
    """A bucket of the unigram table: counts all blocks' words and answers each block in its own order."""
    table = table.sort_by("block")
    parts = [(unpack_sorted(a), unpack(b)) for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist())]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.uint64)
    bucket = table["bucket"][0].as_py()
    rows, begin = [], 0
    for block, (k, _) in zip(table["block"].to_pylist(), parts):
        own = at[begin : begin + len(k)]
        rows.append((block, bucket, WORD_ANSWER, pack_sorted(own), pack(counts[own]), None, None))
        begin += len(k)
    total = np.r_[len(keys), np.count_nonzero(counts), counts.sum(), _histogram(counts)]
    rows.append((None, bucket, WORD_TOTAL, total.astype("<i8").tobytes(), None, None, None))
    return _rows(rows)


class Vocabulary:
    """What all blocks need to know of the unigram table: a few numbers per bucket."""

    def __init__(self, totals: dict[int, np.ndarray], train_docs: int, buckets: int):
        sums = sum(totals.values()) if totals else np.zeros(3 + CUT + 2, np.int64)
        sizes = np.array([totals[b][0] if b in totals else 0 for b in range(buckets)], np.int64)
        self.first = np.cumsum(sizes) - sizes  # the id of a bucket's first word
        self.start = int(sizes.sum())  # the id of the history before a document
        if self.start >= 1 << 32:
            raise ValueError("2^32 distinct words or more; pairs of their ids do not fit in 64 bits")
        self.distinct, self.tokens, self.docs, self.buckets = int(sums[1]), int(sums[2]), train_docs, buckets
        n = sums[3:].tolist()
        self.d = discounts(n)
        left = sum((1 - self.d[r]) * r * n[r] for r in range(1, CUT + 1))
        # With nothing discounted one count is set aside for the unknown word.
        self.scale, self.unknown = (1.0, left / self.tokens) if left > 0 else (self.tokens / (self.tokens + 1), 1 / (self.tokens + 1))

    def probability(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        p = self.scale * self.d[np.minimum(c, CUT + 1).astype(np.int64)] * c / max(self.tokens, 1)
        return np.where(c > 0, p, self.unknown)

    def parts(self, c: np.ndarray) -> np.ndarray:
        """Over how many buckets the successors of a history with count c are dealt."""
        share = max(1, self.tokens // self.buckets)
        return np.clip(-(-c.astype(np.int64) // share), 1, self.buckets)


class Block:
    """A block's tokens with ids and counts, and its distinct bigrams in the order it sends them."""

    def __init__(self, table: pa.Table, known: Vocabulary):
        kinds = table["kind"].to_numpy()
        base = table.filter(pc.equal(table["kind"], TOKENS))
        self.name = base["block"][0].as_py()
        self.ids, self.held = base["ids"][0].as_py(), np.array(base["held"][0].as_py(), bool)
        tokens, self.lengths = unpack(base["a"][0].as_py()).astype(np.int64), unpack(base["b"][0].as_py()).astype(np.int64)
        answers = table.filter(pa.array(kinds == WORD_ANSWER)).sort_by("bucket")
        ids = np.concatenate([unpack_sorted(a).astype(np.int64) + known.first[b] for a, b in zip(answers["a"].to_pylist(), answers["bucket"].to_pylist())])
        counts = np.concatenate([unpack(x) for x in answers["b"].to_pylist()]).astype(np.int64)
        self.count = counts[tokens]
        ends = np.cumsum(self.lengths)
        begins = ends - self.lengths
        before = np.r_[0, tokens[:-1]] if len(tokens) else tokens
        size = len(ids)
        before[begins] = size  # the history before a document
        self.before_count = np.r_[counts, known.docs][before]
        # Distinct bigrams, by bucket, history and word.
        pair = before * (size + 1) + tokens
        distinct, at = np.unique(pair, return_inverse=True)
        h, w = np.divmod(distinct, size + 1)
        hid, wid, hc = np.r_[ids, known.start][h], ids[w], np.r_[counts, known.docs][h]
        parts = known.parts(hc)
        bucket = ((_mix(hid) >> np.uint64(16)) + _mix(wid) % parts.astype(np.uint64)) % np.uint64(known.buckets)
        order = np.lexsort((wid, hid, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at = place[at]
        self.bucket, self.hid, self.wid, self.split, self.word_count = bucket[order].astype(np.int64), hid[order], wid[order], parts[order] > 1, counts[w][order]
        trained = np.repeat(~self.held, self.lengths)
        self.trained = np.bincount(self.at[trained], minlength=len(distinct))
        self.cuts = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1], True]) if len(distinct) else np.zeros(1, np.int64)

    def messages(self) -> pa.Table:
        """Histories and words as sorted pairs, how often each comes in training, the words' counts."""
        rows = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            key = self.hid[a:b].astype(np.uint64) << np.uint64(32) | self.wid[a:b].astype(np.uint64)
            rows.append((self.name, int(self.bucket[a]), PAIRS, pack_sorted(key), pack(self.trained[a:b]), pack(self.word_count[a:b]), pack(self.split[a:b].astype(np.uint8))))
        return _rows(rows)


def _count_pairs(known: Vocabulary):
    """A bucket of the bigram table: counts, and for each history what its seen successors take."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        cols = [[f(x) for x in table[n].to_pylist()] for n, f in (("a", unpack_sorted), ("b", unpack), ("c", unpack), ("d", unpack))]
        keys, first, at = np.unique(np.concatenate(cols[0]), return_index=True, return_inverse=True)
        counts = np.bincount(at, np.concatenate(cols[1]), len(keys)).astype(np.int64)
        words, split = np.concatenate(cols[2])[first], np.concatenate(cols[3])[first] > 0
        history = keys >> np.uint64(32)
        begins = np.flatnonzero(np.r_[True, history[1:] != history[:-1]])
        group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(keys)]))
        seen = counts > 0
        # How many seen successors have each small count, and the unigram mass of all seen ones.
        small = np.stack([np.bincount(group[counts == r], minlength=len(begins)) for r in range(1, CUT + 1)])
        mass = np.bincount(group[seen], known.probability(words[seen]), len(begins))
        bucket, rows, begin = table["bucket"][0].as_py(), [], 0
        for block, k in zip(table["block"].to_pylist(), cols[0]):
            own = at[begin : begin + len(k)]
            begin += len(k)
            g = group[own]
            heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            need = np.logical_or.reduceat(counts[own] == 0, heads)  # only these histories back off in this block
            heads = g[heads]
            kept = np.where(need, small[:, heads], np.minimum(small[:, heads], 1) * (np.cumsum(small[:, heads] > 0, axis=0) == 1))
            rows.append((block, bucket, PAIR_ANSWER, pack(counts[own]), pack(kept.ravel()), np.where(need, mass[heads], 0).tobytes(), None))
        hot = split[begins]
        if hot.any():
            rows.append((None, bucket, SPLIT, history[begins][hot].tobytes(), small[:, hot].astype("<i8").tobytes(), mass[hot].tobytes(), None))
        rows.append((None, bucket, PAIR_TOTAL, _histogram(counts).astype("<i8").tobytes(), None, None, None))
        return _rows(rows)

    return work


def _score_block(known: Vocabulary, d: np.ndarray, split: dict[int, tuple[np.ndarray, float]], table: pa.Table) -> tuple:
    """(ids, held out, tokens, known tokens, base score, score) of a block's documents."""
    block = Block(table, known)
    answers = table.filter(pc.equal(table["kind"], PAIR_ANSWER)).sort_by("bucket")
    counts = np.concatenate([unpack(x) for x in answers["a"].to_pylist()]).astype(np.int64)
    # Per history of each bucket: the small counts of its successors and the mass of the seen ones.
    mark = np.flatnonzero(np.r_[True, (block.hid[1:] != block.hid[:-1]) | (block.bucket[1:] != block.bucket[:-1])])
    small = np.concatenate([unpack(x).reshape(CUT, -1) for x in answers["b"].to_pylist()], axis=1).astype(np.float64)
    mass = np.frombuffer(b"".join(answers["c"].to_pylist()), np.float64).copy()
    for i in np.flatnonzero(block.split[mark]):
        small[:, i], mass[i] = split[int(block.hid[mark[i]])]
    r = np.arange(1, CUT + 1)
    freed = ((1 - d[1 : CUT + 1]) * r) @ small
    of = np.repeat(np.arange(len(mark)), np.diff(np.r_[mark, len(block.hid)]))[block.at]
    n, c12, c1 = block.before_count.astype(np.float64), counts[block.at], block.before_count
    lean = freed[of] == 0  # nothing was discounted: one count is set aside
    scale, left = np.where(lean, n / (n + 1), 1.0), np.where(lean, 1 / (n + 1), freed[of] / np.maximum(n, 1))
    uni = known.probability(block.count)
    alpha = np.where(c1 > 0, left / np.maximum(1 - mass[of], known.unknown), 1.0)
    p = np.where(c12 > 0, scale * d[np.minimum(c12, CUT + 1)] * c12 / np.maximum(n, 1), alpha * uni)
    base = np.log10((block.count + PSEUDO) / (known.tokens + PSEUDO * (known.distinct + 1)))
    begins = np.cumsum(block.lengths) - block.lengths
    sums = [np.add.reduceat(x, begins) for x in ((block.count > 0).astype(np.int64), base, np.log10(p))]
    return block.ids, block.held, block.lengths, *sums


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``df``: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows for which ``held_out`` is not true and scores all. Tokens: words of the text,
    A to Z in lower case, and one end. ``base_score`` is the log10 probability under add-0.1 unigrams,
    ``score`` that under the back-off model. A null text has no words, only its end; null ids and
    repeated rows are documents of their own; other columns are not read. Without training rows every
    token is unknown, with probability one. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    held_out = F.coalesce(held_out, F.lit(False))
    told = df.agg(F.sum(F.octet_length(text_col)), F.sum(F.when(held_out, 0).otherwise(1))).first()
    buckets = max(8, -(-(told[0] or 0) // bucket_bytes))
    blocks = stage(spark, _blocks(df, held_out, id_col, text_col, buckets, block_bytes), "lm_blocks", ("kind",))
    columns = [n for n, _ in _FIELDS]

    words = blocks.where(F.col("kind") == WORDS).select(columns)
    unigrams = stage(spark, words.groupBy("bucket").applyInArrow(_count_words, _SCHEMA), "lm_unigrams", ("kind",))
    totals = {x["bucket"]: np.frombuffer(x["a"], "<i8") for x in unigrams.where(F.col("kind") == WORD_TOTAL).select("bucket", "a").collect()}
    known = Vocabulary(totals, told[1] or 0, buckets)
    answers = unigrams.where(F.col("kind") == WORD_ANSWER)
    tokens = blocks.where(F.col("kind") == TOKENS)
    told_once = tokens.unionByName(answers, allowMissingColumns=True)

    pairs = told_once.groupBy("block").applyInArrow(lambda t: Block(t, known).messages(), _SCHEMA)
    bigrams = stage(spark, pairs.groupBy("bucket").applyInArrow(_count_pairs(known), _SCHEMA), "lm_bigrams", ("kind",))
    n = sum((np.frombuffer(x["a"], "<i8") for x in bigrams.where(F.col("kind") == PAIR_TOTAL).select("a").collect()), np.zeros(CUT + 2, np.int64))
    d = discounts(n.tolist())
    # Histories over a bucket's share of all tokens: as many as there are buckets at most.
    split: dict[int, tuple[np.ndarray, float]] = {}
    for x in bigrams.where(F.col("kind") == SPLIT).select("a", "b", "c").collect():
        names, small, mass = np.frombuffer(x["a"], np.uint64), np.frombuffer(x["b"], "<i8").reshape(CUT, -1), np.frombuffer(x["c"], np.float64)
        for i, name in enumerate(names.tolist()):
            old = split.get(name, (np.zeros(CUT), 0.0))
            split[name] = (old[0] + small[:, i], old[1] + mass[i])

    kind = df.schema[id_col].dataType.simpleString()
    result = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told_twice = told_once.unionByName(bigrams.where(F.col("kind") == PAIR_ANSWER), allowMissingColumns=True)
    id_type = pa.schema(_arrow(result)).field("id").type

    def final(table: pa.Table) -> pa.Table:
        ids, held, lengths, n_known, base, own = _score_block(known, d, split, table)
        return pa.table({"id": pa.array(ids, id_type), "held_out": held, "n_tokens": lengths, "n_known": n_known, "train_tokens": np.full(len(ids), known.tokens), "base_score": base, "score": own})

    return told_twice.groupBy("block").applyInArrow(final, result).withColumnRenamed("id", id_col)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))
