"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least a given value.

Equal sets are merged first. In any fixed order of the shingles, two sets of similarity t share one of
their first n - ceil(t n) + 1, so texts meet under these and no pair is missed. The order puts shingles late
that many texts share: by how often the shingles of a hash bucket come in the table (in powers of two, from
what chance explains on), and by whether a shingle that would come first does so in OFTEN texts; then by
hash. Sets that meet are discarded by size, by the places of the shingle they meet in, and by fingerprints:
parity bitmaps, whose Hamming distance is at most the number of differing shingles, of 1024 bits where they
meet and of about as many bits as a set has shingles afterwards. Survivors are compared exactly. Each text
is compared with the first of all it meets, then with the first under each shingle; at last all pairs that
are still apart follow. Pairs that another search found (``simhash``) come before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.session import discard

from .common import map_arrow, ship, slices, stage
from .components import connected_components

#: Bits of a hash bucket whose shingles are counted together, and of one whose shingles are often first; tables that are added up at once.
BUCKET_BITS, FIRST_BITS, ADDED = 20, 25, 64
#: How many texts have a shingle first for it to come late; least bits of a bitmap.
OFTEN, LEAST_BITS = 4, 1024
SEED, WORDS, LEAST = 42, 5, 0.8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run, one without words none."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(split)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1) - 1
    k = min(words, n)
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: n - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n - k + 1))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """How often the shingles of each bucket come: 0 up to what chance explains, then powers of two of the excess."""
    mean = counts.mean()
    excess = np.maximum(counts - mean, 0) / (6 * math.sqrt(mean) + 8)
    return np.ceil(np.log2(np.maximum(excess, 1))).astype(np.uint8) + (excess > 1)


def _merged(tables: DataFrame, add: Callable[[list[np.ndarray]], np.ndarray], dtype: type) -> np.ndarray | None:
    """One table from (part, packed): ADDED at a time, so that what reaches the driver is of fixed size."""
    schema = pa.schema([("part", pa.int64()), ("packed", pa.binary())])

    def merge(some: pa.Table) -> pa.Table:
        parts = [np.frombuffer(zstandard.decompress(x), dtype) for x in some["packed"].to_pylist()]
        return pa.Table.from_pydict({"part": [some["part"][0].as_py() // ADDED], "packed": [zstandard.compress(add(parts).tobytes(), 1)]}, schema=schema)

    for _ in range(4):  # enough for ADDED^4 tasks
        tables = tables.groupBy(F.floor(F.col("part") / ADDED).alias("group")).applyInArrow(merge, "part long, packed binary")
    found = tables.first()
    return np.frombuffer(zstandard.decompress(found["packed"]), dtype) if found else None


def _tallied(rows: DataFrame, column: str, take: Callable[[list], np.ndarray], size: int, finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(part, packed): each task's counts of the buckets that ``take`` gives, of fixed size whatever it reads."""
    out = pa.schema([("part", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, held, n = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(take(part[column]))
                n += len(held[-1])
                if n > size:
                    counts += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "packed": [zstandard.compress(finish(counts).tobytes(), 1)]}, schema=out)

    ship(rows.sparkSession)
    return rows.select(column).mapInArrow(run, "part long, packed binary")


def bucket_levels(rows: DataFrame, words: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """The level of each bucket over all rows (text). Any levels give the same groups."""

    def take(texts: list) -> np.ndarray:
        return np.concatenate([shingles(x, words) for x in texts]).astype(np.uint64) >> np.uint64(64 - bits)

    found = _merged(_tallied(rows, "text", lambda x: take(x).astype(np.int64), 1 << bits, lambda c: c), sum, np.int64)
    return np.zeros(1 << bits, np.uint8) if found is None else levels_of(found)


def often_first(rows: DataFrame, words: int, least: float, levels: np.ndarray, often: int = OFTEN, bits: int = FIRST_BITS) -> np.ndarray:
    """Packed bits of the buckets with a shingle that comes first in ``often`` texts or more. Any bits give the same groups."""

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            return {"token": np.concatenate([prefix(shingles(x, words), least, levels, None) for x in part["text"]]).view(np.int64)}

        return work

    tokens = map_arrow(rows.select("text"), "token long", make).groupBy("token").count().where(F.col("count") >= often)
    take = lambda x: (np.array(x, np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    found = _merged(_tallied(tokens, "token", take, 1 << bits, lambda c: np.packbits(c > 0, bitorder="little")), np.bitwise_or.reduce, np.uint8)
    return np.zeros(1 << bits >> 3, np.uint8) if found is None else found


def prefix(s: np.ndarray, least: float, levels: np.ndarray, often: np.ndarray | None) -> np.ndarray:
    """The shingles under which a set meets others, in their order."""
    own = levels[(s >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)].astype(np.int16)
    if often is not None:
        at = (s >> np.uint64(62 - len(often).bit_length())).astype(np.int64)
        own += (often[at >> 3] >> (at & 7) & 1).astype(np.int16) * 256
    return s[np.argsort(own, kind="stable")][: len(s) - math.ceil(least * len(s) - 1e-9) + 1]


def bitmap(s: np.ndarray) -> bytes:
    """Which residues an odd number of shingles has, modulo the power of two from the set's size on."""
    size = max(LEAST_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    odd = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) % 2
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(x: bytes) -> np.ndarray:
    """A bitmap folded to LEAST_BITS bits, as longs."""
    return np.bitwise_xor.reduce(np.frombuffer(x, "<i8").reshape(-1, LEAST_BITS // 64), axis=0)


def differing(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded to the size of the shorter; at most the differing shingles."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _sets(rows: DataFrame, words: int, least: float, levels: np.ndarray, often: np.ndarray) -> DataFrame:
    """(node, digest, n, bits, prefix) of rows (node, text)."""

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            sets = [shingles(x, words) for x in part["text"]]
            bits = [bitmap(s) for s in sets]
            return {
                "node": part["node"],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "n": [len(s) for s in sets],
                "bits": bits,
                "fold": [folded(x) for x in bits],
                "prefix": [prefix(s, least, levels, often).view(np.int64) for s in sets],
            }

        return work

    return map_arrow(rows, "node long, digest binary, n long, bits binary, fold array<long>, prefix array<long>", make)


def _similar(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is ``least`` or more."""

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            kept = []
            for a, b, x, y in zip(part["a"], part["b"], part["x"], part["y"]):
                s, t = shingles(x, words), shingles(y, words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both / (len(s) + len(t) - both) >= least:
                    kept.append((a, b))
            return {"a": [a for a, _ in kept], "b": [b for _, b in kept]}

        return work

    x, y = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), "a long, b long", make)


def _unlike(n: Column, m: Column, least: float) -> Column:
    """How many shingles two sets of n and m may differ in at most."""
    return (1 - least) / (1 + least) * (n + m) + 1e-9


def _close(pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b, m, n, p, q) whose bitmaps allow the similarity."""

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            most = [(1 - least) / (1 + least) * (m + n) + 1e-9 for m, n in zip(part["m"], part["n"])]
            kept = [(a, b) for a, b, p, q, d in zip(part["a"], part["b"], part["p"], part["q"], most) if differing(p, q) <= d]
            return {"a": [a for a, _ in kept], "b": [b for _, b in kept]}

        return work

    return map_arrow(pairs, "a long, b long", make)


def near_groups(df: DataFrame, id_col: str, text_col: str = "text", words: int = WORDS, least: float = LEAST, bucket_bits: int = BUCKET_BITS, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per row of ``df``: (id, root), the same root for what is joined by links of similarity ``least`` or more.

    ``near`` gives pairs (a, b) of a table of nodes, one for each set, that are compared exactly before all
    others; those it links are not compared again. Any pairs give the same groups.

    The ids are distinct longs that do not change when ``df`` is read again. Case and kind of white space
    do not count; texts without words (nulls too) are one group; other columns are not read; an empty
    table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].alias("node"), df[text_col].alias("text"))
    levels = bucket_levels(rows, words, bucket_bits)
    made = stage(spark, _sets(rows, words, least, levels, often_first(rows, words, least, levels)), "sets")
    lows = made.groupBy("digest").agg(F.min("node").alias("low"))
    alike = stage(spark, made.join(lows, "digest").select("node", "low"), "alike")
    firsts = made.where("n > 0").join(alike.where("node = low"), "node", "left_semi")
    distinct = stage(spark, firsts.select("node", "n", "bits", "fold"), "distinct")

    # One exchange: the rows of a shingle pass in order, the first of them beside each.
    tokens = firsts.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "token"))
    in_order = Window.partitionBy("token").orderBy("node")
    first = F.first(F.struct("node", "n", "place")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = tokens.withColumns({"first": first, "after": F.lead("node").over(in_order)}).where("first.node <> node or after is not null").drop("after")
    met = stage(spark, met, "met")
    discard(made)
    # Of shingles under which the same texts meet the first is enough: it is the first common one of any pair that another could be of.
    same = met.groupBy("token").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other"), F.min("first.place").alias("place"))
    kept = same.groupBy("many", "one", "other").agg(F.min_by("token", F.struct("place", "token")).alias("token")).select("token")
    every, met = met, stage(spark, met.join(kept, "token", "left_semi"), "met_once")
    discard(every)

    def allowed(m: str, n: str, i: str, j: str) -> Column:
        """What sizes allow, and the places of a pair's first common shingle: no shingle before it is common."""
        sizes = F.least(m, n) >= least * F.greatest(m, n) - 1e-9
        return sizes & (F.col(i) + F.col(j) <= _unlike(F.col(m), F.col(n), least))

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that bitmaps allow."""
        sides = pairs.join(distinct.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("p")), "a")
        sides = sides.join(distinct.select(F.col("node").alias("b"), "n", F.col("bits").alias("q")), "b")
        return stage(spark, _close(sides.select("a", "b", "m", "n", "p", "q"), least), "candidates")

    links: DataFrame | None = None

    def joined(pairs: DataFrame) -> DataFrame:
        """The roots after the similar ones of these pairs are linked too."""
        nonlocal links
        found = stage(spark, _similar(candidates(pairs), rows, words, least), "similar")
        links = found if links is None else links.union(found)
        return connected_components(links)

    def apart(roots: DataFrame) -> DataFrame:
        """Texts that meet under several roots, and the root of the first of them."""
        placed = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        head = F.max(F.when(F.col("node") == F.col("first.node"), F.col("root"))).alias("head")
        mixed = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), head).where("r0 <> r1")
        return placed.join(mixed.select("token", "head"), "token")

    # As many pairs as texts, then as shingles of texts, then those of all that are still apart.
    ahead = met.where("node <> first.node").groupBy(F.col("node").alias("b")).agg(F.min("first.node").alias("a"))
    if near is not None:
        roots = joined(near(distinct.select("node")))
        of_a, of_b = (roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab")
        ahead = ahead.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    roots = joined(ahead)
    star = apart(roots).where((F.col("root") != F.col("head")) & allowed("n", "first.n", "place", "first.place"))
    roots = joined(star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct())
    # Each brings its small bitmap, so that only what it allows becomes a pair.
    held = apart(roots).join(distinct.select("node", "fold"), "node")
    held = stage(spark, held.select("token", "node", "n", "place", "root", *(F.col("fold")[k].alias(f"f{k}") for k in range(LEAST_BITS // 64))), "open")
    a, b = (held.select(*(F.col(c).alias(f"{c}_{side}") for c in held.columns)) for side in "ab")
    unlike = sum(F.bit_count(F.col(f"f{k}_a").bitwiseXOR(F.col(f"f{k}_b"))) for k in range(LEAST_BITS // 64))
    near = allowed("n_a", "n_b", "place_a", "place_b") & (unlike <= _unlike(F.col("n_a"), F.col("n_b"), least))
    rest = a.join(b, F.expr("token_a = token_b and node_a < node_b and root_a <> root_b") & near)
    roots = joined(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    out = alike.join(roots.withColumnRenamed("node", "low"), "low", "left")
    return out.select(F.col("node").alias(id_col), F.coalesce("root", "low").alias("root"))
