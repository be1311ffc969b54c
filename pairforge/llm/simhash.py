"""SimHash near-duplicates with pivot distance tables.

The Hamming distances of every distinct fingerprint to PIVOTS reference fingerprints are computed once
and stored: its row of the pivot table. By the triangle inequality a pair whose distances to any pivot
differ by more than the radius is discarded; only survivors are verified by their differing bits.

Which rows of the table are compared at all is decided by the pigeonhole principle, as distances of
hashes lie too close together to tell far ones apart by a join: of four 16-bit segments at least two are
equal in any pair that differs in two bits, so pairs meet under one of six 32-bit keys. Blocks of more
than BLOCK fingerprints are dealt anew by 28 keys over their other 32 bits (six of eight nibbles equal),
which leaves 256 at most. Blocks give spanning links, not pairs; components are built from those.

``similar_groups`` uses the same steps at WIDE bits over runs of WIDE_WORDS words, where near copies lie
closer together, and has an exact check of the similarity of sets follow (``jaccard``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.session import discard

from . import jaccard
from .common import map_arrow, ship, stage
from .components import connected_components

#: Differing bits of a link; pivots; fingerprints of a block that are compared at once; hashes summed at once.
RADIUS, PIVOTS, BLOCK, SUMMED = 2, 32, 1024, 1 << 16
SEED, WORDS = 42, 3
#: The same of groups by similarity: differing bits, words of a run, fingerprints of a block that are compared at once.
WIDE, WIDE_WORDS, WIDE_BLOCK = 4, 2, 4096


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, spread over the whole space."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, seed=SEED) for i in range(count)], dtype=np.uint64)


def fingerprint_of(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no word."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(split)
    if not n:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1) - 1
    k = min(words, n)
    last = ends[k - 1 :]
    first = np.r_[0, ends[: n - k] + 1]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), SUMMED):
        h = [digest(joined[a:b], seed) for a, b in zip(first[at : at + SUMMED].tolist(), last[at : at + SUMMED].tolist())]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0]
    return int(value)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row: (id, fp) with the fingerprint as a signed long; a null text has fingerprint 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            found = [fingerprint_of(x, words) for x in part["text"]]
            return {"id": part["id"], "fp": [x - (1 << 64) if x >> 63 else x for x in found]}

        return work

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return map_arrow(picked, f"id {kind}, fp long", make).withColumnRenamed("id", id_col)


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """Six keys: the numbers of two 16-bit segments above their 32 bits."""
    return F.array(*(F.shiftleft(_bits(fp, 16 * a, 16), 16).bitwiseOR(_bits(fp, 16 * b, 16)).bitwiseOR(F.lit(i << 32)) for i, (a, b) in enumerate(combinations(range(4), 2))))


def _sub_keys(fp: Column, key: Column) -> Column:
    """28 keys over the 32 bits that ``key`` leaves open: six of their eight nibbles."""
    halves = list(combinations(range(4), 2))
    rest = F.lit(0).cast("long")
    for i, own in enumerate(halves):
        a, b = (x for x in range(4) if x not in own)
        open_bits = F.shiftleft(_bits(fp, 16 * a, 16), 16).bitwiseOR(_bits(fp, 16 * b, 16))
        rest = F.when(F.shiftrightunsigned(key, 32) == i, open_bits).otherwise(rest)
    keys = []
    for i, out in enumerate(combinations(range(8), 2)):
        mask = (1 << 32) - 1
        for x in out:
            mask &= ~(15 << 4 * x)
        keys.append(rest.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(i << 32)))
    return F.array(*keys)


def coordinates(fp: Column) -> Column:
    """The row of the pivot table: distances to all pivots, array<tinyint>."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p).cast("long"))).cast("tinyint") for p in pivots().view(np.int64).tolist()))


def link_blocks(values: np.ndarray, sizes: np.ndarray, coords: np.ndarray, radius: int = RADIUS, tally: Counter | None = None) -> Iterator[tuple[int, int]]:
    """Spanning links within blocks that stand one after the other in ``values`` (unsigned), with their rows of the pivot table.

    ``tally`` counts the pairs that ``met``, that the pivots ``left``, and that are ``near``.
    """
    ends = np.repeat(np.cumsum(sizes), sizes)
    order = np.arange(len(values))
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for step in range(1, int(sizes.max(initial=1))):
        left = order[: len(order) - step][order[step:] < ends[: len(order) - step]]
        met = len(left)
        for p in range(coords.shape[1]):  # the largest coordinate difference, one pivot after the other
            if not len(left):
                break
            left = left[np.abs(coords[left, p] - coords[left + step, p]) <= radius]
        passed = len(left)
        left = left[np.bitwise_count(values[left] ^ values[left + step]) <= radius]
        if tally is not None:
            tally.update(met=met, left=passed, near=len(left))
        for a in left.tolist():
            x, y = find(a), find(a + step)
            if x != y:
                parent[y] = x
                yield a, a + step


def _links(blocks: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows that hold a block each, ``rows array<struct<fp, c>>``."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 2048):
                part = column.slice(at, 2048)
                fp, c = part.flatten().flatten()
                values = fp.to_numpy(zero_copy_only=False).view(np.uint64)
                coords = c.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
                found = np.array(list(link_blocks(values, np.diff(part.offsets.to_numpy()), coords, radius)), np.int64).reshape(-1, 2)
                signed = values.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[found[:, 0]]), pa.array(signed[found[:, 1]])], schema=out)

    ship(blocks.sparkSession)
    return blocks.select("rows").mapInArrow(run, "a long, b long")


def near_links(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span every component of distinct fingerprints at RADIUS differing bits or fewer.

    ``table``: (fp, c), the pivot table with one row for each fingerprint.
    """
    keyed = table.select("fp", "c", F.explode(_keys(F.col("fp"))).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, "key")
    small = met.where(F.col("n") <= block).groupBy("key").agg(F.collect_list(F.struct("fp", "c")).alias("rows"))
    large = met.where(F.col("n") > block).select("key", "fp", "c", F.explode(_sub_keys(F.col("fp"), F.col("key"))).alias("sub"))
    large = large.groupBy("key", "sub").agg(F.collect_list(F.struct("fp", "c")).alias("rows")).where(F.size("rows") > 1)
    return _links(small.select("rows").union(large.select("rows")), RADIUS)


def _mask(bits: list[int]) -> int:
    """A signed long with these bits."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * p // parts : len(bits) * (p + 1) // parts] for p in range(parts)]


def wide_links(table: DataFrame, radius: int = WIDE, block: int = WIDE_BLOCK) -> DataFrame:
    """As ``near_links`` for any radius under eight, (a, b) once each.

    Of ``radius`` + 2 segments two at least are equal, so pairs meet under the bits of any two. Larger blocks
    are dealt anew by their open bits in eight parts, of which ``radius`` differ at most. Keys travel without
    rows of the pivot table; only fingerprints that meet another fetch theirs.
    """
    every, keys, subs = list(range(64)), [], []
    for i, pair in enumerate(combinations(_cut(every, radius + 2), 2)):
        own = sum(pair, [])
        keys.append(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(own)).cast("long")).alias("bits")))
        parts = _cut([b for b in every if b not in own], 8)
        subs += [(i, j, _mask(sum(chosen, []))) for j, chosen in enumerate(combinations(parts, 8 - radius))]
    keyed = table.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")
    counts = keyed.groupBy("i", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, ["i", "bits"]).join(table, "fp")
    rows = F.collect_list(F.struct("fp", "c")).alias("rows")
    small = met.where(F.col("n") <= block).groupBy("i", "bits").agg(rows)
    # As many rows as there are sub-keys: about a thousand, whatever the tables.
    masks = table.sparkSession.createDataFrame(subs, "i int, j int, mask long")
    large = met.where(F.col("n") > block).join(F.broadcast(masks), "i").withColumn("sub", F.col("fp").bitwiseAND(F.col("mask")))
    large = large.groupBy("i", "bits", "j", "sub").agg(rows).where(F.size("rows") > 1)
    found = _links(small.select("rows").union(large.select("rows")), radius)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``df``: (id, fingerprint, component_id, n_same).

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id reachable over links
    of at most RADIUS differing bits, equal fingerprints included; ``n_same`` how many rows have this
    very fingerprint. Texts without words (nulls too) have fingerprint zero and link like any other.
    Rows with a null id get one too; null only if no row they reach has an id. Repeated rows are kept;
    other columns are not read; an empty table gives no rows. Very long texts are hashed SUMMED shingles
    at a time.
    """
    spark = df.sparkSession
    made = stage(spark, fingerprints(df, id_col, text_col, words), "fingerprints")
    # Copies meet here, before anything is compared: one row of the pivot table per distinct fingerprint.
    distinct = made.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n_same"))
    distinct = stage(spark, distinct.withColumn("c", coordinates(F.col("fp"))), "pivot_table")
    roots = connected_components(near_links(distinct.select("fp", "c")))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", "n_same", F.coalesce("root", "fp").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = placed.join(lows, "root").select("fp", "n_same", "component_id")
    return made.join(labels, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def similar_groups(df: DataFrame, id_col: str, text_col: str = "text", words: int = jaccard.WORDS, similarity: float = jaccard.LEAST) -> DataFrame:
    """(id, root): the groups of texts linked by a Jaccard similarity of ``similarity`` over runs of ``words`` words.

    Of texts with different sets fingerprints are taken and their rows of the pivot table stored; what lies
    within WIDE bits after the pivots have discarded the rest is compared exactly, and so are texts of one
    fingerprint. The bits of a SimHash bound no similarity of sets (at 0.8 they differ in up to twenty of 64),
    so texts that are still apart follow by an exact way that loses no link: ``jaccard``, which also says
    what holds of nulls, empty texts, repeated rows, other columns and empty tables.
    """
    spark = df.sparkSession
    made = stage(spark, fingerprints(df, id_col, text_col, WIDE_WORDS), "fingerprints").withColumnRenamed(id_col, "node")

    def near(nodes: DataFrame) -> DataFrame:
        held = stage(spark, made.join(nodes, "node", "left_semi"), "held")
        lows = held.groupBy("fp").agg(F.min("node").alias("low"))
        table = stage(spark, lows.withColumn("c", coordinates(F.col("fp"))), "pivot_table")
        low_a, low_b = (table.select(F.col("fp").alias(side), F.col("low").alias(f"low_{side}")) for side in "ab")
        far = wide_links(table.select("fp", "c")).join(low_a, "a").join(low_b, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
        same = held.join(lows, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
        found = stage(spark, far.union(same), "near")
        for used in (made, held, table):
            discard(used)
        return found

    return jaccard.near_groups(df, id_col, text_col, words, similarity, near=near)
