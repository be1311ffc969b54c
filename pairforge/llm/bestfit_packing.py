"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most ``capacity`` tokens, all full but the first; full pieces are
sequences of their own. The others are items, dealt to blocks of ``BLOCK_ITEMS``. Each block is evolved on
ISLANDS islands, each a row that Spark deals to some task: an island founds its own best-fit packings, and
crossover injects whole well-filled bins of one parent into the other, drops that parent's bins with
duplicates, and best-fits the displaced items (``grouping_ga``). After each epoch the islands' populations
are written, and every island receives the best packing of the one before it in the ring, until a packing is
proven to be as small as any can be, or EPOCHS have passed.

Of a block's best packing the emptiest bins are opened again; their items meet those of about MERGE other
blocks in a block of the next level, which is evolved in the same way, until one block is left.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytecodec import open_byte_codec
from .common import map_arrow, ship, slices, stage
from .grouping_ga import Packing, evolve, fitness, founders, least_bins

CAPACITY, END_ID = 1024, 2
#: Items of a block; islands of a block, packings of an island, crossovers between migrations, migrations and one.
BLOCK_ITEMS, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 8192, 3, 5, 12, 2
#: Items that a block passes to the next level at most; blocks that meet there.
RELEASE, MERGE = 128, 64

_ISLAND = "block long, island int, lengths array<int>, least int, bins int, score long, population array<binary>"


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of each piece: all have ``capacity`` ids but the first, which holds the rest."""
    n = len(ids) // 4
    start = 0
    end = n % capacity or capacity
    while start < n:
        yield start, ids[4 * start : 4 * end]
        start, end = end, end + capacity


def _pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"part long, idx long, id {kind}, piece int, start long, length long, ids_crc32 long, block long, ids binary"
    out, end = to_arrow_schema(T.StructType.fromDDL(schema)), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, idx, items = open_byte_codec(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for rows in slices(batch):
                made = []
                for key, ids in zip(rows["id"], codec.encode(rows["text"])):
                    for piece, (start, own) in enumerate(cut(ids + end, capacity)):
                        n = len(own) // 4
                        block = None if n == capacity else part << 16 | items // BLOCK_ITEMS
                        items += block is not None
                        made.append((part, idx, key, piece, start, n, crc32(own), block, own if with_ids else None))
                        idx += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    ship(df.sparkSession)
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)


def _dump(packing: Packing, n: int) -> bytes:
    of = array("i", bytes(4 * n))
    for b, held in enumerate(packing[0]):
        for i in held:
            of[i] = b
    return of.tobytes()


def _load(raw: bytes, lengths: list[int]) -> Packing:
    of = array("i", raw)
    bins, fills = [[] for _ in range(max(of) + 1)], [0] * (max(of) + 1)
    for i, b in enumerate(of):
        bins[b].append(i)
        fills[b] += lengths[i]
    return bins, fills


def _island_row(block: int, island: int, lengths: list[int], least: int, population: list[Packing]) -> tuple:
    bins, score = fitness(population[0])
    return block, island, lengths, least, -bins, score, [_dump(p, len(lengths)) for p in population]


def _columns(rows: list[tuple], names: list[str]) -> dict[str, list]:
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _evolved(blocks: DataFrame, count: int, capacity: int) -> DataFrame:
    """(block, elite): the best packing of each of the ``count`` blocks, as bin numbers of its items."""
    spark = blocks.sparkSession
    names = [f.name for f in T.StructType.fromDDL(_ISLAND)]
    # The rows are few bytes and many seconds: a stated number of partitions keeps them from being drawn together.
    islands = max(1, count * ISLANDS)
    tasks = min(islands, max(int(spark.conf.get("spark.sql.shuffle.partitions")), islands // 16))

    def found():
        def work(rows: dict[str, list]) -> dict[str, list]:
            made = []
            for block, island, lengths in zip(rows["block"], rows["island"], rows["lengths"]):
                rnd, least = random.Random(f"{block} {island}"), least_bins(lengths, capacity)
                population = founders(lengths, capacity, POPULATION, rnd)
                made.append(_island_row(block, island, lengths, least, evolve(population, lengths, capacity, GENERATIONS, rnd)))
            return _columns(made, names)

        return work

    def again(epoch: int):
        def make():
            def work(rows: dict[str, list]) -> dict[str, list]:
                made = []
                for block, island, lengths, least, packed, migrant in zip(*(rows[n] for n in ("block", "island", "lengths", "least", "population", "migrant"))):
                    population = [_load(p, lengths) for p in [*packed[:-1], migrant]]
                    made.append(_island_row(block, island, lengths, least, evolve(population, lengths, capacity, GENERATIONS, random.Random(f"{block} {island} {epoch}"))))
                return _columns(made, names)

            return work

        return make

    bare = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths")
    state = stage(spark, map_arrow(bare.repartition(tasks, "block", "island"), _ISLAND, found), "islands")
    states = [state]
    for epoch in range(1, EPOCHS):
        open_blocks = state.groupBy("block").agg(F.min(F.col("bins") - F.col("least")).alias("over")).where("over > 0").select("block")
        own = state.join(open_blocks, "block", "left_semi")
        sent = own.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("population")[0].alias("migrant"))
        state = stage(spark, map_arrow(own.join(sent, ["block", "island"]).repartition(tasks, "block", "island"), _ISLAND, again(epoch)), "islands")
        states.append(state)
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    order = F.struct(-F.col("bins"), F.col("score"), -F.col("island"))
    return every.groupBy("block").agg(F.max_by(F.col("population")[0], order).alias("elite"))


def pack_best_fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset, ids).

    ``ids`` are the piece's ids as little-endian unsigned 32-bit bytes; left out unless ``with_ids``. A null
    text is the document that has only its end id; null ids, repeated ids and repeated rows are documents of
    their own; other columns are not read. An empty table gives no rows. A very long text is encoded whole
    and its ids (4 bytes each) are held until its pieces are cut. Items of equal length are told apart by
    where they came from; the same input in the same partitions gives the same sequences. The pieces are
    written to the shared folder once, as are the islands of each epoch.
    """
    spark = df.sparkSession
    pieces = stage(spark, _pieces(df, id_col, text_col, tokenizer, end_id, capacity, with_ids), "pieces")
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    full = pieces.where("block is null").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.shiftleft("part", 34).bitwiseOR(F.col("idx")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")

    items = pieces.where("block is not null").select("block", "part", "idx", F.col("length").cast("int").alias("length"))
    placed, level = [], 0
    while True:
        level += 1
        held = F.sort_array(F.collect_list(F.struct("part", "idx", "length")))
        blocks = stage(spark, items.groupBy("block").agg(held.alias("items")), "blocks")
        count = blocks.count()
        groups, last = -(-count // MERGE), count <= 1
        best = _evolved(blocks.select("block", F.col("items.length").alias("lengths")), count, capacity)
        solved = stage(spark, map_arrow(blocks.join(best, "block"), "part long, idx long, length int, sequence_id long, offset long, block long", _open(level, capacity, last)), "placed")
        placed.append(solved.where("sequence_id is not null").select("part", "idx", "sequence_id", "offset"))
        if last:
            break
        items = solved.where("sequence_id is null").select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("block"), "part", "idx", "length")
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    rest = pieces.where("block is not null").join(every, ["part", "idx"]).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    return full.unionByName(rest).select(id_col, *columns)


def _open(level: int, capacity: int, last: bool):
    """Places of the items in the closed bins of each block; items of the emptiest bins, up to RELEASE, have none."""

    def make():
        def work(rows: dict[str, list]) -> dict[str, list]:
            made = []
            for block, items, elite in zip(rows["block"], rows["items"], rows["elite"]):
                lengths = [x["length"] for x in items]
                bins, fills = _load(elite, lengths)
                left, freed = RELEASE, set()
                for b in sorted(range(len(bins)), key=lambda b: fills[b]) if not last else ():
                    if fills[b] == capacity or len(bins[b]) > left:
                        break
                    freed.add(b)
                    left -= len(bins[b])
                for b, held in enumerate(bins):
                    offset, sequence = 0, None if b in freed else level << 58 | block << 14 | b
                    for i in held:
                        made.append((items[i]["part"], items[i]["idx"], lengths[i], sequence, None if sequence is None else offset, block))
                        offset += lengths[i]
            return _columns(made, ["part", "idx", "length", "sequence_id", "offset", "block"])

        return work

    return make
