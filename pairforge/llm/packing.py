"""Hierarchical multi-length packing of tokenised documents.

Each task packs its own rows as they stream by. A document is cut into windows of the longest context;
what is left of it is routed to the tier of its length class (256, 512, 1024 or 2048 tokens). Windows of
a tier begin with one of its own pieces; gaps are filled with the largest piece of the same or a shorter
tier that fits, and where none fits the head of the smallest piece closes the window. The less than one
long window that each task has left is packed again together with that of others, TASKS at a time, and
what then remains is cut into windows of ever smaller powers of two, so no sequence is padded.

Training steps are numbered over all tasks: a tier's sequences, in order of tasks, are dealt to groups of
STEP_TOKENS tokens, which are all full but the last of each tier.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stage
from .wordcodec import open_codec

#: Context sizes; tokens of a training step; tokens that may wait in a task's pool; tasks whose rests are packed together.
TIERS, STEP_TOKENS, POOL_TOKENS, TASKS = (256, 512, 1024, 2048), 32_768, 1 << 20, 64
#: Partition number of the first group of rests in sequence ids, above those of tasks.
RESTS = 1 << 22

#: (document, start of the piece, its ids as bytes of 4)
Piece = tuple[int, int, bytes]


class Pool:
    """Waiting pieces by length; a bit mask of lengths finds the largest that fits."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.mask = 0
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        if n:
            self.by_length.setdefault(n, []).append(piece)
            self.mask |= 1 << n
            self.tokens += n

    def _pop(self, n: int) -> Piece:
        held = self.by_length[n]
        piece = held.pop()
        if not held:
            del self.by_length[n]
            self.mask &= ~(1 << n)
        self.tokens -= n
        return piece

    def largest(self, most: int) -> Piece | None:
        below = self.mask & ((1 << (most + 1)) - 1)
        return self._pop(below.bit_length() - 1) if below else None

    def smallest(self) -> Piece:
        return self._pop((self.mask & -self.mask).bit_length() - 1)

    def window(self, size: int) -> list[Piece]:
        """Pieces that fill ``size`` tokens exactly; the pool must hold that many."""
        got, gap = [], size
        while gap:
            piece = self.largest(gap)
            if piece is None:  # all that wait are longer: cut the shortest
                doc, start, ids = self.smallest()
                piece = (doc, start, ids[: 4 * gap])
                self.put((doc, start + gap, ids[4 * gap :]))
            got.append(piece)
            gap -= len(piece[2]) // 4
        return got


class Packer:
    """Turns documents into windows; ``rest`` ends the stream."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS):
        self.tiers, self.pool_tokens, self.pool = sorted(tiers, reverse=True), pool_tokens, Pool()

    def add(self, doc: int, ids: bytes) -> Iterator[list[Piece]]:
        size = 4 * self.tiers[0]
        whole = len(ids) // size
        for k in range(whole):
            yield [(doc, k * self.tiers[0], ids[k * size : (k + 1) * size])]
        self.pool.put((doc, whole * self.tiers[0], ids[whole * size :]))
        if self.pool.tokens >= self.pool_tokens:
            yield from self.drain(self.pool_tokens // 8)

    def drain(self, leave: int) -> Iterator[list[Piece]]:
        """Windows of each tier, long ones first, from pieces of its class, while enough tokens wait."""
        pool = self.pool
        for size in self.tiers:
            own = ((1 << (size + 1)) - 1) & ~((1 << (size // 2 + 1)) - 1)
            while pool.tokens >= max(leave, size) and pool.mask & own:
                yield pool.window(size)

    def rest(self, close: bool = True) -> Iterator[list[Piece]]:
        """The last windows; with ``close`` short ones too, so that nothing is left."""
        yield from self.drain(0)
        size = self.tiers[0]
        while self.pool.tokens >= (1 if close else size):
            while self.pool.tokens >= size:
                yield self.pool.window(size)
            size //= 2

    def left(self) -> Iterator[Piece]:
        while self.pool.tokens:
            yield self.pool.smallest()


class _Rows:
    """Rows of placed pieces and of pieces that are left (tier 0), with the numbers of their sequences."""

    def __init__(self, schema: pa.Schema, with_ids: bool):
        self.schema, self.with_ids, self.rows = schema, with_ids, []
        self.sequence, self.made = 0, {}

    def place(self, windows: Iterator[list[Piece]], of, part: int) -> None:
        for pieces in windows:
            size = sum(len(p[2]) for p in pieces) // 4
            number = self.made[size] = self.made.get(size, -1) + 1
            offset = 0
            for doc, start, ids in pieces:
                n, (key, tokens) = len(ids) // 4, of(doc, len(ids) // 4)
                self.rows.append((key, start, n, crc32(ids), tokens, part, self.sequence, offset, size, number, ids if self.with_ids else None))
                offset += n
            self.sequence += 1

    def leave(self, pieces: Iterator[Piece], of, part: int) -> None:
        for doc, start, ids in pieces:
            key, tokens = of(doc, len(ids) // 4)
            self.rows.append((key, start, len(ids) // 4, 0, tokens, part, 0, 0, 0, 0, ids))

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows.clear()
        return batch


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids).

    ``ids`` are the piece's ids as little-endian unsigned 32-bit bytes; left out unless ``with_ids``.
    ``tier`` is the sequence's length. A null text is the document that has only its end id; null ids,
    repeated ids and repeated rows are documents of their own; other columns are not read. An empty table
    gives no rows. A very long text is encoded whole, its ids (4 bytes each) are held until they are
    written. The pieces are written to the shared folder once, as the rests of tasks are packed again.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, sequence long, offset long, tier int, number long, ids binary"
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer, made = open_codec(tokenizer), Packer(tiers), _Rows(out, with_ids)
        part = TaskContext.get().partitionId()
        waiting: dict[int, list] = {}  # document number -> [id, tokens, tokens not yet placed]
        number = 0

        def of(doc: int, n: int) -> tuple:
            held = waiting[doc]
            if held[2] == n:
                del waiting[doc]
            held[2] -= n
            return held[0], held[1]

        for batch in batches:
            for rows in slices(batch):
                for key, ids in zip(rows["id"], codec.encode(rows["text"])):
                    ids += end
                    waiting[number] = [key, len(ids) // 4, len(ids) // 4]
                    made.place(packer.add(number, ids), of, part)
                    number += 1
                if made.rows:
                    yield made.flush()
        made.place(packer.rest(close=False), of, part)
        made.leave(packer.left(), of, part)
        if made.rows:
            yield made.flush()

    def again(table: pa.Table) -> pa.Table:
        packer, made, rows = Packer(tiers), _Rows(out, with_ids), table.to_pydict()
        of = lambda doc, n: (rows["id"][doc], rows["doc_tokens"][doc])
        part = RESTS + rows["part"][0] // TASKS
        for i, (start, ids) in enumerate(zip(rows["start"], rows["ids"])):
            packer.pool.put((i, start, ids))
        made.place(packer.rest(), of, part)
        return pa.Table.from_batches([made.flush()])

    ship(spark)
    first = stage(spark, df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema), "pieces")
    # Of each task less than one long window is left, so a group of TASKS is small whatever the table.
    rest = first.where("tier = 0").groupBy(F.floor(F.col("part") / TASKS).alias("group")).applyInArrow(again, schema)
    both = first.where("tier > 0").unionByName(stage(spark, rest, "rests"))

    # One row for each task and tier: where the task's sequences begin among all of the tier.
    counts = both.groupBy("tier", "part").agg((F.max("number") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("tier", "part", F.coalesce(before, F.lit(0)).alias("begins"))
    # Short sequences come from groups of rests alone, less than one long window from each.
    shorts = F.floor((F.col("part") - RESTS) / (step_tokens // max(tiers)))
    step = F.when(F.col("tier") < min(tiers), shorts).otherwise(F.shiftleft(F.col("tier").cast("long"), 40) + F.floor((F.col("begins") + F.col("number")) * F.col("tier") / step_tokens))
    done = both.join(begins, ["tier", "part"])
    columns = ["start", "length", "ids_crc32", "doc_tokens", F.shiftleft("part", 40).bitwiseOR(F.col("sequence")).alias("sequence_id"), "offset", "tier", step.alias("step_group")]
    return done.select(F.col("id").alias(id_col), *columns, *(["ids"] if with_ids else []))
