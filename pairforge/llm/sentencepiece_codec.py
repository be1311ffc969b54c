"""SentencePiece encoding and decoding by streaming Viterbi.

``StreamingViterbi`` reads characters as they come. Scores are kept for the last positions that a
piece can still begin at (a window of the longest piece); back pointers are followed from all of them,
and once the paths meet in one boundary the ids before it are committed and forgotten. A segment that
begins with a blank after something else starts a new window, as no piece of the model spans it
(checked when the model is opened); ids of such segments are remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import map_arrow
from .wordcodec import resolve

BLANK = "▁"
INFINITE = float("inf")
#: Added to the worst score for a character that no piece has; positions between two looks for a meeting point.
UNKNOWN_PENALTY, LOOK = 10.0, 64
#: Longest segment that is remembered, and how many are.
REMEMBERED, SEGMENTS = 64, 900_000


class Model:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, model: str = "piece_bpe_32k.model"):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        sp = sentencepiece.SentencePieceProcessor(model_file=resolve(model))
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(size)]
        self.unknown = sp.unk_id()
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not special[i] and not sp.is_byte(i)]
        self.prefix = sp.encode(" ", out_type=str)[:1] != []  # a dummy blank is put before every text
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids), default=1)
        #: Character -> (score of the piece that ends here or None, what may follow).
        self.trie: dict[str, tuple] = {}
        nodes = {"": self.trie}
        for name in sorted({x[:k] for x in self.ids for k in range(1, len(x) + 1)}, key=len):
            nodes[name] = {}
            nodes[name[:-1]][name[-1]] = (self.scores.get(name), nodes[name])
        self.worst = min((sp.get_score(i) for i in plain), default=0.0) - UNKNOWN_PENALTY
        self.blanks_lead = not any(a != BLANK and b == BLANK for x in self.ids for a, b in zip(x, x[1:]))
        self.lines_part = self.blanks_lead and not any("\n" in x for x in self.ids)
        self.surface = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(BLANK, " ").encode() for i in range(size)]
        self.surface[self.unknown] = " ⁇ ".encode()
        proto = pb.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        spec = proto.normalizer_spec
        # All the model's normaliser does is to write blanks its own way and to put one first.
        self.identity = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        self.normalize = sp.normalize

    def spelled(self, text: str) -> str:
        """The text as the model sees it."""
        if not text:
            return ""
        return BLANK + text.replace(" ", BLANK) if self.identity else self.normalize(text)

    def piece_ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


class StreamingViterbi:
    """Best path over characters fed in any portions; yields ids as soon as they are certain."""

    def __init__(self, model: Model):
        self.model, self.text, self.best, self.back = model, "", [0.0], [0]
        self.done = 0  # starts whose pieces have all been tried

    def feed(self, characters: str) -> Iterator[int]:
        self.text += characters
        self.best += [-INFINITE] * len(characters)
        self.back += [0] * len(characters)
        # A start can be tried once the longest piece from it is in sight.
        while self.done + self.model.longest <= len(self.text):
            self._try(min(len(self.text) - self.model.longest + 1, self.done + LOOK))
            yield from self._commit(range(self.done, min(self.done + self.model.longest, len(self.text)) + 1))

    def end(self) -> list[int]:
        """The ids that are left; the end of the text is the boundary in which all paths meet."""
        self._try(len(self.text))
        ids = self._path(len(self.text))
        self.text, self.best, self.back, self.done = "", [0.0], [0], 0
        return ids

    def _path(self, at: int) -> list[int]:
        text, back, ids, known = self.text, self.back, [], self.model.ids
        while at:
            before = back[at]
            piece = text[before:at]
            if (i := known.get(piece)) is not None:
                ids.append(i)
            else:
                ids += reversed(self.model.piece_ids(piece))
            at = before
        ids.reverse()
        return ids

    def _try(self, stop: int) -> None:
        text, best, back, root, longest, worst = self.text, self.best, self.back, self.model.trie, self.model.longest, self.model.worst
        for a in range(self.done, stop):
            base, b, follow = best[a], a, root
            for ch in text[a : a + longest]:
                got = follow.get(ch)
                if got is None:
                    break
                score, follow = got
                b += 1
                if score is not None and base + score > best[b]:
                    best[b], back[b] = base + score, a
            if (alone := root.get(text[a])) is None or alone[0] is None:
                if base + worst > best[a + 1]:
                    best[a + 1], back[a + 1] = base + worst, a
        self.done = stop

    def _commit(self, live: Iterable[int]) -> Iterator[int]:
        """Ids before the boundary in which the paths from all ``live`` positions that are reached meet."""
        open_ends = {x for x in live if self.best[x] != -INFINITE}
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.discard(last)
            open_ends.add(self.back[last])
        meet = open_ends.pop()
        if not meet:
            return
        yield from self._path(meet)
        base = self.best[meet]
        self.text, self.done = self.text[meet:], self.done - meet
        self.best = [x - base for x in self.best[meet:]]
        self.back = [max(0, x - meet) for x in self.back[meet:]]


class Codec:
    """Ids of whole texts and texts of ids."""

    def __init__(self, model: str):
        self.model = Model(model)
        self.known: dict[str, bytes] = {}
        self.short = StreamingViterbi(self.model)
        after = {b for x in self.model.ids for a, b in zip(x, x[1:]) if a.isalpha()}
        self.tails = "".join(c for c in ".,;:!?|%&$*#" if c not in after)
        self.split = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" if self.model.lines_part else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if self.model.blanks_lead else "(?s:.+)")

    def _segment(self, segment: str) -> bytes:
        if len(segment) > REMEMBERED:
            return b"".join(self._long(StreamingViterbi(self.model), segment))
        known = self.known
        if len(known) >= SEGMENTS:
            known.clear()
        base = segment.rstrip(self.tails)
        if base != segment and base and base[-1].isalpha():  # no piece has a letter before such a mark
            tail = segment[len(base) :]
            held = known[segment] = (known.get(base) or self._segment(base)) + (known.get(tail) or self._segment(tail))
            return held
        # A short segment is a single window: its paths meet at its end alone.
        stream, size = self.short, len(segment)
        stream.text, stream.best, stream.back = segment, [0.0] + [-INFINITE] * size, [0] * (size + 1)
        held = known[segment] = array("i", stream.end()).tobytes()
        return held

    @staticmethod
    def _long(stream: StreamingViterbi, segment: str) -> Iterator[bytes]:
        for at in range(0, len(segment), 1024):
            yield array("i", stream.feed(segment[at : at + 1024])).tobytes()
        yield array("i", stream.end()).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit bytes; none for an empty text or a null."""
        segments = self.split.findall(self.model.spelled(text or ""))
        try:
            return b"".join(map(self.known.__getitem__, segments))
        except KeyError:
            get = self.known.get
            return b"".join(self._segment(s) if (held := get(s)) is None else held for s in segments)

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        size, surface = len(self.model.surface), self.model.surface
        raw = b"".join(surface[i if 0 <= i < size else self.model.unknown] for i in ids)
        text = raw.decode("utf-8", "replace") if b"\xed" not in raw else raw.decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") and self.model.prefix else text


@lru_cache(maxsize=2)
def open_model(model: str) -> Codec:
    return Codec(model)


def _kept(df: DataFrame, keep: tuple[Column, ...]) -> tuple[list[str], list[Column]]:
    names = [f"keep_{i}" for i in range(len(keep))]
    return names, [c.alias(n) for c, n in zip(keep, names)]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``df``: (id, keep_0 ..., ids array<int>).

    The best-scored segmentation, ties to the longer piece that begins first; characters without a
    piece become their UTF-8 byte pieces. A null or empty text has no ids. Null ids and repeated rows
    are kept; other columns are not read; an empty table gives no rows. Of a very long text the window
    holds some longest pieces, and its ids are one value of the column. Map-side only.
    """
    names, kept = _kept(df, keep)
    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *kept)
    types = "".join(f"{n} {picked.schema[n].dataType.simpleString()}, " for n in names)

    def make():
        codec = open_model(model)

        def work(part: dict[str, list]) -> dict[str, list]:
            held = [codec.encode(x) for x in part["text"]]
            offsets = np.cumsum([0, *(len(x) // 4 for x in held)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(held), "<i4")))
            return {"id": part["id"]} | {n: part[n] for n in names} | {"ids": ids}

        return work

    return map_arrow(picked, f"id {df.schema[id_col].dataType.simpleString()}, {types}ids array<int>", make).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "piece_bpe_32k.model", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``df``: (id, keep_0 ..., decoded); null ids give null, ids out of range the unknown mark.

    Repeated rows and null ids are kept; other columns are not read; an empty table gives no rows.
    """
    names, kept = _kept(df, keep)
    picked = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"), *kept)
    types = "".join(f"{n} {picked.schema[n].dataType.simpleString()}, " for n in names)

    def make():
        codec = open_model(model)

        def work(part: dict[str, list]) -> dict[str, list]:
            return {"id": part["id"]} | {n: part[n] for n in names} | {"decoded": [codec.decode(x) for x in part["ids"]]}

        return work

    return map_arrow(picked, f"id {df.schema[id_col].dataType.simpleString()}, {types}decoded string", make).withColumnRenamed("id", id_col)
