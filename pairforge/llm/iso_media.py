"""Media columns: ISO base media (MP4-family) containers as binary columns.

``read_media`` walks the nested boxes of each file, decodes the sample tables (of movie fragments too) and
gives codec, duration and the byte ranges of keyframes without decoding a payload. Edit lists are not
applied: all that is stored counts. ``store_media`` writes bytes
as an uncompressed video track of 8x8 RGB frames (192 samples of 8 bits each), so that any text can
be a lossless media file with real sample tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_arrow

#: A frame of 8x8 pixels with three 8-bit samples; frames a chunk, between keyframes, a second.
FRAME, CHUNK, GOP, RATE = 192, 32, 12, 24
#: Boxes that hold only boxes.
NESTED = frozenset((b"moov", b"mdia", b"minf", b"stbl", b"dinf", b"mvex"))
#: The identity matrix of track and movie headers, in 16.16 and 2.30 fixed point.
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_media(payload: bytes, frame: int = FRAME, chunk: int = CHUNK, gop: int = GOP, rate: int = RATE) -> bytes:
    """An ISO media file whose only track stores ``payload``, whole frames of ``frame`` bytes."""
    n, odd = divmod(len(payload), frame)
    if odd or not n:
        raise ValueError("the payload must be a positive multiple of the frame size")
    chunks, last = -(-n // chunk), n % chunk or chunk
    big = len(payload) >= 1 << 31

    def header(first: int) -> bytes:
        runs = [(1, chunk if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != chunk else [])
        keys = np.arange(1, n + 1, gop, dtype=">u4")
        at = first + np.arange(chunks, dtype=np.uint64) * np.uint64(chunk * frame)
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8), struct.pack(">III", 72 << 16, 72 << 16, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1))
        table = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *x) for x in runs)),
            full(b"stsz", 0, struct.pack(">II", frame, n)),
            full(b"co64", 0, struct.pack(">I", chunks), at.astype(">u8").tobytes()) if big else full(b"stco", 0, struct.pack(">I", chunks), at.astype(">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)),
            full(b"hdlr", 0, struct.pack(">I4s", 0, b"vide"), bytes(12), b"pairs\0"),
            box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), table),
        )
        track = box(b"trak", full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), UNITY, struct.pack(">II", 8 << 16, 8 << 16)), media)
        movie = full(b"mvhd", 0, struct.pack(">IIII", 0, 0, rate, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ") + box(b"moov", movie, track)

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if big else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return header(len(header(0)) + len(head)) + head + payload


def boxes(data: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the content) of the boxes between ``at`` and ``end``; ValueError if one is cut off."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError(f"{end - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"box at {at} is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise ValueError(f"box at {at} has size {size}")
        yield kind, at + head, at + size
        at += size


@dataclass
class Track:
    """What the tables of a track say; offsets and lengths are bytes of the file."""

    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Duration, size and flags of a fragment's samples, unless it has its own.
    defaults: tuple[int, int, int] = (0, 0, 0)

    def extend(self, offsets: np.ndarray, sizes: np.ndarray, keys: np.ndarray, duration: int, file_size: int) -> None:
        """Samples of a movie fragment, after those there are."""
        if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > file_size):
            raise ValueError("a sample lies outside the file")
        self.duration = (self.duration if len(self.sizes) else 0) + duration
        self.keyframes = np.r_[self.keyframes, keys + len(self.sizes)]
        self.offsets, self.sizes = np.r_[self.offsets, offsets], np.r_[self.sizes, sizes]

    def runs(self) -> list[tuple[int, int]]:
        """Byte ranges of all samples in order, neighbours merged."""
        if not len(self.sizes):
            return []
        ends = self.offsets + self.sizes
        first = np.flatnonzero(np.r_[True, self.offsets[1:] != ends[:-1]])
        last = np.r_[first[1:] - 1, len(self.sizes) - 1]
        return list(zip(self.offsets[first].tolist(), ends[last].tolist()))


def _table(data: memoryview, at: int, end: int, kind: str, width: int, skip: int = 4) -> np.ndarray:
    """The rows of a counted table after its version and flags."""
    count = struct.unpack_from(">I", data, at + skip)[0]
    size = np.dtype(kind).itemsize * width
    if at + skip + 4 + count * size > end:
        raise ValueError(f"table at {at} is cut off")
    return np.frombuffer(data, kind, count * width, at + skip + 4).astype(np.int64).reshape(count, width)


def _sizes(data: memoryview, found: dict[bytes, tuple[int, int]], file_size: int) -> np.ndarray:
    """Sample sizes: one for all, a table, or a compact table of 4, 8 or 16 bits."""
    if b"stsz" in found:
        at, end = found[b"stsz"]
        uniform, count = struct.unpack_from(">II", data, at + 4)
        return np.full(count, uniform, np.int64) if uniform and count <= file_size // uniform else _table(data, at, end, ">u4", 1, 8)[:, 0]
    at, end = found[b"stz2"]
    bits, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16) or at + 12 + -(-count * bits // 8) > end:
        raise ValueError(f"compact size table at {at} is cut off")
    raw = np.frombuffer(data, ">u2" if bits == 16 else "u1", count if bits > 4 else -(-count // 2), at + 12).astype(np.int64)
    return raw if bits > 4 else np.stack([raw >> 4, raw & 15], 1).ravel()[:count]


def _fragment(data: memoryview, start: int, at: int, end: int, tracks: dict[int, Track]) -> None:
    """Add the samples of a movie fragment that begins at ``start``."""
    after = start
    for kind, a, b in boxes(data, at, end):
        if kind != b"traf":
            continue
        track, (duration, size, flags), base, begin = None, (0, 0, 0), None, after
        for kind, c, d in boxes(data, a, b):
            if kind == b"tfhd":
                told, number = struct.unpack_from(">II", data, c)
                if (track := tracks.get(number)) is None:
                    raise ValueError(f"a fragment of track {number}, which the movie doesn't have")
                duration, size, flags = track.defaults
                c += 8
                if told & 1:
                    base = struct.unpack_from(">Q", data, c)[0]
                elif told & 0x20000:
                    base = start
                c += 8 * (told & 1) + 4 * (told >> 1 & 1)
                own = [duration, size, flags]
                for k, bit in enumerate((8, 0x10, 0x20)):
                    if told & bit:
                        own[k] = struct.unpack_from(">I", data, c)[0]
                        c += 4
                duration, size, flags = own
                base = begin = after if base is None else base
            elif kind == b"trun":
                if track is None:
                    raise ValueError("a run without its track")
                told, count = struct.unpack_from(">II", data, c)
                c += 8
                if told & 1:
                    begin = base + struct.unpack_from(">i", data, c)[0]
                first = struct.unpack_from(">I", data, c + 4 * (told & 1))[0] if told & 4 else None
                c += 4 * (told & 1) + 4 * (told >> 2 & 1)
                held = [bit for bit in (0x100, 0x200, 0x400, 0x800) if told & bit]
                if c + 4 * len(held) * count > d or count > len(data):
                    raise ValueError(f"run at {c} is cut off")
                rows = np.frombuffer(data, ">u4", len(held) * count, c).astype(np.int64).reshape(count, len(held))
                of = lambda bit, other: rows[:, held.index(bit)] if bit in held else np.full(count, other, np.int64)  # noqa: B023, E731
                durations, sizes, marks = of(0x100, duration), of(0x200, size), of(0x400, flags)
                if first is not None and count and 0x400 not in held:
                    marks = np.r_[first, marks[1:]]
                ends = begin + np.cumsum(sizes)
                track.extend(ends - sizes, sizes, np.flatnonzero(marks & 0x10000 == 0), int(durations.sum()), len(data))
                begin = after = int(ends[-1]) if count else begin


def _sample_tables(data: memoryview, found: dict[bytes, tuple[int, int]], track: Track, file_size: int) -> None:
    at, end = found[b"stsd"]
    if struct.unpack_from(">I", data, at + 4)[0]:
        track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    sizes = _sizes(data, found, file_size)
    place = b"co64" if b"co64" in found else b"stco"
    chunks = _table(data, *found[place], ">u8" if place == b"co64" else ">u4", 1)[:, 0]
    runs = _table(data, *found[b"stsc"], ">u4", 3)
    if len(sizes):
        if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
            raise ValueError("the sample-to-chunk table is out of order")
        per = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1]))
        if per.sum() != len(sizes):
            raise ValueError(f"chunks hold {per.sum()} samples, the size table {len(sizes)}")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per) - per
        track.offsets = np.repeat(chunks - before[np.minimum(first, len(sizes) - 1)], per) + before
        if track.offsets.min() < 0 or (track.offsets + sizes).max() > file_size:
            raise ValueError("a sample lies outside the file")
    track.sizes = sizes
    keys = _table(data, *found[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in found else np.arange(len(sizes))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise ValueError("a keyframe has no sample")
    track.keyframes = keys
    times = _table(data, *found[b"stts"], ">u4", 2)
    if int(times[:, 0].sum()) != len(sizes):
        raise ValueError("the time table doesn't cover the samples")
    track.duration = int((times[:, 0] * times[:, 1]).sum()) or track.duration


def parse_media(data: bytes) -> tuple[str, list[Track]]:
    """(major brand, tracks); ValueError or struct.error on a malformed file."""
    view, brand, tracks, defaults = memoryview(data), "", [], {}

    def walk(at: int, end: int, track: Track | None, found: dict[bytes, tuple[int, int]]) -> None:
        nonlocal brand
        for kind, a, b in boxes(view, at, end):
            if kind == b"ftyp":
                brand = bytes(view[a : a + 4]).decode("latin-1")
            elif kind == b"trak":
                own, tables = Track(), {}
                walk(a, b, own, tables)
                if missing := {b"stsd", b"stsc", b"stts"} - tables.keys() | ({b"stsz"} if not {b"stsz", b"stz2"} & tables.keys() else set()) | ({b"stco"} if not {b"stco", b"co64"} & tables.keys() else set()):
                    raise ValueError(f"track without {sorted(x.decode() for x in missing)}")
                _sample_tables(view, tables, own, len(view))
                tracks.append(own)
            elif kind == b"trex":
                number, _, *own = struct.unpack_from(">5I", view, a + 4)
                defaults[number] = tuple(own)
            elif kind == b"moof":
                for x in tracks:
                    x.defaults = defaults.get(x.track_id, x.defaults)
                _fragment(view, at, a, b, {x.track_id: x for x in tracks})
            elif kind in NESTED:
                walk(a, b, track, found)
            elif track is not None and kind == b"tkhd":
                track.track_id = struct.unpack_from(">I", view, a + (20 if view[a] else 12))[0]
            elif track is not None and kind == b"mdhd":
                track.timescale, track.duration = struct.unpack_from(">IQ", view, a + 20) if view[a] else struct.unpack_from(">II", view, a + 12)
            elif track is not None and kind == b"hdlr" and not track.handler:
                track.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
            else:
                found.setdefault(kind, (a, b))
            at = b

    walk(0, len(view), None, {})
    return brand, tracks


def text_payload(text: str | None, frame: int = FRAME) -> tuple[int, bytes]:
    """(bytes of the text, the text padded with spaces to a positive multiple of ``frame``)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % frame if raw else frame)


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id, n_bytes, media). A null text is stored as the empty one, which is one blank frame.

    Null ids and repeated rows are stored like any other; other columns are not read; an empty table gives
    no rows. A file is held in memory whole, as it is one value of a column.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            held = [text_payload(x) for x in part["text"]]
            return {"id": part["id"], "n_bytes": [n for n, _ in held], "media": [write_media(x) for _, x in held]}

        return work

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return map_arrow(picked, f"id {kind}, n_bytes long, media binary", make).withColumnRenamed("id", id_col)


TRACK = "struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<sample:long,offset:long,length:long>>>"


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """One row per row: (id, media, brand, tracks, error), and the first track's ``payload`` if asked for.

    ``tracks`` has every keyframe's number and byte range. Malformed or empty files give no tracks and an
    ``error``; a null file gives nulls. Repeated rows and null ids are kept; other columns are not read; an
    empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def one(data: bytes | None) -> tuple:
            if data is None:
                return None, None, None, None
            try:
                brand, tracks = parse_media(data)
            except (ValueError, struct.error, IndexError) as e:
                return None, [], str(e)[:200] or "malformed", None
            told = [
                {
                    "track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes),
                    "keyframes": [{"sample": s, "offset": o, "length": n} for s, o, n in zip((t.keyframes + 1).tolist(), t.offsets[t.keyframes].tolist(), t.sizes[t.keyframes].tolist())],
                }
                for t in tracks
            ]
            payload = b"".join(data[a:b] for a, b in tracks[0].runs()) if with_payload and tracks else None
            return brand, told, None, payload

        def work(part: dict[str, list]) -> dict[str, list]:
            brand, tracks, error, payload = zip(*map(one, part["media"])) if part["media"] else ((),) * 4
            out = {"id": part["id"], "media": part["media"], "brand": list(brand), "tracks": list(tracks), "error": list(error)}
            return out | ({"payload": list(payload)} if with_payload else {})

        return work

    picked = df.select(df[id_col].alias("id"), df[media_col].alias("media"))
    schema = f"id {kind}, media binary, brand string, tracks array<{TRACK}>, error string" + ", payload binary" * with_payload
    return map_arrow(picked, schema, make).withColumnRenamed("id", id_col)
