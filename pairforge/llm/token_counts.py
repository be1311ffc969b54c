"""Token counts of whole texts by overlap resynchronisation.

Texts of up to ``chunk_chars`` characters are encoded in one piece. Longer ones are encoded in
overlapping chunks with character offsets. Two neighbours are spliced at a common boundary that is
proven stable: no token, merge or normalisation of the tokenizer crosses it, whatever stands around; both
chunks have a token edge there; and both hold the same tokens from there to the next such boundary. Such
boundaries lie before an ASCII white space that follows something else and, where the pre-tokenizer keeps
digits and marks apart, between ASCII digits and letters and before ASCII punctuation after either.
Overlaps are widened until they hold two boundaries. Where the left chunk has none, as within one word
of a script without spaces, both become one chunk, and chunks double, so that the work stays in proportion
to the text. The count equals that of the text in one piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_arrow
from .wordcodec import WordCodec, open_codec

#: Characters of a chunk, of the first overlap; counts above OVER_LIMIT tokens are flagged.
CHUNK_CHARS, OVERLAP_CHARS, OVER_LIMIT = 32_768, 256, 2048

_SPACE = r"(?<=[^ \t\n\r\x0b\x0c])(?=[ \t\n\r\x0b\x0c])"
_CUT = re.compile(_SPACE)
_FINE = re.compile(rf"{_SPACE}|(?<=[A-Za-z0-9])(?=[.,;:!?])|(?<=[0-9])(?=[A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9])")

Token = tuple[int, int, int]


def encode_with_offsets(codec: WordCodec, text: str, at: int) -> list[Token]:
    """(start, end, id) of each token, in characters of the whole text that ``text`` begins at ``at``."""
    found = codec.library.encode(text, add_special_tokens=False)
    return [(s + at, e + at, i) for (s, e), i in zip(found.offsets, found.ids)]


def splice(left: list[Token], right: list[Token], cuts: list[int]) -> tuple[int, int, int] | None:
    """The boundary, how many tokens of ``left`` to keep and of ``right`` to drop; None if they don't align.

    ``cuts``: the proven boundaries inside the overlap, in order. Tokens between the first two that
    follow one another and agree are the witness; with the end of the overlap never used, as the left
    chunk may have cut a word there.
    """
    starts_l, starts_r = [t[0] for t in left], [t[0] for t in right]
    for a, b in zip(cuts, cuts[1:]):
        la, lb = bisect_left(starts_l, a), bisect_left(starts_l, b)
        ra, rb = bisect_left(starts_r, a), bisect_left(starts_r, b)
        edges = (not la or left[la - 1][1] <= a) and (not ra or right[ra - 1][1] <= a)
        if edges and la < lb and left[la:lb] == right[ra:rb]:
            return a, la, ra
    return None


def encode_long(codec: WordCodec, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[Token]]:
    """Tokens of a text of any length, run by run; two chunks are held, or a word that is longer."""
    pattern = _FINE if codec.fine else _CUT
    start, end = 0, min(chunk, len(text))
    left = encode_with_offsets(codec, text[:end], 0)
    while end < len(text):
        cuts = [m.start() for m in pattern.finditer(text, start, end) if start < m.start() < end]
        stop, wide, at = min(len(text), end + chunk - overlap), overlap, None
        while at is None and len(cuts) > 1:
            begin = max(start, min(end - wide, cuts[-2] - 1))
            right = encode_with_offsets(codec, text[begin:stop], begin)
            at = splice(left, right, cuts[bisect_left(cuts, begin + 1) :])
            if begin == start:
                break
            wide = 2 * (end - begin)
        if at is None:
            stop = min(len(text), end + max(chunk, end - start))
            left = encode_with_offsets(codec, text[start:stop], start)
        else:
            start, keep, drop = at
            yield left[:keep]
            left = right[drop:]
        end = stop
    yield left


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, over_limit: int = OVER_LIMIT
) -> DataFrame:
    """One row per row of ``df``: (id, n_bytes, n_tokens, over_limit, n_chunked).

    Map-side only. A null text counts as the empty one, with no bytes and no tokens; null ids and
    repeated rows each give their own row; other columns are not read; an empty table gives no rows. Of a
    very long text two chunks of tokens are held at a time. ``n_chunked`` is true for texts that were
    encoded in overlapping chunks. Special strings in a text are tokens, as the library has
    it by default; none are added.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        codec = open_codec(tokenizer)

        def work(part: dict[str, list]) -> dict[str, list]:
            texts = part["text"]
            long = [codec.splits and len(x or "") > chunk_chars for x in texts]
            counts = [len(x) // 4 for x in codec.encode(["" if cut else x for x, cut in zip(texts, long)])]
            for i, cut in enumerate(long):
                if cut:
                    counts[i] = sum(map(len, encode_long(codec, texts[i], chunk_chars, overlap_chars)))
            return {
                "id": part["id"],
                "n_bytes": [len((x or "").encode("utf-8", "surrogatepass")) for x in texts],
                "n_tokens": counts,
                "over_limit": [n > over_limit for n in counts],
                "n_chunked": long,
            }

        return work

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = map_arrow(picked, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunked boolean", make)
    return out.withColumnRenamed("id", id_col)
