"""Exact ids of byte-level tokenizers.

A byte-level pre-tokenizer with its usual pattern starts a new piece at every blank that a visible
character follows, whatever stands before: the blank belongs to the piece that follows. Nothing crosses
such a place, so the ids of a text are those of its stretches between these places, in order.
``ByteCodec`` checks that premise when it opens a tokenizer. Stretches of plain characters are merged by a
second library from the same vocabulary, which takes a quarter of the time; the others, and special
strings, are left to the tokenizer's own library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from .wordcodec import _byte_alphabet, _packed, resolve

#: A blank before anything but white space; characters that some version of Unicode calls white space count as it.
_CUT = re.compile("\x20(?=[^\\s\x1c-\x1f\x85\u180e\u200b\ufeff])")
#: Text that every version of Unicode cuts alike: ASCII, and Latin letters that are neither joined nor split.
_PLAIN = re.compile("[\\x20-\\x7e\\t\\n\\rÀ-ÖØ-öø-ɏ]*")

class ByteCodec:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The second library is only used where the vocabulary numbers its merges in their order, as it assumes.
    """

    def __init__(self, tokenizer: str = "byte_bpe_50k.json"):
        from tokenizers import Tokenizer

        path = resolve(tokenizer)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        plain = all(not x.get("lstrip") and not x.get("rstrip") and not x.get("single_word") and not any(c.isspace() for c in x["content"]) for x in added)
        self.splits = plain and not spec.get("normalizer") and not spec.get("post_processor") and first.get("type") == "ByteLevel" and first.get("use_regex") is True and not first.get("add_prefix_space")
        self.marks = sorted({x["content"][:2] for x in added})
        self.merge = _merger(spec["model"], {x["content"] for x in added}) if self.splits else None
    def _library(self, chunks: list[str]) -> list[bytes]:
        return [_packed(x.ids) for x in self.library.encode_batch(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null is the empty text."""
        merge = self.merge
        if merge is None:
            return self._library([x or "" for x in texts])
        done: list = []
        asked: list[str] = []
        for text in texts:
            if not text or self._plain(text):
                done.append(_packed(merge(text or "")))
                continue
            # Stretches of plain chunks, and between them chunks for the library, as places in ``asked``.
            parts, run, at, start = [], True, 0, 0
            for m in _CUT.finditer(text):
                plain = self._plain(text[at : m.start()])
                if plain != run:
                    self._stretch(parts, text[start:at], run, asked)
                    start, run = at, plain
                at = m.start()
            plain = self._plain(text[at:])
            if plain != run:
                self._stretch(parts, text[start:at], run, asked)
                start, run = at, plain
            self._stretch(parts, text[start:], run, asked)
            done.append(parts)
        found = self._library(asked)
        return [x if isinstance(x, bytes) else b"".join(found[p] if isinstance(p, int) else p for p in x) for x in done]

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(m in text for m in self.marks)

    def _stretch(self, parts: list, text: str, plain: bool, asked: list[str]) -> None:
        if text and plain:
            parts.append(_packed(self.merge(text)))
        elif text:
            parts.append(len(asked))
            asked.append(text)


def _merger(model: dict, added: set[str]):
    """A function from plain text to ids, or None where the vocabulary's numbers are not the order of its merges."""
    import tiktoken

    as_byte = {ord(c): b for b, c in _byte_alphabet().items()}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if model.get("type", "BPE") != "BPE" or made != sorted(set(made)) or len(vocab) != 256 + len(made) or min(made, default=256) < 256:
        return None
    ranks = {bytes(as_byte[ord(c)] for c in t): i for t, i in vocab.items()}
    # The pattern of byte-level pre-tokenizers. Fixed value.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


@lru_cache(maxsize=2)
def open_byte_codec(tokenizer: str) -> ByteCodec:
    """The worker's codec; it outlives a task."""
    return ByteCodec(tokenizer)
