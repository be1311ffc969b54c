"""Exact tokenizer ids through a bounded cache of white-space-free words.

A tokenizer whose pre-tokenizer drops white space never lets a token, a merge or a normalisation
cross an ASCII white space, so the ids of a text are the ids of its words in order. ``WordCodec``
checks that premise when it opens a tokenizer and then asks the library only for words it has not
seen lately.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

#: ASCII bytes that may end a word after a letter or digit; none of them starts a contraction or a special token.
TAIL = b".,!?;:*%&$#"
#: Lower-case letters that the normaliser leaves alone and the pre-tokenizer keeps together.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def resolve(tokenizer: str) -> str:
    """A path, or the name of a file of the installed public tokenizers; resolved where it is used."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


class WordCodec:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    At most ``max_words`` words are kept between calls; a fuller cache is emptied, never wrong.
    """

    def __init__(self, tokenizer: str = "word_bpe_49k.json", max_words: int = 500_000):
        from tokenizers import Tokenizer

        path = resolve(tokenizer)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splits = _drops_white_space(spec)
        self.folds = any(x.get("type") == "Lowercase" for x in _parts(spec.get("normalizer"), "normalizers"))
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.marks = sorted({x[:2] for x in added})
        if any(c.isspace() for x in added for c in x) or any(x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", [])):
            self.splits = False
        pattern = ((_parts(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex", "")
        #: Whether ASCII digits, letters and punctuation are kept apart, in special strings too.
        self.fine = self.splits and "|[\\p{N}]|" in pattern and not any(re.search("[0-9.,;:!?]", x) for x in added)
        self.max_words = max_words
        self.bytes_as = _byte_alphabet() if self.splits and _is_byte_level(spec) else None
        self.known: dict[bytes, bytes] = {}

    def _library(self, words: list[str]) -> list[bytes]:
        found = self.library.encode_batch(words, add_special_tokens=False)
        return [_packed(x.ids) for x in found]

    def _learn(self, words: set[bytes]) -> None:
        known, whole, joined = self.known, [], []
        for word in words:
            base = word.rstrip(TAIL)
            if base != word and base and _ends_with_letter(base):
                joined.append((word, base))
            else:
                whole.append(word)
        parts = {x for word, base in joined for x in (base, word[len(base) :])}.difference(known, whole)
        asked, tokenize, bytes_as = [], self.library.model.tokenize, self.bytes_as
        for x in (*whole, *parts):
            if bytes_as is not None and PLAIN.fullmatch(text := x.decode("utf-8", "surrogatepass")):
                # One pre-token already in normal form: the model alone gives its ids.
                known[x] = _packed([t.id for t in tokenize(text if len(text) == len(x) else x.decode("latin-1").translate(bytes_as))])
            else:
                asked.append(x)
        known.update(zip(asked, self._library([x.decode("utf-8", "surrogatepass") for x in asked])))
        for word, base in joined:
            known[word] = known[base] + known[word[len(base) :]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null is the empty text."""
        if not self.splits:
            return self._library([x or "" for x in texts])
        split = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            # Folding early may only be seen by special strings and by marks U+0300 to U+037F that compose.
            if self.folds and text and not any(x in text for x in self.marks) and b"\xcc" not in raw and b"\xcd" not in raw:
                raw = raw.lower()
            split.append(raw.split())
        words: set[bytes] = set()
        for x in split:
            words.update(x)
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > self.max_words:
            self.known.clear()
            missing = words
        if missing:
            self._learn(missing)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in split]


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


def _is_byte_level(spec: dict) -> bool:
    steps = _parts(spec.get("pre_tokenizer"), "pretokenizers")
    last = steps[-1] if steps else {}
    return last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and last.get("use_regex") is False and spec["model"]["type"] == "BPE"


def _byte_alphabet() -> dict[int, str]:
    """How byte-level tokenizers write each byte: printable ones as themselves, the others from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(256 + i) for i, x in enumerate(rest)}


def _parts(node: dict | None, key: str) -> list[dict]:
    if not node:
        return []
    return node[key] if node.get("type") == "Sequence" else [node]


def _drops_white_space(spec: dict) -> bool:
    """True if white space separates tokens and never becomes part of one."""
    first = (_parts(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    normal = all(x.get("type") in ("NFC", "NFKC", "Lowercase", "Replace") for x in _parts(spec.get("normalizer"), "normalizers"))
    keeps_out = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return normal and keeps_out and "[^\\s\\p{L}\\p{N}]+" in pattern and " " not in pattern and not spec.get("post_processor")


def _ends_with_letter(word: bytes) -> bool:
    last = word[-1]
    if last < 0x80:
        return 0x61 <= last <= 0x7A or 0x41 <= last <= 0x5A or 0x30 <= last <= 0x39
    ch = word.decode("utf-8")[-1]
    return "À" <= ch <= "ɏ" and ch not in "×÷" and len(ch.lower()) == 1


@lru_cache(maxsize=2)
def open_codec(tokenizer: str) -> WordCodec:
    """The worker's codec; it outlives a task, so that the next one finds its words."""
    return WordCodec(tokenizer)
