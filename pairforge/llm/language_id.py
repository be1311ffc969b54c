"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (one to three characters of lower-cased
words, padded by a blank on either side), most frequent first, ties by code points. A document's
profile is compared to that of each language by the out-of-place distance: the sum over its n-grams
of how far the rank differs, with the profile's length for n-grams that a language doesn't have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship, slices

#: N-grams of a profile; labelled rows that profiles are fitted on at most; most languages told apart.
PROFILE, FIT_ROWS, LANGUAGES = 400, 40_000, 1000
#: Characters of a text that are turned into n-grams at once.
CHARS = 1 << 20
UNKNOWN = "und"


def codes_of(text: str) -> Iterator[np.ndarray]:
    """N-gram codes (21 bits a character) of a text, piece by piece; letters count, all else parts words."""
    for at in range(0, len(text), CHARS):
        # A piece begins two characters early, so that n-grams over the seam are seen; those seen twice are left out.
        piece = text[max(0, at - 2) : at + CHARS]
        seam = at - max(0, at - 2)
        # A sigma at the end of a word has a form of its own, which depends on what stands around.
        points = np.frombuffer(piece.replace("Σ", "σ").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(points) != len(piece):
            points = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in piece), np.int64, len(piece))
        points = np.where(_letters(points), points, 32)
        if not at:
            points = np.r_[32, points]
            seam = 0
        if at + CHARS >= len(text):
            points = np.r_[points, 32]
        two = points[:-1] << 21 | points[1:]
        three = two[:-1] << 21 | points[2:]
        keep1 = points[seam:]
        keep2 = two[max(0, seam - 1) :]
        blank = 32 << 21 | 32
        yield keep1[keep1 != 32]
        yield keep2[(keep2 != blank)]
        yield three[(three & ((1 << 42) - 1) != blank) & (three >> 21 != blank)]


_table = np.zeros(0, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _table
    if not len(_table):
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _table = table
    return _table[points]


def profile_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes in ascending order, and how often each comes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for codes in codes_of(text):
        held.append(np.unique(codes, return_counts=True))
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(text) <= CHARS:  # n-grams of one, two and three letters never share a code
        return np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
    codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * size:  # only what may be among them needs an order
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def fit_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, fit_rows: int = FIT_ROWS, order_col: str | None = None) -> dict[str, list[int]]:
    """Language -> n-gram codes by rank, from at most ``fit_rows`` labelled rows.

    The rows are those with the smallest hashes of their text (and of ``order_col``); of rows that are equal
    in both, as many as the bound leaves room for. The bound is on the classifier's training rows alone.
    Counting is spread over the tasks; only the profiles reach the driver: ``size`` codes for each of at
    most LANGUAGES languages. Rows without language or text are left out; no rows give no profiles.
    """
    key = F.xxhash64(*([order_col] if order_col else []), text_col)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if rows.select(F.count("*")).first()[0] > fit_rows:
        # ``fit_rows`` numbers, of which the largest is the bound.
        last = rows.select(key.alias("key")).orderBy("key").limit(fit_rows).agg(F.max("key")).first()[0]
        below = rows.where(key < F.lit(last))
        rows = below.unionByName(rows.where(key == F.lit(last)).limit(fit_rows - below.count()))
    out = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part["lang"], part["text"]):
                    held.setdefault(lang, []).append(profile_counts(text))
                for lang in held:
                    if len(held[lang]) > 64:
                        held[lang] = [merged(lang)]
        for lang in held:
            codes, counts = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], schema=out)

    ship(labelled.sparkSession)
    counted = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, code long, n long")
    counted = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    got = ranked.orderBy("lang", "rank").limit(LANGUAGES * size + 1).collect()
    if len(got) > LANGUAGES * size:
        raise ValueError(f"more than {LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for row in got:
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


class RankOrder:
    """Out-of-place distances of documents to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for x in profiles.values() for c in x], np.int64)) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is one less the mean displacement over its most, from 0 to 1."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        codes, counts = profile_counts(text)
        if not len(codes):
            return UNKNOWN, 0.0
        own = top(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        ranks = self.ranks[at]
        places = np.arange(len(own), dtype=np.int32)[:, None]
        away = np.where(ranks < 0, self.size, np.abs(ranks - places)).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def identify(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE, keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``df``: (id, lang_pred, score), with the columns ``keep`` in between.

    Map-side only. Null texts and texts without a letter are ``und`` with score 0, as is everything if
    there are no profiles; ties go to the first language by name. Null ids and repeated rows are kept;
    other columns are not read; an empty table gives no rows. Very long texts are counted CHARS characters
    at a time.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *(c.alias(n) for c, n in zip(keep, names)))
    kept = "".join(f"{n} {picked.schema[n].dataType.simpleString()}, " for n in names)

    def make():
        model = RankOrder(profiles, size)

        def work(part: dict[str, list]) -> dict[str, list]:
            got = [model.predict(x) for x in part["text"]]
            return {"id": part["id"]} | {n: part[n] for n in names} | {"lang_pred": [x for x, _ in got], "score": [x for _, x in got]}

        return work

    out = map_arrow(picked, f"id {df.schema[id_col].dataType.simpleString()}, {kept}lang_pred string, score double", make)
    return out.withColumnRenamed("id", id_col)
