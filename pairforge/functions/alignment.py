"""Pairwise alignment with affine gaps, and distances over alignments.

The kernel aligns pairs of like lengths together and fills one row of their score tables at a time with
NumPy: the vertical gap and the diagonal are vector operations, the horizontal gap a running maximum. A
cell keeps one byte: where it comes from, and whether the gaps that end in it are extended ones. Distances
are column expressions over the aligned strings and stay on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.scoring import Scores, nucleotide
from pairforge.session import ship

GAP = "-"
STOP, DIAGONAL, UP, LEFT = range(4)
#: Marks of a cell's byte beside its direction; cells of score tables that are held at once, unless one pair has more.
UP_EXTENDED, LEFT_EXTENDED, CELLS = 4, 8, 1 << 25


@dataclass(frozen=True)
class Aligned:
    score: float
    start1: int
    start2: int
    aligned1: str
    aligned2: str
    markup: str
    identity: int
    similarity: int
    gaps: int


def _matrix(scores: Scores) -> np.ndarray:
    out = np.zeros((128, 128), np.float32)
    out[0], out[:, 0] = -1e9, -1e9  # what fills up a shorter sequence
    for (a, b), v in scores.items():
        out[ord(a), ord(b)] = v
    return out


class Aligner:
    """Local (default) or global alignment; a gap of length L costs open + (L - 1) * extend."""

    def __init__(self, scores: Scores | None = None, open_: float = 14, extend: float = 4, local: bool = True):
        self.table = _matrix(nucleotide() if scores is None else scores)
        self.open, self.extend, self.local = np.float32(open_), np.float32(extend), local

    def align(self, a: str, b: str) -> Aligned:
        return self.align_many([(a, b)])[0]

    def align_many(self, pairs: list[tuple[str, str]]) -> list[Aligned]:
        """The alignments of all pairs, in their order."""
        order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
        found: list[Aligned | None] = [None] * len(pairs)
        while order:
            n, m, take = 0, 0, 0
            for k in order:  # as many as fit, one at least
                n, wider = max(n, len(pairs[k][0])), max(m, len(pairs[k][1]))
                if take and (take + 1) * (n + 1) * (wider + 1) > CELLS:
                    break
                m, take = wider, take + 1
            for k, one in zip(order[:take], self._together([pairs[k] for k in order[:take]])):
                found[k] = one
            order = order[take:]
        return found

    def _together(self, pairs: list[tuple[str, str]]) -> list[Aligned]:
        texts = [(a.upper(), b.upper()) for a, b in pairs]
        # Shorter sequences are filled up with a symbol of no score; no best cell lies there.
        sizes = np.array([(len(a), len(b)) for a, b in texts])
        n, m = sizes.max(axis=0).tolist()
        x, y = (np.zeros((len(texts), w), np.uint8) for w in (n, m))
        for k, (a, b) in enumerate(texts):
            x[k, : len(a)], y[k, : len(b)] = (np.frombuffer(t.encode("ascii", "replace"), np.uint8) & 127 for t in (a, b))
        every, worst = np.arange(len(texts)), np.float32(-1e30)
        steps = np.arange(m + 1, dtype=np.float32) * self.extend
        row = np.zeros((len(texts), m + 1), np.float32)
        up = np.full_like(row, worst)
        cells = np.zeros((n + 1, *row.shape), np.uint8)
        if not self.local:
            row[:, 1:] = -(self.open + steps[:-1])
            cells[0, :, 1:] = LEFT
            cells[0, :, 2:] |= LEFT_EXTENDED
        best = np.where(sizes[:, 0] == 0, row[every, sizes[:, 1]], 0).astype(np.float32)
        end = np.zeros_like(sizes) if self.local else sizes
        for i in range(1, n + 1):
            longer, fresh = up - self.extend, row - self.open
            cell = np.where(longer > fresh, UP_EXTENDED, 0).astype(np.uint8)
            up = np.maximum(longer, fresh)
            diagonal = np.full_like(row, worst)
            diagonal[:, 1:] = row[:, :-1] + self.table[x[:, i - 1, None], y]
            stay = np.maximum(diagonal, up)
            if self.local:
                stay = np.maximum(stay, 0)
            stay[:, 0] = 0 if self.local else -(self.open + (i - 1) * self.extend)
            # The best left gap into j comes from the best of stay[k] + k * extend over k < j; the last such k opens it.
            lifted = stay + steps
            reach = np.maximum.accumulate(lifted, axis=1)
            left = np.full_like(row, worst)
            left[:, 1:] = reach[:, :-1] - self.open - steps[:-1]
            cell[:, 2:] |= np.where(lifted[:, 1:-1] == reach[:, 1:-1], 0, LEFT_EXTENDED).astype(np.uint8)
            row = np.maximum(stay, left)
            way = np.where(row == diagonal, DIAGONAL, np.where(row == up, UP, LEFT)).astype(np.uint8)
            if self.local:
                way[row <= 0] = STOP
                at = row.argmax(axis=1)
                top = row[every, at]
                better = top > best
                best[better] = top[better]
                end[better, 0], end[better, 1] = i, at[better]
            else:
                way[:, 0] = UP
                cell[:, 0] = UP_EXTENDED if i > 1 else 0
                last = sizes[:, 0] == i
                best[last] = row[last, sizes[last, 1]]
            cells[i] = cell | way
        return [self._trace(a, b, float(best[k]), *end[k].tolist(), cells[:, k]) for k, (a, b) in enumerate(texts)]

    def _trace(self, a: str, b: str, score: float, i: int, j: int, cells: np.ndarray) -> Aligned:
        one, two = [], []
        while (i or j) and (way := cells[i, j] & 3) != STOP:
            if way == DIAGONAL:
                i, j = i - 1, j - 1
                one.append(a[i])
                two.append(b[j])
            elif way == UP:
                k = 1
                while cells[i - k + 1, j] & UP_EXTENDED:
                    k += 1
                one += reversed(a[i - k : i])
                two += GAP * k
                i -= k
            else:
                k = 1
                while cells[i, j - k + 1] & LEFT_EXTENDED:
                    k += 1
                one += GAP * k
                two += reversed(b[j - k : j])
                j -= k
        one, two = "".join(reversed(one)), "".join(reversed(two))
        same = sum(p == q != GAP for p, q in zip(one, two))
        gaps = sum(GAP in (p, q) for p, q in zip(one, two))
        alike = [GAP not in (p, q) and self.table[ord(p) % 128, ord(q) % 128] > 0 for p, q in zip(one, two)]
        markup = "".join("|" if p == q != GAP else ":" if s else " " if GAP in (p, q) else "." for p, q, s in zip(one, two, alike))
        return Aligned(score, i, j, one, two, markup, same, sum(alike), gaps)


FIELDS = "score float, start1 int, start2 int, aligned1 string, aligned2 string, markup string, identity int, similarity int, gaps int"


def align_pairs(pairs: DataFrame, a: str, b: str, keep: list[str], scores: Scores | None = None, open_: float = 14, extend: float = 4, local: bool = True) -> DataFrame:
    """Align two columns of each row: (keep ..., FIELDS). Null sequences count as empty."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = pairs.select(*keep, F.coalesce(a, F.lit("")).alias("_a"), F.coalesce(b, F.lit("")).alias("_b"))
    schema = "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in keep) + FIELDS
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(scores, open_, extend, local)
        for batch in batches:
            found = aligner.align_many(list(zip(batch["_a"].to_pylist(), batch["_b"].to_pylist())))
            made = [pa.array([getattr(f, n) for f in found], out.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *made], schema=out)

    ship(pairs.sparkSession)
    return picked.mapInArrow(run, schema)


def _columns(a: Column, b: Column) -> Column:
    """The aligned columns as an array of structs (p, q), in upper case."""
    return F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _count(columns: Column, test) -> Column:
    return F.size(F.filter(columns, test)).cast("double")


def _paired(c: Column) -> Column:
    return (c["p"] != GAP) & (c["q"] != GAP)


def percent_identity(a: Column, b: Column) -> Column:
    """Equal non-gap columns over all columns; null for empty rows."""
    return _count(_columns(a, b), lambda c: _paired(c) & (c["p"] == c["q"])) / F.nullif(F.length(a), F.lit(0))


def percent_identity_non_gap(a: Column, b: Column) -> Column:
    """Equal columns over the columns without a gap."""
    c = _columns(a, b)
    n = _count(c, _paired)
    return F.when(n > 0, _count(c, lambda x: _paired(x) & (x["p"] == x["q"])) / n).otherwise(F.lit(0.0))


def percent_identity_overlap(a: Column, b: Column) -> Column:
    """Equal columns over the columns between the leading and trailing gaps of either row."""
    lead = F.greatest(F.length(F.regexp_extract(a, "^-*", 0)), F.length(F.regexp_extract(b, "^-*", 0)))
    trail = F.greatest(F.length(F.regexp_extract(a, "-*$", 0)), F.length(F.regexp_extract(b, "-*$", 0)))
    n = F.length(a) - lead - trail
    cut = F.slice(_columns(a, b), lead + 1, F.greatest(n, F.lit(0)))
    return F.when(n > 0, _count(cut, lambda x: _paired(x) & (x["p"] == x["q"])) / n).otherwise(F.lit(0.0))


def percent_similarity(a: Column, b: Column, scores: Scores | None = None) -> Column:
    """Columns without a gap whose score is above zero, over all columns."""
    alike = sorted({x + y for (x, y), v in (nucleotide() if scores is None else scores).items() if v > 0})
    return _count(_columns(a, b), lambda c: F.concat(c["p"], c["q"]).isin(alike)) / F.nullif(F.length(a), F.lit(0))


_PURINES, _PYRIMIDINES = ["A", "G"], ["C", "T"]


def kimura_distance(a: Column, b: Column, clip: float | None = 10.0, undefined: float = 10.0) -> Column:
    """Two-parameter distance over columns without a gap; ``undefined`` where a logarithm has no value.

    Purine for purine or pyrimidine for pyrimidine is a transition; every other change, those of ambiguity
    letters too, counts as a transversion.
    """
    c = _columns(a, b)
    kind = lambda x: (x["p"].isin(_PURINES) & x["q"].isin(_PURINES)) | (x["p"].isin(_PYRIMIDINES) & x["q"].isin(_PYRIMIDINES))
    changed = lambda x: _paired(x) & (x["p"] != x["q"])
    n = _count(c, _paired)
    some = F.nullif(n, F.lit(0.0))
    p = _count(c, lambda x: changed(x) & kind(x)) / some
    q = _count(c, lambda x: changed(x) & ~kind(x)) / some
    one, two = F.lit(1.0) - 2 * p - q, F.lit(1.0) - 2 * q
    d = F.when((n > 0) & (one > 0) & (two > 0), -0.5 * F.log(one) - 0.25 * F.log(two)).otherwise(F.lit(undefined))
    return d if clip is None else F.least(d, F.lit(clip))


def jukes_cantor_distance(a: Column, b: Column, undefined: float | None = 10.0) -> Column:
    """-3/4 log(1 - 4/3 p) with p the share of unequal among columns without a gap; with no ``undefined`` value it raises."""
    p = F.lit(1.0) - percent_identity_non_gap(a, b)
    inside = F.lit(1.0) - 4.0 / 3.0 * p
    other = F.raise_error(F.lit("the distance is undefined")).cast("double") if undefined is None else F.lit(undefined)
    return F.when(inside > 1e-12, -0.75 * F.log(inside)).otherwise(other)


def self_score(sequence: Column, scores: Scores | None = None) -> Column:
    """The sum of each symbol's score with itself."""
    table = nucleotide() if scores is None else scores
    own = F.create_map(*(F.lit(x) for (a, b), v in table.items() if a == b for x in (a, v)))
    return F.aggregate(F.split(F.upper(sequence), ""), F.lit(0.0), lambda s, ch: s + F.coalesce(F.try_element_at(own, ch), F.lit(0.0)))


def min_max_normalised(score: Column, self1: Column, self2: Column) -> Column:
    """A local score over the larger self score."""
    return score / F.greatest(self1, self2)


def min_max_normalised_global(score: Column, self1: Column, self2: Column, len1: Column, len2: Column, open_: float, extend: float) -> Column:
    """A global score between the worst, 2 * open + (len1 + len2) * extend (penalties as negative numbers), and the larger self score."""
    low = F.lit(2.0 * open_) + (len1 + len2) * F.lit(extend)
    return (score - low) / (F.greatest(self1, self2) - low)


def gap_intervals(aligned: Column) -> Column:
    """The runs of gaps of an aligned row."""
    return F.regexp_extract_all(aligned, F.lit("(-+)"), 1)


def mismatch_positions(a: Column, b: Column) -> Column:
    """Column numbers, from 0, where two bases differ."""
    marked = F.transform(_columns(a, b), lambda c, i: F.when(_paired(c) & (c["p"] != c["q"]), i))
    return F.filter(marked, lambda i: i.isNotNull())


DISTANCES = {
    "percent_identity": lambda a, b: F.lit(1.0) - percent_identity(a, b),
    "percent_identity_non_gap": lambda a, b: F.lit(1.0) - percent_identity_non_gap(a, b),
    "percent_similarity": lambda a, b: F.lit(1.0) - percent_similarity(a, b),
    "kimura": kimura_distance,
    "jukes_cantor": jukes_cantor_distance,
}


def alignment_distance(kind: str, a: Column, b: Column) -> Column:
    if kind not in DISTANCES:
        raise ValueError(f"no distance {kind!r}; one of {sorted(DISTANCES)}")
    return DISTANCES[kind](a, b)
