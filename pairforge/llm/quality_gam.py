"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature after the other (then on chosen pairs of features)
and added into lookup tables over the features' bins, so the model is a sum of tables: a score takes
one addition per feature and pair, vectorised over the rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, map_arrow

#: Labelled rows that the model is fitted on at most; bins of a feature, of a feature in a pair; rounds; pairs; rate.
FIT_ROWS, BINS, PAIR_BINS, ROUNDS, PAIRS, RATE = 40_000, 32, 8, 200, 6, 0.2

FEATURES = (
    "log_chars", "log_words", "mean_word", "distinct_words", "top_word", "repeats", "log_lines", "distinct_lines", "mean_line",
    "upper", "digits", "stops", "marks", "symbols", "bars", "wide", "capitals", "ends",
)

_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "stops": np.isin(_BYTES, [*b".,;:'\"-()"]),
    "marks": np.isin(_BYTES, [*b"!?"]),
    "symbols": np.isin(_BYTES, [*b"#$%&*+/<=>@\\^_`~{}[]"]),
    "bars": _BYTES == 124,
    "wide": _BYTES >= 128,
}
_MATRIX = np.stack([*_CLASSES.values()]).astype(np.int64)


def features_of(text: str | None) -> list[float]:
    """FEATURES of a whole text; zeros for an empty one or a null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    shares = (_MATRIX @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    counts = Counter(words)
    capitals = sum(w[0] in range(65, 91) for w in counts) / max(len(counts), 1)
    ends = sum(w[-1] in b".!?" for w in counts) / max(len(counts), 1)
    return [
        np.log1p(len(raw)), np.log1p(n), sum(map(len, words)) / max(n, 1), len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        sum(map(eq, words, words[1:])) / max(n - 1, 1), np.log1p(len(lines)), len(set(lines)) / len(lines), len(raw) / len(lines),
        *shares.tolist(), capitals, ends,
    ]


@dataclass
class Gam:
    """Cut points and tables; ``pairs`` has (feature, feature, cuts, cuts, table)."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            total += table[np.searchsorted(cuts_a, x[:, a], "right"), np.searchsorted(cuts_b, x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points: on either side of values that make a bin by themselves, and at quantiles of all the others."""
    values, n = np.unique(x, return_counts=True)
    if len(values) <= bins:
        return values[1:]
    often = n * bins >= len(x)
    rest = np.repeat(values[~often], n[~often])
    cuts = np.quantile(rest, np.linspace(0, 1, bins + 1)[1:-1], method="higher") if len(rest) else values[:0]
    after = np.flatnonzero(often) + 1
    return np.setdiff1d(np.r_[cuts, values[often], values[after[after < len(values)]]], values[:1])


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The values of a shallow regression tree over ordered bins with gradient and hessian sums."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), ridge))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-12:
            out = np.r_[_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)]
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of depth two over a grid: the better axis is split first, each side then along the other."""
    best, out = -np.inf, np.zeros_like(g)
    for axis in (0, 1):
        ga, ha = (g, h) if axis == 0 else (g.T, h.T)
        for at in range(1, len(ga)):
            sides = []
            for part in (slice(None, at), slice(at, None)):
                gs, hs = ga[part].sum(0), ha[part].sum(0)
                sides.append((_tree(gs, hs, 1, ridge), gs, hs, part))
            gain = sum(float(v @ gs - 0.5 * (v**2 @ (hs + ridge / len(hs)))) for v, gs, hs, _ in sides)
            if gain > best:
                best, grid = gain, np.zeros_like(ga)
                for v, _, _, part in sides:
                    grid[part] = v
                out = grid if axis == 0 else grid.T
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE, ridge: float = 2.0) -> Gam:
    """Cyclic boosting on rows x features and 0/1 labels; rows of one class give that class's constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))), [_cuts(c, BINS) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1], [], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(x) or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T)]
    logit = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, (at, table) in enumerate(zip(bins, model.tables)):
            r, w = slope()
            step = rate * _tree(np.bincount(at, r, len(table)), np.bincount(at, w, len(table)), 2, ridge)
            table += step
            logit += step[at]
    # Pairs whose residuals a single grid of trees explains best.
    small = [_cuts(c, PAIR_BINS) for c in x.T]
    where = [np.searchsorted(c, v, "right") for c, v in zip(small, x.T)]
    r, w = slope()
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(small[a]) + 1, len(small[b]) + 1)
            cell = where[a] * shape[1] + where[b]
            g, h = np.bincount(cell, r, shape[0] * shape[1]), np.bincount(cell, w, shape[0] * shape[1])
            gains.append((-float((g**2 / (h + ridge)).sum()), a, b))
    for _, a, b in sorted(gains)[:pairs]:
        model.pairs.append((a, b, small[a], small[b], np.zeros((len(small[a]) + 1, len(small[b]) + 1))))
    for _ in range(rounds // 4):
        for a, b, _, _, table in model.pairs:
            r, w = slope()
            cell = where[a] * table.shape[1] + where[b]
            g, h = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (r, w))
            step = rate * _pair_tree(g, h, ridge)
            table += step
            logit += step[where[a], where[b]]
    return model


FEATURE_SCHEMA = ", ".join(f"{x} double" for x in FEATURES)


def with_features(df: DataFrame, id_col: str, text_col: str, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, keep_0 ..., FEATURES): one row per row, map-side."""
    names = [f"keep_{i}" for i in range(len(keep))]
    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *(c.alias(n) for c, n in zip(keep, names)))
    kept = "".join(f"{n} {picked.schema[n].dataType.simpleString()}, " for n in names)

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            columns = zip(*map(features_of, part["text"])) if part["text"] else [[]] * len(FEATURES)
            return {"id": part["id"]} | {n: part[n] for n in names} | {n: list(map(float, c)) for n, c in zip(FEATURES, columns)}

        return work

    return map_arrow(picked, f"id {df.schema[id_col].dataType.simpleString()}, {kept}{FEATURE_SCHEMA}", make)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Gam:
    """Fit on at most ``fit_rows`` labelled documents, those with the smallest hashes of id and text.

    The bound is on the classifier's training rows alone. Null ids and labels are left out; ids with
    several labels take the more frequent one, 1 on a tie; of an id's several documents each is a row. No
    labelled rows give the constant one half.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
    known = known.agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("label"))
    keyed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("key", F.xxhash64("id", "text"))
    # Labels meet ids and hashes first, without texts: whatever share of the labels has documents, the bound is on what fits.
    met = keyed.select("id", "key").join(known, F.col("id") == F.col("label_id")).select("label_id", "label", "key")
    last = met.select("key").orderBy("key").limit(fit_rows).agg(F.max("key")).first()[0]
    chosen = met.where(F.col("key") <= F.lit(last)).select("label_id", "label").distinct()
    # No more ids than rows up to the bound, which are ``fit_rows`` and their repetitions.
    rows = keyed.where(F.col("key") <= F.lit(last)).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    got = with_features(rows, "id", "text", (F.col("label"), F.xxhash64("id", "text"))).orderBy("keep_1", "id", *FEATURES).limit(fit_rows).toPandas()
    return fit(got[list(FEATURES)].to_numpy(float), got["keep_0"].to_numpy(float))


def classify(df: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``df``: (id, score, predicted), with the columns ``keep`` in between.

    ``score`` is the probability of label 1; ``predicted`` is 1 from one half on. Nulls are scored as
    empty texts; null ids and repeated rows are kept; other columns are not read; an empty table gives no
    rows. Whole texts are read, one at a time where they are very long. Map-side only.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *(c.alias(n) for c, n in zip(keep, names)))
    kept = "".join(f"{n} {picked.schema[n].dataType.simpleString()}, " for n in names)

    def make():
        def work(part: dict[str, list]) -> dict[str, list]:
            x = np.array([features_of(t) for t in part["text"]], float).reshape(-1, len(FEATURES))
            score = model.score(x)
            return {"id": part["id"]} | {n: part[n] for n in names} | {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

        return work

    out = map_arrow(picked, f"id {df.schema[id_col].dataType.simpleString()}, {kept}score double, predicted int", make)
    return out.withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that the query may learn from: those outside its held-out fold."""
    return labels.where(crc_fold(id_col, 3) != 1)
