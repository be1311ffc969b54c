"""Fit of one point set onto another: translation, rotation, inversion and scale.

The sums that the least-squares solution needs (means and a D x D table) are one aggregate; the table is
decomposed on the driver. That is the exact minimum an iterative fit of angles would search for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proper_angle(a: Column) -> Column:
    """The angle in [-pi, pi)."""
    return a - F.floor((a + math.pi) / (2 * math.pi)) * (2 * math.pi)


def bounded_scale(parameter: Column, low: float, high: float) -> Column:
    """A scale between two bounds as a smooth function of a free parameter."""
    return F.lit((low + high) / 2) + F.lit((high - low) / 2) * F.sin(parameter)


def elementary(dim: int, a: int, b: int, angle: float, derivative: bool = False) -> np.ndarray:
    """The rotation in the plane of axes a and b, or its derivative by the angle."""
    out = np.zeros((dim, dim)) if derivative else np.eye(dim)
    c, s = (-math.sin(angle), math.cos(angle)) if derivative else (math.cos(angle), math.sin(angle))
    out[a, a], out[a, b], out[b, a], out[b, b] = c, -s, s, c
    return out


def total(angles: list[float], scale: float = 1.0, inverted: bool = False) -> np.ndarray:
    """scale * inversion * R3 * R2 * R1 in three dimensions (one angle: two dimensions)."""
    dim = 3 if len(angles) == 3 else 2
    planes = [(0, 1), (1, 2), (0, 1)] if dim == 3 else [(0, 1)]
    out = np.eye(dim)
    for (a, b), angle in zip(planes, angles):
        out = elementary(dim, a, b, angle) @ out
    flip = np.eye(dim)
    if inverted:
        flip[-1, -1] = -1
    return scale * flip @ out


@dataclass(frozen=True)
class Transform:
    matrix: np.ndarray
    translation: np.ndarray
    scale: float
    inverted: bool
    residual: float
    n: int

    def apply(self, points: DataFrame, x: str = "x") -> DataFrame:
        """The points with ``x`` transformed."""
        rows = [sum(F.lit(float(m)) * F.get(x, k) for k, m in enumerate(row)) + F.lit(float(t)) for row, t in zip(self.matrix, self.translation)]
        return points.withColumn(x, F.array(*rows))


def fit(first: DataFrame, second: DataFrame, dim: int = 3, scaled: bool = True, inversion: bool = True, weights: str | None = None) -> Transform:
    """The transform that maps ``second`` (id, x) best onto ``first`` (id, x) over their common ids."""
    w = F.col("w") if weights else F.lit(1.0)
    a = first.select("id", F.col("x").alias("p"), *([F.col(weights).alias("w")] if weights else []))
    both = a.join(second.select("id", F.col("x").alias("q")), "id")
    sums = [F.sum(w).alias("w"), F.count("*").alias("n")]
    for k in range(dim):
        sums += [F.sum(w * F.get("p", k)).alias(f"p{k}"), F.sum(w * F.get("q", k)).alias(f"q{k}")]
        for m in range(dim):
            sums.append(F.sum(w * F.get("p", k) * F.get("q", m)).alias(f"c{k}{m}"))
    sums += [F.sum(w * sum(F.get(v, k) * F.get(v, k) for k in range(dim))).alias(f"{v}{v}") for v in "pq"]
    row = both.agg(*sums).first()
    if not row["n"]:
        raise ValueError("the point sets share no id")
    size = row["w"]
    mp, mq = (np.array([row[f"{v}{k}"] for k in range(dim)]) / size for v in "pq")
    cross = np.array([[row[f"c{k}{m}"] for m in range(dim)] for k in range(dim)]) / size - np.outer(mp, mq)
    spread_p, spread_q = row["pp"] / size - mp @ mp, row["qq"] / size - mq @ mq
    u, d, v = np.linalg.svd(cross)
    proper = np.linalg.det(u) * np.linalg.det(v) > 0
    sign = np.ones(dim)
    if not proper and not inversion:
        sign[-1] = -1
    rotation = u @ np.diag(sign) @ v
    s = float((d * sign).sum() / spread_q) if scaled and spread_q > 0 else 1.0
    residual = max(0.0, float(spread_p - 2 * s * (d * sign).sum() + s * s * spread_q)) * size
    matrix = s * rotation
    return Transform(matrix, mp - matrix @ mq, s, bool(np.linalg.det(rotation) < 0), residual, row["n"])


def normal_equations(rows: DataFrame, jacobian: str, residual: str, dim: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(J'J, J'r, r'r) summed over the rows of a small problem, for a dense solve on the driver."""
    sums = [F.sum(F.get(jacobian, a) * F.get(jacobian, b)) for a in range(dim) for b in range(dim)]
    sums += [F.sum(F.get(jacobian, a) * F.col(residual)) for a in range(dim)] + [F.sum(F.col(residual) * F.col(residual))]
    got = np.array(list(rows.agg(*sums).first()), float)
    return got[: dim * dim].reshape(dim, dim), got[dim * dim : -1], float(got[-1])


def solve_dense(matrix: np.ndarray, right: np.ndarray, damping: float = 0.0) -> np.ndarray:
    return np.linalg.solve(matrix + damping * np.diag(np.diag(matrix)), right)


def eigen_limits(matrix: np.ndarray) -> tuple[float, float]:
    values = np.linalg.eigvalsh(matrix)
    return float(values[0]), float(values[-1])
