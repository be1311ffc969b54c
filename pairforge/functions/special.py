"""Special functions as vectorised UDFs; hyperbolic functions, log10 and hypot are built in."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf


def igam(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    return 1 - igamc(a, x) if x > 1 and x > a else _series(a, x)


def _series(a: float, x: float) -> float:
    if x <= 0 or a <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def igamc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by Lentz's continued fraction beyond the series."""
    if x <= 0 or a <= 0:
        return 1.0
    if x < 1 or x < a:
        return 1 - _series(a, x)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = an * d + b, b + an / c
        d, c = (1e-300 if d == 0 else d), (1e-300 if c == 0 else c)
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def ibeta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function of arrays, by its continued fraction on the side where that is short."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.clip(np.where(swap, 1 - x, x), 1e-300, 1 - 1e-16)
    log_beta = _lgamma(a) + _lgamma(b) - _lgamma(a + b)
    front = np.exp(p * np.log(t) + q * np.log1p(-t) - log_beta) / p
    f, c, d = np.ones_like(t), np.ones_like(t), np.zeros_like(t)
    for i in range(1000):
        m = i // 2
        if i == 0:
            n = np.ones_like(t)
        elif i % 2 == 0:
            n = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            n = -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 + n * d, 1 + n / c
        d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
        f = f * c * d
        if np.all(np.abs(1 - c * d) < 1e-15):
            break
    part = front * (f - 1)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - part, part)))


_lgamma = np.vectorize(math.lgamma, otypes=[float])
#: Values times nodes held at once.
CELLS = 1 << 20


@functools.lru_cache(maxsize=64)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on 0 to 1."""
    t, w = np.polynomial.legendre.leggauss(n)
    return (t + 1) / 2, w / 2


def _in_chunks(f, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """f of arrays (n, x) and the number of nodes, values of like size together; that number grows with order and argument."""
    out = np.full(x.shape, np.nan)
    order = np.argsort(np.abs(n) + np.abs(x), kind="stable")
    order = order[np.isfinite(x[order])]
    at = 0
    while at < len(order):
        here = order[at : at + 4096]
        while True:
            nodes = 64 * (1 + int(np.max(np.abs(n[here]) + np.abs(x[here])) + 40) // 64)
            if len(here) * nodes <= CELLS or len(here) == 1:
                break
            here = here[: len(here) // 2]
        out[here] = f(n[here], x[here], nodes)
        at += len(here)
    return out


def _j(n: np.ndarray, x: np.ndarray, nodes: int) -> np.ndarray:
    # The integrand is even and periodic, so the trapezoid rule converges exponentially.
    t = np.linspace(0, math.pi, nodes + 1)
    v = np.cos(np.outer(n, t) - np.outer(x, np.sin(t)))
    return (v.sum(1) - 0.5 * (v[:, 0] + v[:, -1])) / nodes


def _y(n: np.ndarray, x: np.ndarray, nodes: int) -> np.ndarray:
    t, w = _nodes(nodes)
    first = np.sin(np.outer(x, np.sin(math.pi * t)) - np.outer(n, math.pi * t)) @ w
    u, v = _nodes(32)
    high = np.arcsinh((745 + 40 * np.abs(n)) / x) + 1
    second = np.zeros_like(x)
    for part in range(16):
        at = high[:, None] * ((part + u) / 16)
        fall = x[:, None] * np.sinh(at)
        odd = np.where(n % 2 == 0, 1.0, -1.0)[:, None]
        second += (np.exp(n[:, None] * at - fall) + odd * np.exp(-n[:, None] * at - fall)) @ v * high / 16
    return first - second / math.pi


def bessel_j(n, x) -> np.ndarray:
    """Bessel function of the first kind of integer order, from its integral; arrays or numbers, nan for infinite arguments."""
    n, x = np.broadcast_arrays(np.asarray(n, float), np.asarray(x, float))
    return _in_chunks(_j, n.ravel(), x.ravel()).reshape(x.shape)


def bessel_y(n, x) -> np.ndarray:
    """Bessel function of the second kind of integer order; minus infinity at 0, nan below."""
    n, x = np.broadcast_arrays(np.asarray(n, float), np.asarray(x, float))
    flat_n, flat = n.ravel(), x.ravel()
    out = np.where(flat == 0, -np.inf, np.nan)
    above = flat > 0
    out[above] = _in_chunks(_y, flat_n[above], flat[above])
    return out.reshape(x.shape)


def _arrays(f, count: int):
    """A UDF of whole columns; null where any argument is."""

    def call(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(float, na_value=np.nan) for c in columns]
        known = ~np.any([np.isnan(v) for v in values], axis=0)
        out = np.full(len(known), np.nan)
        out[known] = f(*(v[known] for v in values))
        return pd.Series(out).where(known, None)

    if count == 1:

        @pandas_udf("double")
        def one(x: pd.Series) -> pd.Series:
            return call(x)

        return one
    if count == 2:

        @pandas_udf("double")
        def two(a: pd.Series, x: pd.Series) -> pd.Series:
            return call(a, x)

        return two

    @pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return call(a, b, x)

    return three


def _one(f):
    @pandas_udf("double")
    def udf(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return udf


def _two(f):
    @pandas_udf("double")
    def udf(a: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([f(p, q) for p, q in zip(a, x)], dtype=float)

    return udf


def udfs() -> dict:
    """Name -> UDF; made on demand, as UDFs need a session."""
    return {
        "igam": _two(igam), "igamc": _two(igamc), "lgamma": _one(math.lgamma), "gamma": _one(math.gamma), "erf": _one(math.erf), "erfc": _one(math.erfc),
        "normal": _one(lambda x: 0.5 * math.erfc(-x / math.sqrt(2))), "chisq": _two(lambda df, x: igam(df / 2, x / 2)), "chisqc": _two(lambda df, x: igamc(df / 2, x / 2)),
        "poisson": _two(lambda k, x: igamc(k + 1, x)), "poissonc": _two(lambda k, x: igam(k + 1, x)),
        "j0": _arrays(lambda x: bessel_j(0, x), 1), "j1": _arrays(lambda x: bessel_j(1, x), 1), "y0": _arrays(lambda x: bessel_y(0, x), 1), "y1": _arrays(lambda x: bessel_y(1, x), 1),
        "jn": _arrays(bessel_j, 2), "yn": _arrays(bessel_y, 2), "ibeta": _arrays(ibeta, 3),
    }


def transform_4d(d: float, dim: float, tolerance: float = 1e-5, most: int = 50) -> float:
    """The squared distance in four dimensions that is as improbable as ``d`` in ``dim`` dimensions, by fixed-point steps."""
    p = igamc(dim / 2, d)
    x = d
    for _ in range(most):
        # The upper incomplete gamma function of 2 is (1 + x) exp(-x).
        new = math.log1p(x) - math.log(max(p, 1e-300))
        if abs(new - x) < tolerance:
            return new
        x = new
    return x
