"""Queries over runs of blocks that are taken up again, and over functions of points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairforge.functions import vector as V
from pairforge.operators import block_runs as B
from pairforge.operators import function_cuts as C
from pairforge.plans.basics import DIM, DIST, PTS, points, r6
from pairforge.session import shared_dir

BLOCKS, AT_ONCE = 6, 6


def restarted_run(spark, sf):
    """All distances in blocks; the run is broken off after half of the jobs and taken up again."""
    path = f"{shared_dir(spark)}/pairforge/{uuid.uuid4().hex}"
    compute = lambda p: p.select("row_block", "col_block", "i", "j", F.explode(F.array(V.distance(F.col("x_i"), F.col("x_j"), DIM))).alias("d"))
    again = lambda jobs=None: B.run(points(spark, sf), ["x"], compute, path, BLOCKS, at_once=AT_ONCE, jobs=jobs, project="distances")
    again(2)
    again()
    got = B.results(spark, path).groupBy("row_block", "col_block").agg(F.count("*").alias("n"), r6(F.sum("d"), "total"))
    covered = B.manifest(spark, path).groupBy("row_block", "col_block").agg(F.count("*").alias("times"), F.sum("pairs").alias("pairs"), F.min("row_first").alias("row_first"), F.max("col_last").alias("col_last"))
    return got.join(covered, ["row_block", "col_block"])


def _functions(spark, sf):
    """Three functions of each point: a coordinate, a mix of coordinates, and the label."""
    p = points(spark, sf)
    each = {"mixed": F.get("x", 0) + 2 * F.get("x", 1) - F.get("x", 5), "third": F.get("x", 2), "label": F.col("label").cast("double")}
    return p.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in each.items()))).alias("f")).select("id", "f.name", "f.value")


def _positions(spark, sf):
    return points(spark, sf).select("id", F.slice("x", 1, 3).alias("x"))


def function_statistics(spark, sf):
    w = points(spark, sf).select("id", (F.pmod("id", F.lit(5)) + 1).cast("double").alias("w"))
    got = C.statistics(_positions(spark, sf), _functions(spark, sf), 3, w)
    return got.select("name", "n", r6("weight"), r6("mean"), r6("sigma"), r6("correlation"), *(r6(F.get("direction", k), f"a{k}") for k in range(3)))


def function_divisions(spark, sf):
    return C.divided(_functions(spark, sf)).select("id", "name", "division", "division_nz")


def function_division_means(spark, sf):
    got = C.division_statistics(C.divided(_functions(spark, sf)), _positions(spark, sf), 3)
    return got.select("name", "division", "n", r6("low"), r6("high"), r6("mean"), *(r6(F.get("center", k), f"c{k}") for k in range(3)))


QUERIES = {"pairs_restarted_run": restarted_run, "function_statistics": function_statistics, "function_divisions": function_divisions, "function_division_means": function_division_means}

_FUN = PTS + ", f AS (SELECT id, x, unnest(['mixed', 'third', 'label']) AS name, unnest([x[1] + 2 * x[2] - x[6], x[3], CAST(label AS DOUBLE)]) AS value FROM pts)"
_DIV = _FUN + """, s AS (SELECT name, avg(abs(value)) AS size FROM f GROUP BY name), n AS (SELECT f.*, size, ntile(10) OVER (PARTITION BY f.name ORDER BY value, id) AS division FROM f JOIN s ON s.name = f.name)"""
_V = [[f"(v{min(a, b)}{max(a, b)})" for b in range(3)] for a in range(3)]


def _det(m: list[list[str]]) -> str:
    return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"


_SOLVED = [_det([[f"(c{a})" if b == k else _V[a][b] for b in range(3)] for a in range(3)]) for k in range(3)]
ORACLE_SQL = {
    "pairs_restarted_run": f"""WITH {DIST}, e AS (SELECT min(id) AS low, max(id) AS high FROM pts), k AS (SELECT id, CAST(floor((id - low) * {BLOCKS} / (high - low + 1)) AS BIGINT) AS b FROM pts, e),
h AS (SELECT r.b AS row_block, c.b AS col_block, d FROM dist JOIN k r ON r.id = i JOIN k c ON c.id = j WHERE CASE WHEN r.b = c.b THEN i > j ELSE (r.b > c.b) = ((r.b + c.b) % 2 = 0) END),
z AS (SELECT b, min(id) AS first, max(id) AS last FROM k GROUP BY b)
SELECT row_block, col_block, count(*) AS n, round(sum(d), 6) AS total, 1 AS times, count(*) AS pairs, any_value(r.first) AS row_first, any_value(c.last) AS col_last FROM h JOIN z r ON r.b = row_block JOIN z c ON c.b = col_block GROUP BY row_block, col_block""",
    "function_divisions": f"WITH {_DIV} SELECT id, name, division, CASE WHEN abs(value) < 0.1::DOUBLE * size THEN 0 ELSE division END AS division_nz FROM n",
    "function_division_means": f"WITH {_DIV} SELECT name, division, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, {', '.join(f'round(avg(x[{k + 1}]), 6) AS c{k}' for k in range(3))} FROM n GROUP BY name, division",
    "function_statistics": f"""WITH {_FUN}, w AS (SELECT *, CAST(id % 5 + 1 AS DOUBLE) AS w FROM f),
s AS (SELECT name, count(*) AS n, sum(w) AS weight, sum(w * value) / sum(w) AS mean, sum(w * value * value) / sum(w) AS gg, {', '.join(f'sum(w * x[{k + 1}]) / sum(w) AS m{k}, sum(w * x[{k + 1}] * value) / sum(w) AS q{k}' for k in range(3))},
  {', '.join(f'sum(w * x[{a + 1}] * x[{b + 1}]) / sum(w) AS u{a}{b}' for a in range(3) for b in range(a, 3))} FROM w GROUP BY name),
t AS (SELECT name, n, weight, mean, gg - mean * mean AS variance, {', '.join(f'q{k} - mean * m{k} AS c{k}' for k in range(3))}, {', '.join(f'u{a}{b} - m{a} * m{b} AS v{a}{b}' for a in range(3) for b in range(a, 3))} FROM s),
y AS (SELECT *, {', '.join(f'{_SOLVED[k]} / {_det(_V)} AS y{k}' for k in range(3))} FROM t), a AS (SELECT *, sqrt(y0 * y0 + y1 * y1 + y2 * y2) AS size FROM y),
b AS (SELECT *, {', '.join(f'y{k} / size AS a{k}' for k in range(3))} FROM a)
SELECT name, n, round(weight, 6) AS weight, round(mean, 6) AS mean, round(sqrt(variance), 6) AS sigma, round((a0 * c0 + a1 * c1 + a2 * c2) / sqrt(variance * ({' + '.join(f'a{a} * a{b} * {_V[a][b]}' for a in range(3) for b in range(3))})), 6) AS correlation,
  round(a0, 6) AS a0, round(a1, 6) AS a1, round(a2, 6) AS a2 FROM b""",
}
