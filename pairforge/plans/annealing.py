"""Queries over deterministic annealing, multidimensional scaling and rotation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pairforge.operators import mds as X
from pairforge.operators import pairwise_da as C
from pairforge.operators import rotation as O
from pairforge.operators import vector_da as D
from pairforge.plans.basics import DIM, DIST, MEANS, PTS, distances, label_means, points, r6
from pairforge.session import table


def _members(spark, sf):
    """Two soft clusters that depend on the id alone."""
    p = points(spark, sf).select("id")
    m = (F.pmod(F.col("id"), F.lit(7)) + 1) / 10.0
    return p.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), m.alias("m")), F.struct(F.lit(1).alias("k"), (1 - m).alias("m")))).alias("e")).select("id", "e.k", "e.m")


def da_initial_temperature(spark, sf):
    return C.initial_temperature(distances(spark, sf)).select(*(r6(c) for c in ("mean", "sigma", "t0", "dimension")))


def da_m_step(spark, sf):
    eps, _ = C.m_step(distances(spark, sf), _members(spark, sf))
    return eps.select("id", "k", r6("b"), r6("eps"))


def da_clusters(spark, sf):
    _, clusters = C.m_step(distances(spark, sf), _members(spark, sf))
    return clusters.select("k", r6("c"), r6("freezing"), r6("p"), r6("a"))


def da_e_step(spark, sf):
    eps, _ = C.m_step(distances(spark, sf), _members(spark, sf))
    return C.e_step(eps, 0.05).select("id", "k", r6("m"))


def da_labels(spark, sf):
    eps, _ = C.m_step(distances(spark, sf), _members(spark, sf))
    return C.labels(eps.withColumn("eps", F.round("eps", 9)))


def da_remove_small(spark, sf):
    m = _members(spark, sf).unionByName(points(spark, sf).where("id < 3").select("id", F.lit(2).alias("k"), F.lit(0.3).alias("m")))
    return C.remove_small(m, 5).select("id", F.col("k").cast("long").alias("k"), r6("m"))


def pairwise_annealing(spark, sf):
    s = C.anneal(distances(spark, sf), most=3, cooling=0.7, final=0.5, inner=2)
    return s.labels().groupBy("cluster").agg(F.count("*").alias("n"))


def vda_initial(spark, sf):
    return D.initial_state(points(spark, sf)).select(r6("spread"), r6("t0"))


def _centers(spark, sf):
    return label_means(points(spark, sf)).select(F.col("k"), "y", F.lit(0.1).alias("p"))


def vda_memberships(spark, sf):
    return D.memberships(points(spark, sf), _centers(spark, sf), 0.2, sponge=1.2, dim=DIM, with_x=False).select("id", F.col("k").cast("long").alias("k"), r6("m"))


def vda_sizes(spark, sf):
    m = D.memberships(points(spark, sf), _centers(spark, sf), 0.2, sponge=1.2, dim=DIM, with_x=False)
    return D.cluster_sums(m, 0.2).select(F.col("k").cast("long").alias("k"), r6("c"), r6("width"))


def vda_means(spark, sf):
    m = D.memberships(points(spark, sf), _centers(spark, sf), 0.2, dim=DIM)
    return D.weighted_means(m).select(F.col("k").cast("long").alias("k"), F.posexplode("y").alias("pos", "v")).select("k", F.col("pos").cast("long").alias("pos"), r6("v"))


def vda_nearest_clusters(spark, sf):
    m = D.memberships(points(spark, sf), _centers(spark, sf), 0.2, sponge=1.2, dim=DIM)
    return D.nearest_clusters(m, 3, 2.0).select("id", F.col("k").cast("long").alias("k"), r6("m"))


def vda_close_centers(spark, sf):
    return D.close_centers(label_means(points(spark, sf)), 0.8).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), r6("d2"))


def eigen_2x2(spark, sf):
    p = points(spark, sf)
    a, b, d = (F.get("x", k) for k in range(3))
    value, x, y = D.eigenpair_2x2(a, b, d)
    return p.select("id", r6(value, "value"), r6(x * x, "x2"), r6(y * y, "y2"))


def vda_covariance(spark, sf):
    p = points(spark, sf)
    m = p.select("id", F.slice("x", 1, 4).alias("x"), F.col("label").alias("k"), F.lit(1.0).alias("m"))
    c = label_means(p).select("k", F.slice("y", 1, 4).alias("y"))
    return D.covariances(m, c).select(F.col("k").cast("long").alias("k"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("v"))


def vector_annealing(spark, sf):
    s = D.anneal(points(spark, sf), sponge=1.2, dim=DIM)
    return s.labels().groupBy("cluster").agg(F.count("*").alias("n"))


def _positions(spark, sf):
    return points(spark, sf).select("id", F.slice("x", 1, 3).alias("x"))


FIT = X.Fit(norm=2, formula=1, average=1.0, least=0.01)


def mds_gradient(spark, sf):
    g = X.gradient(distances(spark, sf), _positions(spark, sf), FIT)
    return g.select("id", r6("chi"), *(r6(F.get("g", k), f"g{k}") for k in range(3)), *(r6(F.get("h", k), f"h{k}") for k in range(3)))


def mds_hessian_product(spark, sf):
    state = points(spark, sf).select("id", F.slice("x", 1, 3).alias("x"), F.slice("x", 4, 3).alias("v"))
    return X.hessian_product(distances(spark, sf), state, FIT).select("id", *(r6(F.get("hv", k), f"hv{k}") for k in range(3)))


def mds_components(spark, sf):
    p = _positions(spark, sf)
    return X.chi_components(distances(spark, sf), p, p.select("id", (F.col("id") % 3 == 0).alias("varied")), FIT).select("varied_i", "varied_j", r6("chi"), "n")


def mds_scaling(spark, sf):
    return X.scale(distances(spark, sf), X.Fit(norm=3), rounds=2, steps=2).positions.select("id", *(F.get("x", k).alias(n) for k, n in enumerate("xyz")))


def rotation_fit(spark, sf):
    """A rotated, shifted and scaled copy is mapped back onto the points."""
    p = _positions(spark, sf)
    turn = O.Transform(O.total([0.3, -0.8, 1.1], 1.7, True), np.array([0.5, -2.0, 1.0]), 1.7, True, 0.0, 0)
    copy = turn.apply(p)
    back = O.fit(p, copy).apply(copy)
    return back.select("id", *(r6(F.get("x", k), n) for k, n in enumerate("xyz")))


def rotation_apply(spark, sf):
    turn = O.Transform(O.total([0.5]), np.array([1.0, 2.0]), 1.0, False, 0.0, 0)
    return turn.apply(points(spark, sf).select("id", F.slice("x", 1, 2).alias("x"))).select("id", *(r6(F.get("x", k), n) for k, n in enumerate("xy")))


def proper_angles(spark, sf):
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("a"))
    return i.select("l_orderkey", "l_linenumber", r6(O.proper_angle(F.col("a")), "angle"), r6(O.bounded_scale(F.col("a"), 0.5, 2.0), "scale"))


QUERIES = {
    "da_initial_temperature": da_initial_temperature, "da_m_step": da_m_step, "da_clusters": da_clusters, "da_e_step": da_e_step, "da_labels": da_labels, "da_remove_small": da_remove_small,
    "pairwise_annealing": pairwise_annealing, "vda_initial": vda_initial, "vda_memberships": vda_memberships, "vda_sizes": vda_sizes, "vda_means": vda_means, "vda_nearest_clusters": vda_nearest_clusters,
    "vda_close_centers": vda_close_centers, "vda_eigen_2x2": eigen_2x2, "vda_covariance": vda_covariance, "vector_annealing": vector_annealing, "mds_gradient": mds_gradient,
    "mds_hessian_product": mds_hessian_product, "mds_components": mds_components, "mds_scaling": mds_scaling, "rotation_fit": rotation_fit, "rotation_apply": rotation_apply, "rotation_angles": proper_angles,
}

_MEM = DIST + """, mem AS (SELECT id, 0 AS k, (id % 7 + 1) / 10.0::DOUBLE AS m FROM pts UNION ALL SELECT id, 1, 1 - (id % 7 + 1) / 10.0::DOUBLE FROM pts)"""
_STEP = _MEM + """, c AS (SELECT k, sum(m) AS c, sum(m * (1 - m)) / sum(m) AS freezing, sum(m) / (SELECT count(*) FROM pts) AS p FROM mem GROUP BY k),
  s AS (SELECT i AS id, k, sum(d * m) AS s FROM dist JOIN mem ON mem.id = j GROUP BY i, k), b AS (SELECT s.id, s.k, mem.m, s / c AS b FROM s JOIN c ON c.k = s.k JOIN mem ON mem.id = s.id AND mem.k = s.k),
  a AS (SELECT b.k, -0.5 * sum(b * m) / any_value(c) AS a FROM b JOIN c ON c.k = b.k GROUP BY b.k), eps AS (SELECT b.id, b.k, b, b + a AS eps FROM b JOIN a ON a.k = b.k)"""
_VDA = MEANS + """, t0 AS (SELECT id, k, list_distance(x, y) * list_distance(x, y) / 0.2::DOUBLE AS t FROM pts CROSS JOIN centers)"""
_SPONGE = ", t1 AS (SELECT id, CAST(k AS BIGINT) AS k, t, CAST(0.1 AS DOUBLE) AS p FROM t0 UNION ALL SELECT id, -1, 1.2::DOUBLE * 1.2::DOUBLE / 0.2::DOUBLE, CAST(0 AS DOUBLE) FROM pts)"
_PLAIN = ", t1 AS (SELECT id, CAST(k AS BIGINT) AS k, t, CAST(0.1 AS DOUBLE) AS p FROM t0)"
_SOFT = ", l AS (SELECT *, min(t) OVER (PARTITION BY id) AS low FROM t1), e AS (SELECT id, k, t, low, CASE WHEN t - low < 40 THEN greatest(p, 1e-7) * exp(-0.5 * (t - low)) ELSE 0 END AS e FROM l), m AS (SELECT id, k, t, low, e / sum(e) OVER (PARTITION BY id) AS m FROM e)"
_PAIRS = DIST + """, q AS (SELECT i, j, d, [a.x[1] - b.x[1], a.x[2] - b.x[2], a.x[3] - b.x[3]] AS z, [a.x[4] - b.x[4], a.x[5] - b.x[5], a.x[6] - b.x[6]] AS dv FROM dist JOIN pts a ON a.id = i JOIN pts b ON b.id = j),
  q2 AS (SELECT *, sqrt(z[1] * z[1] + z[2] * z[2] + z[3] * z[3] + 0.0001) AS far, 1 / sqrt(greatest(d, 0.01)) AS w2 FROM q), t AS (SELECT *, w2 * (d - far) AS f, 0.5 / far AS sl FROM q2)"""
_R = O.total([0.5])
ORACLE_SQL = {
    "da_initial_temperature": f"WITH {DIST} SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sigma, round(2 * avg(d), 6) AS t0, round(2 * avg(d) * avg(d) / var_pop(d), 6) AS dimension FROM dist",
    "da_m_step": f"WITH {_STEP} SELECT id, k, round(b, 6) AS b, round(eps, 6) AS eps FROM eps",
    "da_clusters": f"WITH {_STEP} SELECT c.k, round(c, 6) AS c, round(freezing, 6) AS freezing, round(p, 6) AS p, round(a, 6) AS a FROM c JOIN a ON a.k = c.k",
    "da_e_step": f"WITH {_STEP}, e AS (SELECT id, k, exp(-(eps - min(eps) OVER (PARTITION BY id)) / 0.05::DOUBLE) AS e FROM eps) SELECT id, k, round(e / sum(e) OVER (PARTITION BY id), 6) AS m FROM e",
    "da_labels": f"WITH {_STEP} SELECT id, arg_min(k, struct_pack(e := round(eps, 9), k := k)) AS cluster FROM eps GROUP BY id",
    "da_remove_small": f"WITH {PTS} SELECT id, CAST(0 AS BIGINT) AS k, round((id % 7 + 1) / 10.0::DOUBLE, 6) AS m FROM pts UNION ALL SELECT id, 1, round(1 - (id % 7 + 1) / 10.0::DOUBLE, 6) FROM pts",
    "vda_initial": f"WITH {MEANS}, g AS (SELECT p, avg(v) AS v FROM pos GROUP BY p), s AS (SELECT pos.id, sum((pos.v - g.v) * (pos.v - g.v)) AS s FROM pos JOIN g ON g.p = pos.p GROUP BY pos.id) SELECT round(avg(s), 6) AS spread, round(1.5 * avg(s), 6) AS t0 FROM s",
    "vda_memberships": f"WITH {_VDA}{_SPONGE}{_SOFT} SELECT id, k, round(m, 6) AS m FROM m",
    "vda_sizes": f"WITH {_VDA}{_SPONGE}{_SOFT} SELECT k, round(sum(m), 6) AS c, round(sum(m * t * 0.2::DOUBLE) / sum(m), 6) AS width FROM m GROUP BY k",
    "vda_means": f"WITH {_VDA}{_PLAIN}{_SOFT} SELECT m.k, pos.p AS pos, round(sum(m * v) / sum(m), 6) AS v FROM m JOIN pos ON pos.id = m.id GROUP BY m.k, pos.p",
    "vda_nearest_clusters": f"WITH {_VDA}{_SPONGE}{_SOFT}, n AS (SELECT id, k, m FROM m QUALIFY (row_number() OVER (PARTITION BY id ORDER BY t, k) <= 3 AND t - low <= 4) OR k = -1) SELECT id, k, round(CASE WHEN sum(m) OVER (PARTITION BY id) < 0.2 THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY id) ELSE m / sum(m) OVER (PARTITION BY id) END, 6) AS m FROM n",
    "vda_close_centers": f"WITH {MEANS}, d AS (SELECT CAST(a.k AS BIGINT) AS a, CAST(b.k AS BIGINT) AS b, list_distance(a.y, b.y) * list_distance(a.y, b.y) AS d2 FROM centers a JOIN centers b ON a.k < b.k) SELECT a, b, round(d2, 6) AS d2 FROM d WHERE d2 < 0.8",
    "vda_eigen_2x2": f"WITH {PTS}, v AS (SELECT id, x[1] AS a, x[2] AS b, x[3] AS d, 0.5 * (x[1] + x[3] - sqrt((x[1] - x[3]) * (x[1] - x[3]) + 4 * x[2] * x[2])) AS l FROM pts) SELECT id, round(l, 6) AS value, round(b * b / (b * b + (l - a) * (l - a)), 6) AS x2, round((l - a) * (l - a) / (b * b + (l - a) * (l - a)), 6) AS y2 FROM v",
    "vda_covariance": f"WITH {MEANS}, z AS (SELECT pos.id, pos.label, pos.p, pos.v - m.v AS z FROM pos JOIN mean_pos m ON m.label = pos.label AND m.p = pos.p WHERE pos.p < 4) SELECT CAST(a.label AS BIGINT) AS k, a.p AS i, b.p AS j, round(sum(a.z * b.z), 6) AS v FROM z a JOIN z b ON a.id = b.id AND a.p <= b.p GROUP BY a.label, a.p, b.p",
    "mds_gradient": f"WITH {_PAIRS} SELECT i AS id, round(sum(f * f), 6) AS chi, {', '.join(f'round(sum(-4 * z[{k + 1}] * f * sl * w2), 6) AS g{k}, round(sum(8 * z[{k + 1}] * z[{k + 1}] * sl * sl * w2 * w2), 6) AS h{k}' for k in range(3))} FROM t GROUP BY i",
    "mds_hessian_product": f"WITH {_PAIRS}, u AS (SELECT *, 8 * sl * sl * w2 * w2 * (z[1] * dv[1] + z[2] * dv[2] + z[3] * dv[3]) AS c FROM t) SELECT i AS id, {', '.join(f'round(sum(z[{k + 1}] * c), 6) AS hv{k}' for k in range(3))} FROM u GROUP BY i",
    "mds_components": f"WITH {_PAIRS} SELECT i % 3 = 0 AS varied_i, j % 3 = 0 AS varied_j, round(sum(f * f), 6) AS chi, count(*) AS n FROM t GROUP BY 1, 2",
    "rotation_fit": f"WITH {PTS} SELECT id, round(x[1], 6) AS x, round(x[2], 6) AS y, round(x[3], 6) AS z FROM pts",
    "rotation_apply": f"WITH {PTS} SELECT id, round({float(_R[0, 0])!r} * x[1] + {float(_R[0, 1])!r} * x[2] + 1, 6) AS x, round({float(_R[1, 0])!r} * x[1] + {float(_R[1, 1])!r} * x[2] + 2, 6) AS y FROM pts",
    "rotation_angles": f"SELECT l_orderkey, l_linenumber, round((l_quantity - 25) - floor(((l_quantity - 25) + {math.pi!r}) / (2 * {math.pi!r})) * (2 * {math.pi!r}), 6) AS angle, round(1.25 + 0.75 * sin(l_quantity - 25), 6) AS scale FROM lineitem",
}
