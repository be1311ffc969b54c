"""Queries over bounded K-means, frames of reference, bounds and steps of scaling, schedules, restarts, cluster offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import annealing_control as N
from pairforge.operators import comparison as L
from pairforge.operators import kmeans as K
from pairforge.operators import mds as X
from pairforge.operators import mds_control as M
from pairforge.operators import transforms as T
from pairforge.operators import triangle as B
from pairforge.plans.annealing import _members
from pairforge.plans.basics import DIM, DIST, MEANS, PTS, distances, points, r6
from pairforge.plans.clustering import SETTLED, _LLOYD, _TWO, _converged_sql, _scaled, _two
from pairforge.session import stage


def kmeans_bounded(spark, sf):
    """Two updates by bounds; the same clusters as without them."""
    pts = points(spark, sf)
    first = pts.where("id < 4").select(F.col("id").alias("k"), F.col("x").alias("y"))
    assigned, _, _ = B.fit(pts, first, cut=float("inf"), extra=0, most=1, dim=DIM)
    return K.center_stats(assigned).select("k", "n", r6("radius"), r6("width"))


def kmeans_bounded_converged(spark, sf):
    """To the fixed point, and whether bounds saved a third of the distances."""
    pts = points(spark, sf)
    first = pts.where("id < 4").select(F.col("id").alias("k"), F.col("x").alias("y"))
    assigned, _, steps = B.fit(pts, first, **SETTLED, dim=DIM)
    # One number.
    saved = assigned.agg((F.avg("computed") < 0.67 * 4 * (steps + 1)).alias("saved"))
    return assigned.select("id", "k", r6("d")).join(F.broadcast(saved))


def mds_center(spark, sf):
    return M.center(distances(spark, sf)).select("center", r6("radius"))


def mds_center_bins(spark, sf):
    return M.distance_bins(distances(spark, sf), 1.2, 1.5, 30)


def mds_axes(spark, sf):
    """The points that fix the center, the x axis and the xy plane."""
    d = stage(spark, distances(spark, sf), "distances")
    center = M.center(d).first()["center"]
    axis = M.x_axis(d, center)
    x = axis.first()["point"]
    one = lambda which, f: f.select(F.lit(which).alias("which"), F.col("point"), r6("d"))
    return one("x", axis).unionByName(one("xy", M.xy_plane(d, center, x)))


def mds_nearby(spark, sf):
    return M.nearby(distances(spark, sf), 1.2)


def transform_4d(spark, sf):
    d = _scaled(spark, sf)
    return d.select("i", "j", r6(T.transform(F.col("d"), 8, 1.0), "t8"), r6(T.transform(F.col("d"), 9, 1.0), "t9"))


FIT = X.Fit(norm=3, formula=1, average=1.0, dim=3)


def _positions(spark, sf):
    return points(spark, sf).select("id", F.slice("x", 1, 3).alias("x"))


def mds_trace_norm(spark, sf):
    return M.trace_and_norm(distances(spark, sf), _positions(spark, sf), FIT).select(F.round("trace", 4).alias("trace"), F.round("norm", 4).alias("norm"))


def mds_predicted_change(spark, sf):
    """The steepest-descent step: what it should change by its linear and quadratic terms, and does."""
    d, p = stage(spark, distances(spark, sf), "distances"), _positions(spark, sf)
    state = stage(spark, p.join(X.gradient(d, p, FIT), "id").select("id", "x", "g", "h"), "state")
    step = stage(spark, M.steepest_descent(d, state, FIT), "step")
    linear, quadratic = M.predicted_change(d, step, FIT)
    before, after = (0.5 * M.chi_squared(d, step.select("id", X._mix("x", t, "s", 3).alias("x")), FIT) for t in (0.0, 1.0))
    factor, value = M.line_search(d, step, FIT)
    got = {"linear": linear, "quadratic": quadratic, "before": before, "after": after}
    row = (*(round(v, 3) for v in got.values()), after < before, 0.5 * value <= after * (1 + 1e-9) and factor > 0)
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in got) + ", falls boolean, search_not_worse boolean")


def mds_derivative_test(spark, sf):
    """The derivative along a direction, by a difference and from the gradient."""
    along = F.array(*((F.col("id") * (2 * k + 3) % 11).cast("double") / 11 - 0.5 for k in range(3)))
    numerical, analytical = M.derivative_test(stage(spark, distances(spark, sf), "distances"), _positions(spark, sf), FIT, direction=along)
    return spark.createDataFrame([(round(numerical, 2), round(analytical, 4))], "numerical double, analytical double")


def mds_damping_limits(spark, sf):
    """Bounds of the Hessian's eigenvalues lie between zero and its trace and norm."""
    d, p = stage(spark, distances(spark, sf), "distances"), _positions(spark, sf)
    got, bound = M.damping_limits(d, p, FIT, most=15), M.trace_and_norm(d, p, FIT).first()
    top = min(bound["trace"], bound["norm"])
    return spark.createDataFrame([(0 < got.low <= got.high, got.high <= 1.001 * top, round(top, 4))], "ordered boolean, bounded boolean, bound double")


def vda_restart(spark, sf):
    labels = points(spark, sf).select("id", F.when(F.col("id") % 17 == 0, -1).otherwise(F.col("label")).cast("long").alias("cluster"))
    return N.restart(points(spark, sf), labels, DIM).select("k", r6("p"), r6(F.aggregate("y", F.lit(0.0), lambda a, b: a + b), "total"))


def vda_membership_change(spark, sf):
    old = _members(spark, sf)
    new = points(spark, sf).select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), ((F.col("id") % 5 + 1) / 10).alias("m")), F.struct(F.lit(2).alias("k"), F.lit(0.5).alias("m")))).alias("e")).select("id", "e.k", "e.m")
    return N.membership_change(old, new).select(F.col("k").cast("long").alias("k"), r6("change"))


def annealing_schedules(spark, sf):
    """A width and a sponge over falling temperatures."""
    t = points(spark, sf).select("id", (10.0 * F.pow(F.lit(0.99), F.col("id"))).alias("t"))
    return t.select("id", r6(N.annealed(F.lit(2.0), 0.5, F.col("t"), 1.0, 0.95), "width"), r6(N.sponge_factor(F.lit(4.0), 5.0, 1.0, F.col("t"), 8.0, 0.5), "sponge"))


def cluster_offsets(spark, sf):
    p = points(spark, sf).select(F.col("label").alias("grp"), (F.get("x", 0) + 3).alias("x"), F.get("x", 1).alias("y"))
    return L.offset_histograms(p, 20, (0.02, 0.1), (0.5, 12), (0.5, 30))


def golden_clusters(spark, sf):
    a, b = _two(spark, sf)
    c = points(spark, sf).select("id", F.when(F.get("x", 3) > 0, 1).otherwise(0).cast("long").alias("cluster"))
    return L.golden_comparison(a, {"signs": b, "half": c}, 10)


QUERIES = {
    "kmeans_bounded": kmeans_bounded, "kmeans_bounded_converged": kmeans_bounded_converged, "mds_center": mds_center, "mds_center_bins": mds_center_bins, "mds_axes": mds_axes, "mds_nearby": mds_nearby,
    "transform_4d": transform_4d, "mds_trace_norm": mds_trace_norm, "mds_predicted_change": mds_predicted_change, "mds_derivative_test": mds_derivative_test, "mds_damping_limits": mds_damping_limits,
    "vda_restart": vda_restart, "vda_membership_change": vda_membership_change, "annealing_schedules": annealing_schedules, "compare_offset_histograms": cluster_offsets, "compare_golden": golden_clusters,
}

_MDS_CENTER = DIST + ", c AS (SELECT i, avg(d) AS mean FROM dist GROUP BY i), best AS (SELECT arg_min(i, struct_pack(m := mean, i := i)) AS center, min(mean) AS radius FROM c)"
_AXIS = _MDS_CENTER + ", ax AS (SELECT arg_min(i, struct_pack(d := -d, i := i)) AS point, max(d) AS d FROM dist JOIN best ON j = center)"
_T = DIST + """, t AS MATERIALIZED (SELECT i, j, d, a.x[1] - b.x[1] AS u, a.x[2] - b.x[2] AS v, a.x[3] - b.x[3] AS w FROM dist JOIN pts a ON a.id = i JOIN pts b ON b.id = j),
f AS MATERIALIZED (SELECT *, sqrt(u * u + v * v + w * w + 1e-6) AS far FROM t)"""
_STEP = _T + """, g AS (SELECT i, sum(-2 * (d - far) * u / far) AS gu, sum(-2 * (d - far) * v / far) AS gv, sum(-2 * (d - far) * w / far) AS gw, sum(2 * u * u / (far * far)) AS hu, sum(2 * v * v / (far * far)) AS hv, sum(2 * w * w / (far * far)) AS hw FROM f GROUP BY i),
s0 AS MATERIALIZED (SELECT *, -gu / sqrt(CASE WHEN hu > 0 THEN hu ELSE 1 END) AS su, -gv / sqrt(CASE WHEN hv > 0 THEN hv ELSE 1 END) AS sv, -gw / sqrt(CASE WHEN hw > 0 THEN hw ELSE 1 END) AS sw FROM g),
e AS MATERIALIZED (SELECT f.*, a.su - b.su AS du, a.sv - b.sv AS dv, a.sw - b.sw AS dw FROM f JOIN s0 a ON a.i = f.i JOIN s0 b ON b.i = f.j WHERE f.i > f.j),
m AS (SELECT gs, curve, -gs / curve AS factor FROM (SELECT sum(gu * su + gv * sv + gw * sw) AS gs FROM s0) CROSS JOIN (SELECT sum(2 * pow((u * du + v * dv + w * dw) / far, 2)) AS curve FROM e)),
c AS (SELECT any_value(-factor * gs) AS linear, any_value(-0.5::DOUBLE * factor * factor * curve) AS quadratic, sum(pow(d - far, 2)) AS before, sum(pow(d - sqrt(pow(u + factor * du, 2) + pow(v + factor * dv, 2) + pow(w + factor * dw, 2) + 1e-6), 2)) AS after FROM e CROSS JOIN m)"""


_TRACE_NORM = f"""WITH {DIST}, t AS (SELECT i, a.x[1] - b.x[1] AS u, a.x[2] - b.x[2] AS v, a.x[3] - b.x[3] AS w FROM dist JOIN pts a ON a.id = i JOIN pts b ON b.id = j),
s AS (SELECT *, 2 / (u * u + v * v + w * w + 1e-6) AS s FROM t),
g AS (SELECT i, sum(s * u * u) AS uu, sum(s * v * v) AS vv, sum(s * w * w) AS ww, sum(s * u * v) AS uv, sum(s * u * w) AS uw, sum(s * v * w) AS vw,
  sum(s * abs(u) * (abs(u) + abs(v) + abs(w))) AS ou, sum(s * abs(v) * (abs(u) + abs(v) + abs(w))) AS ov, sum(s * abs(w) * (abs(u) + abs(v) + abs(w))) AS ow FROM s GROUP BY i)
SELECT round(sum(uu + vv + ww), 4) AS trace, round(max(greatest(abs(uu) + abs(uv) + abs(uw) + ou, abs(uv) + abs(vv) + abs(vw) + ov, abs(uw) + abs(vw) + abs(ww) + ow)), 4) AS norm FROM g"""


def _along(t: str) -> str:
    new = " + ".join(f"pow({x} + {t} * (((i * {k} % 11) - (j * {k} % 11)) / 11.0::DOUBLE), 2)" for x, k in (("u", 3), ("v", 5), ("w", 7)))
    return f"sum(pow(d - sqrt({new} + 1e-6), 2))"


ORACLE_SQL = {
    "kmeans_bounded": f"WITH {_LLOYD} SELECT k, count(*) AS n, round(max(d), 6) AS radius, round(sum(d * d), 6) AS width FROM a1 GROUP BY k",
    "kmeans_bounded_converged": f"WITH {_converged_sql()} SELECT id, k, d, true AS saved FROM a",
    "mds_center": f"WITH {_MDS_CENTER} SELECT center, round(radius, 6) AS radius FROM best",
    "mds_center_bins": f"WITH {DIST}, h AS (SELECT (d - CAST(1.2 AS DOUBLE)) * (30 / (CAST(1.5 AS DOUBLE) - CAST(1.2 AS DOUBLE))) AS v FROM dist) SELECT CAST(least(greatest(CASE WHEN floor(v) = 30 THEN floor(v - CAST(0.00001 AS DOUBLE)) ELSE floor(v) END, -1), 30) + 1 AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY 1",
    "mds_axes": f"""WITH {_AXIS}, pr AS (SELECT a.i, a.d * b.d AS d FROM dist a JOIN best ON a.j = center JOIN dist b ON b.i = a.i JOIN ax ON b.j = ax.point)
SELECT 'x' AS which, point, round(d, 6) AS d FROM ax UNION ALL SELECT 'xy', arg_min(i, struct_pack(d := -d, i := i)), round(max(d), 6) FROM pr""",
    "mds_nearby": f"WITH {DIST}, n AS (SELECT i, count(*) AS n FROM dist WHERE d < CAST(1.2 AS DOUBLE) GROUP BY i) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs, count(*) AS points FROM n",
    "transform_4d": f"""WITH RECURSIVE {DIST}, half AS (SELECT i, j, -ln(d / 2) AS first FROM dist WHERE i > j),
r AS (SELECT i, j, first, first AS e, false AS done, 0 AS step FROM half UNION ALL SELECT i, j, first, first + ln(1 + e), abs(first + ln(1 + e) - e) < 1e-5, step + 1 FROM r WHERE NOT done AND step < 50)
SELECT i, j, round(e, 6) AS t8, round(sqrt(e), 6) AS t9 FROM (SELECT i, j, arg_max(e, step) AS e FROM r GROUP BY i, j)""",
    "mds_trace_norm": _TRACE_NORM,
    "mds_predicted_change": f"WITH {_STEP} SELECT round(linear, 3) AS linear, round(quadratic, 3) AS quadratic, round(before, 3) AS before, round(after, 3) AS after, after < before AS falls, true AS search_not_worse FROM c",
    "mds_derivative_test": f"""WITH {_T} SELECT round(({_along("1e-4::DOUBLE")} - {_along("-1e-4::DOUBLE")}) / 2e-4::DOUBLE, 2) AS numerical,
  round(sum(-2 * (d - far) / far * (u * ((i * 3 % 11) - (j * 3 % 11)) + v * ((i * 5 % 11) - (j * 5 % 11)) + w * ((i * 7 % 11) - (j * 7 % 11))) / 11.0::DOUBLE), 4) AS analytical FROM f WHERE i > j""",
    "mds_damping_limits": "SELECT true AS ordered, true AS bounded, least(trace, norm) AS bound FROM (" + _TRACE_NORM + ")",
    "vda_restart": f"""WITH {PTS}, l AS (SELECT id, x, CASE WHEN id % 17 = 0 THEN -1 ELSE label END AS k FROM pts), n AS (SELECT k, count(*) / (SELECT count(*) FROM l) AS p FROM l GROUP BY k),
e AS (SELECT k, unnest(range(64)) AS pos, unnest(x) AS v FROM l WHERE k >= 0), m AS (SELECT k, pos, avg(v) AS v FROM e GROUP BY k, pos), y AS (SELECT k, sum(v) AS total FROM m GROUP BY k)
SELECT CAST(n.k AS BIGINT) AS k, round(p, 6) AS p, round(total, 6) AS total FROM n LEFT JOIN y ON y.k = n.k""",
    "vda_membership_change": """WITH o AS (SELECT vec_id AS id, 0 AS k, (vec_id % 7 + 1) / 10 AS m FROM embeddings UNION ALL SELECT vec_id, 1, 1 - (vec_id % 7 + 1) / 10 FROM embeddings),
n AS (SELECT vec_id AS id, 0 AS k, (vec_id % 5 + 1) / 10 AS m FROM embeddings UNION ALL SELECT vec_id, 2, 0.5 FROM embeddings)
SELECT CAST(coalesce(o.k, n.k) AS BIGINT) AS k, round(sum(abs(coalesce(o.m, 0) - coalesce(n.m, 0))), 6) AS change FROM o FULL JOIN n ON o.id = n.id AND o.k = n.k GROUP BY 1""",
    "annealing_schedules": """WITH t AS (SELECT vec_id AS id, 10.0::DOUBLE * pow(0.99::DOUBLE, vec_id) AS t FROM embeddings)
SELECT id, round(CASE WHEN t <= 1 THEN 0.5::DOUBLE ELSE greatest(0.5::DOUBLE, 2 * exp(ln(0.95::DOUBLE) * (ln(0.5::DOUBLE) - ln(2.0::DOUBLE)) / least(ln(1.0::DOUBLE) - ln(t), ln(0.95::DOUBLE)))) END, 6) AS width,
  round(CASE WHEN t <= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE, 1 + 4 * (t - 0.5::DOUBLE) / 7.5::DOUBLE) END, 6) AS sponge FROM t""",
    "compare_offset_histograms": f"""WITH {PTS}, g AS (SELECT label AS grp, x[1] + 3 AS x, x[2] AS y FROM pts), m AS (SELECT grp, avg(x) AS mx, avg(y) AS my FROM g GROUP BY grp HAVING count(*) > 20),
o AS (SELECT (x - mx) / (CAST(0.02 AS DOUBLE) * mx) AS u, (y - my) / CAST(0.1 AS DOUBLE) AS v FROM g JOIN m ON m.grp = g.grp),
b AS (SELECT 'x' AS which, least(floor(abs(u) / 0.5::DOUBLE), 11) AS bin FROM o UNION ALL SELECT 'y', least(floor(abs(v) / 0.5::DOUBLE), 11) FROM o UNION ALL SELECT 'xy', least(floor((u * u + v * v) / 0.5::DOUBLE), 29) FROM o)
SELECT which, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1, 2""",
    "compare_golden": f"""WITH {_TWO}, f AS (SELECT 'signs' AS method, id, cluster FROM b UNION ALL SELECT 'half', id, CAST((x[4] > 0) AS BIGINT) FROM pts),
s AS (SELECT cluster AS base, count(*) AS n FROM a WHERE cluster >= 0 GROUP BY cluster HAVING count(*) > 10), z AS (SELECT method, cluster AS target, count(*) AS target_n FROM f GROUP BY 1, 2),
t AS (SELECT method, a.cluster AS base, f.cluster AS target, count(*) AS overlap FROM a JOIN f ON a.id = f.id WHERE a.cluster >= 0 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY method, base ORDER BY overlap DESC, target) = 1)
SELECT t.method, CAST(s.base AS BIGINT) AS base, n, t.target, overlap AS major, n - overlap AS stray, target_n FROM s JOIN t ON t.base = s.base JOIN z ON z.method = t.method AND z.target = t.target""",
}
