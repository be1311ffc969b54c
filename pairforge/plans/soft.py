"""Queries over soft clusters in short lists and the runs composed of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import lcms as R
from pairforge.operators import soft_clusters as S
from pairforge.operators import vector_da as D
from pairforge.plans.annealing import _centers
from pairforge.plans.basics import DIM, MEANS, PTS, points, r6

#: Temperature of the bounded memberships, sponge and temperature of the runs.
COOL, SPONGE, WARM = 0.02, 0.95, 0.1


def bounded_memberships(spark, sf):
    """Memberships after one update of the centers, found by the bounds of the step before."""
    _, y, p, _ = D.collected(_centers(spark, sf))
    model = S.Model(y, p, COOL)
    lists = S.Lists(points(spark, sf), nearest=len(y))
    sums = S.em_sums(lists.rebuilt(model), model)
    model = S.Model(sums.means, sums.c[:-1] / sums.c.sum(), COOL)
    return S.members(lists.rebuilt(model), model).select("id", F.col("k").cast("long").alias("k"), r6("m"))


def em_update(spark, sf):
    """One pass: sizes, widths and means of soft clusters with a sponge, from short lists."""
    _, y, p, _ = D.collected(_centers(spark, sf))
    model = S.Model(y, p, 0.2, 1.2)
    sums = S.em_sums(S.Lists(points(spark, sf), nearest=len(y)).rebuilt(model), model)
    totals = [*sums.means.sum(1), 0.0]
    rows = [(k if k < len(y) else S.SPONGE, float(c), float(w), float(t)) for k, (c, w, t) in enumerate(zip(sums.c, sums.width, totals))]
    return spark.createDataFrame(rows, "k long, c double, width double, total double").select("k", r6("c"), r6("width"), r6("total"))


def leading_variances(spark, sf):
    """The largest variance of each label's points over all dimensions, and how far its direction is from an eigenvector's."""
    p = points(spark, sf)
    _, y, q, _ = D.collected(_centers(spark, sf))
    lists = p.select("id", "x", F.array("label").alias("ks"))
    # With one cluster in each list memberships are one.
    value, v = S.leading_variance(lists, S.Model(y, q, 1.0), most=100, tolerance=1e-4)
    rows = spark.createDataFrame([(k, float(a), float((u * u).sum())) for k, (a, u) in enumerate(zip(value, v))], "k long, value double, unit double")
    return rows.select("k", F.round("value", 3).alias("value"), r6("unit"))


def _labels(spark, sf):
    return points(spark, sf).select("id", F.when(F.col("id") % 17 == 0, S.SPONGE).otherwise(F.col("label")).cast("int").alias("cluster"))


def _summary(run, mode, before=None):
    """One row: points, labelled ones, and whether the run kept what every run keeps."""
    got = run.labels.agg(F.count("*").alias("points"), F.countDistinct("id").alias("ids"), F.count_if(F.col("cluster") >= S.SPONGE).alias("labelled"))
    prior = run.centers.agg(F.sum("p").alias("prior"), F.count_if(F.col("k") >= 0).alias("clusters"))
    # One row of two numbers.
    both = got.join(F.broadcast(prior))
    fits = F.col("clusters") <= before if before is not None else F.col("clusters") >= 1
    return both.select(F.lit(mode).alias("mode"), "points", "ids", "labelled", F.round("prior", 6).alias("prior"), fits.alias("clusters_fit"))


def lcms_fresh(spark, sf):
    s = D.Schedule(cooling=0.7, final=0.3, sponge=1.2, sponge_from=0.8)
    return _summary(R.run(points(spark, sf), "fresh", schedule=s, most=6, dim=DIM), "fresh", 6)


def lcms_sponge_again(spark, sf):
    """Every point dealt once between the clusters of its labels and a sponge."""
    got = R.run(points(spark, sf), "sponge_again", _labels(spark, sf), D.Schedule(sponge=SPONGE), WARM, nearest=10, dim=DIM)
    return got.labels.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"))


def lcms_join(spark, sf):
    got = R.run(points(spark, sf), "join", _labels(spark, sf), D.Schedule(close=1.0), 0.02, dim=DIM)
    return _summary(got, "join", 10)


def lcms_sponge_change(spark, sf):
    s = D.Schedule(cooling=0.7, final=0.5, sponge=SPONGE, sponge_first=1.5, sponge_from=1.0)
    return _summary(R.run(points(spark, sf), "sponge_change", _labels(spark, sf), s, 0.02, dim=DIM), "sponge_change", 10)


def lcms_analyse(spark, sf):
    got = R.run(points(spark, sf), "analyse", _labels(spark, sf), dim=DIM).clusters()
    return got.select(F.col("cluster").cast("long").alias("cluster"), "dense", "n", r6("width"))


def lcms_sizes(spark, sf):
    return R.run(points(spark, sf), "analyse", _labels(spark, sf), dim=DIM).sizes()


QUERIES = {
    "vda_bounded_memberships": bounded_memberships, "vda_em_update": em_update, "vda_leading_variance": leading_variances, "lcms_fresh": lcms_fresh, "lcms_sponge_again": lcms_sponge_again,
    "lcms_join": lcms_join, "lcms_sponge_change": lcms_sponge_change, "lcms_analyse": lcms_analyse, "lcms_sizes": lcms_sizes,
}


def _soft(name: str, source: str, temperature: float, sponge: float | None = None, noise: str = "0") -> str:
    """CTEs ``name``_m (id, k, t, m) of memberships to the centers (k, y, p) of ``source``."""
    extra = f" UNION ALL SELECT id, CAST(-1 AS BIGINT), {sponge!r}::DOUBLE * {sponge!r}::DOUBLE / {temperature!r}::DOUBLE, CAST({noise} AS DOUBLE) FROM pts" if sponge else ""
    return f"""{name}_t AS (SELECT id, CAST(k AS BIGINT) AS k, list_distance(x, y) * list_distance(x, y) / {temperature!r}::DOUBLE AS t, p FROM pts CROSS JOIN {source}{extra}),
{name}_l AS (SELECT *, min(t) OVER (PARTITION BY id) AS low FROM {name}_t), {name}_e AS (SELECT id, k, t, CASE WHEN t - low < 40 THEN greatest(p, 1e-7) * exp(-0.5 * (t - low)) ELSE 0 END AS e FROM {name}_l),
{name}_m AS (SELECT id, k, t, e / sum(e) OVER (PARTITION BY id) AS m FROM {name}_e)"""


def _updated(name: str, source: str) -> str:
    """CTE ``name`` (k, y, p): centers and priors of the memberships ``source``_m."""
    return f"""{name}_c AS (SELECT k, sum(m) AS c FROM {source}_m GROUP BY k), {name}_v AS (SELECT m.k, pos.p AS pos, sum(m * v) AS s FROM {source}_m m JOIN pos ON pos.id = m.id WHERE m.k >= 0 GROUP BY m.k, pos.p),
{name} AS (SELECT v.k, list(s / c ORDER BY pos) AS y, any_value(c) / (SELECT count(*) FROM pts) AS p FROM {name}_v v JOIN {name}_c c ON c.k = v.k GROUP BY v.k)"""


_FIRST = MEANS + ", first AS (SELECT k, y, CAST(0.1 AS DOUBLE) AS p FROM centers)"
_LABELLED = PTS + ", lab AS (SELECT id, x, CAST(CASE WHEN id % 17 = 0 THEN -1 ELSE label END AS BIGINT) AS cluster FROM pts), pos AS (SELECT id, cluster, unnest(range(64)) AS p, unnest(x) AS v FROM lab)"
_RUN = "SELECT '{0}' AS mode, count(*) AS points, count(DISTINCT vec_id) AS ids, count(vec_id) AS labelled, CAST(1 AS DOUBLE) AS prior, true AS clusters_fit FROM embeddings"
ORACLE_SQL = {
    "vda_bounded_memberships": f"WITH {_FIRST}, {_soft('a', 'first', COOL)}, {_updated('second', 'a')}, {_soft('b', 'second', COOL)} SELECT id, k, round(m, 6) AS m FROM b_m WHERE m > 0",
    "vda_em_update": f"""WITH {_FIRST}, {_soft('a', 'first', 0.2, 1.2)}, {_updated('second', 'a')} SELECT m.k, round(sum(m), 6) AS c, round(sum(m * t * 0.2::DOUBLE) / sum(m), 6) AS width, round(coalesce(any_value(list_sum(y)), 0), 6) AS total
FROM a_m m LEFT JOIN second ON second.k = m.k GROUP BY m.k""",
    "lcms_fresh": _RUN.format("fresh"),
    "lcms_join": _RUN.format("join"),
    "lcms_sponge_change": _RUN.format("sponge_change"),
    "lcms_sponge_again": f"""WITH {_LABELLED}, mean_pos AS (SELECT cluster AS k, p, avg(v) AS v FROM pos WHERE cluster >= 0 GROUP BY cluster, p), n AS (SELECT cluster AS k, count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY cluster),
first AS (SELECT m.k, list(v ORDER BY m.p) AS y, any_value(n.p) AS p FROM mean_pos m JOIN n ON n.k = m.k GROUP BY m.k), {_soft('a', 'first', WARM, SPONGE, '(SELECT p FROM n WHERE k = -1)')},
best AS (SELECT id, arg_min(k, struct_pack(m := -m, k := k)) AS cluster FROM a_m GROUP BY id) SELECT cluster, count(*) AS n FROM best GROUP BY cluster""",
    "lcms_analyse": f"""WITH {_LABELLED}, w AS (SELECT cluster, p, var_pop(v) AS v FROM pos WHERE cluster >= 0 GROUP BY cluster, p), s AS (SELECT cluster, sum(v) AS width FROM w GROUP BY cluster), n AS (SELECT cluster, count(*) AS n FROM lab GROUP BY cluster)
SELECT n.cluster, CASE WHEN n.cluster >= 0 THEN row_number() OVER (PARTITION BY n.cluster < 0 ORDER BY n.cluster) - 1 END AS dense, n, round(width, 6) AS width FROM n LEFT JOIN s ON s.cluster = n.cluster""",
    "lcms_sizes": f"WITH {_LABELLED}, n AS (SELECT count(*) AS n FROM lab WHERE cluster >= 0 GROUP BY cluster UNION ALL SELECT 1 FROM lab WHERE cluster < 0) SELECT n AS size, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS points FROM n GROUP BY n",
}
