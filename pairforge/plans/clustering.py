"""Queries over distance transforms, histograms, centers, K-means and clustering comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.functions import histogram as H
from pairforge.operators import centers as C
from pairforge.operators import comparison as L
from pairforge.operators import density as M
from pairforge.operators import kmeans as K
from pairforge.operators import transforms as T
from pairforge.plans.basics import DIM, DIST, MEANS, PTS, distances, half_distances, label_means, points, r6
from pairforge.session import stage, table


def _scaled(spark, sf):
    """Distances divided by two, so that most lie below one.

    The explode of one element is a barrier: what uses d several times gets its value, not its 64 terms.
    """
    return half_distances(spark, sf).select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), F.explode(F.array(F.col("d") / 2)).alias("d"))


def distance_cut(spark, sf):
    d = _scaled(spark, sf).withColumn("c", T.cut(F.col("d"), 0.7))
    return d.groupBy("i").agg(F.count("*").alias("n"), F.count("c").alias("defined"), r6(F.sum("c"), "total"))


def distance_transforms(spark, sf):
    return _scaled(spark, sf).select("i", "j", *(r6(T.transform(F.col("d"), m, 1.7), f"t{m}") for m in (10, 11, 12)), r6(F.col("d") * F.col("d"), "squared"))


def prune_links(spark, sf):
    """Links are the shortest distances, twelve in a thousand."""
    d = stage(spark, distances(spark, sf), "distances")
    # One number.
    near = d.join(F.broadcast(d.agg(F.percentile("d", F.lit(0.012)).alias("cut")))).where("d <= cut").select("i", "j", "d")
    return T.prune_sparse(near, 3).groupBy("i").agg(F.count("*").alias("n"))


CUTS = [0.55, 0.65, 0.75]


def distance_bin_weights(spark, sf):
    w = T.bin_weights(_scaled(spark, sf), CUTS)
    return w.groupBy("bin").agg(F.count("*").alias("n"), r6(F.max("w"), "w"), r6(F.sum(F.col("w") * F.col("w")), "total"))


def selection(spark, sf):
    return T.classify_points(points(spark, sf).select("id"), "0-99,150-300", "5,7,50-60")


def weights_mean_one(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") + 1).alias("raw"))
    return T.normalised_weights(s, "raw").select("id", r6("w"))


def relabel(spark, sf):
    p = points(spark, sf).select("id", F.col("label").cast("long").alias("cluster"))
    by = p.where("id % 3 = 0").select("id", (F.col("cluster") + 100).alias("cluster"))
    return T.relabelled(p, by).select("id", "cluster", T.family_by_cuts(F.col("id"), [100, 250]).alias("family"))


def pretty_histogram(spark, sf):
    o = table(spark, sf, "orders")
    span = o.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    start, size = H.pretty_range(F.col("low"), F.col("high"), 25)
    ranged = o.join(F.broadcast(span.select(start.alias("start"), size.alias("size"))))
    return ranged.select("start", "size", H.bin_number(F.col("o_totalprice"), F.col("start"), F.col("size"), 25).alias("bin")).groupBy("bin", r6("start"), r6("size")).agg(F.count("*").alias("n"))


def density_matrix(spark, sf):
    """Original against mapped distance (the first three dimensions), 50 x 50 cells."""
    return M.cells(points(spark, sf), (DIM, 3), 50).groupBy("cx", "cy").agg(F.sum("n").alias("n"))


def density_marginals(spark, sf):
    """Both axes of the density matrix by themselves, for all pairs, those of one label and those of two."""
    return H.marginals(M.cells(points(spark, sf), (DIM, 3), 50), "intra")


def density_range(spark, sf):
    return M.ranges(points(spark, sf), (DIM,)).select("intra", "n", r6("low0", "low"), r6("high0", "high"))


def _groups(spark, sf):
    return points(spark, sf).select("id", F.col("label").cast("long").alias("grp"), "x")


def group_centers(spark, sf):
    g = _groups(spark, sf)
    return C.group_centers(None, g, 3, dim=DIM).select("grp", "method", "id", r6("score"), "rank")


def group_centers_mapped(spark, sf):
    """Centers by distances between mapped positions, here the first three dimensions."""
    g = _groups(spark, sf).withColumn("x", F.slice("x", 1, 3))
    return C.group_centers(None, g, 3, dim=3).select("grp", "method", "id", r6("score"), "rank")


def kmeans_assignment(spark, sf):
    pts = points(spark, sf)
    return K.assign(pts, label_means(pts), DIM).select("id", F.col("k").cast("long").alias("k"), r6("d"))


def kmeans_center_stats(spark, sf):
    pts = points(spark, sf)
    return K.center_stats(K.assign(pts, label_means(pts), DIM)).select(F.col("k").cast("long").alias("k"), "n", r6("radius"), r6("width"))


def kmeans_two_iterations(spark, sf):
    pts = points(spark, sf)
    first = pts.where("id < 4").select(F.col("id").alias("k"), F.col("x").alias("y"))
    second = K.means(K.assign(pts, first, DIM))
    return K.center_stats(K.assign(pts, second, DIM)).select("k", "n", r6("radius"), r6("width"))


#: Until centers stand still but for rounding: points that change clusters move them by more of the radius.
SETTLED = {"cut": 1e-12, "extra": 0, "most": 1000}


def kmeans_converged(spark, sf):
    """To the fixed point; the operators' own rule of a small move may stop before it."""
    pts = points(spark, sf)
    first = pts.where("id < 4").select(F.col("id").alias("k"), F.col("x").alias("y"))
    assigned, _, _ = K.fit(pts, first, **SETTLED, dim=DIM)
    return assigned.select("id", "k", r6("d"))


def kmeans_start(spark, sf):
    pts = points(spark, sf)
    n = pts.count()
    return pts.select("id", K.initial_assignment(F.col("id"), n, 5, -4).cast("long").alias("block"), F.when(F.col("id") < 5, K.initial_assignment(F.col("id"), n, 5, -2)).cast("long").alias("first"))


def nearest_centers(spark, sf):
    return K.nearest_centers(label_means(points(spark, sf)), 3).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), r6("d"), "rank")


def center_histogram(spark, sf):
    pts = points(spark, sf)
    return K.assign(pts, label_means(pts), DIM).select(H.bin_number(F.col("d"), F.lit(0.0), F.lit(0.05), 30).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def _two(spark, sf):
    """The labels, and the leading sign pattern of three dimensions as another clustering."""
    pts = points(spark, sf)
    a = pts.select("id", F.when(F.col("id") % 17 == 0, -1).otherwise(F.col("label")).cast("long").alias("cluster"))
    b = pts.select("id", sum(F.when(F.get("x", i) > 0, 1 << i).otherwise(0) for i in range(3)).cast("long").alias("cluster"))
    return a, b


def reindexed(spark, sf):
    return L.reindex(_two(spark, sf)[0]).select("cluster", "dense", "n")


def size_histogram(spark, sf):
    return L.size_histogram(table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))


def widths(spark, sf):
    g = _groups(spark, sf).select("grp", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))
    m = g.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = g.join(m, "grp")
    return d.groupBy("grp").agg(r6(F.sum((F.col("x") - F.col("mx")) ** 2), "x_width"), r6(F.sum((F.col("y") - F.col("my")) ** 2), "y_width"))


def best_overlap(spark, sf):
    return L.best_overlap(*_two(spark, sf), 10)


def cut_centers(spark, sf):
    g = _groups(spark, sf).select("grp", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))
    return L.cut_center(g, 0.15, 3).select("grp", r6("cx"), r6("cy"), "inside")


def radial_histogram(spark, sf):
    g = _groups(spark, sf).select("grp", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))
    m = g.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    r = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    h = g.join(m, "grp").select(F.least(F.floor(r / 0.02), F.lit(40)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return L.trimmed(h)


def noise_singletons(spark, sf):
    return L.singletons_for_noise(points(spark, sf).select("id", F.col("label").cast("long").alias("cluster")))


def close_clusters(spark, sf):
    """For each center, how many others lie within the cut."""
    near = K.center_pairs(label_means(points(spark, sf)))
    return near.groupBy(F.col("a").cast("long").alias("k")).agg(F.count_if(F.col("d") < 0.6).alias("close"), r6(F.min("d"), "nearest"))


def misplaced_points(spark, sf):
    """Points nearer to another center than to their own."""
    pts = points(spark, sf)
    a = K.assign(pts, label_means(pts), DIM).select("id", F.col("k").alias("near"))
    both = a.join(pts.select("id", "label"), "id")
    return both.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("near") != F.col("label")).alias("misplaced"))


def cluster_property_histogram(spark, sf):
    sizes = points(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return sizes.select(H.bin_number(F.col("n"), F.lit(0), F.lit(10), 20).alias("bin")).groupBy("bin").agg(F.count("*").alias("clusters"))


QUERIES = {
    "transform_cut": distance_cut, "transform_methods": distance_transforms, "transform_prune_links": prune_links, "transform_bin_weights": distance_bin_weights,
    "select_points": selection, "weights_mean_one": weights_mean_one, "relabel_points": relabel, "histogram_pretty": pretty_histogram,
    "density_matrix": density_matrix, "density_range": density_range, "density_marginals": density_marginals, "centers_all_methods": group_centers, "centers_mapped": group_centers_mapped,
    "kmeans_assignment": kmeans_assignment, "kmeans_center_stats": kmeans_center_stats, "kmeans_two_iterations": kmeans_two_iterations, "kmeans_converged": kmeans_converged,
    "kmeans_start": kmeans_start, "kmeans_nearest_centers": nearest_centers, "kmeans_distance_histogram": center_histogram,
    "compare_reindex": reindexed, "compare_size_histogram": size_histogram, "compare_widths": widths, "compare_best_overlap": best_overlap, "compare_cut_center": cut_centers,
    "compare_radial_histogram": radial_histogram, "compare_noise_singletons": noise_singletons, "quality_close_clusters": close_clusters, "quality_misplaced": misplaced_points,
    "quality_property_histogram": cluster_property_histogram,
}

_HALF = DIST + ", half AS (SELECT i, j, d / 2 AS d FROM dist WHERE i > j)"
_PRUNE = ", ".join(
    f"n{k} AS MATERIALIZED (SELECT e.i, e.j FROM n{k - 1} e SEMI JOIN k{k} a ON a.i = e.i SEMI JOIN k{k} b ON b.i = e.j)".replace(f"n{k} AS", f"k{k} AS MATERIALIZED (SELECT i FROM n{k - 1} GROUP BY i HAVING count(*) > 3), n{k} AS", 1)
    for k in range(1, 13)
)
_XY = PTS + ", g AS (SELECT label AS grp, x[1] AS x, x[2] AS y FROM pts), m AS (SELECT grp, avg(x) AS mx, avg(y) AS my FROM g GROUP BY grp)"
_ASSIGN = MEANS + ", near AS (SELECT id, any_value(label) AS label, CAST(arg_min(k, struct_pack(d := list_distance(x, y), k := k)) AS BIGINT) AS k, min(list_distance(x, y)) AS d FROM pts CROSS JOIN centers GROUP BY id)"
_LLOYD = PTS + """, c0 AS (SELECT id AS k, x AS y FROM pts WHERE id < 4),
  a0 AS (SELECT id, any_value(x) AS x, arg_min(k, struct_pack(d := list_distance(x, y), k := k)) AS k FROM pts CROSS JOIN c0 GROUP BY id),
  e0 AS (SELECT k, unnest(range(64)) AS p, unnest(x) AS v FROM a0), m0 AS (SELECT k, p, avg(v) AS v FROM e0 GROUP BY k, p),
  c1 AS (SELECT k, list(v ORDER BY p) AS y FROM m0 GROUP BY k),
  a1 AS (SELECT id, arg_min(k, struct_pack(d := list_distance(x, y), k := k)) AS k, min(list_distance(x, y)) AS d FROM pts CROSS JOIN c1 GROUP BY id)"""
_TWO = PTS + """, a AS (SELECT id, CASE WHEN id % 17 = 0 THEN -1 ELSE label END AS cluster FROM pts),
  b AS (SELECT id, CAST((x[1] > 0) AS BIGINT) + 2 * CAST((x[2] > 0) AS BIGINT) + 4 * CAST((x[3] > 0) AS BIGINT) AS cluster FROM pts)"""
_NEAR = MEANS + ", cc AS (SELECT CAST(a.k AS BIGINT) AS a, CAST(b.k AS BIGINT) AS b, list_distance(a.y, b.y) AS d FROM centers a JOIN centers b ON a.k <> b.k)"


def _pretty(x: str) -> str:
    return f"(ceil(least({x} * pow(10, 1 - floor(log10({x}))), 100)) / pow(10, 1 - floor(log10({x}))))"


def _converged_sql(rounds: int = 45) -> str:
    """Lloyd's updates from the first four points, more of them than any of the tables needs to settle."""
    out = PTS + ", c0 AS MATERIALIZED (SELECT id AS k, x AS y FROM pts WHERE id < 4)"
    for r in range(1, rounds + 1):
        out += f""", a{r} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(k, struct_pack(d := list_distance(x, y), k := k)) AS k FROM pts CROSS JOIN c{r - 1} GROUP BY id),
  m{r} AS (SELECT k, p, avg(v) AS v FROM (SELECT k, unnest(range(64)) AS p, unnest(x) AS v FROM a{r}) GROUP BY k, p), c{r} AS MATERIALIZED (SELECT k, list(v ORDER BY p) AS y FROM m{r} GROUP BY k)"""
    return out + f", a AS (SELECT id, arg_min(k, struct_pack(d := list_distance(x, y), k := k)) AS k, round(min(list_distance(x, y)), 6) AS d FROM pts CROSS JOIN c{rounds} GROUP BY id)"


def _cut_sql(passes: int) -> str:
    out = _XY + ", z0 AS (SELECT grp, mx AS cx, my AS cy, 0 AS inside FROM m)"
    for k in range(1, passes + 1):
        out += f""", w{k} AS (SELECT g.grp, avg(x) AS mx, avg(y) AS my, count(*) AS inside FROM g JOIN z{k - 1} z ON z.grp = g.grp WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 0.15 * 0.15 GROUP BY g.grp),
  z{k} AS (SELECT z.grp, coalesce(w.mx, z.cx) AS cx, coalesce(w.my, z.cy) AS cy, coalesce(w.inside, 0) AS inside FROM z{k - 1} z LEFT JOIN w{k} w ON w.grp = z.grp)"""
    return out


def _centers_sql(k: int = 3, dim: int = 64) -> str:
    rank = lambda x: f"SELECT grp, id, score, row_number() OVER (PARTITION BY grp ORDER BY score, id) AS rank FROM {x} QUALIFY rank <= {k}"
    sql = DIST + f""", s AS (SELECT CAST(label AS BIGINT) AS grp, count(*) AS size FROM pts GROUP BY label HAVING count(*) > {k}),
  q AS (SELECT id, CAST(label AS BIGINT) AS grp, x FROM pts WHERE label IN (SELECT grp FROM s)),
  within AS (SELECT a.grp, i, j, d FROM dist JOIN q a ON a.id = i JOIN q b ON b.id = j WHERE a.grp = b.grp),
  m1 AS (SELECT grp, i AS id, avg(d) AS score FROM within WHERE d > 0 GROUP BY grp, i), r1 AS ({rank("m1")}),
  pp AS (SELECT grp, unnest(range(64)) AS p, unnest(x) AS v FROM q), pm AS (SELECT grp, p, avg(v) AS v FROM pp GROUP BY grp, p), pc AS (SELECT grp, list(v ORDER BY p) AS y FROM pm GROUP BY grp),
  m2 AS (SELECT q.grp, id, list_distance(x, y) AS score FROM q JOIN pc ON pc.grp = q.grp), r2 AS ({rank("m2")}),
  t AS (SELECT grp, max(d) AS top, count(*) AS total FROM within GROUP BY grp),
  bins AS (SELECT w.grp, any_value(top) AS top, any_value(total) AS total, least(floor(d / top * 1000), 999) AS bin, count(*) AS n FROM within w JOIN t ON t.grp = w.grp GROUP BY w.grp, 4),
  run AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY bin) AS upto FROM bins)"""
    union = [f"SELECT grp, 'mean_distance' AS method, id, score, rank, 1.0 AS w FROM r1", "SELECT grp, 'to_centroid', id, score, rank, 1.0 FROM r2"]
    for n, f in enumerate((0.15, 0.4, 0.75)):
        sql += f""", rad{n} AS (SELECT grp, (least(min(bin) + 1, 999) + 0.5) * any_value(top) / 1000 AS radius FROM run WHERE upto >= total * CAST({f} AS DOUBLE) GROUP BY grp),
  b{n} AS (SELECT w.grp, i AS id, CAST(any_value(size) - count(*) AS DOUBLE) AS score FROM within w JOIN rad{n} ON rad{n}.grp = w.grp JOIN s ON s.grp = w.grp WHERE d <= radius GROUP BY w.grp, i), rb{n} AS ({rank(f"b{n}")})"""
        union.append(f"SELECT grp, 'bucket_{f}', id, score, rank, CAST(1.0 AS DOUBLE) / 3 FROM rb{n}")
    sql += f""", every AS ({" UNION ALL ".join(union)}),
  o AS (SELECT grp, id, round(sum(rank * w) / sum(w), 9) AS score FROM every GROUP BY grp, id HAVING sum(w) > 0.6), ro AS ({rank("o")})
  SELECT grp, method, id, round(score, 6) AS score, rank FROM every UNION ALL SELECT grp, 'overall', id, round(score, 6), rank FROM ro"""
    return "WITH " + (sql if dim == 64 else sql.replace("range(64)", f"range({dim})").replace("CAST(embedding AS DOUBLE[])", f"CAST(embedding AS DOUBLE[])[1:{dim}]"))


ORACLE_SQL = {
    "transform_cut": f"WITH {_HALF} SELECT i, count(*) AS n, count(CASE WHEN d <= 0.7 THEN 1 END) AS defined, round(sum(CASE WHEN d <= 0.7 THEN d END), 6) AS total FROM half GROUP BY i",
    "transform_methods": f"WITH {_HALF} SELECT i, j, round(pow(least(d, 1.0), 1.7), 6) AS t10, round(1 - pow(1 - least(d, 1.0), 1.7), 6) AS t11, round(ln(1 - pow(least(d, 0.975), 1.7)) / ln(1 - pow(0.975, 1.7)), 6) AS t12, round(d * d, 6) AS squared FROM half",
    "transform_prune_links": f"WITH {DIST}, n0 AS MATERIALIZED (SELECT i, j FROM dist WHERE d <= (SELECT quantile_cont(d, 0.012) FROM dist)), {_PRUNE} SELECT i, count(*) AS n FROM n12 GROUP BY i",
    "transform_bin_weights": f"WITH {_HALF}, b AS (SELECT d, CAST((d >= 0.55) AS BIGINT) + CAST((d >= 0.65) AS BIGINT) + CAST((d >= 0.75) AS BIGINT) AS bin FROM half), w AS (SELECT bin, count(*) AS n, sqrt(sum(count(*)) OVER () / (4.0 * count(*))) AS w FROM b GROUP BY bin) SELECT bin, n, round(w, 6) AS w, round(n * w * w, 6) AS total FROM w",
    "select_points": "SELECT vec_id AS id, CASE WHEN vec_id IN (5, 7) OR vec_id BETWEEN 50 AND 60 THEN 'fixed' WHEN vec_id BETWEEN 0 AND 99 OR vec_id BETWEEN 150 AND 300 THEN 'varied' ELSE 'ignored' END AS role FROM embeddings",
    "weights_mean_one": "SELECT s_suppkey AS id, round((abs(s_acctbal) + 1) / avg(abs(s_acctbal) + 1) OVER (), 6) AS w FROM supplier",
    "relabel_points": "SELECT vec_id AS id, CAST(CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS BIGINT) AS cluster, CAST((vec_id >= 100) AS BIGINT) + CAST((vec_id >= 250) AS BIGINT) AS family FROM embeddings",
    "histogram_pretty": f"""WITH s AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders), f AS (SELECT low, high, CASE WHEN low < 0 THEN -{_pretty("abs(low)")} ELSE {_pretty("abs(low)")} END AS start FROM s),
r AS (SELECT start, {_pretty("((high - start) / 25)")} AS size FROM f)
SELECT CAST(greatest(0, least(26, floor((o_totalprice - start) / size) + 1)) AS BIGINT) AS bin, round(start, 6) AS start, round(size, 6) AS size, count(*) AS n FROM orders CROSS JOIN r GROUP BY ALL""",
    "density_matrix": f"""WITH {PTS}, d AS (SELECT list_distance(a.x, b.x) AS a, list_distance(a.x[1:3], b.x[1:3]) AS b FROM pts a JOIN pts b ON a.id > b.id), s AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM d)
SELECT CAST(least(floor((a - a0) / ((a1 - a0) / 50)), 49) AS BIGINT) AS cx, CAST(least(floor((b - b0) / ((b1 - b0) / 50)), 49) AS BIGINT) AS cy, count(*) AS n FROM d CROSS JOIN s GROUP BY 1, 2""",
    "density_range": f"WITH {PTS} SELECT a.label = b.label AS intra, count(*) AS n, round(min(list_distance(a.x, b.x)), 6) AS low, round(max(list_distance(a.x, b.x)), 6) AS high FROM pts a JOIN pts b ON a.id > b.id GROUP BY 1",
    "density_marginals": f"""WITH {PTS}, d AS (SELECT a.label = b.label AS intra, list_distance(a.x, b.x) AS a, list_distance(a.x[1:3], b.x[1:3]) AS b FROM pts a JOIN pts b ON a.id > b.id), s AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM d),
c AS (SELECT intra, CAST(least(floor((a - a0) / ((a1 - a0) / 50)), 49) AS BIGINT) AS cx, CAST(least(floor((b - b0) / ((b1 - b0) / 50)), 49) AS BIGINT) AS cy FROM d CROSS JOIN s),
e AS (SELECT intra, 'x' AS axis, cx AS bin FROM c UNION ALL SELECT intra, 'y', cy FROM c)
SELECT 'whole' AS part, axis, bin, count(*) AS n FROM e GROUP BY axis, bin UNION ALL SELECT CASE WHEN intra THEN 'intra' ELSE 'inter' END, axis, bin, count(*) FROM e GROUP BY intra, axis, bin""",
    "centers_all_methods": _centers_sql(),
    "centers_mapped": _centers_sql(dim=3),
    "kmeans_assignment": f"WITH {_ASSIGN} SELECT id, k, round(d, 6) AS d FROM near",
    "kmeans_center_stats": f"WITH {_ASSIGN} SELECT k, count(*) AS n, round(max(d), 6) AS radius, round(sum(d * d), 6) AS width FROM near GROUP BY k",
    "kmeans_two_iterations": f"WITH {_LLOYD} SELECT k, count(*) AS n, round(max(d), 6) AS radius, round(sum(d * d), 6) AS width FROM a1 GROUP BY k",
    "kmeans_converged": f"WITH {_converged_sql()} SELECT id, k, d FROM a",
    "kmeans_start": "SELECT vec_id AS id, CAST(least(floor(vec_id / greatest(1, floor((SELECT count(*) FROM embeddings) / 5))), 4) AS BIGINT) AS block, CASE WHEN vec_id < 5 THEN vec_id END AS first FROM embeddings",
    "kmeans_nearest_centers": f"WITH {_NEAR} SELECT a, b, round(d, 6) AS d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM cc QUALIFY rank <= 3",
    "kmeans_distance_histogram": f"WITH {_ASSIGN} SELECT CAST(greatest(0, least(31, floor(d / CAST(0.05 AS DOUBLE)) + 1)) AS BIGINT) AS bin, count(*) AS n FROM near GROUP BY 1",
    "compare_reindex": f"WITH {_TWO} SELECT CAST(cluster AS BIGINT) AS cluster, row_number() OVER (ORDER BY cluster) - 1 AS dense, count(*) AS n FROM a WHERE cluster >= 0 GROUP BY cluster",
    "compare_size_histogram": "SELECT n AS size, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS points FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n",
    "compare_widths": f"WITH {_XY} SELECT CAST(g.grp AS BIGINT) AS grp, round(sum((x - mx) * (x - mx)), 6) AS x_width, round(sum((y - my) * (y - my)), 6) AS y_width FROM g JOIN m ON m.grp = g.grp GROUP BY g.grp",
    "compare_best_overlap": f"""WITH {_TWO}, s AS (SELECT cluster AS base, count(*) AS n FROM a WHERE cluster >= 0 GROUP BY cluster HAVING count(*) > 10),
t AS (SELECT a.cluster AS base, b.cluster AS target, count(*) AS overlap FROM a JOIN b ON a.id = b.id WHERE a.cluster >= 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY base ORDER BY overlap DESC, target) = 1)
SELECT CAST(s.base AS BIGINT) AS base, n, target, overlap AS major, n - overlap AS stray FROM s JOIN t ON t.base = s.base""",
    "compare_cut_center": f"WITH {_cut_sql(3)} SELECT CAST(grp AS BIGINT) AS grp, round(cx, 6) AS cx, round(cy, 6) AS cy, inside FROM z3",
    "compare_radial_histogram": f"WITH {_XY} SELECT CAST(least(floor(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) / CAST(0.02 AS DOUBLE)), 40) AS BIGINT) AS bin, count(*) AS n FROM g JOIN m ON m.grp = g.grp GROUP BY 1",
    "compare_noise_singletons": "SELECT vec_id AS id, CAST(CASE WHEN label = 0 THEN (SELECT max(label) FROM embeddings) + row_number() OVER (PARTITION BY label = 0 ORDER BY vec_id) ELSE label END AS BIGINT) AS cluster FROM embeddings",
    "quality_close_clusters": f"WITH {_NEAR} SELECT a AS k, count(CASE WHEN d < 0.6 THEN 1 END) AS close, round(min(d), 6) AS nearest FROM cc GROUP BY a",
    "quality_misplaced": f"WITH {_ASSIGN} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, count(CASE WHEN k <> label THEN 1 END) AS misplaced FROM near GROUP BY label",
    "quality_property_histogram": "SELECT CAST(greatest(0, least(21, floor(n / 10) + 1)) AS BIGINT) AS bin, count(*) AS clusters FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) GROUP BY 1",
}
