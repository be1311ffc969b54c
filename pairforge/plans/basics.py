"""Queries over pair enumeration, vectors and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import vector as V
from pairforge.operators import block_distances as B
from pairforge.operators import pairs as P
from pairforge.operators import reductions as R
from pairforge.session import table

DIM = 64
PTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
DIST = PTS + ", dist AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM pts a JOIN pts b ON a.id <> b.id)"
MEANS = PTS + """, pos AS (SELECT id, label, unnest(range(64)) AS p, unnest(x) AS v FROM pts),
  mean_pos AS (SELECT label, p, avg(v) AS v FROM pos GROUP BY label, p),
  centers AS (SELECT label AS k, list(v ORDER BY p) AS y FROM mean_pos GROUP BY label)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def half_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, d) for each unordered pair of embeddings."""
    return B.distances(points(spark, sf_dir), (DIM,))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mirrored(half_distances(spark, sf_dir))


def label_means(pts: DataFrame) -> DataFrame:
    """(k, y): the mean vector of each label."""
    means = R.elementwise(pts, "x", "mean", ("label",), DIM)
    return means.groupBy(F.col("label").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("y"))


def r6(c: str | F.Column, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def partition_ranges(spark, sf):
    pts = points(spark, sf).select("id")
    n = pts.agg(F.count("*").alias("n"))
    # One row of one number: a scalar, whatever the table's size.
    return pts.join(F.broadcast(n)).select("id", P.range_of(F.col("id"), F.col("n"), 7).alias("part"))


def partition_by_length(spark, sf):
    return points(spark, sf).select("id", P.length_range_of(F.col("id"), 90).alias("part"))


def block_grid(spark, sf):
    k = points(spark, sf).select(F.pmod("id", F.lit(6)).alias("k")).distinct()
    block = F.pmod("k", F.lit(3)).cast("long").alias("block")
    grid = P.block_pairs(k.select(block, F.col("k").alias("row_block_")), k.select(block, F.col("k").alias("col_block_")), 3)
    return grid.select(F.col("row_block_").alias("r"), F.col("col_block_").alias("c"), P.chosen_block(F.col("row_block_"), F.col("col_block_")).alias("chosen"))


def all_pairs_mirrored(spark, sf):
    return distances(spark, sf).groupBy("i").agg(F.count("*").alias("n"), r6(F.sum("d"), "total"), r6(F.min("d"), "nearest"), r6(F.max("d"), "farthest"))


def restart_blocks(spark, sf):
    grid = block_grid(spark, sf).where("chosen").select(F.col("r").alias("row_block"), F.col("c").alias("col_block"))
    return P.remaining_blocks(grid, grid.where("row_block < 2"))


def matrix_gather(spark, sf):
    return P.matrix_rows(distances(spark, sf)).select("i", F.size("row").cast("long").alias("n"), r6(F.aggregate("row", F.lit(0.0), lambda a, b: a + b), "total"), r6(F.col("row")[0], "first"))


def range_intersection(spark, sf):
    n = points(spark, sf)
    of = lambda k, p: n.withColumn("n", F.lit(1)).select("id").groupBy(F.floor(F.col("id") / k).alias("g")).agg(F.min("id").alias(f"s{p}"), F.max("id").alias(f"e{p}")).select(F.pmod("g", F.lit(4)).cast("long").alias("block"), f"s{p}", f"e{p}")
    both = P.block_pairs(of(70, "a"), of(110, "b"), 4)
    meet, start, end = P.intersection(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb"))
    return both.where(meet).select("sa", "sb", start.alias("start_at"), end.alias("end_at"))


def membership_pass(spark, sf):
    pts = points(spark, sf)
    m = pts.select("id", F.col("label").alias("k"), F.lit(1.0).alias("m"))
    return P.membership_sums(distances(spark, sf), m).select("i", "k", r6("b"))


def _sigma(pts: DataFrame) -> DataFrame:
    pos = pts.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.var_pop("v").alias("s"))
    return pos.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("sigma"))


def scaled_distance_to_centers(spark, sf):
    pts = points(spark, sf)
    own = pts.join(label_means(pts), F.col("label") == F.col("k"))
    # One row of as many numbers as there are dimensions.
    both = own.join(F.broadcast(_sigma(pts)))
    return both.select("id", r6(V.scaled_squared_distance(F.col("x"), F.col("y"), F.col("sigma")), "sq"), r6(V.scaled_distance(F.col("x"), F.col("y"), F.col("sigma")), "dist"))


def euclidean_pairs(spark, sf):
    return half_distances(spark, sf).select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), r6("d"))


def position_sigma(spark, sf):
    base = [0.5 + 0.01 * i for i in range(DIM)]
    pts = points(spark, sf)
    total = lambda m: r6(F.aggregate(V.position_sigma(F.col("x"), base, m), F.lit(0.0), lambda a, b: a + b), f"method{m}")
    return pts.select("id", total(0), total(1), total(2))


def quantised_distance(spark, sf):
    q = half_distances(spark, sf).select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), V.quantised(F.col("d") / 3).cast("int").alias("raw"))
    return q.select("i", "j", F.col("raw").cast("long").alias("raw"), r6(V.stored_distance(F.col("raw")), "d"), r6(V.stored_distance(F.col("raw"), squared=True), "d2"))


def dot_and_combination(spark, sf):
    pts = points(spark, sf)
    both = pts.join(label_means(pts), F.col("label") == F.col("k"))
    mix = V.linear_combination(2.0, F.col("x"), -0.5, F.col("y"))
    return both.select("id", r6(V.dot(F.col("x"), F.col("y")), "dot"), r6(F.aggregate(mix, F.lit(0.0), lambda a, b: a + b), "mix_sum"))


def transposed_blocks(spark, sf):
    """The whole matrix by blocks of 20 rows and 8 columns, each transposed."""
    cells = points(spark, sf).select(F.col("id").alias("i"), F.posexplode("x").alias("j", "v"))
    return V.matrix_blocks(cells, 20, 8, transposed=True).select("row_block", "col_block", "i", "j", r6("v"))


def _items(spark, sf):
    return table(spark, sf, "lineitem")


def bool_or(spark, sf):
    return _items(spark, sf).groupBy("l_returnflag").agg(F.bool_or(F.col("l_quantity") > 49).alias("some"), F.bool_and(F.col("l_quantity") > 0).alias("every"))


def sums_and_means(spark, sf):
    return _items(spark, sf).agg(F.sum("l_linenumber").cast("long").alias("int_sum"), r6(F.sum("l_quantity"), "double_sum"), r6(F.avg("l_discount"), "mean"), r6(F.max("l_extendedprice"), "largest"))


def mean_sigma(spark, sf):
    return R.mean_sigma(_items(spark, sf), "l_quantity").select(r6("mean"), r6("sigma"))


def bin_counts(spark, sf):
    return R.histogram(_items(spark, sf).select(F.floor(F.col("l_quantity") / 5).alias("bin")), "bin")


def bin_counts_2d(spark, sf):
    return R.histogram_2d(_items(spark, sf).select(F.floor(F.col("l_quantity") / 10).alias("cx"), F.floor(F.col("l_discount") * 50 + 1e-9).alias("cy")), "cx", "cy")


def vector_reductions(spark, sf):
    pts = points(spark, sf)
    s, m, a = (R.elementwise(pts, "x", how, dim=DIM).withColumnRenamed("value", how) for how in ("sum", "max", "mean"))
    return s.join(m, "pos").join(a, "pos").select(F.col("pos").cast("long").alias("pos"), r6("sum", "total"), r6("max", "largest"), r6("mean", "average"))


def group_vector_sum(spark, sf):
    return R.elementwise(points(spark, sf), "x", "sum", ("label",), DIM).select("label", F.col("pos").cast("long").alias("pos"), r6("value"))


def indexed_sum(spark, sf):
    return _items(spark, sf).groupBy("l_suppkey").agg(r6(F.sum("l_quantity"), "total"), F.count("*").alias("n"))


def min_max_with_index(spark, sf):
    o = table(spark, sf, "orders")
    low, high = R.extreme_with_index(o, "o_totalprice", "o_orderkey"), R.extreme_with_index(o, "o_totalprice", "o_orderkey", True)
    return low.select(F.lit("min").alias("which"), r6("value"), "index").union(high.select(F.lit("max"), r6("value"), "index"))


def k_smallest(spark, sf):
    return R.smallest(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 12).select("rank", r6("value"), "index")


def k_smallest_remainder(spark, sf):
    return R.smallest_with_remainder(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 5).select("rank", r6("value"), "index", "kept")


def correlation(spark, sf):
    return R.correlation(_items(spark, sf), "l_quantity", "l_extendedprice").select(*(r6(c) for c in ("mean_x", "mean_y", "sigma_x", "sigma_y", "corr")))


QUERIES = {
    "pairs_range_split": partition_ranges, "pairs_length_split": partition_by_length, "pairs_block_grid": block_grid, "pairs_all_mirrored": all_pairs_mirrored,
    "pairs_restart_blocks": restart_blocks, "pairs_matrix_gather": matrix_gather, "pairs_range_intersection": range_intersection, "pairs_membership_pass": membership_pass,
    "vector_scaled_distance": scaled_distance_to_centers, "vector_euclidean_pairs": euclidean_pairs, "vector_position_sigma": position_sigma,
    "vector_quantised_distance": quantised_distance, "vector_dot_combination": dot_and_combination, "matrix_transposed_blocks": transposed_blocks,
    "reduce_bool": bool_or, "reduce_sums": sums_and_means, "reduce_mean_sigma": mean_sigma, "reduce_histogram": bin_counts, "reduce_histogram_2d": bin_counts_2d,
    "reduce_vectors": vector_reductions, "reduce_group_vectors": group_vector_sum, "reduce_indexed_sum": indexed_sum, "reduce_min_max_index": min_max_with_index,
    "reduce_k_smallest": k_smallest, "reduce_k_smallest_remainder": k_smallest_remainder, "reduce_correlation": correlation,
}

_GRID = "k AS (SELECT DISTINCT vec_id % 6 AS k FROM embeddings), grid AS (SELECT a.k AS r, b.k AS c, (a.k = b.k OR (a.k > b.k AND (a.k + b.k) % 2 = 0) OR (a.k < b.k AND (a.k + b.k) % 2 = 1)) AS chosen FROM k a CROSS JOIN k b)"
_BASE = "[" + ", ".join(str(0.5 + 0.01 * i) for i in range(DIM)) + "]"
_LOWER = "SELECT i, j, d FROM dist WHERE i > j"
ORACLE_SQL = {
    "pairs_range_split": "SELECT vec_id AS id, CAST(ntile(7) OVER (ORDER BY vec_id) - 1 AS BIGINT) AS part FROM embeddings",
    "pairs_length_split": "SELECT vec_id AS id, CAST(floor(vec_id / 90) AS BIGINT) AS part FROM embeddings",
    "pairs_block_grid": f"WITH {_GRID} SELECT r, c, chosen FROM grid",
    "pairs_all_mirrored": f"WITH {DIST} SELECT i, count(*) AS n, round(sum(d), 6) AS total, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM dist GROUP BY i",
    "pairs_restart_blocks": f"WITH {_GRID} SELECT r AS row_block, c AS col_block FROM grid WHERE chosen AND r >= 2",
    "pairs_matrix_gather": f"WITH {DIST} SELECT i, count(*) AS n, round(sum(d), 6) AS total, round(arg_min(d, j), 6) AS first FROM dist GROUP BY i",
    "pairs_range_intersection": """WITH a AS (SELECT min(vec_id) AS sa, max(vec_id) AS ea FROM embeddings GROUP BY floor(vec_id / 70)), b AS (SELECT min(vec_id) AS sb, max(vec_id) AS eb FROM embeddings GROUP BY floor(vec_id / 110))
SELECT sa, sb, greatest(sa, sb) AS start_at, least(ea, eb) AS end_at FROM a JOIN b ON greatest(sa, sb) <= least(ea, eb)""",
    "pairs_membership_pass": f"WITH {DIST} SELECT i, p.label AS k, round(sum(d), 6) AS b FROM dist JOIN pts p ON p.id = j GROUP BY i, p.label",
    "vector_scaled_distance": f"""WITH {MEANS}, s AS (SELECT p, var_pop(v) AS s FROM pos GROUP BY p),
sq AS (SELECT pos.id, sum((pos.v - m.v) * (pos.v - m.v) / s.s) AS sq FROM pos JOIN mean_pos m ON m.label = pos.label AND m.p = pos.p JOIN s ON s.p = pos.p GROUP BY pos.id)
SELECT id, round(sq, 6) AS sq, round(sqrt(sq), 6) AS dist FROM sq""",
    "vector_euclidean_pairs": f"WITH {DIST} SELECT i, j, round(d, 6) AS d FROM ({_LOWER})",
    "vector_position_sigma": f"WITH {PTS}, b AS (SELECT id, x[1] AS x0, {_BASE} AS base FROM pts) SELECT id, CAST(64.0 AS DOUBLE) AS method0, round(CAST(list_sum(base) AS DOUBLE), 6) AS method1, round(CAST(list_sum(base) - base[1] + (base[1] * x0) * (base[1] * x0) AS DOUBLE), 6) AS method2 FROM b",
    "vector_quantised_distance": f"WITH {DIST}, q AS (SELECT i, j, CAST(floor(least(greatest(d / 3, 0.0), 1.0) * 32767) AS BIGINT) AS raw FROM ({_LOWER})), u AS (SELECT *, CASE WHEN raw >= 0 AND raw < 32767 THEN raw / 32767.0::DOUBLE END AS u FROM q) SELECT i, j, raw, round(u, 6) AS d, round(u * u, 6) AS d2 FROM u",
    "vector_dot_combination": f"WITH {MEANS} SELECT id, round(list_inner_product(x, y), 6) AS dot, round(2 * list_sum(x) - 0.5 * list_sum(y), 6) AS mix_sum FROM pts JOIN centers ON k = label",
    "matrix_transposed_blocks": f"WITH {PTS} , c AS (SELECT id, unnest(range(64)) AS p, unnest(x) AS v FROM pts) SELECT CAST(floor(p / 8) AS BIGINT) AS row_block, CAST(floor(id / 20) AS BIGINT) AS col_block, p AS i, id AS j, round(v, 6) AS v FROM c",
    "reduce_bool": "SELECT l_returnflag, bool_or(l_quantity > 49) AS some, bool_and(l_quantity > 0) AS every FROM lineitem GROUP BY l_returnflag",
    "reduce_sums": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS int_sum, round(sum(l_quantity), 6) AS double_sum, round(avg(l_discount), 6) AS mean, round(max(l_extendedprice), 6) AS largest FROM lineitem",
    "reduce_mean_sigma": "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sigma FROM lineitem",
    "reduce_histogram": "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "reduce_histogram_2d": "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS cx, CAST(floor(l_discount * 50 + 1e-9) AS BIGINT) AS cy, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "reduce_vectors": f"WITH {MEANS} SELECT p AS pos, round(sum(v), 6) AS total, round(max(v), 6) AS largest, round(avg(v), 6) AS average FROM pos GROUP BY p",
    "reduce_group_vectors": f"WITH {MEANS} SELECT label, p AS pos, round(sum(v), 6) AS value FROM pos GROUP BY label, p",
    "reduce_indexed_sum": "SELECT l_suppkey, round(sum(l_quantity), 6) AS total, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "reduce_min_max_index": "SELECT 'min' AS which, round(o_totalprice, 6) AS value, o_orderkey AS index FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION ALL SELECT 'max', round(o_totalprice, 6), o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)",
    "reduce_k_smallest": "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, round(o_totalprice, 6) AS value, o_orderkey AS index FROM orders QUALIFY rank <= 12",
    "reduce_k_smallest_remainder": "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, round(o_totalprice, 6) AS value, o_orderkey AS index, rank <= 5 AS kept FROM orders QUALIFY rank <= 6",
    "reduce_correlation": "SELECT round(avg(l_quantity), 6) AS mean_x, round(avg(l_extendedprice), 6) AS mean_y, round(stddev_pop(l_quantity), 6) AS sigma_x, round(stddev_pop(l_extendedprice), 6) AS sigma_y, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem",
}
