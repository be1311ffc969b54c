"""Queries that write a file of each format to the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairforge.functions import alignment as A
from pairforge.operators import pairs as P
from pairforge.plans.basics import DIM, DIST, PTS, distances, points, r6
from pairforge.plans.sequences import _COLS, _SEQ, neighbours, sequences
from pairforge.session import shared_dir, stage, table
from pairforge.sources import fasta, matrix, matrix_source, point_files
from pairforge.sources import points as S


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/pairforge/{uuid.uuid4().hex}"


def _written(spark, lines, name: str):
    """Lines written as a text file and read again."""
    path = f"{_folder(spark)}/{name}"
    lines.write.text(path)
    return S.lines(spark, path)


def fasta_file(spark, sf):
    path = f"{_folder(spark)}/sequences.fasta"
    fasta.write_fasta(sequences(spark, sf), path)
    return fasta.read_fasta(spark, path).select("label", "residues")


def index_file(spark, sf):
    return S.labels_with_length(_written(spark, fasta.index_lines(sequences(spark, sf)), "index.txt"))


def solution_file(spark, sf):
    """Positions written as a scaling's solution with its header, and read back."""
    p = points(spark, sf)
    role = F.when(F.col("id") % 7 == 0, "fixed").when(F.col("id") % 11 == 0, "deleted").when(F.col("id") % 13 == 0, "ignored").otherwise("varied")
    found = p.select("id", F.slice("x", 1, 3).alias("x"), F.transform(F.slice("x", 4, 3), F.abs).alias("err"))
    solution = point_files.solution_points(found, p.select("id", (F.col("id") * 2).alias("original"), role.alias("role")), "scaling-1")
    read = _written(spark, point_files.solution_header(solution, "scaling-1", "all points").unionByName(point_files.solution_lines(solution)), "solution.txt")
    total = point_files.headers(read, {"NumberPointsinFile": "long", "FileGenerationType": "long"})
    got = point_files.points(read, names={"xerr": "double", "grouplabel": "string", "source": "string"})
    # One header.
    return got.join(F.broadcast(total)).select("number", "original", r6("x"), r6("y"), r6("z"), r6("xerr"), "group", "grouplabel", "source", F.col("NumberPointsinFile").alias("points"), F.col("FileGenerationType").alias("kind"))


def comparison_label_file(spark, sf):
    """Peaks of one charge with golden and compared labels: each label's peaks."""
    i = table(spark, sf, "lineitem")
    golden = F.when(F.col("l_linenumber") % 2 == 0, F.lit("NA")).otherwise(F.col("l_suppkey").cast("string"))
    cols = [F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity").cast("int"), F.col("l_returnflag"), golden, F.col("l_partkey") % 9 + 0.9995, F.col("l_suppkey") % 5]
    read = _written(spark, i.select(F.concat_ws("\t", *(c.cast("string") for c in cols)).alias("value")), "peaks.txt")
    got = point_files.comparison_labels(read, 10)
    return got.groupBy(F.col("mclust").cast("long").alias("mclust"), F.col("medea").cast("long").alias("medea")).agg(F.count("*").alias("n"), F.count_if(F.col("golden") >= 0).alias("golden"), F.countDistinct("golden_label").alias("labels"), r6(F.sum("rt"), "rt"))


def _rows(spark, sf):
    """The whole distance matrix by rows, with its zero diagonal."""
    own = points(spark, sf).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))
    return P.matrix_rows(distances(spark, sf).unionByName(own))


def _totals(rows):
    return rows.select("i", F.size("row").cast("long").alias("n"), r6(F.aggregate("row", F.lit(0.0), lambda a, b: a + b), "total"))


def matrix_text_file(spark, sf):
    path = f"{_folder(spark)}/matrix.txt"
    matrix.write_text(_rows(spark, sf), path)
    return _totals(matrix.read_text(spark, path))


def _thirds(spark, sf):
    """The matrix over three, so that all are below one; made once."""
    return stage(spark, _rows(spark, sf).select("i", F.transform("row", lambda d: d / 3).alias("row")), "matrix")


def matrix_binary_files(spark, sf):
    """Parts of 16-bit numbers, read as one matrix."""
    path = f"{_folder(spark)}/matrix"
    matrix_source.write_matrix(_thirds(spark, sf), path, "int16", 32767.0)
    return _totals(matrix_source.read_matrix(spark, path, kind="int16", scale=32767.0))


#: Number types of binary matrices, and text, with what their numbers are multiplied by.
MATRIX_TYPES = {"int16": 32767.0, "uint16": 65535.0, "int32": 2147483647.0, "uint32": 4294967295.0, "float32": None, "float64": None, "text": None}


def matrix_types(spark, sf):
    """The matrix in parts of every type, and as text."""
    rows, out, folder = _thirds(spark, sf), None, _folder(spark)
    for kind, scale in MATRIX_TYPES.items():
        matrix_source.write_matrix(rows, f"{folder}/{kind}", kind, scale)
        got = matrix_source.read_matrix(spark, f"{folder}/{kind}", kind=kind, scale=scale)
        one = _totals(got).select(F.lit(kind).alias("type"), "i", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


def matrix_slices(spark, sf):
    """The middle half of the rows, sought in parts of each layout; numbers as they are stored."""
    rows, out, folder = _thirds(spark, sf), None, _folder(spark)
    n = rows.count()
    for kind in ("uint16", "float64", "text"):
        matrix_source.write_matrix(rows, f"{folder}/{kind}", kind, MATRIX_TYPES[kind])
        # A headerless folder has no description: the width is told.
        got = matrix_source.read_matrix(spark, f"{folder}/{kind}", n, kind, (n // 4, n // 4 + n // 2 - 1), MATRIX_TYPES[kind])
        one = _totals(got).select(F.lit(kind).alias("type"), "i", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


def matrix_reordered(spark, sf):
    """Every other point, in reverse order, distances above 1.4 undefined."""
    order = points(spark, sf).where("id % 2 = 0").select(F.col("id").alias("old"), (F.lit(1_000_000) - F.col("id")).alias("new"))
    d = matrix.load_distances(_rows(spark, sf), order, 1.4)
    return d.groupBy("i").agg(F.count("*").alias("n"), F.count("d").alias("defined"), r6(F.sum("d"), "total"))


def vector_file(spark, sf):
    lines = points(spark, sf).select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.transform("x", lambda v: v.cast("string")), "\t"), F.col("label").cast("string")).alias("value"))
    got = S.vectors(_written(spark, lines, "vectors.txt"), DIM, 1, DIM + 1)
    return got.select("id", r6(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), "total"), "cluster")


def points_3d_file(spark, sf):
    p = points(spark, sf).select(F.concat_ws(" ", F.col("id").cast("string"), *(F.col("x")[k].cast("string") for k in range(3)), F.col("label").cast("string")).alias("value"))
    return S.points_3d(_written(spark, p, "points.txt")).select("id", r6("x"), r6("y"), r6("z"), "cluster")


def cluster_file(spark, sf):
    return S.cluster_numbers(_written(spark, S.cluster_lines(points(spark, sf), "id", "label"), "clusters.txt"))


def lcms_previous_file(spark, sf):
    i = points(spark, sf).select(F.concat_ws(" ", F.col("id").cast("string"), F.col("x")[0].cast("string"), F.col("x")[1].cast("string"), F.lit("0.0"), F.col("label").cast("string")).alias("value"))
    return S.lcms_previous(_written(spark, i, "lcms.txt")).select("idx", r6("mz"), r6("rt"), r6("z"), "cluster")


def center_file(spark, sf):
    c = points(spark, sf).select(F.col("id").alias("point"), F.round(F.col("x")[0] + 2, 3).alias("measure"), F.lit("MDS").alias("method"), "label")
    return S.centers(_written(spark, S.center_lines(c.withColumnRenamed("label", "grp")), "centers.txt")).select("point", r6("measure"), "method", "grp")


def _solution(spark, sf):
    return points(spark, sf).select(F.col("id").alias("index"), *(F.col("x")[k].alias(n) for k, n in enumerate("xyz")), F.col("label").alias("cluster"), F.pmod("id", F.lit(3)).alias("family1"), F.pmod("id", F.lit(5)).alias("family2"))


def solution_styles(spark, sf):
    """A solution in all styles, read back: the sum of the last column of each, and of the first coordinate."""
    out = None
    for style in ("family1", "family2", "cluster", "group"):
        got = S.old_clusters(_written(spark, S.style_lines(_solution(spark, sf), style), f"{style}.txt"), 3)
        one = got.agg(F.lit(style).alias("style"), F.count("*").alias("n"), F.sum("color").cast("long").alias("colors"), F.round(F.sum(F.split("text", "\t")[1].cast("double")), 2).alias("x"))
        out = one if out is None else out.unionByName(one)
    colon = S.properties(_written(spark, S.style_lines(_solution(spark, sf), "colon"), "colon.txt"), {"index": "long", "x": "double", "cluster": "int"})
    return out.unionByName(colon.agg(F.lit("colon").alias("style"), F.count("*").alias("n"), F.sum("cluster").cast("long").alias("colors"), F.round(F.sum("x"), 2).alias("x")))


def alignment_dump(spark, sf):
    a, b = F.col("a"), F.col("b")
    rows = neighbours(spark, sf).select(F.concat(F.lit("s"), "idx").alias("name1"), a.alias("row1"), F.concat(F.lit("t"), "idx").alias("name2"), b.alias("row2"), A.kimura_distance(a, b).alias("kimura"), A.jukes_cantor_distance(a, b).alias("jukes_cantor"), A.percent_identity(a, b).alias("identity"))
    lines = _written(spark, S.alignment_lines(rows), "alignments.txt").where("value like '>%'")
    part = lambda key: F.regexp_extract("value", rf"{key}: ([0-9.]+)", 1).cast("double").alias(key.lower())
    return lines.select(F.regexp_extract("value", r"^>(\S+)", 1).alias("name"), part("Kimura"), part("JukesCantor"), part("PercentIdentity"))


def alignment_score_dump(spark, sf):
    a, b = F.col("a"), F.col("b")
    rows = neighbours(spark, sf).select(
        F.col("idx").alias("row"), (F.col("idx") + 1).alias("col"), F.concat(F.lit("s"), "idx").alias("name1"), a.alias("row1"), F.concat(F.lit("t"), "idx").alias("name2"), b.alias("row2"), F.length("residues").alias("n1"), F.length("other").alias("n2"),
        F.lit(0.0).alias("score"), A.percent_identity(a, b).alias("identity"), A.percent_identity_non_gap(a, b).alias("identity_non_gap"), A.self_score(F.col("residues")).alias("self1"), A.self_score(F.col("other")).alias("self2"),
    )
    lines = _written(spark, S.alignment_score_lines(rows), "scores.txt").where("value like '#PID%' or value like '#FL%'")
    part = lambda key: F.regexp_extract("value", rf"{key}:([0-9.]+)", 1)
    fl = lines.where("value like '#FL%'").agg(F.count("*").alias("n"), F.sum(part("FL").cast("long")).alias("first"), F.sum(part("SL").cast("long")).alias("second"), F.sum(part("AL").cast("long")).alias("aligned"))
    pid = lines.where("value like '#PID%'").agg(F.round(F.sum(part("PIDNG").cast("double")), 3).alias("identity"), F.sum(part("First").cast("double")).alias("self1"))
    return fl.join(F.broadcast(pid))


QUERIES = {
    "file_solution": solution_file, "file_comparison_labels": comparison_label_file,
    "file_fasta": fasta_file, "file_index": index_file, "file_matrix_text": matrix_text_file, "file_matrix_binary": matrix_binary_files, "file_matrix_types": matrix_types, "file_matrix_slices": matrix_slices, "matrix_reordered": matrix_reordered,
    "file_vectors": vector_file, "file_points_3d": points_3d_file, "file_clusters": cluster_file, "file_lcms_previous": lcms_previous_file, "file_centers": center_file,
    "file_solution_styles": solution_styles, "file_alignments": alignment_dump, "file_alignment_scores": alignment_score_dump,
}

_TYPED = " UNION ALL ".join(
    f"SELECT '{kind}' AS type, i, " + (f"trunc(d / 3 * {scale}) / {scale}" if scale else "CAST(CAST(d / 3 AS FLOAT) AS DOUBLE)" if kind == "float32" else "d / 3") + " AS v FROM full_" for kind, scale in MATRIX_TYPES.items()
)
_FULL = DIST + ", full_ AS (SELECT i, j, d FROM dist UNION ALL SELECT id, id, 0.0 FROM pts)"
ORACLE_SQL = {
    "file_solution": f"""WITH {PTS}, r AS (SELECT id, x, CASE WHEN id % 7 = 0 THEN 2 WHEN id % 11 = 0 THEN 3 WHEN id % 13 = 0 THEN -1 ELSE 1 END AS g FROM pts)
SELECT id AS number, id * 2 AS original, round(CASE WHEN g <> 3 THEN x[1] END, 6) AS x, round(CASE WHEN g <> 3 THEN x[2] END, 6) AS y, round(CASE WHEN g <> 3 THEN x[3] END, 6) AS z, round(CASE WHEN g <> 3 THEN abs(x[4]) END, 6) AS xerr,
  CAST(g AS BIGINT) AS group, CASE g WHEN 1 THEN 'Varied' WHEN 2 THEN 'Fixed' WHEN 3 THEN 'Deleted' ELSE 'Ignored' END AS grouplabel, CASE WHEN g = 1 THEN 'scaling-1' END AS source, count(*) OVER () AS points, CAST(CASE WHEN bool_or(g <> 1) OVER () THEN 4 ELSE 2 END AS BIGINT) AS kind FROM r""",
    "file_comparison_labels": """SELECT CAST(l_partkey % 9 + 1 AS BIGINT) AS mclust, CAST(l_suppkey % 5 AS BIGINT) AS medea, count(*) AS n, count(CASE WHEN l_linenumber % 2 = 1 THEN 1 END) AS golden, count(DISTINCT l_returnflag) AS labels, round(sum(CAST(l_discount AS DOUBLE)), 6) AS rt
FROM lineitem WHERE CAST(floor(l_quantity) AS INTEGER) = 10 GROUP BY 1, 2""",
    "file_fasta": f"WITH {_SEQ} SELECT concat('item ', idx) AS label, residues FROM seq",
    "file_index": f"WITH {_SEQ} SELECT idx, concat('item ', idx) AS name, CAST(length(residues) AS INTEGER) AS length FROM seq",
    "file_matrix_text": f"WITH {_FULL} SELECT i, count(*) AS n, round(sum(d), 6) AS total FROM full_ GROUP BY i",
    "file_matrix_binary": f"WITH {_FULL} SELECT i, count(*) AS n, round(sum(trunc(d / 3 * 32767) / 32767), 6) AS total FROM full_ GROUP BY i",
    "file_matrix_types": f"""WITH {_FULL}, t AS ({_TYPED}) SELECT type, i, count(*) AS n, round(sum(v), 6) AS total FROM t GROUP BY type, i""",
    "file_matrix_slices": f"""WITH {_FULL}, t AS ({_TYPED}), c AS (SELECT count(*) AS n FROM pts)
SELECT type, i, count(*) AS n, round(sum(v), 6) AS total FROM t WHERE type IN ('uint16', 'float64', 'text') AND i >= (SELECT n // 4 FROM c) AND i < (SELECT n // 4 + n // 2 FROM c) GROUP BY type, i""",
    "matrix_reordered": f"WITH {_FULL} SELECT 1000000 - i AS i, count(*) AS n, count(CASE WHEN d <= CAST(1.4 AS DOUBLE) THEN 1 END) AS defined, round(sum(CASE WHEN d <= CAST(1.4 AS DOUBLE) THEN d END), 6) AS total FROM full_ WHERE i % 2 = 0 AND j % 2 = 0 GROUP BY i",
    "file_vectors": f"WITH {PTS} SELECT id, round(list_sum(x), 6) AS total, label AS cluster FROM pts",
    "file_points_3d": f"WITH {PTS} SELECT id, round(x[1], 6) AS x, round(x[2], 6) AS y, round(x[3], 6) AS z, label AS cluster FROM pts",
    "file_clusters": "SELECT vec_id AS idx, label AS cluster FROM embeddings",
    "file_lcms_previous": f"WITH {PTS} SELECT id AS idx, round(x[1], 6) AS mz, round(x[2], 6) AS rt, CAST(0 AS DOUBLE) AS z, label AS cluster FROM pts",
    "file_centers": f"WITH {PTS} SELECT id AS point, round(x[1] + 2, 3) AS measure, 'MDS' AS method, label AS grp FROM pts",
    "file_solution_styles": f"""WITH {PTS}, s AS (SELECT unnest(['family1', 'family2', 'cluster', 'group', 'colon']) AS style)
SELECT style, count(*) AS n, CAST(sum(CASE style WHEN 'family1' THEN id % 3 WHEN 'family2' THEN id % 5 WHEN 'group' THEN 1 ELSE label END) AS BIGINT) AS colors,
  round(sum(CASE style WHEN 'colon' THEN x[1] ELSE CAST(printf('%.4e', x[1]) AS DOUBLE) END), 2) AS x FROM pts CROSS JOIN s GROUP BY style""",
    "file_alignments": f"""WITH {_COLS}, f AS (SELECT *, ts / paired AS p, tv / paired AS q, 1 - 4.0::DOUBLE / 3 * (1 - same / paired) AS inside FROM n),
g AS (SELECT idx, CASE WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN least(-0.5 * ln(1 - 2 * p - q) - 0.25 * ln(1 - 2 * q), 10) ELSE 10 END AS kimura, CASE WHEN inside > 1e-12 THEN -0.75 * ln(inside) ELSE 10 END AS jukescantor, same / w AS percentidentity FROM f)
SELECT concat(t.x, idx) AS name, round(kimura, 5) AS kimura, round(jukescantor, 5) AS jukescantor, round(percentidentity, 5) AS percentidentity FROM g CROSS JOIN (VALUES ('s'), ('t')) t(x)""",
    "file_alignment_scores": f"""WITH {_COLS} SELECT count(*) AS n, CAST(sum(length(residues)) AS BIGINT) AS first, CAST(sum(length(other)) AS BIGINT) AS second, CAST(sum(al.w) AS BIGINT) AS aligned,
  round(sum(round(same / paired, 5)), 3) AS identity, CAST(sum(5.0 * length(residues)) AS DOUBLE) AS self1 FROM n JOIN al ON al.idx = n.idx""",
}
