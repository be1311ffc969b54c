"""Queries over sequences, score tables, alignments, file formats and special functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.functions import alignment as A
from pairforge.functions import special
from pairforge.functions.scoring import nucleotide
from pairforge.operators import pairs as P
from pairforge.plans.basics import r6
from pairforge.sources import points as S
from pairforge.session import ship, table

LETTERS, MAPPED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def sequences(spark, sf):
    """The benchmark texts' letters, spelled in four bases."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), F.concat(F.lit("item "), F.col("item_id")).alias("label"), F.translate(letters, LETTERS, MAPPED).alias("residues"))


def neighbours(spark, sf):
    """Each sequence with the next one, padded with gaps to one length."""
    s = sequences(spark, sf)
    t = s.select((F.col("idx") - 1).alias("idx"), F.col("residues").alias("other"))
    both = s.join(t, "idx")
    width = F.greatest(F.length("residues"), F.length("other"))
    return both.select("idx", F.rpad("residues", width, "-").alias("a"), F.lpad("other", width, "-").alias("b"), "residues", "other")


def sequence_index(spark, sf):
    return sequences(spark, sf).select("idx", "label", F.length("residues").cast("long").alias("length"), F.substring("residues", 3, 12).alias("part"))


def score_table(spark, sf):
    """Scores of the nucleotide letters that the benchmark texts are written with, and how often the first comes."""
    letters = table(spark, sf, "benchmark").select(F.explode(F.split(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "")).alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    scores = spark.createDataFrame([(a, b, float(v)) for (a, b), v in nucleotide().items()], "a string, b string, score double")
    # As many rows as pairs of letters.
    return letters.join(F.broadcast(scores), "a").select("a", "b", "score", "n")


def alignment_identities(spark, sf):
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf).select("idx", r6(A.percent_identity(a, b), "pid"), r6(A.percent_identity_non_gap(a, b), "pid_non_gap"), r6(A.percent_identity_overlap(a, b), "pid_overlap"), r6(A.percent_similarity(a, b), "similarity"))


def alignment_distances(spark, sf):
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf).select("idx", r6(A.kimura_distance(a, b), "kimura"), r6(A.jukes_cantor_distance(a, b), "jukes_cantor"), r6(A.alignment_distance("percent_identity", a, b), "pid_distance"))


def self_scores(spark, sf):
    s1, s2 = A.self_score(F.col("residues")), A.self_score(F.col("other"))
    n = neighbours(spark, sf).select("idx", s1.alias("s1"), s2.alias("s2"), F.length("residues").alias("n1"), F.length("other").alias("n2"))
    return n.select("idx", r6("s1"), r6("s2"), r6(A.min_max_normalised(F.lit(100.0), F.col("s1"), F.col("s2")), "local_norm"), r6(A.min_max_normalised_global(F.lit(100.0), F.col("s1"), F.col("s2"), F.col("n1"), F.col("n2"), -14, -4), "global_norm"))


def alignment_analysis(spark, sf):
    n = neighbours(spark, sf)
    return n.select("idx", F.size(A.gap_intervals(F.col("b"))).cast("long").alias("gaps"), F.size(A.mismatch_positions(F.col("a"), F.col("b"))).cast("long").alias("mismatches"))


def _all_pairs(spark, sf):
    """Each unordered pair of sequences, i > j."""
    half = P.half_pairs(sequences(spark, sf), ["residues"], "idx")
    swap = F.col("i") < F.col("j")
    first, second = (F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in (("residues_i", "residues_j"), ("residues_j", "residues_i")))
    return half.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), first.alias("a"), second.alias("b"))


def smith_waterman(spark, sf):
    """Local alignments of all pairs of sequences."""
    got = A.align_pairs(_all_pairs(spark, sf), "a", "b", ["i", "j"])
    return got.select("i", "j", F.col("score").cast("double").alias("score"), "start1", "start2", F.col("identity").cast("long").alias("identity"), "gaps", F.length("aligned1").alias("columns"), r6(A.kimura_distance(F.col("aligned1"), F.col("aligned2")), "kimura"))


def needleman_wunsch(spark, sf):
    """Global alignments of all pairs of sequences."""
    got = A.align_pairs(_all_pairs(spark, sf), "a", "b", ["i", "j"], local=False)
    return got.select("i", "j", F.col("score").cast("double").alias("score"), F.col("identity").cast("long").alias("identity"), "gaps", r6(A.percent_identity(F.col("aligned1"), F.col("aligned2")), "pid"))


def alignment_scores(spark, sf):
    """Best local and global scores of all pairs of sequences."""
    pairs = _all_pairs(spark, sf)
    near = A.align_pairs(pairs, "a", "b", ["i", "j"]).select("i", "j", F.col("score").cast("long").alias("local"))
    far = A.align_pairs(pairs, "a", "b", ["i", "j"], local=False).select("i", "j", F.col("score").cast("long").alias("global"))
    return near.join(far, ["i", "j"])


def _lcms_lines(spark, sf):
    i = table(spark, sf, "lineitem")
    cols = [F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber"), F.lit("PEP"), F.col("l_partkey"), F.col("l_suppkey"), F.lit(-1)]
    return i.select(F.concat_ws("\t", *(c.cast("string") for c in cols)).alias("value"))


def lcms_points(spark, sf):
    return S.lcms_points(_lcms_lines(spark, sf), -3).groupBy("charge").agg(F.count("*").alias("n"), r6(F.sum("rt"), "rt"), F.sum("peptide_id").cast("long").alias("peptides"), F.min("medea").alias("medea"))


def lcms_charges(spark, sf):
    return S.charge_counts(S.lcms_points(_lcms_lines(spark, sf)))


def labels_and_lengths(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.concat(F.lit("from "), "source"), F.col("n_chars").cast("string")).alias("value"))
    return S.labels_with_length(lines)


def point_properties(spark, sf):
    e = table(spark, sf, "embeddings")
    lines = S.property_lines(e.select(F.col("vec_id").alias("index"), F.when(F.col("label") % 2 == 0, F.col("label")).otherwise(-1).alias("cluster"), F.lit("p q").alias("label")), ["index", "cluster", "label"])
    return S.properties(lines, {"index": "long", "cluster": "int", "label": "string"})


def center_lines(spark, sf):
    e = table(spark, sf, "embeddings")
    lines = e.select(F.concat(F.lit("PointNumber="), F.col("vec_id"), F.lit(" Measure="), F.round(F.col("embedding")[0].cast("double"), 4), F.lit(" Method=best Group="), F.col("label")).alias("value"))
    return S.centers(lines).groupBy("grp", "method").agg(F.count("*").alias("n"), F.min("point").alias("first"))


def hyperbolic(spark, sf):
    x = F.col("l_discount") + 0.1
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    fs = {"sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "atanh": F.atanh, "log10": F.log10}
    return i.select("l_orderkey", "l_linenumber", *(r6(f("x"), n) for n, f in fs.items()), r6(F.acosh(F.col("x") + 1), "acosh"), r6(F.hypot("x", F.lit(2.0)), "hypot"), (F.col("l_linenumber") % 2).cast("long").alias("parity"))


def special_functions(spark, sf):
    ship(spark)
    u = special.udfs()
    i = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("p")).distinct().withColumn("k", F.col("q") / 5)
    one = {n: u[n](F.col("k")) for n in ("lgamma", "erf", "erfc", "normal", "j0", "j1", "y0", "y1")}
    two = {n: u[n](F.lit(3.0), F.col("k")) for n in ("igam", "igamc", "chisq", "chisqc", "poisson", "poissonc", "jn", "yn")}
    return i.select("q", "p", *(r6(c, n) for n, c in (one | two).items()))


QUERIES = {
    "sequence_index": sequence_index, "score_table": score_table, "alignment_identities": alignment_identities, "alignment_distances": alignment_distances, "alignment_self_scores": self_scores,
    "alignment_analysis": alignment_analysis, "smith_waterman": smith_waterman, "needleman_wunsch": needleman_wunsch, "alignment_scores": alignment_scores, "lcms_points": lcms_points, "lcms_charges": lcms_charges,
    "labels_and_lengths": labels_and_lengths, "point_properties": point_properties, "center_lines": center_lines, "hyperbolic": hyperbolic, "special_functions": special_functions,
}

_SEQ = f"seq AS (SELECT item_id AS idx, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{MAPPED}') AS residues FROM benchmark)"
_PAIR = _SEQ + ", nb AS (SELECT s.idx, s.residues, t.residues AS other, greatest(length(s.residues), length(t.residues)) AS w FROM seq s JOIN seq t ON t.idx = s.idx + 1), al AS (SELECT *, rpad(residues, CAST(w AS INTEGER), '-') AS a, lpad(other, CAST(w AS INTEGER), '-') AS b FROM nb)"
_COLS = _PAIR + """, col AS (SELECT idx, w, a, b, unnest(range(w)) AS i FROM al), c AS (SELECT idx, i, a[i + 1] AS p, b[i + 1] AS q, w, greatest(length(regexp_extract(a, '^-*')), length(regexp_extract(b, '^-*'))) AS lead, greatest(length(regexp_extract(a, '-*$')), length(regexp_extract(b, '-*$'))) AS trail FROM col),
  n AS (SELECT idx, any_value(w) AS w, count(CASE WHEN p = q AND p <> '-' THEN 1 END) AS same, count(CASE WHEN p <> '-' AND q <> '-' THEN 1 END) AS paired, any_value(w - lead - trail) AS span,
    count(CASE WHEN p <> '-' AND q <> '-' AND p <> q AND (p IN ('A', 'G')) = (q IN ('A', 'G')) THEN 1 END) AS ts, count(CASE WHEN p <> '-' AND q <> '-' AND (p IN ('A', 'G')) <> (q IN ('A', 'G')) THEN 1 END) AS tv FROM c GROUP BY idx)"""


def _cells_sql(kind: str, local: bool) -> str:
    """Rows of the affine-gap table one after the other: h the best score, f the best that ends in a gap of b; a gap of a is a running maximum along the row."""
    edge = "0" if local else "-(14 + 4 * (step - 1))"
    corner = "0" if local else "CASE WHEN step = 0 THEN 0 ELSE -(14 + 4 * (step - 1)) END"
    floor = "0, " if local else ""
    first = "0" if local else "-(14 + 4 * (c - 1))"
    from_edge = "-1000000" if local else f"{edge} - 14 - 4 * (c - 1)"
    return f"""{kind}(i, j, c, step, y, h, f, best) AS (SELECT i, j, c, 0, y, CAST({first} AS INTEGER), -1000000, 0 FROM col
UNION ALL SELECT i, j, c, step, y, greatest(hp, e), f, greatest(best, hp, e) FROM (
  SELECT *, greatest(coalesce(max(hp + 4 * c) OVER (PARTITION BY i, j ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 14 - 4 * (c - 1), -1000000), {from_edge}) AS e FROM (
    SELECT l.i, l.j, l.c, step + 1 AS step, y, best, greatest(h - 14, f - 4) AS f, greatest({floor}coalesce(hd, {corner}) + CASE WHEN x.letter = y THEN 5 ELSE -4 END, h - 14, f - 4) AS hp
    FROM (SELECT *, lag(h) OVER (PARTITION BY i, j ORDER BY c) AS hd FROM {kind}) l JOIN letters x ON x.idx = l.i AND x.pos = l.step + 1)))"""


_SCORES = f"""WITH RECURSIVE {_SEQ}, letters AS (SELECT idx, unnest(range(1, length(residues) + 1)) AS pos, unnest(string_split(residues, '')) AS letter FROM seq),
n AS (SELECT idx, max(pos) AS n FROM letters GROUP BY idx), col AS (SELECT n.idx AS i, x.idx AS j, x.pos AS c, x.letter AS y FROM n JOIN letters x ON n.idx > x.idx),
{_cells_sql("near", True)}, {_cells_sql("far", False)},
a AS (SELECT near.i, near.j, max(best) AS local FROM near JOIN n ON n.idx = near.i AND step = n.n GROUP BY 1, 2), b AS (SELECT far.i, far.j, max_by(h, c) AS global FROM far JOIN n ON n.idx = far.i AND step = n.n GROUP BY 1, 2)
SELECT a.i, a.j, CAST(local AS BIGINT) AS local, CAST(global AS BIGINT) AS global FROM a JOIN b ON a.i = b.i AND a.j = b.j"""


def _gamma_sql(a: str, x: str) -> str:
    """The lower incomplete gamma function as a sum of positive terms."""
    return f"list_sum(list_transform(range(500), lambda n: exp(-({x}) + ({a} + n) * ln({x}) - lgamma({a} + n + 1))))"


def _bessel_sql(n: str, x: str) -> str:
    return f"list_sum(list_transform(range(60), lambda m: CASE WHEN m % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp((2 * m + {n}) * ln({x} / 2) - lgamma(m + 1.0::DOUBLE) - lgamma(m + {n} + 1.0::DOUBLE))))"


# Order 0 of the second kind is a series over even orders of the first kind, order 1 follows from the Wronskian, the others by recurrence.
_SPECIAL = f"""WITH i AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS q, l_discount AS p FROM lineitem), k AS (SELECT DISTINCT q, q / 5 AS k FROM i),
g AS (SELECT q, k, lgamma(k) AS lgamma, {_gamma_sql("0.5::DOUBLE", "k * k")} AS erf, {_gamma_sql("0.5::DOUBLE", "k * k / 2")} AS half, {_gamma_sql("3.0::DOUBLE", "k")} AS igam, {_gamma_sql("1.5::DOUBLE", "k / 2")} AS chisq, {_gamma_sql("4.0::DOUBLE", "k")} AS poissonc,
  {_bessel_sql("0", "k")} AS j0, {_bessel_sql("1", "k")} AS j1, {_bessel_sql("3", "k")} AS jn FROM k),
even AS (SELECT k.q, m, CASE WHEN m % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / m * {_bessel_sql("2 * o.m", "k").replace("lambda m:", "lambda t:").replace("m % 2", "t % 2").replace("(2 * m +", "(2 * t +").replace("lgamma(m +", "lgamma(t +")} AS term FROM k CROSS JOIN (SELECT unnest(range(1, 31)) AS m) o),
y AS (SELECT g.*, 2 / pi() * (ln(k / 2) + 0.5772156649015329::DOUBLE) * j0 + 4 / pi() * term AS y0 FROM g JOIN (SELECT q, sum(term) AS term FROM even GROUP BY q) e ON e.q = g.q),
z AS (SELECT *, (j1 * y0 - 2 / (pi() * k)) / j0 AS y1 FROM y)
SELECT i.q, i.p, round(lgamma, 6) AS lgamma, round(erf, 6) AS erf, round(1 - erf, 6) AS erfc, round((1 + half) / 2, 6) AS normal, round(j0, 6) AS j0, round(j1, 6) AS j1, round(y0, 6) AS y0, round(y1, 6) AS y1,
  round(igam, 6) AS igam, round(1 - igam, 6) AS igamc, round(chisq, 6) AS chisq, round(1 - chisq, 6) AS chisqc, round(1 - poissonc, 6) AS poisson, round(poissonc, 6) AS poissonc, round(jn, 6) AS jn, round(4 / k * (2 / k * y1 - y0) - y1, 6) AS yn FROM i JOIN z ON z.q = i.q"""
ORACLE_SQL = {
    "alignment_scores": _SCORES,
    "special_functions": _SPECIAL,
    "sequence_index": f"WITH {_SEQ} SELECT idx, concat('item ', idx) AS label, length(residues) AS length, substring(residues, 3, 12) AS part FROM seq",
    "score_table": f"""WITH l AS (SELECT unnest(string_split(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '')) AS a FROM benchmark), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
s(a, b, score) AS (VALUES {', '.join(f"('{a}', '{b}', CAST({v} AS DOUBLE))" for (a, b), v in nucleotide().items())}) SELECT a, b, score, n FROM s JOIN n USING (a)""",
    "alignment_identities": f"WITH {_COLS} SELECT idx, round(same / w, 6) AS pid, round(same / paired, 6) AS pid_non_gap, round(same / span, 6) AS pid_overlap, round(same / w, 6) AS similarity FROM n",
    "alignment_distances": f"""WITH {_COLS}, f AS (SELECT *, ts / paired AS p, tv / paired AS q, 1 - 4.0::DOUBLE / 3 * (1 - same / paired) AS inside FROM n)
SELECT idx, round(CASE WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN least(-0.5 * ln(1 - 2 * p - q) - 0.25 * ln(1 - 2 * q), 10) ELSE 10 END, 6) AS kimura, round(CASE WHEN inside > 1e-12 THEN -0.75 * ln(inside) ELSE 10 END, 6) AS jukes_cantor, round(1 - same / w, 6) AS pid_distance FROM f""",
    "alignment_self_scores": f"""WITH {_PAIR}, s AS (SELECT idx, 5.0::DOUBLE * length(residues) AS s1, 5.0::DOUBLE * length(other) AS s2, -28.0::DOUBLE - 4 * (length(residues) + length(other)) AS low FROM al)
SELECT idx, s1, s2, round(100 / greatest(s1, s2), 6) AS local_norm, round((100 - low) / (greatest(s1, s2) - low), 6) AS global_norm FROM s""",
    "alignment_analysis": f"WITH {_COLS} SELECT n.idx, len(regexp_extract_all(b, '-+')) AS gaps, paired - same AS mismatches FROM n JOIN al ON al.idx = n.idx",
    "lcms_points": "SELECT l_linenumber AS charge, count(*) AS n, round(sum(l_quantity), 6) AS rt, CAST(sum(l_partkey) AS BIGINT) AS peptides, -1 AS medea FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1",
    "lcms_charges": "SELECT CAST(least(greatest(l_linenumber + 1, 0), 199) AS BIGINT) AS slot, count(*) AS n FROM lineitem GROUP BY 1",
    "labels_and_lengths": "SELECT doc_id AS idx, concat('from ', source) AS name, CAST(n_chars AS INTEGER) AS length FROM documents",
    "point_properties": "SELECT vec_id AS index, CASE WHEN label % 2 = 0 THEN label END AS cluster, 'p q' AS label FROM embeddings",
    "center_lines": "SELECT label AS grp, 'best' AS method, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY label",
    "hyperbolic": "WITH i AS (SELECT *, l_discount + 0.1::DOUBLE AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(sinh(x), 6) AS sinh, round(cosh(x), 6) AS cosh, round(tanh(x), 6) AS tanh, round(asinh(x), 6) AS asinh, round(atanh(x), 6) AS atanh, round(log10(x), 6) AS log10, round(acosh(x + 1), 6) AS acosh, round(sqrt(x * x + 4), 6) AS hypot, CAST(l_linenumber % 2 AS BIGINT) AS parity FROM i",
}
