"""Point files with a header, of bare, key:value or mixed lines, and the writer of a scaling's solution.

A header line begins with FileProperties. A point is a bare line (number, then up to three coordinates, then a group
or a label), the word PointProperties with tab-separated key:value fields, or a bare part before such fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, MARK = "FileProperties", "PointProperties"
#: Groups that a solution gives to points, with their labels and what each says of being fixed (2) or varied (1).
GROUPS = {"varied": (1, "Varied", 1), "fixed": (2, "Fixed", 2), "deleted": (3, "Deleted", 0), "ignored": (-1, "Ignored", 0)}
COORDINATES, ERRORS = ("x", "y", "z"), ("xerr", "yerr", "zerr")


def field(text: Column, key: str, kind: str = "string") -> Column:
    """The first value of a key among tab-separated key:value fields; null where it is absent or not of the kind."""
    found = F.regexp_extract(text, rf"(?:^|\t)[ ]*{key}:([^\t]*)", 1)
    value = F.when(text.rlike(rf"(?:^|\t)[ ]*{key}:"), F.trim(found))
    return value if kind == "string" else value.try_cast(kind)


def _tidy(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.trim(F.col("value"), F.lit(" \t\r")), "\t\t", "\t")
    return lines.where(F.length("value") >= 2).select(text.alias("text"))


def headers(lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row for each header line: the named fields with their types."""
    rest = F.regexp_replace("text", rf".*{HEADER}", "")
    return _tidy(lines).where(F.contains("text", F.lit(HEADER))).select(*(field(rest, n, k).alias(n) for n, k in names.items()))


def points(lines: DataFrame, labels: bool = False, names: dict[str, str] | None = None, first: int = 0) -> DataFrame:
    """(number, original, x, y, z, group, label, colons, bare, names ...) of every point of a file.

    ``labels``: the last field of a bare line is a label, not a group. ``first`` is what the file adds to the original
    numbers of points with fields. Lines of less than two characters are skipped; a bare part of another number of
    fields than 2, 4 or 5, or with a number, group or coordinate that is none, is an error. A bare part wins over fields.
    """
    at = F.instr("text", MARK)
    rows = _tidy(lines).where(~F.contains("text", F.lit(HEADER)) & (F.col("text") != ""))
    split = rows.select("text", F.when(at > 0, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("head"), F.when(at > 0, F.regexp_replace(F.substr("text", at), f"^{MARK}[ \t]*", "")).alias("rest"))
    p = F.filter(F.split("head", "[ \t]+"), lambda v: v != "")
    split = split.withColumn("p", p).withColumn("n", F.size("p"))
    last, number = F.element_at("p", -1), F.try_element_at("p", F.lit(1)).try_cast("long")
    bare = F.col("n") > 0
    value = {c: F.when(F.col("n") >= (5 if i == 2 else 4), F.get("p", i + 1).try_cast("double")) for i, c in enumerate(COORDINATES)}
    group = F.lit(None).cast("long") if labels else F.when(bare, F.try_element_at("p", F.lit(-1)).try_cast("long"))
    wrong = bare & (~F.col("n").isin(2, 4, 5) | number.isNull() | (F.lit(not labels) & group.isNull()) | ((F.col("n") >= 4) & (value["x"].isNull() | value["y"].isNull())) | ((F.col("n") == 5) & value["z"].isNull()))
    told = lambda key, kind: field(F.col("rest"), key, kind)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a point: "), F.col("text"))).cast("long"))
    return split.select(
        F.coalesce(checked, number, told("LocalPointNumber", "long")).alias("number"), (told("OriginalPointNumber", "long") - first).alias("original"),
        *(F.coalesce(value[c], told(c, "double")).alias(c) for c in COORDINATES), F.coalesce(group, told("group", "long")).alias("group"),
        F.coalesce(F.when(bare, last) if labels else F.lit(None).cast("string"), told("pointlabel", "string")).alias("label"), F.col("rest").isNotNull().alias("colons"), bare.alias("bare"),
        *(told(n, k).alias(n) for n, k in (names or {}).items()),
    )


def file_kind(records: DataFrame, labels: bool, header: bool) -> DataFrame:
    """One row (kind, points): 0 with positions, 1 without, 2 labels; 3 more if all is key:value, 6 more if it is mixed."""
    seen = records.agg(F.coalesce(F.bool_or(F.col("x").isNotNull()), F.lit(False)).alias("placed"), F.coalesce(F.bool_or("colons"), F.lit(False)).alias("colons"), F.coalesce(F.bool_or("bare"), F.lit(False)).alias("bare"), F.count("*").alias("points"))
    base = F.lit(2) if labels else F.when(F.col("placed"), 0).otherwise(1)
    more = F.when(F.col("colons") | F.lit(header), F.when(F.col("bare"), 6).otherwise(3)).otherwise(0)
    return seen.select((base + more).cast("long").alias("kind"), "points")


def comparison_labels(lines: DataFrame, charge: int) -> DataFrame:
    """(idx, mz, rt, golden, golden_label, mclust, medea) of the peaks of one charge, from lines of eight fields.

    A golden id that is no whole number is -1; the other two are rounded down. Lines whose charge is no number are
    skipped; shorter lines and labels that are no numbers are errors.
    """
    p = F.split(F.trim(F.col("value"), F.lit(" \t\r")), "[ \t]")
    rows = lines.where(F.length("value") > 0).withColumn("p", p)
    short = F.when(F.size("p") < 8, F.raise_error(F.concat(F.lit("short line: "), F.col("value"))).cast("int"))
    whole = lambda i: F.coalesce(F.get("p", i).try_cast("int"), F.floor(F.get("p", i).cast("double") + 0.001).cast("int"))
    golden = F.when(F.get("p", 5).rlike(r"^[+-]?\d+$"), F.get("p", 5).try_cast("int"))
    return rows.where(F.coalesce(short, F.get("p", 3).try_cast("int")) == charge).select(
        F.get("p", 0).try_cast("long").alias("idx"), F.get("p", 1).cast("double").alias("mz"), F.get("p", 2).cast("double").alias("rt"), F.coalesce(golden, F.lit(-1)).alias("golden"),
        F.get("p", 4).alias("golden_label"), whole(6).alias("mclust"), whole(7).alias("medea"),
    )


def solution_points(positions: DataFrame, roles: DataFrame, run: str) -> DataFrame:
    """Properties that a scaling gives its points: positions (id, x, err) joined with roles (id, original, role), a key of GROUPS.

    Points without a position, and deleted ones, have neither coordinates nor errors; a null role counts as ignored.
    Varied points name the run as their source.
    """
    role = F.coalesce(F.col("role"), F.lit("ignored"))
    pick = lambda k: F.element_at(F.create_map(*(F.lit(v) for n, g in GROUPS.items() for v in (n, g[k]))), role)
    both = roles.select("id", "original", "role").join(positions.select("id", F.col("x").alias("at"), "err"), "id", "left")
    kept = F.col("at").isNotNull() & (role != "deleted")
    value = lambda c, i: F.when(kept, F.get(c, i)).cast("double")
    return both.select(
        F.col("id").alias("LocalPointNumber"), F.col("original").alias("OriginalPointNumber"), *(value("at", i).alias(n) for i, n in enumerate(COORDINATES)), *(value("err", i).alias(n) for i, n in enumerate(ERRORS)),
        pick(0).cast("long").alias("group"), pick(1).alias("grouplabel"), pick(2).cast("long").alias("FixedorVaried"), F.when(role == "varied", F.lit(run)).alias("source"),
    )


def solution_header(points: DataFrame, run: str, comment: str = "") -> DataFrame:
    """The one header line of a solution (value): how many points it holds, and its kind, 4 where any is not varied."""
    seen = points.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("FixedorVaried") != 1), F.lit(False)).alias("fixed"))
    fields = {"GroupName": F.lit(run), "FileGenerationType": F.when(F.col("fixed"), 4).otherwise(2), "NumberPointsinFile": F.col("n"), "LocalPointStartIndex": F.lit(0), "OriginalPointStartIndex": F.lit(0), "Comment": F.lit(comment or None)}
    return seen.select(_line(HEADER, fields))


def solution_lines(points: DataFrame) -> DataFrame:
    """A line of key:value fields for each point of ``solution_points``; nulls are left out."""
    return points.select(_line(MARK, {c: F.col(c) for c in points.columns}))


def _line(mark: str, fields: dict[str, Column]) -> Column:
    each = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), F.regexp_replace(v.cast("string"), "[\t\r\n]+", " "))) for k, v in fields.items()]
    return F.concat_ws("\t", F.lit(mark), *each).alias("value")


def plain_solution_lines(points: DataFrame, dim: int = 3) -> DataFrame:
    """Number, ``dim`` coordinates in four digits and one cluster for all, of the points that have a position."""
    shown = [F.format_string("%.4E", F.col(c)) for c in COORDINATES[:dim]]
    return points.where("x is not null").select(F.concat_ws("\t", F.col("LocalPointNumber").cast("string"), *shown, F.lit("1")).alias("value"))
