"""Point, label, cluster, center and property files; all are text, one record a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = r"[\s,]+"


def fields(df: DataFrame, column: str = "value") -> Column:
    return F.split(F.trim(column), FIELDS)


def number(parts: Column, i: int, kind: str = "double") -> Column:
    return F.get(parts, i).try_cast(kind)


def vectors(lines: DataFrame, dim: int, first: int = 1, cluster: int | None = None) -> DataFrame:
    """(id, x, cluster): ``dim`` numbers from column ``first``; headers and short lines are skipped."""
    p = fields(lines)
    x = F.transform(F.slice(p, first + 1, dim), lambda v: v.try_cast("double"))
    label = F.lit(None).cast("int") if cluster is None else number(p, cluster, "int")
    rows = lines.where(F.size(p) >= first + dim).select(number(p, 0, "double").cast("long").alias("id"), x.alias("x"), label.alias("cluster"))
    return rows.where(F.col("id").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def lcms_points(lines: DataFrame, charge: int | None = None) -> DataFrame:
    """(idx, mz, rt, charge, peptide, peptide_id, mclust, medea); a negative ``charge`` leaves that one out."""
    p = fields(lines)
    rows = lines.where(F.size(p) >= 8).select(
        number(p, 0, "long").alias("idx"), number(p, 1).alias("mz"), number(p, 2).alias("rt"), number(p, 3, "int").alias("charge"), F.get(p, 4).alias("peptide"),
        *(F.floor(number(p, i) + 0.001).cast("int").alias(n) for i, n in ((5, "peptide_id"), (6, "mclust"), (7, "medea"))),
    ).where("idx is not null")
    if charge is None:
        return rows
    return rows.where(F.col("charge") == charge) if charge >= 0 else rows.where(F.col("charge") != -charge)


def lcms_previous(lines: DataFrame) -> DataFrame:
    """(idx, mz, rt, z, cluster) of a former result."""
    p = fields(lines)
    return lines.where(F.size(p) >= 5).select(number(p, 0, "long").alias("idx"), number(p, 1).alias("mz"), number(p, 2).alias("rt"), number(p, 3).alias("z"), number(p, 4, "int").alias("cluster")).where("idx is not null")


def charge_counts(points: DataFrame, most: int = 199) -> DataFrame:
    """(slot, n): how many points have each charge, at 1 + charge within 0 to ``most``."""
    return points.groupBy(F.least(F.greatest(F.col("charge") + 1, F.lit(0)), F.lit(most)).cast("long").alias("slot")).agg(F.count("*").alias("n"))


def points_3d(lines: DataFrame) -> DataFrame:
    p = fields(lines)
    return lines.where(F.size(p) >= 4).select(number(p, 0, "long").alias("id"), *(number(p, i).alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))), number(p, 4, "int").alias("cluster")).where("id is not null")


def labels_with_length(lines: DataFrame) -> DataFrame:
    """(idx, name, length): the first field, what is between, and the last."""
    p = fields(lines)
    return lines.where(F.size(p) >= 3).select(number(p, 0, "long").alias("idx"), F.array_join(F.slice(p, F.lit(2), F.size(p) - 2), " ").alias("name"), F.element_at(p, -1).try_cast("int").alias("length")).where("idx is not null")


def cluster_numbers(lines: DataFrame) -> DataFrame:
    p = fields(lines)
    return lines.where(F.size(p) >= 2).select(number(p, 0, "long").alias("idx"), number(p, 1, "int").alias("cluster")).where("idx is not null")


def centers(lines: DataFrame) -> DataFrame:
    """(point, measure, method, grp) of lines of key=value."""
    value = lambda key: F.nullif(F.regexp_extract("value", rf"\b{key}=(\S+)", 1), F.lit(""))
    return lines.select(value("PointNumber").try_cast("long").alias("point"), value("Measure").try_cast("double").alias("measure"), value("Method").alias("method"), value("Group").try_cast("int").alias("grp")).where("point is not null")


def properties(lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """Point properties, tab-separated key:value; ``names`` maps keys to types. Negative indices are null."""
    pairs = lines.select(F.expr(r"str_to_map(value, '\t', ':')").alias("m"))
    out = []
    for name, kind in names.items():
        v = F.try_element_at("m", F.lit(name)).try_cast(kind)
        out.append((F.when(v >= 0, v) if kind in ("int", "long") else v).alias(name))
    return pairs.select(*out)


def property_lines(df: DataFrame, names: list[str]) -> DataFrame:
    """One line of key:value for each row; nulls are left out."""
    each = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(n).cast("string"))) for n in names]
    return df.select(F.concat_ws("\t", *each).alias("value"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def cluster_lines(df: DataFrame, id_col: str = "id", cluster: str = "cluster", extra: list[str] | None = None) -> DataFrame:
    return df.select(F.concat_ws("\t", F.col(id_col).cast("string"), *(F.col(c).cast("string") for c in extra or []), F.col(cluster).cast("string")).alias("value"))


def plot_xml(points: DataFrame, clusters: list[tuple[int, str]], most: int = 100_000) -> str:
    """Plot XML of (id, x, y, z, cluster); for driver-side viewing of at most ``most`` points, more raise an error."""
    from xml.etree import ElementTree as E

    rows = points.orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points to plot")
    top = E.Element("plot")
    box = E.SubElement(top, "clusters")
    for key, label in clusters:
        c = E.SubElement(box, "cluster")
        E.SubElement(c, "key").text, E.SubElement(c, "label").text = str(key), label
        hue = key * 137 % 360
        E.SubElement(c, "color", h=str(hue))
    box = E.SubElement(top, "points")
    for r in rows:
        p = E.SubElement(box, "point")
        E.SubElement(p, "key").text, E.SubElement(p, "clusterkey").text = str(r["id"]), str(r["cluster"])
        E.SubElement(p, "location", x=repr(r["x"]), y=repr(r["y"]), z=repr(r["z"]))
    return E.tostring(top, encoding="unicode")


#: Styles of point files beside key:value lines, and the property whose number each shows.
STYLES = {"family1": "family1", "family2": "family2", "cluster": "cluster", "group": "group"}


def style_lines(df: DataFrame, style: str, coordinates: tuple[str, ...] = ("x", "y", "z"), first: int = 0) -> DataFrame:
    """Lines of a point file: colon (key:value of all columns), or number, coordinates (4 digits) and one of STYLES, tab-separated.

    ``df`` has a column index; a style whose property is not a column has 1 in its place if it is group.
    """
    if style == "colon":
        return property_lines(df, df.columns)
    if style not in STYLES:
        raise ValueError(f"no style {style!r}; colon or one of {sorted(STYLES)}")
    value = F.col(style) if style in df.columns else F.lit(1) if style == "group" else None
    if value is None:
        raise ValueError(f"points have no {style}")
    shown = [F.format_string("%.4E", F.col(c).cast("double")) for c in coordinates if c in df.columns]
    return df.select(F.concat_ws("\t", (F.col("index") + first).cast("string"), *shown, value.cast("string")).alias("value"))


def old_clusters(lines: DataFrame, dim: int) -> DataFrame:
    """(idx, text, color) of lines of a number, ``dim`` coordinates and a color: all but the color joined by tabs; short and odd lines are skipped."""
    p = F.filter(fields(lines), lambda v: v != "")
    rows = lines.where(F.size(p) == dim + 2)
    return rows.select(number(p, 0, "long").alias("idx"), F.array_join(F.slice(p, 1, dim + 1), "\t").alias("text"), F.element_at(p, -1).try_cast("double").cast("int").alias("color")).where("idx is not null")


def center_lines(df: DataFrame) -> DataFrame:
    """Lines of a center file from (point, measure, method, grp): the number to six places, then key=value."""
    return df.select(F.concat(F.lit("PointNumber="), F.rpad(F.col("point").cast("string"), 6, " "), F.format_string(" Measure=%.4f Method=%s Group=%d", F.col("measure"), F.col("method"), F.col("grp"))).alias("value"))


def alignment_lines(df: DataFrame) -> DataFrame:
    """Four lines and an empty one for each alignment (name1, row1, name2, row2, kimura, jukes_cantor, identity)."""
    told = F.format_string("Kimura: %.5f, JukesCantor: %.5f, PercentIdentity: %.5f", "kimura", "jukes_cantor", "identity")
    return df.select(F.concat_ws("\n", F.concat(F.lit(">"), "name1", F.lit(" "), told), "row1", F.concat(F.lit(">"), "name2", F.lit(" "), told), "row2", F.lit("")).alias("value"))


def alignment_score_lines(df: DataFrame) -> DataFrame:
    """Seven lines and an empty one for each alignment (row, col, name1, row1, name2, row2, n1, n2, score, identity, identity_non_gap, self1, self2)."""
    told = F.format_string("#PID:%.5f\tScore:%.5f\tPIDNG:%.5f\tFirst:%.1f\tSecond:%.1f", "identity", "score", "identity_non_gap", "self1", "self2")
    head = [F.format_string("#Row:%d\tCol:%d", "row", "col"), F.format_string("#FL:%d\tSL:%d\tAL:%d", "n1", "n2", F.length("row1")), told]
    return df.select(F.concat_ws("\n", *head, F.concat(F.lit(">"), "name1"), "row1", F.concat(F.lit(">"), "name2"), "row2", F.lit("")).alias("value"))
