"""How far the words of each source stray from those of its language and of the other sources.

Terms are counted by (language, source) inside tasks and summed once. Terms with the same counts in the same
sources have one column of counts between them: every value is computed once for each distinct column,
weighed by the number of its terms, and given back to the terms when they are ranked. A source that lacks a
term has one share for all such terms, so columns stay sparse: pairs are evaluated for sources that share a
column, and what one or both lack follows from the columns of one source and from the number of terms.
All arithmetic is in integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage

#: Documents of its language that a term must occur in; terms that are ranked for a source; parts of a whole share.
MIN_DOCS, RANKS, SHARE = 3, 200, 1_000_000_000
#: Distinct terms that a task counts before it passes them on; bytes of a text that are split into words at once.
HELD_TERMS, SPLIT_BYTES = 300_000, 1 << 20

#: ASCII but letters separates terms, A-Z fold, every other character is part of a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_SEPARATOR = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    while at < len(text):
        found = _SEPARATOR.search(text, at + SPLIT_BYTES)
        end = found.start() if found else len(text)
        yield text[at:end].translate(_FOLD).split()
        at = end


def _counts(df: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """(lang, source, term, count, docs), partly summed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    schema = "lang string, source string, term string, count long, docs long"
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                terms = list(found)
                seen = docs[lang, source]
                for k in range(0, len(terms), 20_000):
                    part = terms[k : k + 20_000]
                    columns = [[lang] * len(part), [source] * len(part), [t.decode("utf-8", "replace") for t in part], [found[t] for t in part], [seen[t] for t in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
            counts.clear()
            docs.clear()

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text")
            for k, key in enumerate(zip(langs, sources)):
                count, seen = counts.setdefault(key, Counter()), docs.setdefault(key, Counter())
                own: set[bytes] = set()
                for words in terms_of(texts[k].as_buffer().to_pybytes()):
                    count.update(words)
                    own.update(words)
                seen.update(own)
                if k % 64 == 0 and sum(map(len, counts.values())) > HELD_TERMS:
                    yield from flush()
        yield from flush()

    ship(df.sparkSession)
    return df.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text")).mapInArrow(run, schema)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SHARE * (count + 1) / (total + terms)), exactly."""
    top = F.lit(SHARE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return (1 + F.call_function("div", top, (total + terms).cast("decimal(20,0)"))).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank), ranks from 1 for each language, source and part.

    Part ``pair``: every other source of the language, valued by its gap to the source over all kept terms.
    Part ``term``: the kept terms that the source uses more than its language does, to rank ``ranks``.
    Ties go to the item that is first in UTF-8. Nulls are empty texts and names; repeated rows are documents
    of their own; an empty table gives no rows; other columns are not read. Sources without terms take part
    with counts of zero; a language whose terms are all rare gives pairs of value 0. Of a very long text its
    distinct terms are held, and its words SPLIT_BYTES at a time. The result has a row for each two sources
    of a language, so one list of a language's sources is held where they are paired.
    """
    spark = df.sparkSession
    lang, source = F.coalesce(df[lang_col].cast("string"), F.lit("")), F.coalesce(df[source_col].cast("string"), F.lit(""))
    counted = _counts(df, lang, source, F.coalesce(df[text_col].cast("string"), F.lit("")))
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    # One entry for each source of the language; sorted, so that equal columns are equal arrays.
    column = F.sort_array(F.collect_list(F.struct("source", "count"))).alias("column")
    terms = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), column).where(F.col("docs") >= min_docs).select("lang", "term", "column")
    terms = stage(spark, terms, "terms")

    distinct = terms.groupBy("lang", "column").agg(F.count(F.lit(1)).alias("n"))
    distinct = stage(spark, distinct, "columns")

    totals = distinct.select("lang", "n", F.explode("column").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum(F.col("n") * F.col("c.count")).alias("total"))
    kept = distinct.groupBy("lang").agg(F.sum("n").alias("terms"))
    groups = df.select(lang.alias("lang"), source.alias("source")).distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    sources = groups.join(kept, "lang", "left").na.fill(0, ["terms"])
    # A row for each language: its sources with their totals and the share of a term they lack (null without terms).
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))
    langs = sources.withColumn("none", none).groupBy("lang").agg(
        F.first("terms").alias("terms"), F.sum("total").alias("lang_total"), F.sort_array(F.collect_list(F.struct("source", "total", "none"))).alias("sources")
    )
    langs = stage(spark, langs, "languages")

    # Each distinct column with the shares of its entries, computed once.
    of_source = F.map_from_arrays(F.transform("sources", lambda s: s["source"]), F.col("sources"))
    in_lang = F.aggregate("column", F.lit(0).cast("long"), lambda a, e: a + e["count"])
    known = distinct.join(langs, "lang").withColumn("of", of_source)

    def entry(e: Column) -> Column:
        s = F.element_at("of", e["source"])
        return F.struct(e["source"].alias("source"), _share(e["count"], s["total"], F.col("terms")).alias("p"), s["none"].alias("none"))

    shares = known.select("lang", "column", "n", _share(in_lang, F.col("lang_total"), F.col("terms")).alias("q"), F.transform("column", entry).alias("entries"))
    shares = stage(spark, shares, "shares")

    pairs = _pairs(shares, langs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    # Terms of one column tie, so none past its first ``ranks`` can be ranked anywhere.
    first = Window.partitionBy("lang", "column").orderBy("term")
    leading = terms.withColumn("place", F.row_number().over(first)).where(F.col("place") <= ranks).select("lang", "column", "term")
    gaps = shares.select("lang", "column", F.filter(F.transform("entries", lambda e: F.struct(e["source"].alias("source"), e["p"].alias("p"), F.when(e["p"] > F.col("q"), _gap(e["p"], F.col("q"))).alias("value"))), lambda e: e["value"].isNotNull()).alias("entries"))
    found = leading.join(gaps, ["lang", "column"]).select("lang", F.col("term").alias("item"), F.explode("entries").alias("e")).select("lang", "e.source", "item", "e.value")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(found.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _pairs(shares: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): the gaps of each two sources of a language, summed over its terms.

    A sum over all terms of what sources lack, plus what each entry changes in it, plus what entries of
    both sources change beyond that.
    """
    f = _gap
    each = shares.select("lang", "n", F.explode("entries").alias("a"), "entries").select("lang", "n", "a", F.explode("entries").alias("b")).where("a.source <> b.source")
    p, q, p0, q0 = F.col("a.p"), F.col("b.p"), F.col("a.none"), F.col("b.none")
    both = each.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("n") * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))).alias("value"))

    single = shares.select("lang", "n", F.explode("entries").alias("a")).groupBy("lang", "a").agg(F.sum("n").alias("n"))
    other = single.join(langs.select("lang", "sources"), "lang").select("lang", "n", "a", F.explode("sources").alias("b")).where("a.source <> b.source")
    lacks = F.array(
        F.struct(F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("n") * (f(p, q0) - f(p0, q0))).alias("value")),
        F.struct(F.col("b.source").alias("source"), F.col("a.source").alias("item"), (F.col("n") * (f(q0, p) - f(q0, p0))).alias("value")),
    )
    one = other.select("lang", F.explode(lacks).alias("x")).select("lang", "x.*")

    all_pairs = langs.select("lang", "terms", F.explode("sources").alias("a"), "sources").select("lang", "terms", "a", F.explode("sources").alias("b")).where("a.source <> b.source")
    none = all_pairs.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.coalesce(F.col("terms") * f(p0, q0), F.lit(0)).alias("value"))
    return none.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def oracle() -> str:
    """The same rows in DuckDB, every term and pair written out."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
n AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
p AS (SELECT lang, source, term, c, 1 + ({SHARE}::HUGEINT * (c + 1)) // (n + v)::HUGEINT AS p FROM counts JOIN n USING (lang, source) JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + ({SHARE}::HUGEINT * (lc + 1)) // (sum(lc) OVER (PARTITION BY lang) + v)::HUGEINT AS q
      FROM (SELECT lang, term, sum(c) AS lc FROM counts GROUP BY lang, term) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
