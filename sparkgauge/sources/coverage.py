"""Coverage reports: LCOV and Cobertura, merged by source and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = (("lines", "LF", "LH", "DA"), ("branches", "BRF", "BRH", "BRDA"), ("functions", "FNF", "FNH", "FNDA"))


def _number(x: Column) -> Column:
    """A count that is not negative, or 0."""
    value = F.try_to_number(F.regexp_extract(x, r"^(\d{1,17})$", 1), F.lit("99999999999999999"))
    return F.coalesce(value.cast("long"), F.lit(0).cast("long"))


def lcov(reports: DataFrame, text: str = "text") -> DataFrame:
    """Per source: found and hit lines, branches and functions.

    A record's own summary outranks its details; records of one source add up.
    """
    records = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(?m)^end_of_record\s*$")
    rows = reports.select(F.explode(records).alias("r")).withColumn("source", F.trim(F.regexp_extract("r", r"(?m)^SF:(.*)$", 1))).where("source <> ''")
    out = {}
    for name, found, hit, detail in PAIRS:
        at = 1 if detail == "FNDA" else None
        details = F.regexp_extract_all("r", F.lit(rf"(?m)^{detail}:(.*)$"), 1)
        value = (lambda d: F.get(F.split(d, ","), 0)) if at else (lambda d, n=(3 if detail == "BRDA" else 1): F.get(F.split(d, ","), n))
        hits = F.size(F.filter(details, lambda d: _number(value(d)) > 0))
        total = F.regexp_extract("r", rf"(?m)^{found}:(\d+)\s*$", 1)
        got = F.regexp_extract("r", rf"(?m)^{hit}:(\d+)\s*$", 1)
        out[f"{name}_found"] = F.when(total != "", total.cast("long")).otherwise(F.size(details).cast("long"))
        out[f"{name}_hit"] = F.when(got != "", got.cast("long")).otherwise(hits.cast("long"))
    return rows.withColumns(out).groupBy("source").agg(*[F.sum(c).alias(c) for c in out])


COBERTURA = "packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, lines: struct<line: array<struct<_number: long, _hits: long, `_condition-coverage`: string>>>>>>>>>"


def cobertura(reports: DataFrame, text: str = "text") -> DataFrame:
    """Per source: found and hit lines and branches of XML reports; a line that is named again counts once, with its best."""
    doc = F.from_xml(F.col(text), COBERTURA)
    rows = reports.select(F.explode(doc["packages"]["package"]).alias("p")).select(F.explode("p.classes.class").alias("c"))
    lines = rows.select(F.col("c._filename").alias("source"), F.explode("c.lines.line").alias("l"))
    of = lambda part: F.coalesce(F.regexp_extract(F.col("l.`_condition-coverage`"), r"\((\d+)/(\d+)\)", part).try_cast("long"), F.lit(0))
    one = lines.groupBy("source", F.col("l._number").alias("n")).agg(F.max("l._hits").alias("hits"), F.max(of(1)).alias("taken"), F.max(of(2)).alias("ways"))
    return one.groupBy("source").agg(
        F.count("*").alias("lines_found"), F.count_if(F.col("hits") > 0).alias("lines_hit"), F.sum("ways").alias("branches_found"), F.sum("taken").alias("branches_hit")
    )


def by_scope(coverage: DataFrame, scopes: DataFrame) -> DataFrame:
    """Percent covered of each scope; ``scopes`` has source and scope."""
    found, hit = F.sum("lines_found"), F.sum("lines_hit")
    return coverage.join(scopes, "source").groupBy("scope").agg(found.alias("found"), hit.alias("hit"), F.round(100 * hit / F.nullif(found, F.lit(0)), 2).alias("percent"))
