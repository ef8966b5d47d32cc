"""Commit logs: parsing, co-authors, identities and the author-period filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import _cut

FIELDS = ("object_id", "parents", "author_name", "author_email", "author_ts", "committer_ts", "message")


def parsed(log: DataFrame, text: str = "text") -> DataFrame:
    """Records of FIELDS, parted by NUL within and by the record separator between."""
    rows = log.select(F.explode(F.split(F.col(text), "\x1e")).alias("r")).where("trim(r) <> ''")
    cells = F.split("r", "\x00", -1)
    out = {n: F.trim(F.get(cells, i)) for i, n in enumerate(FIELDS)}
    out["parents"] = F.filter(F.split(out["parents"], " "), lambda p: p != "")
    out["author_ts"], out["committer_ts"] = (F.timestamp_seconds(out[n].cast("long")) for n in ("author_ts", "committer_ts"))
    trailer = F.regexp_extract_all(out["message"], F.lit(r"(?im)^co-authored-by:\s*(.+?)\s*$"), 1)
    person = lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^<]*)", 1)).alias("name"), F.regexp_extract(s, r"<([^>]*)>", 1).alias("email"))
    return rows.select(*[c.alias(n) for n, c in out.items()], F.transform(trailer, person).alias("coauthors"))


def identities(name: Column, email: Column) -> Column:
    """The spellings by which a person may be listed, in lower case."""
    return F.transform(F.array(name, email, F.concat(name, F.lit(" <"), email, F.lit(">"))), F.lower)


def selected(commits: DataFrame, contributors: DataFrame, since, until, coauthors: bool = True, merges: str = "exclude", date_field: str = "author_ts") -> DataFrame:
    """Commits of listed people in [since, until): object_id, contributor.

    contributors: (contributor, alias).  ``merges``: exclude, or first-parent to keep them.
    """
    rows = commits.where((F.col(date_field) >= F.lit(since)) & (F.col(date_field) < F.lit(until)))
    if merges == "exclude":
        rows = rows.where(F.size("parents") <= 1)
    people = identities(F.col("author_name"), F.col("author_email"))
    if coauthors:
        people = F.concat(people, F.flatten(F.transform("coauthors", lambda c: identities(c["name"], c["email"]))))
    said = rows.select("object_id", F.explode(F.array_distinct(people)).alias("alias"))
    known = contributors.select("contributor", F.lower("alias").alias("alias"))
    return said.join(known, "alias").select("object_id", "contributor").distinct()


# Why the credit of a commit may be shared.
COAUTHORED, MERGED, INTERLEAVED, SHARED = "coauthored", "merge-by-first-parent", "previous-is-no-parent", "many-contributors"


def author_period(commits: DataFrame, contributors: DataFrame, since, until, coauthors: bool = True, merges: str = "exclude", date_field: str = "author_ts") -> DataFrame:
    """Selected commits of each repository, with who matches them how and what leaves their credit open.

    commits: repo and what ``parsed`` gives.  Gives repo, object_id, ts, kind (direct-author, else coauthor), matches (contributor and kind, in
    order), ambiguity (array) and excluded: matching merges that the policy leaves out are rows with ``excluded`` true and
    take no part in the order.  Commits go by time and id; a repository may hold most of them, so they are ranged and only a range's last is
    passed on.  A null repo matches nothing.
    """
    rows = commits.where((F.col(date_field) >= F.lit(since)) & (F.col(date_field) < F.lit(until)))
    rows = rows.select("repo", "object_id", "parents", F.col(date_field).alias("ts"), identities(F.col("author_name"), F.col("author_email")).alias("_own"), F.flatten(F.transform("coauthors", lambda c: identities(c["name"], c["email"]))).alias("_with"), F.size("coauthors").alias("_co"))
    said = F.array_distinct(F.concat("_own", "_with") if coauthors else F.col("_own"))
    known = contributors.select("contributor", F.lower("alias").alias("alias")).distinct()
    found = rows.select("repo", "object_id", "_own", F.explode(said).alias("alias")).join(known, "alias")
    ways = found.groupBy("repo", "object_id", "contributor").agg(F.max(F.array_contains("_own", F.col("alias"))).alias("_direct"))
    way = F.when(F.col("_direct"), "direct-author").otherwise("coauthor")
    matches = ways.groupBy("repo", "object_id").agg(F.array_sort(F.collect_list(F.struct("contributor", way.alias("kind")))).alias("matches"), F.max("_direct").alias("_direct"))
    met = rows.drop("_own", "_with").join(matches, ["repo", "object_id"]).withColumn("excluded", (F.size("parents") > 1) & F.lit(merges == "exclude"))

    order = ["repo", "excluded", "ts", "object_id"]
    parts = int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _cut(met.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    last = ranged.groupBy("repo", "excluded", "_part").agg(F.max_by("object_id", F.struct("ts", "object_id")).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy("repo", "excluded").orderBy("_part")))  # one row a range of a repository
    w = Window.partitionBy("repo", "excluded", "_part").orderBy("ts", "object_id")
    before = F.coalesce(F.lag("object_id").over(w), F.col("_last"))
    why = [
        F.when(F.col("_co") > 0, COAUTHORED),
        F.when(F.size("parents") > 1, MERGED),
        F.when(F.col("_before").isNotNull() & ~F.array_contains("parents", F.col("_before")), INTERLEAVED),
        F.when(F.size("matches") > 1, SHARED),
    ]
    out = ranged.join(last, ["repo", "excluded", "_part"]).withColumn("_before", before)
    return out.select("repo", "object_id", "ts", F.when(F.col("_direct"), "direct-author").otherwise("coauthor").alias("kind"), "matches", F.when(F.col("excluded"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*why))).alias("ambiguity"), "excluded")
