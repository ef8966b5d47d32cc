"""Evidence documents, manifests and rate cards: JSON with closed schemas, checked on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCATION = "struct<path:string,line:int,symbol:string>"
FACT = f"struct<id:string,kind:string,scope:string,summary:string,provenance:struct<sourceKind:string,analyzer:string,analyzerVersion:string,method:string>,locations:array<{LOCATION}>,measurements:array<struct<name:string,value:decimal(38,10),unit:string>>,tags:array<string>>"
DIAGNOSTIC = f"struct<code:string,severity:string,message:string,evidenceIds:array<string>,locations:array<{LOCATION}>>"
EVIDENCE = f"schemaVersion string, repository struct<name:string,scope:string,ecosystems:array<string>,sourceDigest:string>, facts array<{FACT}>, diagnostics array<{DIAGNOSTIC}>"
RATE_CARD = "id string, version string, currency string, effectiveDate date, hourlyRate decimal(18,2), formula struct<totalCompensationPerHour:decimal(18,2),wagesAndSalariesPerHour:decimal(18,2),billableUtilization:decimal(9,4),roundingIncrement:decimal(9,2)>"
BUCKETS = "id string, label string, sinceInclusive timestamp, untilExclusive timestamp"
CAPACITY = "bucketId string, contributorId string, hours decimal(18,2)"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a closed schema; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def evidence(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """repository, facts and diagnostics of evidence bundles, keyed by the repository's digest."""
    docs = read_json(spark, path, EVIDENCE).withColumn("repo_id", F.col("repository.sourceDigest"))
    return {
        "repository": docs.select("repo_id", "repository.*"),
        "facts": docs.select("repo_id", F.explode("facts").alias("f")).select("repo_id", "f.*"),
        "diagnostics": docs.select("repo_id", F.explode("diagnostics").alias("d")).select("repo_id", "d.*"),
    }


def duplicate_ids(facts: DataFrame) -> DataFrame:
    """Fact ids that a bundle holds twice; a sound bundle has none."""
    return facts.groupBy("repo_id", "id").count().where("count > 1")


def rate_card(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RATE_CARD)


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as Parquet by repository, the form that later runs prune by."""
    facts.write.mode("overwrite").partitionBy("repo_id").parquet(path)


def buckets(spark: SparkSession, path: str) -> DataFrame:
    """Bucket manifest: bucket, label, since, until, each once and none that ends before it begins."""
    rows = read_json(spark, path, f"buckets array<struct<{_fields(BUCKETS)}>>").select(F.inline("buckets"))
    rows = rows.select(F.col("id").alias("bucket"), "label", F.col("sinceInclusive").cast("timestamp_ntz").alias("since"), F.col("untilExclusive").cast("timestamp_ntz").alias("until"))
    return _sound(rows, rows.groupBy("bucket").count().where("count > 1").select("bucket").unionByName(rows.where("until <= since").select("bucket")), "buckets")


def capacity(spark: SparkSession, path: str) -> DataFrame:
    """Capacity manifest: bucket, contributor, hours, one cell each and no negative hours."""
    rows = read_json(spark, path, f"entries array<struct<{_fields(CAPACITY)}>>").select(F.inline("entries"))
    rows = rows.select(F.col("bucketId").alias("bucket"), F.col("contributorId").alias("contributor"), "hours")
    return _sound(rows, rows.groupBy("bucket", "contributor").count().where("count > 1").select("bucket").unionByName(rows.where("hours < 0").select("bucket")), "capacity")


# Forms and limits of the manifests.
SELECTION = "sinceInclusive:timestamp,untilExclusive:timestamp,timeZone:string,dateField:string,mergePolicy:string,coauthorPolicy:string,intervalSemantics:string"
AUTHOR_PERIOD = f"selection struct<{SELECTION}>, contributors array<struct<id:string,aliases:array<string>>>, repositories array<struct<id:string,repositoryPath:string,heads:array<struct<id:string,objectId:string>>>>"
PORTFOLIO = "items array<struct<id:string,repositoryId:string,repositoryPath:string,pullRequest:string,gitHubRepository:string>>"
INTERVAL = "since-inclusive-until-exclusive"
POLICIES = {"dateField": ("author", "committer"), "mergePolicy": ("exclude", "first-parent"), "coauthorPolicy": ("include", "exclude")}
MOST_CONTRIBUTORS, MOST_ALIASES_EACH, MOST_ALIASES, MOST_REPOSITORIES, MOST_HEADS_EACH, MOST_HEADS = 64, 16, 128, 256, 32, 512


def author_period(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """selection (one row), contributors (contributor, alias) and heads (repo, path, head, object_id) of an author-period manifest.

    Ids and, in any case, aliases are each once; counts are within the limits above, so the manifest is small.
    """
    doc = read_json(spark, path, AUTHOR_PERIOD)
    one = doc.collect()
    if len(one) != 1 or one[0].selection is None:
        raise ValueError("author period: one manifest with a selection is needed")
    chosen, people, places = one[0].selection, one[0].contributors or [], one[0].repositories or []
    faults = []
    if chosen.sinceInclusive is None or chosen.untilExclusive is None or chosen.sinceInclusive >= chosen.untilExclusive:
        faults.append("the period ends before it begins")
    faults += [f"{name}: {getattr(chosen, name)}" for name, known in POLICIES.items() if getattr(chosen, name) not in known]
    if chosen.intervalSemantics not in (None, INTERVAL):
        faults.append(f"intervalSemantics: {chosen.intervalSemantics}")
    if not chosen.timeZone or chosen.timeZone != chosen.timeZone.strip():
        faults.append("timeZone")
    aliases = [a for p in people for a in p.aliases or []]
    heads = [(r.id, h.id) for r in places for h in r.heads or []]
    repeated = lambda xs: sorted({str(x) for x in xs if xs.count(x) > 1})
    for name, xs in (("contributor", [p.id for p in people]), ("alias", [(a or "").lower() for a in aliases]), ("repository", [r.id for r in places]), ("head", heads)):
        faults += [f"{name} {x} is given twice" for x in repeated(xs)]
    faults += [f"{name}: {n} of at most {most}" for name, n, most in (("contributors", len(people), MOST_CONTRIBUTORS), ("aliases", len(aliases), MOST_ALIASES), ("repositories", len(places), MOST_REPOSITORIES), ("heads", len(heads), MOST_HEADS)) if not 1 <= n <= most]
    faults += [f"aliases of {p.id}" for p in people if not 1 <= len(p.aliases or []) <= MOST_ALIASES_EACH] + [f"heads of {r.id}" for r in places if not 1 <= len(r.heads or []) <= MOST_HEADS_EACH]
    if faults:
        raise ValueError("author period: " + "; ".join(faults))
    contributors = doc.select(F.explode("contributors").alias("c")).select(F.col("c.id").alias("contributor"), F.explode("c.aliases").alias("alias"))
    tips = doc.select(F.explode("repositories").alias("r")).select(F.col("r.id").alias("repo"), F.col("r.repositoryPath").alias("path"), F.explode("r.heads").alias("h"))
    return {"selection": doc.select("selection.*"), "contributors": contributors, "heads": tips.select("repo", "path", F.col("h.id").alias("head"), F.col("h.objectId").alias("object_id"))}


def portfolio_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a portfolio manifest, each id once and no required text empty: id, repositoryId, repositoryPath, pullRequest, gitHubRepository."""
    rows = read_json(spark, path, PORTFOLIO).select(F.inline("items"))
    empty = F.exists(F.array("id", "repositoryId", "repositoryPath", "pullRequest"), lambda x: F.coalesce(F.trim(x), F.lit("")) == "") | (F.trim("gitHubRepository") == "")
    wrong = rows.where(empty).select("id").unionByName(rows.groupBy("id").count().where("count > 1").select("id"))
    if rows.isEmpty():
        raise ValueError("portfolio: no items")
    return _sound(rows, wrong, "portfolio")


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (c.split(" ", 1) for c in ddl.split(", ")))


def _sound(rows: DataFrame, wrong: DataFrame, name: str) -> DataFrame:
    bad = [r[0] for r in wrong.limit(5).collect()]
    if bad:
        raise ValueError(f"{name}: {bad}")
    return rows
