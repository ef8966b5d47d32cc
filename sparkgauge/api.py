"""The engine's verbs as functions of DataFrames: scan, estimate, change, report, explain, review, calibration, schema, model, rate, version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import capabilities, change as changes, evaluation, pricing, reports
from .sources import documents, files

#: Version of the engine and of its default model.
VERSION = "0.2.0"


def scan(spark: SparkSession, root: str, ignore: list[str] = (), cache: DataFrame | None = None) -> DataFrame:
    """Inspected and classified files under ``root``; unchanged ones come from ``cache``, a former scan.

    A folder is walked by the pruning source, with its own rule files; other stores are listed by Spark.
    """
    if "://" not in root or root.startswith("file://"):
        return files.scan_tree(spark, root.removeprefix("file://"), cache, list(ignore))
    found = files.tree(spark, root)
    return files.scan(found, list(ignore)) if cache is None else files.cached_scan(found, cache, list(ignore))


def estimate(facts: DataFrame, model=None, rate=None) -> dict[str, DataFrame]:
    """``items``, ``gap`` (not in the totals) and ``totals`` of evidence facts."""
    out = capabilities.estimate(facts, model)
    return out | {"totals": capabilities.totals(out["items"], rate)}


def change(base: DataFrame, head: DataFrame, key: str = "path", object_id: str = "object_id") -> DataFrame:
    """Changed paths of two snapshots with their class."""
    return changes.path_classes(changes.snapshot_delta(base, head, key, object_id), base, key, object_id)


def explain(items: DataFrame, facts: DataFrame, item: str = "item_id", evidence: str = "evidence_ids", fact_id: str = "id") -> DataFrame:
    """Evidence of items with the facts behind it."""
    return reports.explained(items, facts, item, evidence, fact_id)


def review(items: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The largest and the least certain items of each group, for a reviewer."""
    return reports.review_queue(items, group or ["repo"], "item_id", "expected", "confidence")


def rate(wages: DataFrame, wage: str = "wage") -> DataFrame:
    """Hourly rates from wages."""
    return wages.withColumn("hourly_rate", pricing.hourly_rate(F.col(wage)))


def report(items: DataFrame, view: str = "category", form: str = "markdown", rate=None) -> str:
    """A view of an estimate as Markdown or as canonical JSON."""
    document = reports.estimate_view(items, view, rate)
    return reports.view_markdown(document) if form == "markdown" else reports.canonical_json(document)


def calibration(targets: DataFrame, references: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """``metrics`` by level and slice, and ``matches`` by record, of estimated items against reviewed targets."""
    return {"metrics": evaluation.level_metrics(evaluation.observations(targets, references, items)), "matches": evaluation.match_rates(targets, references, items)}


def schema(name: str) -> str:
    """DDL of a document that the engine reads: evidence, rate-card, buckets or capacity."""
    return {"evidence": documents.EVIDENCE, "rate-card": documents.RATE_CARD, "buckets": documents.BUCKETS, "capacity": documents.CAPACITY}[name]


def model(spark: SparkSession) -> dict[str, DataFrame]:
    """Rules, tiers and drivers of the default model, for a user to change and pass to ``estimate``."""
    rules, tiers = capabilities.default_model(spark)
    return {"rules": rules, "tiers": tiers, "drivers": capabilities.driver_table(spark)}


def version() -> str:
    return VERSION
