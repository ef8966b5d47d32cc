"""Source trees as DataFrames: inventory with inspection, classification, ignore rules and a cache."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, facts
from . import sourcetree

TEXT_LIMIT = 8 * 1024 * 1024


def tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path (relative), content, length and modification time of all files under a root, which is no link."""
    local = root.removeprefix("file://")
    if os.path.islink(local.rstrip("/")):
        raise ValueError(f"{root} is a link")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace("path", "^.*?" + prefix.replace(".", r"\.").split("://")[-1].lstrip("/"), "")
    return reader.load(root).select(rel.alias("path"), "content", "length", F.col("modificationTime").alias("modified"))


def scan(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Inspected and classified files: excluded and ignored ones dropped, text of those that are text."""
    kept = classify.ignored(files.where(~classify.is_excluded(F.col("path"))), list(ignore)).where(~F.col("ignored")).drop("ignored")
    seen = facts.inspected(kept)
    text = F.when(~F.col("is_binary") & (F.col("bytes") <= TEXT_LIMIT), facts.decoded(F.col("content")))
    return classify.classified(seen.withColumn("text", text).drop("content"), binary="is_binary")


def cached_scan(files: DataFrame, cache: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Rows of ``cache`` (a former scan) where path, length and time are unchanged; the rest scanned anew."""
    key = ["path", "length", "modified"]  # unchanged files lose their rows here, before their content is inspected
    fresh = scan(files.join(cache.select(key), key, "left_anti"), ignore)
    return cache.join(files.select(key), key, "left_semi").unionByName(fresh, allowMissingColumns=True)


def scan_tree(spark: SparkSession, root: str, cache: DataFrame | None = None, rules: list[str] = (), **options) -> DataFrame:
    """Scan of a folder: what is excluded, ignored or a link is never opened, nor what ``cache`` (a former scan) holds unchanged."""
    if cache is None:
        rows = sourcetree.pruned_tree(spark, root, rules=rules, **options).where("reason is null").select("path", "content", "length", "modified")
        return scan(rows)
    fresh, held = sourcetree.changed_files(spark, root, cache, rules=rules, **options)
    return held.unionByName(scan(fresh.select("path", "content", "length", "modified")), allowMissingColumns=True)
