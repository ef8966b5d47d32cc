"""Snapshots of trees and of evidence, and stored results that a digest of their inputs names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import evidence
from .files import tree


def directory_snapshot(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, object_id, length) of all files under a folder; two of these make a delta."""
    return tree(spark, root, glob).select("path", F.sha2("content", 256).alias("object_id"), "length")


def evidence_digest(facts: DataFrame, key: str = "repo_id") -> DataFrame:
    """Digest of a bundle's facts, in any order: (key, digest).

    Facts are digested one by one; the sorted digests of a bundle, 64 characters each, are its document.
    """
    one = facts.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in facts.columns if c != key))), 256).alias("_d"))
    return one.groupBy(key).agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), "\n"), 256)).alias("digest"))


def evidence_snapshot(spark: SparkSession, base: str, head: str, base_digest: str, head_digest: str) -> tuple[DataFrame, DataFrame]:
    """Facts of two bundles, each one repository whose facts have the digest that is asked for; another one is an error."""
    out = []
    for path, want in ((base, base_digest), (head, head_digest)):
        facts = evidence(spark, path)["facts"]
        got = [r["digest"] for r in evidence_digest(facts).limit(2).collect()]
        if got != [want]:
            raise ValueError(f"{path}: digest {got} is not {want}")
        out.append(facts)
    return out[0], out[1]


def stored(spark: SparkSession, folder: str, digest: str, make) -> DataFrame:
    """The result stored under an input's digest, made and written first where there is none.

    A result counts once its write is committed, so a run that was cut off is made again.
    """
    path = f"{folder.rstrip('/')}/{digest.replace(':', '-')}.parquet"
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
