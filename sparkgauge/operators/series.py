"""Portfolio assembly: contributions, causes, ranges by weight, head groups, reconciliation and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import dec
from ..functions.vocabulary import SHARED
from .change import distribute
from .portfolio import bucket_join, cells_of, largest_remainder

POINTS = ("low", "expected", "high")


def contributions(items: DataFrame, effects: DataFrame, key: list[str], path: str = "path") -> DataFrame:
    """An item's hours in even shares of six digits over its distinct paths in order; the last path takes the rest.

    items: key, low, expected, high; effects: key, path.  Items without a path keep their hours at path null.
    """
    w = Window.partitionBy(*key)
    paths = effects.select(*key, path).distinct().withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(path))})
    rows = items.join(paths, key, "left")
    n = F.coalesce("_n", F.lit(1))

    def share(total: Column) -> Column:
        even = F.round((total / n).cast("decimal(28,10)"), 6).cast("decimal(28,6)")
        return F.when(F.coalesce("_i", F.lit(1)) == n, total - even * (n - 1)).otherwise(even).cast("decimal(28,6)")

    return rows.select(*key, path, *[share(F.col(p)).alias(p) for p in POINTS])


def causes(items: DataFrame, effects: DataFrame, reverted: DataFrame, normalized_shared: DataFrame, key: list[str]) -> DataFrame:
    """Structural causes of a repository's normalization: key, place, kind, weight.

    items: key, item, expected, shared, duplicate_of; effects: key, item, path; reverted: key, path;
    normalized_shared: key, shared (hours after normalization).
    """
    active = items.where("duplicate_of is null")
    duplicate = items.groupBy(*key).agg(F.sum(F.when(F.col("duplicate_of").isNotNull(), F.col("expected"))).alias("weight"))
    duplicate = duplicate.where("weight is not null").withColumn("weight", F.greatest("weight", dec("0.01")))
    touched = effects.join(active.select(*key, "item"), [*key, "item"], "left_semi").groupBy(*key, "path").agg(F.count("*").alias("_n"))
    gone = reverted.select(*key, "path", F.lit(True).alias("_gone")).distinct()
    paths = touched.join(gone, [*key, "path"], "left").groupBy(*key).agg(F.count_if(F.col("_n") > 1).alias("overlap"), F.count_if("_gone").alias("revert"))
    shared = active.groupBy(*key).agg(F.sum("shared").alias("_active")).join(normalized_shared.select(*key, F.col("shared").alias("_kept")), key)
    excess = shared.select(*key, F.greatest(F.col("_active") - F.col("_kept"), dec(0)).alias("weight"))
    kinds = [(0, "exact-duplicate", duplicate), (1, "overlap", paths.withColumnRenamed("overlap", "weight")), (2, "revert", paths.withColumnRenamed("revert", "weight")), (3, "shared-context", excess)]
    out = None
    for place, kind, rows in kinds:
        rows = rows.where("weight > 0").select(*key, F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.col("weight").cast("decimal(18,4)").alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def attributed(deltas: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Each delta (key, low, expected, high) shared over its causes by weight in cents; interaction takes what is left."""
    deltas = deltas.where("low <> 0 or expected <> 0 or high <> 0")
    total = found.groupBy(*key).agg(F.sum("weight").alias("_t"))
    rest = deltas.select(*key).join(total, key, "left").select(
        *key, F.lit(9).alias("place"), F.lit("interaction").alias("kind"), F.when(F.col("_t").isNull(), dec(1)).otherwise(F.greatest(dec(1), (F.col("_t") * dec("0.25")).cast("decimal(18,4)"))).cast("decimal(18,4)").alias("weight")
    )
    rows = found.select(*key, "place", "kind", "weight").unionByName(rest).join(deltas, key)
    for p in POINTS:
        rows = distribute(rows, key, ["place"], "weight", p).drop(p).withColumnRenamed("share", p)
    return rows.drop("place")


def range_allocation(rows: DataFrame, totals: DataFrame, group: list[str], order: str, weight: str = "expected_cents", fallback: str = "high_cents") -> DataFrame:
    """Low and high of a group's total dealt in cents by expected weights; ``ordered``: low <= expected <= high.

    rows: group, order, expected_cents, high_cents; totals: group, low_cents, high_total_cents.  A group
    without expected weight deals its high by the fallback weights, or evenly without these.
    """
    w = Window.partitionBy(*group)
    whole, other = F.sum(weight).over(w), F.sum(fallback).over(w)
    base = F.when(whole > 0, F.col(weight)).otherwise(F.lit(1))
    high = F.when(whole > 0, F.col(weight)).when(other > 0, F.col(fallback)).otherwise(F.lit(1))
    rows = rows.join(totals, group).withColumns({"_wl": base.cast("long"), "_wh": high.cast("long")})
    rows = largest_remainder(rows, group, "_wl", "low_cents", order).withColumnRenamed("cents", "low")
    rows = largest_remainder(rows, group, "_wh", "high_total_cents", order).withColumnRenamed("cents", "high")
    rows = rows.withColumnRenamed(weight, "expected")
    return rows.withColumn("ordered", (F.col("low") <= F.col("expected")) & (F.col("expected") <= F.col("high"))).select(*group, order, "low", "expected", "high", "ordered")


def head_groups(reached: DataFrame, heads: DataFrame, items: DataFrame) -> DataFrame:
    """Items by the sorted set of heads that reach them, single heads without an item included.

    reached: repo, item, head; heads: repo, head; items: repo, item, low, expected, high.
    """
    sets = reached.groupBy("repo", "item").agg(F.array_join(F.array_sort(F.collect_set("head")), "+").alias("head_set"), F.countDistinct("head").alias("_n"))
    sums = items.join(sets, ["repo", "item"]).groupBy("repo", "head_set").agg(F.max("_n").alias("_n"), F.count("*").alias("items"), *[F.sum(p).alias(p) for p in POINTS])
    alone = heads.select("repo", F.col("head").alias("head_set")).distinct()
    rows = sums.join(alone.withColumn("_alone", F.lit(True)), ["repo", "head_set"], "full_outer")
    return rows.select("repo", "head_set", F.when(F.coalesce("_n", F.lit(1)) == 1, "single-head").otherwise("shared-heads").alias("kind"), F.coalesce("items", F.lit(0)).alias("items"), *[F.coalesce(p, dec(0)).alias(p) for p in POINTS])


def reconciled(groups: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """Repositories' normalized effort against what was allotted to their items: sums, and whether they agree.

    groups: key, expected; items: key, item, allocated.  A repository without items has none allotted.
    """
    own = items.groupBy(*key).agg(F.count("*").alias("items"), F.sum("allocated").alias("allocated"))
    rows = groups.join(own, key, "left").withColumns({"items": F.coalesce("items", F.lit(0)), "allocated": F.coalesce("allocated", dec(0))})
    return rows.withColumn("agrees", F.col("allocated") == F.col("expected"))


def today_bucket(rows: DataFrame, ts: str, as_of: Column, zone: str) -> DataFrame:
    """Rows of the local day that holds ``as_of``, up to it: their bucket's id and ends in UTC.

    ``ts`` and ``as_of`` are UTC; the bucket begins at local midnight and is partial at its end.
    """
    local = F.from_utc_timestamp(as_of.cast("timestamp"), zone)
    midnight = F.date_trunc("day", local)
    since = F.to_utc_timestamp(midnight, zone)
    until = F.to_utc_timestamp(midnight + F.expr("interval 1 day"), zone)
    at = F.col(ts).cast("timestamp")
    inside = rows.where((at >= since) & (at < F.least(until, as_of.cast("timestamp"))))
    return inside.withColumns({"bucket": F.concat(F.lit("today-"), F.date_format(local, "yyyy-MM-dd")), "since": since.cast("timestamp_ntz"), "until": until.cast("timestamp_ntz"), "partial_end": F.lit(True)})


def additive_series(items: DataFrame, buckets: DataFrame, allocations: DataFrame, ts: str = "ts") -> DataFrame:
    """Each group's normalized effort dealt over the buckets of its items: group, bucket, items, low, expected, high (cents).

    items: group, ts, expected_cents, high_cents; buckets: bucket, since, until; allocations: group, low_cents,
    high_total_cents.  Buckets without items appear with zeros.
    """
    held = bucket_join(items, buckets, ts).groupBy("group", "bucket").agg(F.count("*").alias("items"), F.sum("expected_cents").alias("expected_cents"), F.sum("high_cents").alias("high_cents"))
    grid = cells_of(allocations.select("group"), buckets.select("bucket"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    cells = grid.join(held, ["group", "bucket"], "left").select("group", "bucket", zero("items"), zero("expected_cents"), zero("high_cents"))
    dealt = range_allocation(cells, allocations, ["group"], "bucket")
    return dealt.join(cells.select("group", "bucket", "items"), ["group", "bucket"])


def portfolio_series(additive: DataFrame, totals: DataFrame) -> DataFrame:
    """The additive series summed by bucket, and whether all of them reconcile to the portfolio's expected total.

    totals: one row, ``expected`` in cents.
    """
    points = additive.groupBy("bucket").agg(F.sum("items").alias("items"), *[F.sum(p).alias(p) for p in POINTS])
    check = additive.agg(F.sum("expected").alias("_all")).crossJoin(totals.select(F.col("expected").alias("_want")))
    return points.crossJoin(F.broadcast(check)).withColumn("reconciles", F.col("_all") == F.col("_want")).drop("_all", "_want")  # one row


def isolated_series(matches: DataFrame, buckets: DataFrame, contributors: DataFrame, ts: str = "ts") -> DataFrame:
    """Isolated effort by contributor and bucket, zero cells included; not additive, shared items count for each.

    matches: contributor, item, ts, low, expected, high.
    """
    sums = bucket_join(matches, buckets, ts).groupBy("contributor", "bucket").agg(F.count("*").alias("items"), *[F.sum(p).alias(p) for p in POINTS])
    grid = cells_of(contributors.select("contributor").distinct(), buckets.select("bucket"))
    rows = grid.join(sums, ["contributor", "bucket"], "left")
    return rows.select("contributor", "bucket", F.coalesce("items", F.lit(0)).alias("items"), *[F.coalesce(p, dec(0)).alias(p) for p in POINTS])


def incomplete_report(requested: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """Status of each requested part of a comparison, and whether all of it may be shown as complete.

    requested: key; finished: key, error (null for success).  What is not there was not run.
    """
    rows = requested.join(finished.withColumn("_ran", F.lit(True)), key, "left")
    status = F.when(F.col("_ran").isNull(), "not-run").when(F.col("error").isNotNull(), "failed").otherwise("complete")
    rows = rows.withColumn("status", status).drop("_ran")
    whole = rows.agg(F.bool_and(F.col("status") == "complete").alias("complete"))
    return rows.crossJoin(F.broadcast(whole))  # one row


def semantic_digest(rows: DataFrame, group: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """SHA-256 over a report's rows as ordered JSON of the fields that carry meaning, timings left out.

    A report is small by nature; each group's rows are one document.
    """
    entry = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*fields)).alias("_json"))
    document = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_json"]), "\n")
    return rows.groupBy(*group).agg(F.concat(F.lit("sha256:"), F.sha2(document, 256)).alias("digest"))


def is_shared(category: Column) -> Column:
    return category.isin(*SHARED)
