"""Portfolio operators: duplicates, reverts, components, normalization, allocation, buckets and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rounding import dec, ratio
from .stats import dealt


def duplicate_keeper(items: DataFrame, digest: str, order: list[Column]) -> DataFrame:
    """``kept``: whether a row is the first of its digest in the order; rows without a digest are kept.

    The order's columns name a row, so the first of each digest is found by a grouped minimum, combined
    before its shuffle, and joined back; descending columns must be numbers.
    """
    place = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    rows = items.withColumn("_place", place)
    first = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min("_place").alias("_first"))
    kept = F.col(digest).isNull() | (F.col("_place") == F.col("_first"))
    return rows.join(first, digest, "left").withColumn("kept", kept).drop("_place", "_first")


def exact_reverts(steps: DataFrame, chain: list[str], order: list[str], base: str, head: str) -> DataFrame:
    """Per chain: steps, whether each begins where the one before ended, and whether all return to the start."""
    w = Window.partitionBy(*chain).orderBy(*order)
    linked = steps.withColumn("_joined", F.coalesce(F.lag(head).over(w) == F.col(base), F.lit(True)))
    at = F.struct(*order)
    return linked.groupBy(*chain).agg(
        F.count("*").alias("steps"),
        F.bool_and("_joined").alias("continuous"),
        (F.bool_and("_joined") & (F.min_by(base, at) == F.max_by(head, at)) & (F.count("*") > 1)).alias("reverted"),
    )


def opposing_effects(steps: DataFrame, id_col: str, path: str, base: str, head: str) -> DataFrame:
    """Steps that swap the ends of an earlier one of their path, each with the first that it undoes.

    The first step of each path and direction is a grouped minimum; a step meets that of the other
    direction only, so no pairs of a path's steps are listed.
    """
    first = steps.groupBy(path, F.col(base).alias("_y"), F.col(head).alias("_x")).agg(F.min(id_col).alias("undone"))
    rows = steps.where(F.col(base) != F.col(head)).select(path, F.col(id_col).alias("undoing"), F.col(base).alias("_x"), F.col(head).alias("_y"))
    return rows.join(first, [path, "_x", "_y"]).where("undone < undoing").select(path, "undone", "undoing")


def max_merge(contributions: DataFrame, shared: list[str], unit: list[str], hours: str) -> DataFrame:
    """Per ``shared`` key: the sum over units of the largest contribution (overlap counts once)."""
    return contributions.groupBy(*shared, *unit).agg(F.max(hours).alias("_top")).groupBy(*shared).agg(F.sum("_top").alias("normalized"))


def winner_weights(rows: DataFrame, group: list[str], hours: str) -> DataFrame:
    """Weight of each row: winners of the group share one equally, others get nothing."""
    w = Window.partitionBy(*group)
    best = F.col(hours) == F.max(hours).over(w)
    return rows.withColumn("weight", F.when(best, 1.0 / F.sum(best.cast("int")).over(w)).otherwise(F.lit(0.0)))


def largest_remainder(rows: DataFrame, group: list[str], weight: str, total_cents: str, order: str) -> DataFrame:
    """``cents``: whole cents of the group's total by weight; what flooring leaves goes by remainder, then ``order``."""
    w = Window.partitionBy(*group)
    units = F.col(weight).cast("decimal(20,0)") * F.col(total_cents).cast("decimal(18,0)")
    whole = F.sum(F.col(weight).cast("decimal(20,0)")).over(w)
    rows = rows.withColumns({"_units": units.cast("decimal(38,0)"), "_whole": whole.cast("decimal(38,0)")})
    rows = rows.withColumns({"_floor": F.expr("cast(_units div _whole as long)"), "_rest": F.expr("_units % _whole")})
    left = F.col(total_cents) - F.sum("_floor").over(w)
    turn = F.row_number().over(w.orderBy(F.desc("_rest"), order))
    return rows.withColumn("cents", F.col("_floor") + F.when(turn <= left, 1).otherwise(0)).drop("_units", "_whole", "_floor", "_rest")


def match_sets(rows: DataFrame, subject: str, member: str) -> DataFrame:
    """Subjects grouped by their sorted set of members: match_set, kind (single or shared), subjects."""
    sets = rows.groupBy(subject).agg(F.array_join(F.array_sort(F.collect_set(member)), "+").alias("match_set"), F.countDistinct(member).alias("_n"))
    return sets.groupBy("match_set").agg(F.when(F.max("_n") == 1, "single").otherwise("shared").alias("kind"), F.count("*").alias("subjects"))


def calendar_buckets(rows: DataFrame, ts: str, unit: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows with the half-open month or Monday-week bucket that holds them, cut to [since, until)."""
    start = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    step = F.expr("interval 1 month" if unit == "month" else "interval 7 day")
    end = start + step
    if since:
        rows = rows.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        rows = rows.where(F.col(ts) < F.lit(until).cast("timestamp_ntz"))
    low = F.greatest(start, F.lit(since).cast("timestamp_ntz")) if since else start
    high = F.least(end, F.lit(until).cast("timestamp_ntz")) if until else end
    return rows.withColumns({"since": low, "until": high, "partial": (low > start) | (high < end)})


def to_instant(local: Column, zone: str) -> Column:
    """The UTC instant (without zone) of a local time; of two instants the later, and an error if there is none."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    back = lambda x: F.convert_timezone(F.lit("UTC"), F.lit(zone), x)
    out = utc
    for minutes in (30, 60, 120):  # clocks that are set back show a time twice
        later = utc + F.expr(f"interval {minutes} minute")
        out = F.when(back(later) == local, later).otherwise(out)
    message = F.concat(F.lit(f"no such local time in {zone}: "), local.cast("string"))
    return F.when(back(utc) != local, F.raise_error(message).cast("timestamp_ntz")).otherwise(out)


def calendar_partition(spark: SparkSession, since: str, until: str, unit: str, zone: str) -> DataFrame:
    """The months or Monday weeks of a zone that cover [since, until), both in UTC: bucket, label, since, until, partial_start, partial_end.

    A boundary that the zone's clocks skip is an error, since no bucket could begin there.
    """
    step = "interval 1 month" if unit == "month" else "interval 7 day"
    low, high = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    local = lambda x: F.date_trunc(unit, F.convert_timezone(F.lit("UTC"), F.lit(zone), x)).cast("timestamp_ntz")
    starts = spark.range(1).select(F.explode(F.sequence(local(low), local(high), F.expr(step))).alias("_start"))  # as many rows as the period has buckets
    rows = starts.select("_start", to_instant(F.col("_start"), zone).alias("_from"), to_instant((F.col("_start") + F.expr(step)).cast("timestamp_ntz"), zone).alias("_to")).where((F.col("_from") < high) & (F.col("_to") > low))
    day = F.date_format("_start", "yyyy-MM-dd")
    name = F.date_format("_start", "yyyy-MM") if unit == "month" else F.concat(F.lit("week-"), day)
    label = F.date_format("_start", "MMMM yyyy") if unit == "month" else F.concat(F.lit("Week of "), day)
    return rows.select(
        name.alias("bucket"), label.alias("label"), F.greatest("_from", low).alias("since"), F.least("_to", high).alias("until"), (F.col("_from") < low).alias("partial_start"), (F.col("_to") > high).alias("partial_end")
    )


def partition_faults(buckets: DataFrame, since: Column, until: Column) -> DataFrame:
    """What keeps buckets from being a partition of [since, until): gaps and overlaps, a start or an end elsewhere."""
    order = F.struct("since", *[c for c in buckets.columns if c not in ("since", "until")], "until")
    ends = buckets.agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    row = lambda c: [F.col(f"{c}.{x}").alias(x) for x in buckets.columns]
    start = ends.where(F.col("_first.since") != since).select(*row("_first"), F.lit("start").alias("problem"))
    end = ends.where(F.col("_last.until") != until).select(*row("_last"), F.lit("end").alias("problem"))
    return gap_check(buckets).withColumn("problem", F.lit("gap")).unionByName(start).unionByName(end)


def cells_of(rows: DataFrame, columns: DataFrame, most: int = 10_000) -> DataFrame:
    """Every cell of a matrix that is asked for whole; the columns are broadcast only if a count shows that they are few."""
    return rows.crossJoin(F.broadcast(columns) if columns.limit(most + 1).count() <= most else columns)


def bucket_join(rows: DataFrame, buckets: DataFrame, ts: str, most: int = 10_000) -> DataFrame:
    """Interval join: each row with the half-open bucket that holds its time; rows of no bucket go.

    Buckets are a short list; its length is checked before it is broadcast, and a longer
    list is joined by day instead.
    """
    on = (F.col(ts) >= F.col("since")) & (F.col(ts) < F.col("until"))
    if buckets.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(buckets), on)
    last = F.col("until") - F.expr("interval 1 microsecond")
    by_day = buckets.withColumn("_day", F.explode(F.sequence(F.to_date("since"), F.to_date(last), F.expr("interval 1 day"))))
    return rows.withColumn("_day", F.to_date(ts)).join(by_day, "_day").where(on).drop("_day")


def gap_check(buckets: DataFrame) -> DataFrame:
    """Buckets that do not begin where the one before ended, or end before they begin."""
    order = ["since", *[c for c in buckets.columns if c not in ("since", "until")], "until"]
    ranged = dealt(buckets, F.col("since").cast("timestamp"))
    w = Window.partitionBy("_part").orderBy(*order)
    # of a range only the last row is passed on
    last = ranged.groupBy("_part").agg(F.max_by("until", F.struct(*order)).alias("_last"))
    last = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))  # one row a range
    rows = ranged.withColumn("_before", F.lag("until").over(w)).withColumn("_first", F.row_number().over(w) == 1).join(F.broadcast(last), "_part")
    before = F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_before"))
    return rows.where((before != F.col("since")) | (F.col("until") <= F.col("since"))).select(*buckets.columns)


def trend(points: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """Least squares over the bucket index: points, slope, r2 (1 without variance), change from first to last."""
    w = Window.partitionBy(*series).orderBy(order)
    at = points.withColumn("_x", (F.row_number().over(w) - 1).cast("double")).withColumn("_y", F.col(value).cast("double"))
    first, last = F.min_by("_y", "_x"), F.max_by("_y", "_x")
    return at.groupBy(*series).agg(
        F.count("*").alias("points"),
        F.round(F.regr_slope("_y", "_x"), 8).alias("slope"),
        F.round(F.regr_r2("_y", "_x"), 8).alias("r2"),
        F.round((last - first) / F.nullif(first, F.lit(0.0)), 6).alias("change"),
    )


def rolling_ratio(points: DataFrame, series: list[str], order: str, value: str, capacity: str, width: int = 3) -> DataFrame:
    """Capacity-weighted ratio of the trailing buckets, full windows only."""
    w = Window.partitionBy(*series).orderBy(order).rowsBetween(1 - width, 0)
    full = F.count("*").over(w) == width
    return points.withColumn("rolling", F.when(full, ratio(F.sum(value).over(w), F.sum(capacity).over(w), 6)))


def matrix_gaps(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells that a complete matrix lacks (missing) and cells outside it (unexpected)."""
    full = cells_of(rows.distinct(), columns.distinct())
    names = full.columns
    return full.exceptAll(cells.select(names).distinct()).withColumn("problem", F.lit("missing")).unionByName(cells.select(names).distinct().exceptAll(full).withColumn("problem", F.lit("unexpected")))


def tolerance(isolated: Column, normalized: Column) -> Column:
    """Does the difference stay within the larger of one hour and a tenth?"""
    return F.abs(isolated - normalized) <= F.greatest(dec(1), isolated * dec("0.1"))


def contributor_summary(rows: DataFrame, contributor: str, kind: str) -> DataFrame:
    """Items of each contributor by kind, zero rows included, and their share of the contributor's."""
    g = rows.groupBy(contributor, kind).agg(F.count("*").alias("_n"))
    total = g.groupBy(contributor).agg(F.sum("_n").alias("_total"))
    grid = cells_of(total, g.select(kind).distinct())
    items = F.coalesce("_n", F.lit(0)).cast("long")
    return grid.join(g, [contributor, kind], "left").select(contributor, kind, items.alias("items"), F.round(items / F.col("_total"), 6).alias("share"))


def normalization_summary(touches: DataFrame, group: str, path: str, hours: str) -> DataFrame:
    """Gross hours by group, those on paths touched more than once, and their share; null where nothing is gross."""
    paths = touches.groupBy(group, path).agg(F.sum(hours).alias("_h"), F.count("*").alias("_n"))
    sums = paths.groupBy(group).agg(F.sum("_h").cast("double").alias("gross"), F.sum(F.when(F.col("_n") > 1, F.col("_h")).otherwise(0)).cast("double").alias("rework"))
    return sums.withColumn("rework_share", F.round(F.col("rework") / F.nullif("gross", F.lit(0.0)), 6))
