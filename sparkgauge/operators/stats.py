"""Calibration statistics: error metrics, ranks, quantiles, held-out baselines, support distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut


def half_up(x: Column, digits: int) -> Column:
    """A double that is not negative rounded with halves up, by the same steps in every engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def point_metrics(rows: DataFrame, keys: list[str], reviewed: str, candidate: str, digits: int = 4) -> DataFrame:
    """Mean, median and root mean square error, signed error, weighted error and bias; null where reviewed sums to 0."""
    error = F.col(candidate).cast("decimal(18,4)") - F.col(reviewed).cast("decimal(18,4)")
    whole = F.nullif(F.sum(F.col(reviewed).cast("decimal(18,4)")).cast("double"), F.lit(0.0))
    n = F.count("*")
    total = lambda x: F.sum(x).cast("double")  # noqa: E731  decimals add up alike in any order
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        half_up(total(F.abs(error)) / n, digits).alias("mae"),
        F.round(F.percentile(F.abs(error).cast("double"), F.lit(0.5)), digits).alias("median_ae"),
        F.round(F.sqrt(total((error * error).cast("decimal(28,8)")) / n), digits).alias("rmse"),
        F.round(total(error) / n, digits).alias("signed_error"),
        F.round(total(F.abs(error)) / whole, digits).alias("wape"),
        F.round(total(error) / whole, digits).alias("bias"),
    )


def interval_metrics(rows: DataFrame, keys: list[str], reviewed: str, low: str, high: str, digits: int = 4, reviewed_low: str | None = None, reviewed_high: str | None = None) -> DataFrame:
    """Share of reviewed values within their interval, and the intervals' widths.

    With the reviewed range's ends also how many of these ranges lie within their interval whole.
    """
    whole = [] if reviewed_low is None else [F.count_if((F.col(low) <= F.col(reviewed_low)) & (F.col(reviewed_high) <= F.col(high))).alias("fully_covered")]
    inside = F.col(reviewed).between(F.col(low), F.col(high))
    width = F.col(high).cast("decimal(18,4)") - F.col(low).cast("decimal(18,4)")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(inside).alias("covered"),
        *whole,
        F.round(F.count_if(inside) / F.count("*"), digits).alias("coverage"),
        F.round(F.sum(width).cast("double") / F.count("*"), digits).alias("mean_width"),
        F.round(F.sum(width).cast("double") / F.nullif(F.sum(F.col(reviewed).cast("decimal(18,4)")).cast("double"), F.lit(0.0)), digits).alias("relative_width"),
    )


def range_status(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "below").when(value > high, "above").otherwise("inside")


def range_diagnostic(reviewed: dict[str, Column], candidate: dict[str, Column]) -> dict[str, Column]:
    """How a candidate range stands to a reviewed one: status, miss, widths and asymmetry; dicts of low, expected, high."""
    low, expected, high = (candidate[x] for x in ("low", "expected", "high"))
    said = reviewed["expected"]
    below, above = expected - low, high - expected
    asymmetry, width = F.abs(above - below), high - low
    return {
        "status": F.when(said < low, "candidate-too-high").when(said > high, "candidate-too-low").otherwise("covered"),
        "miss": F.greatest(low - said, said - high, (said - said)),
        "signed_error": expected - said,
        "candidate_width": width,
        "reviewed_width": reviewed["high"] - reviewed["low"],
        "lower_distance": below,
        "upper_distance": above,
        "asymmetry": asymmetry,
        "relative_asymmetry": F.when(width == 0, 0).otherwise(F.round((asymmetry / F.nullif(width, F.lit(0))).cast("decimal(28,8)"), 4)).cast("double"),
        "symmetric": below == above,
    }


def average_ranks(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1; equal values share the mean of their ranks.

    Values are counted before the shuffle, their counts run up by group, and the ranks are joined back, so a group's
    order costs its distinct values.
    """
    before = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    ranks = counts.select(*group, value, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name))
    return rows.join(ranks, [*group, value])


def spearman(rows: DataFrame, group: list[str], x: str, y: str, digits: int = 8) -> DataFrame:
    """Rank correlation within [-1, 1]; null for fewer than two rows or no variance."""
    ranked = average_ranks(average_ranks(rows, group, x, "_rx"), group, y, "_ry")
    # twice the ranks are whole numbers: sums of these are exact in any order
    a, b = (2 * F.col("_rx")).cast("decimal(18,0)"), (2 * F.col("_ry")).cast("decimal(18,0)")
    sums = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), *[F.sum(e.cast("decimal(38,0)")).cast("double").alias(k) for k, e in (("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))]
    )
    spread = F.sqrt(F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")) * F.sqrt(F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb"))
    value = (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.nullif(spread, F.lit(0.0))
    return sums.select(*group, "n", F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value)), digits).alias("rho"))


def nearest_rank(rows: DataFrame, group: list[str], value: str, q: float = 0.8) -> DataFrame:
    """The ceil(q n)-th smallest value of each group.

    Equal values are counted before the shuffle and their counts run up by group, so a group costs its distinct values.
    """
    w = Window.partitionBy(*group)
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("_c")).withColumns({"_upto": F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_c").over(w)})
    want = F.ceil(F.col("n") * F.lit(str(q)).cast("decimal(4,3)"))
    return counts.where((F.col("_upto") >= want) & (F.col("_upto") - F.col("_c") < want)).select(*group, F.col(value).alias("quantile"), "n")


def dealt(rows: DataFrame, value: Column, parts: int = 64) -> DataFrame:
    """``_part``: ranges of a value in its order, of about equal numbers of rows; equal values share one."""
    order = value.cast("double")
    bounds = sorted(set(rows.select(order.alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.005)))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= order)) if bounds else F.lit(0)
    return rows.withColumn("_part", F.when(value.isNull(), 0).otherwise(at))  # nulls come first in order


def running_counts(values: DataFrame, value: str, n: str, name: str) -> DataFrame:
    """``name``: the sum of ``n`` up to each distinct value: totals of ranges, and sums within each range."""
    ranged = dealt(values, F.col(value))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = ranged.groupBy("_part").agg(F.sum(n).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    up = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(totals), "_part").withColumn(name, F.col("_before") + F.sum(n).over(up)).drop("_before")


def leave_one_out_quantile(rows: DataFrame, held: str, value: str, q: float = 0.8) -> DataFrame:
    """For each ``held`` group, the nearest-rank quantile of all other groups' rows.

    With global ranks, and each group's own count below a value, the rank among the others
    is their difference.  Ranks come from counts by value in ranges; a group looks up its range from
    the ranges' totals and meets the values of that range only.
    """
    # histogram first: distinct values are what is sorted, with their counts by group
    hist = rows.groupBy(held, value).agg(F.count("*").alias("n"))
    values = hist.groupBy(value).agg(F.sum("n").alias("all_n"))
    groups = hist.groupBy(held).agg(F.sum("n").alias("own_n"))
    total = groups.agg(F.sum("own_n").alias("total"))
    upto = running_counts(values, value, "all_n", "all_upto")
    own = hist.join(upto, value).select(held, value, "n", "_part")
    ends = upto.groupBy("_part").agg(F.max("all_upto").alias("_end"))
    inside = own.groupBy(held, "_part").agg(F.sum("n").alias("_own"))
    want = F.ceil((F.col("total") - F.col("own_n")) * F.lit(str(q)).cast("decimal(4,3)"))
    grid = groups.crossJoin(F.broadcast(total)).withColumn("want", want).crossJoin(F.broadcast(ends)).join(inside, [held, "_part"], "left")
    w = Window.partitionBy(held).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_own_end", F.coalesce(F.sum("_own").over(w), F.lit(0))).where(F.col("_end") - F.col("_own_end") >= F.col("want"))
    start = F.col("_own_end") - F.coalesce("_own", F.lit(0))
    place = grid.groupBy(held, "own_n", "want").agg(F.min_by(F.struct("_part", start.alias("_own_before")), "_part").alias("p")).select(held, "own_n", "want", "p.*")
    run = Window.partitionBy(held).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cells = place.join(upto, "_part").join(own.drop("_part"), [held, value], "left").withColumn("own_upto", F.col("_own_before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    return (
        cells.where(F.col("all_upto") - F.col("own_upto") >= F.col("want"))
        .groupBy(held)
        .agg(F.min(value).alias("quantile"), F.first("own_n").alias("own_n"))
    )


def overall_rank(rows: DataFrame, value: str, q: float = 0.8) -> DataFrame:
    """The ceil(q n)-th smallest value of all rows, from counts by value in ranges: quantile."""
    upto = running_counts(rows.groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_upto")
    total = upto.agg(F.sum("_n").alias("_total"))
    reached = F.col("_upto") >= F.ceil(F.col("_total") * F.lit(str(q)).cast("decimal(4,3)"))
    return upto.crossJoin(F.broadcast(total)).where(reached).agg(F.min_by(value, "_upto").alias("quantile"))


def conditioned_intervals(rows: DataFrame, bucket: str, repo: str, value: str, least_rows: int = 3, least_repos: int = 2, q: float = 0.8) -> DataFrame:
    """Quantile of each bucket where it has enough rows and repositories, else of all rows: bucket, n, quantile, source."""
    known = nearest_rank(rows, [bucket], value, q).drop("n")
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.countDistinct(repo).alias("repos"))
    overall = overall_rank(rows, value, q).withColumnRenamed("quantile", "global")
    enough = (F.col("n") >= least_rows) & (F.col("repos") >= least_repos)
    return counts.join(known, bucket).crossJoin(F.broadcast(overall)).select(
        bucket, "n", "repos", F.when(enough, F.col("quantile")).otherwise(F.col("global")).alias("quantile"), F.when(enough, "bucket").otherwise("global").alias("source")
    )


def support_levels(rows: DataFrame, repo: str, levels: list[list[str]], least: int = 3) -> DataFrame:
    """The first level of keys with enough rows in other repositories: level index and support."""
    out = rows
    for i, keys in enumerate(levels):  # counted and joined, so a hot key is a join that can be split
        own = rows.groupBy(*keys, repo).agg(F.count("*").alias(f"_own{i}"))
        whole = own.groupBy(*keys).agg(F.sum(f"_own{i}").alias(f"_all{i}"))
        out = out.join(own, [*keys, repo]).join(whole, keys).withColumn(f"_s{i}", F.col(f"_all{i}") - F.col(f"_own{i}")).drop(f"_all{i}", f"_own{i}")
    level = F.coalesce(*[F.when(F.col(f"_s{i}") >= least, F.lit(i)) for i in range(len(levels))], F.lit(len(levels) - 1))
    support = F.get(F.array(*[F.col(f"_s{i}") for i in range(len(levels))]), level)
    return out.withColumns({"level": level, "support": support}).drop(*[f"_s{i}" for i in range(len(levels))])


# What makes a cell of the support hierarchy sufficient.
LEAST_OBSERVATIONS, LEAST_REPOSITORIES = 3, 2


def support_hierarchy(rows: DataFrame, repo: str, levels: list[list[str]]) -> DataFrame:
    """The first level of keys, the last one without any, that has support in other repositories: level, observations, repositories, sufficient.

    Counts are of rows of other repositories that share the level's keys; where no level suffices the last is taken.
    """
    out, cells = rows, []
    for i, keys in enumerate(levels):  # counted and joined, so a hot key is a join that can be split
        own = rows.groupBy(*keys, repo).agg(F.count("*").alias("_own"))
        if keys:
            whole = own.groupBy(*keys).agg(F.sum("_own").alias("_all"), F.count("*").alias("_repos"))
            counts = own.join(whole, keys)
        else:
            one = own.agg(F.sum("_own").alias("_all"), F.count("*").alias("_repos")).withColumn("_k", F.lit(0))
            counts = own.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k").drop("_k")  # one row
        cell = F.struct(F.lit(i).alias("level"), (F.col("_all") - F.col("_own")).alias("observations"), (F.col("_repos") - 1).alias("repositories"))
        out = out.join(counts.select(*keys, repo, cell.alias(f"_c{i}")), [*keys, repo])
        cells.append(f"_c{i}")
    enough = lambda c: (c["observations"] >= LEAST_OBSERVATIONS) & (c["repositories"] >= LEAST_REPOSITORIES)
    picked = F.coalesce(*[F.when(enough(F.col(c)), F.col(c)) for c in cells], F.col(cells[-1]))
    return out.withColumn("_pick", picked).select(*rows.columns, "_pick.*", enough(F.col("_pick")).alias("sufficient"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; two empty sets have distance 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def nearest_profile(profiles: DataFrame, key: str, repo: str, features: str, category: str | None = None, size: str | None = None, complexity: str | None = None, block: int = 2_048) -> DataFrame:
    """Nearest profile of another repository: key, neighbour, distance.

    The distance is the Jaccard distance of the feature sets; with the other columns given it is the mean of
    four terms: another category, the sizes' difference over 8, the complexities' over 3, and Jaccard.

    Distinct profiles are compared once, in pairs of blocks of bounded size; a block gives each profile
    its two nearest of different repositories, which is enough whichever repository asks.
    """
    import numpy as np
    import pandas as pd

    terms = [c for c in (category, size, complexity) if c]
    kind = F.to_json(F.struct(features, *terms)).alias("_kind")
    named = profiles.select(key, repo, kind, F.col(features).alias("_set"), *[F.col(c).alias(f"_{n}") for c, n in zip((category, size, complexity), ("category", "size", "complexity")) if c])
    attributes = [c for c in named.columns if c not in (key, repo, "_kind")]
    holders = named.groupBy("_kind", repo).agg(F.min(key).alias(key))
    first = holders.groupBy("_kind").agg(F.min(F.struct(F.col(key), F.col(repo))).alias("_a"))
    second = holders.join(first, "_kind").where(F.col(repo) != F.col(f"_a.{repo}")).groupBy("_kind").agg(F.min(F.struct(F.col(key), F.col(repo))).alias("_b"))
    known = named.groupBy("_kind").agg(*[F.first(c).alias(c) for c in attributes]).join(first, "_kind").join(second, "_kind", "left")
    blocks = max(1, -(-known.count() // block))
    at = F.pmod(F.xxhash64("_kind"), F.lit(blocks)).cast("int")
    asks = known.select("_kind", *attributes, at.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_y"))
    offers = known.select(*[F.col(c).alias(f"_o{c}") for c in attributes], F.col(f"_a.{key}").alias("_k1"), F.col(f"_a.{repo}").alias("_r1"), F.col(f"_b.{key}").alias("_k2"), F.col(f"_b.{repo}").alias("_r2"), at.alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_u"))
    types = {f.name: f.dataType.simpleString() for f in profiles.schema}
    schema = f"_kind string, distance double, neighbour {types[key]}, _repo {types[repo]}"

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"_kind": [], "distance": [], "neighbour": [], "_repo": []})
        place: dict = {}
        right = right.rename(columns={f"_o{c}": c for c in attributes})
        for sets in (left["_set"], right["_set"]):
            for s in sets:
                for f in s:
                    place.setdefault(f, len(place))

        def incidence(sets):
            m = np.zeros((len(sets), max(1, len(place))), np.float32)
            for i, s in enumerate(sets):
                m[i, [place[f] for f in s]] = 1
            return m

        a, b = incidence(left["_set"]), incidence(right["_set"])
        both = (a @ b.T).astype(np.float64)
        union = a.sum(1)[:, None] + b.sum(1)[None] - both
        distance = np.where(union == 0, 0.0, 1 - both / np.where(union == 0, 1, union))
        if terms:
            column = lambda df, c: df[c].to_numpy() if c in df else np.zeros(len(df))
            distance = distance + (column(left, "_category")[:, None] != column(right, "_category")[None])
            distance = distance + abs(column(left, "_size")[:, None].astype(float) - column(right, "_size")[None].astype(float)) / 8
            distance = (distance + abs(column(left, "_complexity")[:, None].astype(float) - column(right, "_complexity")[None].astype(float)) / 3) / 4
        distance = np.round(distance, 8)
        has = right["_k2"].notna().to_numpy()
        of = np.concatenate([np.arange(len(right)), np.flatnonzero(has)])
        keys = np.concatenate([right["_k1"].to_numpy(), right["_k2"].to_numpy()[has]])
        repos = np.concatenate([right["_r1"].to_numpy(), right["_r2"].to_numpy()[has]])
        rank = keys.argsort(kind="stable").argsort(kind="stable")
        out = []
        for i, name in enumerate(left["_kind"]):
            order = np.lexsort((rank, distance[i][of]))
            other = order[repos[order] != repos[order[0]]][:1]
            out += [(name, distance[i][of[j]], keys[j], repos[j]) for j in (order[0], *other)]
        return pd.DataFrame(out, columns=["_kind", "distance", "neighbour", "_repo"])

    found = asks.groupBy("_x", "_y").cogroup(offers.groupBy("_u", "_v")).applyInPandas(best, schema)
    pick = F.struct("distance", "neighbour", "_repo")
    one = found.groupBy("_kind").agg(F.min(pick).alias("_one"))
    two = found.join(one, "_kind").where(F.col("_repo") != F.col("_one._repo")).groupBy("_kind").agg(F.min(pick).alias("_two"))
    answers = named.select(key, repo, "_kind").join(one, "_kind").join(two, "_kind", "left")
    chosen = F.when(F.col("_one._repo") != F.col(repo), F.col("_one")).otherwise(F.col("_two"))
    return answers.select(key, chosen.alias("_c")).where("_c is not null").select(key, F.col("_c.neighbour").alias("neighbour"), F.col("_c.distance").alias("distance"))


def callable_shape(rows: DataFrame, group: list[str], value: str, limit: int) -> DataFrame:
    """Count, nearest-rank p50 and p90, maximum, and the share of values over a limit; a group costs its distinct values."""
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})").cast(rows.schema[value].dataType)
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"), rank("0.5").alias("p50"), rank("0.9").alias("p90"), F.max(value).alias("largest"), F.round(F.count_if(F.col(value) > limit) / F.count("*"), 6).alias("share_over")
    )


def pearson(rows: DataFrame, group: list[str], a: str, b: str, digits: int = 6) -> DataFrame:
    """Correlation of two measures by group, within [-1, 1]; null for fewer than two rows or no variance."""
    value = F.corr(a, b)
    value = F.when(~F.isnan(value), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value)))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.round(value, digits).alias("pearson"))


def slices(rows: DataFrame, dimensions: dict[str, Column], measure: Column) -> DataFrame:
    """Count and sum of a measure for each value of each dimension, in one pass; an array has each of its members, none is ``unknown``."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), text(c).alias("slice")) for n, c in dimensions.items()])
    return rows.select(F.explode(dims).alias("d"), measure.alias("_m")).groupBy("d.dimension", "d.slice").agg(F.count("*").alias("n"), F.sum("_m").alias("total"))


def monotonic_violations(buckets: DataFrame, order: str, value: str) -> DataFrame:
    """How many of the ordered buckets fall below the one before; one row a bucket goes through one task."""
    before = F.lag(value).over(Window.orderBy(order))
    return buckets.withColumn("_before", before).agg(F.count("*").alias("buckets"), F.count_if(F.col(value) < F.col("_before")).alias("violations"))


def nearest_vectors(asked: DataFrame, rows: DataFrame, digits: int = 6, block: int = 1_024, shard: int = 4_096) -> DataFrame:
    """For each asked vector the nearest of another label by cosine distance, ties to the smaller id: id, neighbour, distance.

    Both have id, label, v (array of double).  Vectors meet in pairs of blocks of bounded size; each gives one answer a vector.
    """
    import numpy as np
    import pandas as pd

    blocks, shards = max(1, -(-asked.count() // block)), max(1, -(-rows.count() // shard))
    deal = lambda df, n, m, own, other: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = deal(asked.select("id", "label", "v"), blocks, shards, "_x", "_y")
    right = deal(rows.select(F.col("id").alias("oid"), F.col("label").alias("olabel"), F.col("v").alias("ov"), F.col("id")), shards, blocks, "_v", "_u").drop("id")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "distance": [], "neighbour": []})
        b = b.sort_values("oid")
        unit = lambda c: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.stack(c.to_numpy()))
        d = np.round(1 - unit(a["v"]) @ unit(b["ov"]).T, digits)
        d[(a["label"].to_numpy()[:, None] == b["olabel"].to_numpy()[None]) | ~np.isfinite(d)] = np.inf
        at = d.argmin(1)  # the first of equal ones has the smallest id
        out = pd.DataFrame({"id": a["id"].to_numpy(), "distance": d[np.arange(len(a)), at], "neighbour": b["oid"].to_numpy()[at]})
        return out[np.isfinite(out["distance"])]

    kind = asked.schema["id"].dataType.simpleString()
    found = left.groupBy("_x", "_y").cogroup(right.groupBy("_u", "_v")).applyInPandas(best, f"id {kind}, distance double, neighbour {kind}")
    return found.groupBy("id").agg(F.min(F.struct("distance", "neighbour")).alias("d")).select("id", "d.neighbour", "d.distance")


def residual_pareto(rows: DataFrame, group: list[str], key: str, error: str, threshold: float = 0.8) -> DataFrame:
    """Errors by size: rank, share, cumulative share, and whether the shares before were below the threshold.

    Rows are ranged by group, size and key; a range adds what the ranges before it hold to sums of its own, so no task
    reads a whole group.  Equal sizes go by key, rows without an error come last.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("_size"), F.asc(key)]
    sized = rows.withColumn("_size", F.abs(F.col(error).cast("decimal(18,4)")))
    ranged = _cut(sized.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    every = Window.partitionBy(*group)  # one row a range of a group
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    known = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum"), F.sum("_s").over(every).alias("_all"))
    same = F.col("_part") == F.col("_of")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy(*group, "_part").orderBy(*order)
    whole = F.nullif(F.col("_all").cast("double"), F.lit(0.0))
    upto = (F.col("_sum") + F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).cast("double")
    out = ranged.join(known, same).withColumns({"rank": (F.col("_rows") + F.row_number().over(w)), "share": half_up(F.col("_size").cast("double") / whole, 6), "cumulative": half_up(upto / whole, 6), "_before": (upto - F.col("_size").cast("double")) / whole})
    return out.withColumn("material", F.round("_before", 6) < threshold).select(*rows.columns, "rank", "share", "cumulative", "material")


def mutation_checks(cases: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions that subject minus reference lies within bounds: delta and passed."""
    s = cases.select(F.col("case_id").alias("subject"), F.col("hours").alias("subject_hours"))
    r = cases.select(F.col("case_id").alias("reference"), F.col("hours").alias("reference_hours"))
    delta = F.col("subject_hours") - F.col("reference_hours")
    return assertions.join(s, "subject", "left").join(r, "reference", "left").withColumn("delta", delta).withColumn("passed", F.coalesce(delta.between(F.col("least"), F.col("most")), F.lit(False)))
