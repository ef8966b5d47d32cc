"""Portfolio plans: duplicates, reverts, normalization, allocation, buckets, trends and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, portfolio
from ..sources import commits, table
from .registry import doubles, query


@query("""
WITH d AS (SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS digest, o_totalprice FROM orders)
SELECT o_orderkey, digest, row_number() OVER (PARTITION BY digest ORDER BY o_totalprice DESC, o_orderkey) = 1 AS kept FROM d
""")
def duplicate_keeper(spark, sf_dir):
    """Of changes with one digest, the dearest is kept."""
    digest = F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", digest.alias("digest"), "o_totalprice")
    return portfolio.duplicate_keeper(rows, "digest", [-F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "digest", "kept")


STEPS = """steps AS (SELECT user_id, ts, event_id, (event_id * 7 % 3) AS base, (event_id * 7 + 1) % 3 AS head FROM events)"""


@query(f"""
WITH {STEPS}, j AS (SELECT *, coalesce(lag(head) OVER w = base, true) AS joined FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS steps, bool_and(joined) AS continuous,
  bool_and(joined) AND arg_min(base, (ts, event_id)) = arg_max(head, (ts, event_id)) AND count(*) > 1 AS reverted FROM j GROUP BY 1
""")
def chain_revert(spark, sf_dir):
    """Chains of steps that are continuous and return to where they began."""
    e = F.col("event_id")
    steps = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (e * 7 % 3).alias("base"), ((e * 7 + 1) % 3).alias("head"))
    return portfolio.exact_reverts(steps, ["user_id"], ["ts", "event_id"], "base", "head")


@query("""
WITH m AS (SELECT s_nationkey, l_partkey, max(CAST(l_quantity AS DECIMAL(18,2))) AS top FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT s_nationkey, CAST(sum(top) AS DOUBLE) AS normalized FROM m GROUP BY 1
""")
def max_merge(spark, sf_dir):
    """Overlapping contributions count once, with the largest."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("decimal(18,2)").alias("hours"))
    rows = rows.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return doubles(portfolio.max_merge(rows, ["s_nationkey"], ["l_partkey"], "hours"), "normalized")


@query("""
SELECT p_partkey, p_brand, CASE WHEN p_size = max(p_size) OVER w THEN 1.0::DOUBLE / sum(CASE WHEN p_size = m THEN 1 ELSE 0 END) OVER w ELSE 0.0::DOUBLE END AS weight
FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) WINDOW w AS (PARTITION BY p_brand)
""")
def winner_weights(spark, sf_dir):
    """Tied winners share one weight."""
    return portfolio.winner_weights(table(spark, sf_dir, "part"), ["p_brand"], "p_size").select("p_partkey", "p_brand", "weight")


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, CAST(round(abs(c_acctbal) * 100) AS HUGEINT) + 1 AS w, 1000003::BIGINT AS total FROM customer),
f AS (SELECT *, w * total // sum(w) OVER g AS fl, w * total % sum(w) OVER g AS rest FROM r WINDOW g AS (PARTITION BY c_nationkey)),
t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, c_custkey) AS turn, total - sum(fl) OVER (PARTITION BY c_nationkey) AS residual FROM f)
SELECT c_custkey, c_nationkey, CAST(fl + CASE WHEN turn <= residual THEN 1 ELSE 0 END AS BIGINT) AS cents FROM t
""")
def largest_remainder(spark, sf_dir):
    """A nation's cents dealt to its customers without loss."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.round(F.abs("c_acctbal") * 100).cast("long") + 1).alias("w"), F.lit(1000003).cast("long").alias("total"))
    return portfolio.largest_remainder(rows, ["c_nationkey"], "w", "total", "c_custkey").select("c_custkey", "c_nationkey", F.col("cents").cast("long").alias("cents"))


@query("""
WITH s AS (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS match_set, count(DISTINCT event_type) AS n FROM events GROUP BY 1)
SELECT match_set, CASE WHEN max(n) = 1 THEN 'single' ELSE 'shared' END AS kind, count(*) AS subjects FROM s GROUP BY 1
""")
def match_set_groups(spark, sf_dir):
    """Subjects by the set of what they match."""
    return portfolio.match_sets(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS since, count(*) AS items, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS hours FROM orders GROUP BY 1
""")
def month_buckets(spark, sf_dir):
    """Additive month series of orders."""
    rows = portfolio.calendar_buckets(table(spark, sf_dir, "orders"), "o_orderdate", "month")
    return rows.groupBy("since").agg(F.count("*").alias("items"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("hours"))


@query("""
WITH e AS (SELECT date_trunc('week', ts)::TIMESTAMP AS monday, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-26')
SELECT greatest(monday, TIMESTAMP '2024-01-03') AS since, least(monday + INTERVAL 7 DAY, TIMESTAMP '2024-01-26') AS until,
  monday < TIMESTAMP '2024-01-03' OR monday + INTERVAL 7 DAY > TIMESTAMP '2024-01-26' AS partial, event_type, count(*) AS items FROM e GROUP BY 1, 2, 3, 4
""")
def week_buckets(spark, sf_dir):
    """Monday weeks cut to the asked period, with partial ones marked."""
    rows = portfolio.calendar_buckets(table(spark, sf_dir, "events"), "ts", "week", "2024-01-03 00:00:00", "2024-01-26 00:00:00")
    return rows.groupBy("since", "until", "partial", "event_type").agg(F.count("*").alias("items"))


BUCKETS = (("a", "2024-01-01 00:00:00", "2024-01-08 12:00:00"), ("b", "2024-01-08 12:00:00", "2024-01-15 00:00:00"), ("c", "2024-01-15 00:00:00", "2024-01-24 06:00:00"))


def custom_buckets(spark):
    rows = spark.createDataFrame(BUCKETS, "bucket string, since string, until string")
    return rows.select("bucket", F.col("since").cast("timestamp_ntz").alias("since"), F.col("until").cast("timestamp_ntz").alias("until"))


VALUES = ", ".join(f"('{b}', TIMESTAMP '{s}', TIMESTAMP '{u}')" for b, s, u in BUCKETS)


@query(f"""
WITH b(bucket, since, until) AS (VALUES {VALUES})
SELECT bucket, user_id, count(*) AS items, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS hours FROM events JOIN b ON ts >= since AND ts < until GROUP BY 1, 2
""")
def range_bucket_join(spark, sf_dir):
    """Interval join with half-open custom buckets."""
    rows = portfolio.bucket_join(table(spark, sf_dir, "events"), custom_buckets(spark), "ts")
    return rows.groupBy("bucket", "user_id").agg(F.count("*").alias("items"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("hours"))


DAYS = "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS hours, count(*) AS capacity FROM events GROUP BY 1, 2"


def days(spark, sf_dir):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return table(spark, sf_dir, "events").groupBy("event_type", day).agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("hours"), F.count("*").alias("capacity"))


@query(f"""
WITH d AS ({DAYS}), x AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY day) - 1)::DOUBLE AS x, hours::DOUBLE AS y FROM d)
SELECT event_type, count(*) AS points, round(regr_slope(y, x), 8) AS slope, round(regr_r2(y, x), 8) AS r2, round((arg_max(y, x) - arg_min(y, x)) / nullif(arg_min(y, x), 0), 6) AS change FROM x GROUP BY 1
""")
def trend_ols(spark, sf_dir):
    """Slope, fit and change of each series over its buckets."""
    return portfolio.trend(days(spark, sf_dir), ["event_type"], "day", "hours")


@query(f"""
WITH d AS ({DAYS})
SELECT event_type, day, CASE WHEN count(*) OVER w = 3 THEN round(CAST(sum(hours) OVER w AS DOUBLE) / CAST(sum(capacity) OVER w AS DOUBLE), 4) END AS rolling FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS 2 PRECEDING)
""")
def rolling_ratio(spark, sf_dir):
    """Trailing three-bucket ratio to capacity, full windows only."""
    return portfolio.rolling_ratio(days(spark, sf_dir), ["event_type"], "day", "hours", "capacity").select("event_type", "day", F.round(F.col("rolling").cast("double"), 4).alias("rolling"))


@query("""
WITH cells AS (SELECT DISTINCT user_id AS contributor, dayofmonth(ts)::INTEGER AS bucket FROM events),
f AS (SELECT contributor, bucket FROM (SELECT DISTINCT contributor FROM cells), (SELECT unnest(range(1, 29))::INTEGER AS bucket))
SELECT contributor, bucket, 'missing' AS problem FROM (SELECT * FROM f EXCEPT SELECT * FROM cells)
UNION ALL SELECT contributor, bucket, 'unexpected' FROM (SELECT * FROM cells EXCEPT SELECT * FROM f)
""")
def capacity_matrix_check(spark, sf_dir):
    """Cells that the capacity matrix lacks or should not have."""
    cells = table(spark, sf_dir, "events").select(F.col("user_id").alias("contributor"), F.dayofmonth("ts").alias("bucket")).distinct()
    buckets = spark.range(1, 29).select(F.col("id").cast("int").alias("bucket"))
    return portfolio.matrix_gaps(cells, cells.select("contributor"), buckets)


EDGES = "e AS (SELECT s_suppkey % 40 AS src, 1000 + (s_suppkey * 17) % 60 AS dst FROM supplier)"


@query(f"""
WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(x, y) AS (SELECT a, b FROM b UNION SELECT r.x, b.b FROM r JOIN b ON r.y = b.a)
SELECT x AS node, min(least(x, y)) AS component FROM r GROUP BY 1
""")
def components(spark, sf_dir):
    """Components of changes over the paths that they share."""
    k = F.col("s_suppkey")
    return graph.connected_components(table(spark, sf_dir, "supplier").select((k % 40).alias("src"), (1000 + k * 17 % 60).alias("dst")))


@query("""
WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS total FROM g GROUP BY 1)
SELECT u.user_id, k.event_type, coalesce(n, 0) AS items, round(coalesce(n, 0)::DOUBLE / total, 6) AS share
FROM t u CROSS JOIN (SELECT DISTINCT event_type FROM events) k LEFT JOIN g ON g.user_id = u.user_id AND g.event_type = k.event_type
""")
def contributor_summary(spark, sf_dir):
    """All requested contributors by kind, zero rows included."""
    return portfolio.contributor_summary(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
WITH s AS (SELECT event_id AS id, 'u' || user_id AS path, event_id % 5 AS base, (event_id + 1 + 3 * (event_id % 2)) % 5 AS head FROM events UNION ALL SELECT o_orderkey, 'c' || o_custkey, o_orderkey % 2, 1 - o_orderkey % 2 FROM orders)
SELECT path, min(a.id) AS undone, b.id AS undoing FROM s b JOIN s a USING (path) WHERE a.base = b.head AND a.head = b.base AND a.id < b.id GROUP BY 1, 3
""")
def opposing_steps(spark, sf_dir):
    """Steps that swap an earlier one's ends on their path, each with the first that it undoes."""
    e, k = F.col("event_id"), F.col("o_orderkey")
    events = table(spark, sf_dir, "events").select(e.alias("id"), F.concat(F.lit("u"), "user_id").alias("path"), (e % 5).alias("base"), ((e + 1 + 3 * (e % 2)) % 5).alias("head"))
    orders = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("c"), "o_custkey").alias("path"), (k % 2).alias("base"), (1 - k % 2).alias("head"))
    return portfolio.opposing_effects(events.union(orders), "id", "path", "base", "head")


@query("""
WITH b AS (SELECT user_id, min(ts) AS since, max(ts) AS until FROM events GROUP BY 1),
l AS (SELECT *, lag(until) OVER (ORDER BY since, user_id) AS before FROM b)
SELECT user_id, since, until FROM l WHERE before <> since OR until <= since
""")
def bucket_gaps(spark, sf_dir):
    """Buckets that leave a gap, overlap, or end before they begin."""
    buckets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    return portfolio.gap_check(buckets).select("user_id", "since", "until")


ALIASES = "a AS (SELECT c_custkey AS contributor, lower(unnest([c_name, 'C' || c_custkey || '@X.ORG'])) AS alias FROM customer)"


@query(f"""
WITH {ALIASES}, m AS (SELECT o_orderkey, lower(CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey || '@x.org' ELSE 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END) AS alias FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01')
SELECT DISTINCT o_orderkey, contributor FROM m JOIN a ON m.alias = a.alias
""")
def alias_match(spark, sf_dir):
    """Changes of a half-open period with the contributors whose names or addresses they carry, in any case."""
    c = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(c.alias("contributor"), F.explode(F.array("c_name", F.concat(F.lit("C"), c, F.lit("@X.ORG")))).alias("alias"))
    k, even = F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    made = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("object_id"),
        F.when(even, "nobody").otherwise(F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))).alias("author_name"),
        F.when(even, F.concat(F.lit("c"), k, F.lit("@x.org"))).otherwise("none").alias("author_email"),
        F.col("o_orderdate").cast("timestamp").alias("author_ts"),
        F.array().cast("array<string>").alias("parents"),
    )
    found = commits.selected(made, people, "1995-01-01", "1996-01-01", coauthors=False)
    return found.select(F.col("object_id").alias("o_orderkey"), "contributor")


@query("""
WITH g AS (SELECT l_partkey, l_suppkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS h, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_suppkey, sum(h) AS gross, sum(CASE WHEN n > 1 THEN h ELSE 0 END) AS rework FROM g GROUP BY 1)
SELECT l_suppkey, CAST(gross AS DOUBLE) AS gross, CAST(rework AS DOUBLE) AS rework, round(CAST(rework AS DOUBLE) / nullif(CAST(gross AS DOUBLE), 0), 6) AS rework_share FROM c
""")
def normalization_summary(spark, sf_dir):
    """Gross hours and the share on paths that were touched more than once; null where nothing is gross."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("h"))
    return portfolio.normalization_summary(rows, "l_suppkey", "l_partkey", "h")


ZONE, SINCE, UNTIL = "America/New_York", "1995-02-10 05:00:00", "2001-05-20 00:00:00"


@query(f"""
WITH o AS (SELECT o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders),
m AS (SELECT *, date_trunc('month', timezone('{ZONE}', timezone('UTC', ts))) AS month FROM o WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'),
b AS (SELECT *, timezone('UTC', timezone('{ZONE}', month::TIMESTAMP)) AS a, timezone('UTC', timezone('{ZONE}', (month + INTERVAL 1 MONTH)::TIMESTAMP)) AS z FROM m)
SELECT strftime(month, '%Y-%m') AS bucket, greatest(a, TIMESTAMP '{SINCE}') AS since, least(z, TIMESTAMP '{UNTIL}') AS until, a < TIMESTAMP '{SINCE}' AS partial_start, z > TIMESTAMP '{UNTIL}' AS partial_end, count(*) AS items, CAST(sum(p) AS DOUBLE) AS hours
FROM b GROUP BY ALL
""")
def zoned_months(spark, sf_dir):
    """Months of a zone with its changing offsets, cut to a period; orders by the month that holds their instant."""
    months = portfolio.calendar_partition(spark, SINCE, UNTIL, "month", ZONE)
    ts = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = table(spark, sf_dir, "orders").select(ts.cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    found = portfolio.bucket_join(rows, months, "ts")
    return found.groupBy("bucket", "since", "until", "partial_start", "partial_end").agg(F.count("*").alias("items"), F.sum("p").cast("double").alias("hours"))


@query("""
WITH b AS (SELECT user_id, min(ts) AS since, max(ts) AS until FROM events GROUP BY 1), l AS (SELECT *, lag(until) OVER (ORDER BY since, user_id, until) AS before FROM b)
SELECT user_id, since, until, 'gap' AS problem FROM l WHERE before <> since OR until <= since
UNION ALL (SELECT *, 'start' FROM b ORDER BY since, user_id, until LIMIT 1)
UNION ALL (SELECT *, 'end' FROM b WHERE (since, user_id, until) = (SELECT (since, user_id, until) FROM b ORDER BY since DESC, user_id DESC, until DESC LIMIT 1) AND until <> (SELECT max(ts) FROM events))
""")
def partition_faults(spark, sf_dir):
    """Gaps and overlaps of buckets, and whether they begin and end where the period does."""
    events = table(spark, sf_dir, "events")
    buckets = events.groupBy("user_id").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    last = events.agg(F.max("ts")).first()[0]
    return portfolio.partition_faults(buckets, F.lit("2024-01-01 00:00:00").cast(buckets.schema["since"].dataType), F.lit(last).cast(buckets.schema["until"].dataType))


@query("""
WITH k AS (SELECT o_orderkey AS k, (o_orderkey // 40) % 5 AS repo, TIMESTAMP '1995-01-01' + to_minutes(CAST(o_orderkey % 600000 AS INTEGER)) AS ts, o_custkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 END AS b, o_orderkey % 7 = 0 AS merge FROM orders),
c AS (SELECT c_custkey AS p FROM customer WHERE c_custkey % 4 <> 1),
m AS (SELECT k.*, EXISTS (SELECT 1 FROM c WHERE p = a) AS da, EXISTS (SELECT 1 FROM c WHERE p = b) AS db FROM k WHERE ts < TIMESTAMP '1996-01-01'),
s AS (SELECT *, lag(k) OVER (PARTITION BY repo, merge ORDER BY ts, k) AS before FROM m WHERE da OR db)
SELECT repo, k, CASE WHEN da THEN 'direct-author' ELSE 'coauthor' END AS kind, da::INTEGER + db::INTEGER AS matched, merge AS excluded,
  CASE WHEN merge THEN '' ELSE array_to_string(list_filter([CASE WHEN b IS NOT NULL THEN 'coauthored' END, CASE WHEN before <> k - 1 THEN 'previous-is-no-parent' END, CASE WHEN da AND db THEN 'many-contributors' END], lambda x: x IS NOT NULL), ',') END AS ambiguity FROM s
""")
def author_period(spark, sf_dir):
    """Commits of listed people in a period, with what leaves their credit open and the merges left out."""
    people = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("contributor"), F.concat(F.lit("P"), "c_custkey", F.lit("@x.org")).alias("alias"))
    k, name = F.col("o_orderkey"), lambda n: F.lpad(n.cast("string"), 12, "0")
    mail = lambda c: F.concat(F.lit("p"), c, F.lit("@x.org"))
    other = F.struct(F.lit("other").alias("name"), mail(F.col("o_custkey") + 1).alias("email"))
    made = table(spark, sf_dir, "orders").select(
        F.expr("(o_orderkey div 40) % 5").alias("repo"), name(k).alias("object_id"), F.when(k % 7 == 0, F.array(name(k - 1), name(k - 9))).otherwise(F.array(name(k - 1))).alias("parents"),
        F.lit("someone").alias("author_name"), mail(F.col("o_custkey")).alias("author_email"), F.timestamp_add("MINUTE", (k % 600_000).cast("int"), F.lit("1995-01-01").cast("timestamp")).alias("author_ts"),
        F.when(k % 3 == 0, F.array(other)).otherwise(F.array().cast("array<struct<name:string,email:string>>")).alias("coauthors"),
    )
    rows = commits.author_period(made, people, "1995-01-01", "1996-01-01")
    return rows.select("repo", F.col("object_id").cast("long").alias("k"), "kind", F.size("matches").alias("matched"), "excluded", F.array_join("ambiguity", ",").alias("ambiguity"))
