"""Portfolio assembly plans: orders as changes of repositories, events as dated items of contributors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import dec
from ..operators import portfolio, series
from ..sources import table
from .portfolios import VALUES, custom_buckets
from .registry import cents, cents_sql, doubles, query

POINTS = series.POINTS


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS path FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY item) AS n, row_number() OVER (PARTITION BY item ORDER BY path) AS i FROM p),
o AS (SELECT o_orderkey AS item, CAST(o_totalprice AS DECIMAL(18,2)) AS e FROM orders), r AS (SELECT item, path, e, coalesce(n, 1) AS n, coalesce(i, 1) AS i FROM o LEFT JOIN n USING (item)),
s AS (SELECT *, CAST(round(CAST(e / n AS DECIMAL(28,10)), 6) AS DECIMAL(28,6)) AS even FROM r)
SELECT item, path, CAST(CASE WHEN i = n THEN e - even * (n - 1) ELSE even END AS DOUBLE) AS expected FROM s
""")
def contribution_split(spark, sf_dir):
    """An item's hours over the paths that it affects."""
    e = F.col("o_totalprice").cast("decimal(18,2)")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), *[e.alias(p) for p in POINTS])
    effects = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("path"))
    return doubles(series.contributions(items, effects, ["item"]).select("item", "path", "expected"), "expected")


CAUSES = f"""i AS (SELECT o_custkey % 50 AS repo, o_orderkey AS item, {cents_sql("o_orderkey", 40000)} AS e, CASE WHEN o_orderpriority < '3' THEN {cents_sql("o_orderkey", 40000)} ELSE 0 END AS s, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 END AS dup FROM orders),
f AS (SELECT DISTINCT repo, item, l_partkey % 200 AS path FROM i JOIN lineitem ON l_orderkey = item), k AS (SELECT repo, CAST(sum(s) * 0.6 AS DECIMAL(18,2)) AS kept FROM i WHERE dup IS NULL GROUP BY 1),
t AS (SELECT f.repo, path, count(*) AS n FROM f JOIN i ON f.item = i.item AND dup IS NULL GROUP BY 1, 2), p AS (SELECT repo, count(*) FILTER (n > 1) AS o, count(*) FILTER (path % 20 = 3) AS v FROM t GROUP BY 1),
c AS (SELECT repo, 0 AS place, 'exact-duplicate' AS kind, CAST(greatest(sum(e), 0.01) AS DECIMAL(18,4)) AS w FROM i WHERE dup IS NOT NULL GROUP BY 1 UNION ALL SELECT repo, 1, 'overlap', CAST(o AS DECIMAL(18,4)) FROM p WHERE o > 0 UNION ALL SELECT repo, 2, 'revert', CAST(v AS DECIMAL(18,4)) FROM p WHERE v > 0
  UNION ALL SELECT repo, 3, 'shared-context', CAST(greatest(a - kept, 0) AS DECIMAL(18,4)) FROM (SELECT repo, sum(s) AS a FROM i WHERE dup IS NULL GROUP BY 1) JOIN k USING (repo) WHERE a > kept)"""


def cause_rows(spark, sf_dir):
    """Customers' orders as items of fifty repositories, with duplicates, shared hours, overlaps and reverts."""
    key, e = F.col("o_orderkey"), cents(F.col("o_orderkey"), 40000)
    items = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("repo"), key.alias("item"), e.alias("expected"), F.when(F.col("o_orderpriority") < "3", e).otherwise(dec(0, "decimal(18,2)")).alias("shared"), F.when(key % 11 == 0, key - 1).alias("duplicate_of")
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_partkey") % 200).alias("path"))
    effects = lines.join(items.select("repo", "item"), "item").select("repo", "item", "path").distinct()
    kept = items.where("duplicate_of is null").groupBy("repo").agg((F.sum("shared") * dec("0.6")).cast("decimal(18,2)").alias("shared"))
    return items, series.causes(items, effects, effects.where("path % 20 = 3").select("repo", "path"), kept, ["repo"])


@query(f"WITH {CAUSES} SELECT repo, kind, CAST(w AS DOUBLE) AS weight FROM c")
def portfolio_causes(spark, sf_dir):
    """Why a repository's normalized effort differs from its items' sum."""
    return doubles(cause_rows(spark, sf_dir)[1].select("repo", "kind", "weight"), "weight")


@query(f"""WITH {CAUSES}, d AS (SELECT repo, CAST(sum(e) * 0.2 AS DECIMAL(18,2)) AS delta FROM i GROUP BY 1),
a AS (SELECT * FROM c UNION ALL SELECT d.repo, 9, 'interaction', CAST(CASE WHEN t.w IS NULL THEN 1 ELSE greatest(1, t.w * 0.25) END AS DECIMAL(18,4)) FROM d LEFT JOIN (SELECT repo, sum(w) AS w FROM c GROUP BY 1) t USING (repo)),
s AS (SELECT a.repo, place, kind, delta, CAST(round(CAST(CAST(delta * w AS DECIMAL(28,8)) / sum(w) OVER (PARTITION BY a.repo) AS DECIMAL(28,8)), 2) AS DECIMAL(18,4)) AS sh FROM a JOIN d USING (repo))
SELECT repo, kind, CAST(CASE WHEN place = 9 THEN delta - coalesce(sum(sh) OVER (PARTITION BY repo ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE sh END AS DOUBLE) AS expected FROM s""")
def portfolio_adjustments(spark, sf_dir):
    """A repository's difference shared over its causes; interaction takes the rest."""
    items, found = cause_rows(spark, sf_dir)
    deltas = items.groupBy("repo").agg((F.sum("expected") * dec("0.2")).cast("decimal(18,2)").alias("expected"))
    deltas = deltas.select("repo", F.col("expected").alias("low"), "expected", F.col("expected").alias("high"))
    return doubles(series.attributed(deltas, found, ["repo"]).select("repo", "kind", "expected"), "expected")


ALLOCATED = """r AS (SELECT c_nationkey AS g, c_custkey AS item, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE CAST(round(abs(c_acctbal) * 100) AS BIGINT) END AS e, CAST(round(abs(c_acctbal) * 200) AS BIGINT) AS h FROM customer),
t AS (SELECT g, CAST(sum(e) // 2 AS BIGINT) AS low, CAST(sum(e) * 2 + 17 AS BIGINT) AS high, sum(e) AS se, sum(h) AS sh FROM r GROUP BY 1),
w AS (SELECT r.*, low, high, CAST(CASE WHEN se > 0 THEN e ELSE 1 END AS HUGEINT) AS wl, CAST(CASE WHEN se > 0 THEN e WHEN sh > 0 THEN h ELSE 1 END AS HUGEINT) AS wh FROM r JOIN t USING (g)),
f AS (SELECT *, wl * low // sum(wl) OVER p AS fl, wl * low % sum(wl) OVER p AS rl, wh * high // sum(wh) OVER p AS fh, wh * high % sum(wh) OVER p AS rh FROM w WINDOW p AS (PARTITION BY g)),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rl DESC, item) AS tl, row_number() OVER (PARTITION BY g ORDER BY rh DESC, item) AS th, low - sum(fl) OVER (PARTITION BY g) AS ll, high - sum(fh) OVER (PARTITION BY g) AS lh FROM f)"""


@query(f"WITH {ALLOCATED}, o AS (SELECT g, item, CAST(fl + CASE WHEN tl <= ll THEN 1 ELSE 0 END AS BIGINT) AS low, CAST(e AS BIGINT) AS expected, CAST(fh + CASE WHEN th <= lh THEN 1 ELSE 0 END AS BIGINT) AS high FROM z) SELECT *, low <= expected AND expected <= high AS ordered FROM o")
def range_allocation(spark, sf_dir):
    """Low and high of a total dealt by expected weights, with the order checked."""
    n, a = F.col("c_nationkey"), F.abs("c_acctbal")
    rows = table(spark, sf_dir, "customer").select(n.alias("g"), F.col("c_custkey").alias("item"), F.when(n % 5 == 0, 0).otherwise(F.round(a * 100)).cast("long").alias("expected_cents"), F.round(a * 200).cast("long").alias("high_cents"))
    totals = rows.groupBy("g").agg(F.expr("sum(expected_cents) div 2").alias("low_cents"), (F.sum("expected_cents") * 2 + 17).alias("high_total_cents"))
    return series.range_allocation(rows, totals, ["g"], "item")


@query("""
WITH r AS (SELECT DISTINCT l_suppkey % 9 AS repo, l_orderkey AS item, l_returnflag AS head FROM lineitem), s AS (SELECT repo, item, string_agg(head, '+' ORDER BY head) AS head_set, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT DISTINCT repo, head AS head_set FROM (SELECT DISTINCT repo FROM r), (SELECT DISTINCT l_returnflag AS head FROM lineitem UNION SELECT 'IDLE')),
g AS (SELECT repo, head_set, max(n) AS n, count(*) AS items, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS e FROM s JOIN orders ON o_orderkey = item GROUP BY 1, 2)
SELECT coalesce(g.repo, h.repo) AS repo, coalesce(g.head_set, h.head_set) AS head_set, CASE WHEN coalesce(n, 1) = 1 THEN 'single-head' ELSE 'shared-heads' END AS kind, coalesce(items, 0) AS items, CAST(coalesce(e, 0) AS DOUBLE) AS expected FROM g FULL JOIN h ON g.repo = h.repo AND g.head_set = h.head_set
""")
def head_groups(spark, sf_dir):
    """Changes by the set of heads that reach them, idle heads included."""
    reached = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 9).alias("repo"), F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("head")).distinct()
    modes = reached.select("head").distinct().union(spark.createDataFrame([("IDLE",)], "head string"))
    heads = portfolio.cells_of(reached.select("repo").distinct(), modes)
    e = F.col("o_totalprice").cast("decimal(18,2)")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), *[e.alias(p) for p in POINTS])
    items = reached.select("repo", "item").distinct().join(orders, "item")
    return doubles(series.head_groups(reached, heads, items).select("repo", "head_set", "kind", "items", "expected"), "expected")


@query("""
WITH i AS (SELECT o_custkey AS repo, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders), s AS (SELECT repo, count(*) AS items, sum(a) AS allocated FROM i GROUP BY 1),
g AS (SELECT c_custkey AS repo, CAST(coalesce(allocated, 0) + CASE WHEN c_custkey % 6 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS expected FROM customer LEFT JOIN s ON repo = c_custkey)
SELECT repo, CAST(expected AS DOUBLE) AS expected, coalesce(items, 0) AS items, CAST(coalesce(allocated, 0) AS DOUBLE) AS allocated, coalesce(allocated, 0) = expected AS agrees FROM g LEFT JOIN s USING (repo)
""")
def portfolio_reconcile(spark, sf_dir):
    """Repositories whose allotted hours do not add up to their normalized ones."""
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").cast("decimal(18,2)").alias("allocated"))
    sums = items.groupBy("repo").agg(F.sum("allocated").alias("expected"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"))
    groups = people.join(sums, "repo", "left").select("repo", (F.coalesce("expected", dec(0)) + F.when(F.col("repo") % 6 == 0, dec("0.01")).otherwise(dec(0))).cast("decimal(18,2)").alias("expected"))
    return doubles(series.reconciled(groups, items, ["repo"]), "expected", "allocated")


@query("""
SELECT event_type, 'today-2024-01-10' AS bucket, TIMESTAMP '2024-01-09 23:00:00' AS since, TIMESTAMP '2024-01-10 23:00:00' AS until, count(*) AS items FROM events WHERE ts >= TIMESTAMP '2024-01-09 23:00:00' AND ts < TIMESTAMP '2024-01-10 15:30:00' GROUP BY 1
""")
def today_bucket(spark, sf_dir):
    """Items of the local day so far, in a zone an hour east of UTC."""
    rows = series.today_bucket(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-10 15:30:00"), "Europe/Paris")
    return rows.groupBy("event_type", "bucket", "since", "until").agg(F.count("*").alias("items"))


SERIES = f"""b(bucket, since, until) AS (VALUES {VALUES}), i AS (SELECT event_type AS g, ts, CAST(round(abs(value) * 100) AS BIGINT) AS e, CAST(round(abs(value) * 250) AS BIGINT) AS h FROM events),
held AS (SELECT g, bucket, count(*) AS items, sum(e) AS e, sum(h) AS h FROM i JOIN b ON ts >= since AND ts < until GROUP BY 1, 2), a AS (SELECT g, CAST(sum(e) // 3 AS BIGINT) AS low, CAST(sum(e) * 2 + 5 AS BIGINT) AS high FROM held GROUP BY 1),
c AS (SELECT a.g, b.bucket, coalesce(items, 0) AS items, CAST(coalesce(e, 0) AS HUGEINT) AS e, low, high FROM a CROSS JOIN b LEFT JOIN held ON held.g = a.g AND held.bucket = b.bucket),
f AS (SELECT *, e * low // sum(e) OVER p AS fl, e * low % sum(e) OVER p AS rl, e * high // sum(e) OVER p AS fh, e * high % sum(e) OVER p AS rh FROM c WINDOW p AS (PARTITION BY g)),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rl DESC, bucket) AS tl, row_number() OVER (PARTITION BY g ORDER BY rh DESC, bucket) AS th, low - sum(fl) OVER (PARTITION BY g) AS ll, high - sum(fh) OVER (PARTITION BY g) AS lh FROM f),
s AS (SELECT g, bucket, CAST(items AS BIGINT) AS items, CAST(fl + CASE WHEN tl <= ll THEN 1 ELSE 0 END AS BIGINT) AS low, CAST(e AS BIGINT) AS expected, CAST(fh + CASE WHEN th <= lh THEN 1 ELSE 0 END AS BIGINT) AS high FROM z)"""


def event_series(spark, sf_dir):
    """Additive series of event kinds as contributor groups over custom buckets."""
    v = F.abs("value")
    items = table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), "ts", F.round(v * 100).cast("long").alias("expected_cents"), F.round(v * 250).cast("long").alias("high_cents"))
    buckets = custom_buckets(spark)
    from ..operators.portfolio import bucket_join

    allocations = bucket_join(items, buckets, "ts").groupBy("group").agg(F.expr("sum(expected_cents) div 3").alias("low_cents"), (F.sum("expected_cents") * 2 + 5).alias("high_total_cents"))
    return series.additive_series(items, buckets, allocations)


@query(f"WITH {SERIES} SELECT g, bucket, items, low, expected, high FROM s")
def additive_series(spark, sf_dir):
    """Normalized effort of each group dealt over the buckets of its items."""
    return event_series(spark, sf_dir).select(F.col("group").alias("g"), "bucket", "items", "low", "expected", "high")


@query(f"WITH {SERIES} SELECT bucket, CAST(sum(items) AS BIGINT) AS items, CAST(sum(low) AS BIGINT) AS low, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(high) AS BIGINT) AS high, true AS reconciles FROM s GROUP BY 1")
def portfolio_series(spark, sf_dir):
    """The additive series summed, which reconciles to the portfolio's total."""
    additive = event_series(spark, sf_dir)
    from ..operators.portfolio import bucket_join

    events = table(spark, sf_dir, "events").select("ts", F.round(F.abs("value") * 100).cast("long").alias("e"))
    totals = bucket_join(events, custom_buckets(spark), "ts").agg(F.sum("e").alias("expected"))
    return series.portfolio_series(additive, totals)


@query(f"""
WITH b(bucket, since, until) AS (VALUES {VALUES}), m AS (SELECT user_id AS contributor, ts, value FROM events UNION ALL SELECT user_id + 1, ts, value FROM events WHERE event_id % 4 = 0),
s AS (SELECT contributor, bucket, count(*) AS items, sum(CAST(value AS DECIMAL(18,4))) AS e FROM m JOIN b ON ts >= since AND ts < until GROUP BY 1, 2)
SELECT k.contributor, b.bucket, coalesce(items, 0) AS items, CAST(coalesce(e, 0) AS DOUBLE) AS expected FROM (SELECT DISTINCT contributor FROM m) k CROSS JOIN b LEFT JOIN s ON s.contributor = k.contributor AND s.bucket = b.bucket
""")
def isolated_series(spark, sf_dir):
    """Isolated effort by contributor and bucket; shared items count for each."""
    e = F.col("value").cast("decimal(18,4)")
    events = table(spark, sf_dir, "events")
    own = events.select(F.col("user_id").alias("contributor"), F.col("event_id").alias("item"), "ts", *[e.alias(p) for p in POINTS])
    also = events.where("event_id % 4 = 0").select((F.col("user_id") + 1).alias("contributor"), F.col("event_id").alias("item"), "ts", *[e.alias(p) for p in POINTS])
    matches = own.union(also)
    return doubles(series.isolated_series(matches, custom_buckets(spark), matches).select("contributor", "bucket", "items", "expected"), "expected")


@query("""
WITH q AS (SELECT DISTINCT user_id, event_type FROM events), f AS (SELECT DISTINCT user_id, event_type, CASE WHEN user_id % 10 = 3 THEN 'timeout' END AS error FROM events WHERE user_id % 7 <> 2)
SELECT q.user_id, q.event_type, CASE WHEN f.user_id IS NULL THEN 'not-run' WHEN error IS NOT NULL THEN 'failed' ELSE 'complete' END AS status, false AS complete FROM q LEFT JOIN f ON f.user_id = q.user_id AND f.event_type = q.event_type
""")
def incomplete_report(spark, sf_dir):
    """Status of each part of a comparison, of which some failed and some did not run."""
    asked = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    done = asked.where("user_id % 7 <> 2").withColumn("error", F.when(F.col("user_id") % 10 == 3, "timeout"))
    return series.incomplete_report(asked, done, ["user_id", "event_type"]).select("user_id", "event_type", "status", "complete")


@query("""
SELECT l_orderkey, 'sha256:' || sha256(string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || ',"mode":"' || l_returnflag || '"}', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS digest FROM lineitem GROUP BY 1
""")
def semantic_digest(spark, sf_dir):
    """Digest of a report's meaning: its ordered rows as JSON, without what varies by run."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("mode"), F.current_timestamp().alias("took"))
    return series.semantic_digest(rows, ["l_orderkey"], ["line", "part", "supplier"], ["line", "part", "mode"])
