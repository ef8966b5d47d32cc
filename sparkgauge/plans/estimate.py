"""Estimator plans: tiered prices, ranges, splitting, roll-ups and costs over orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import dec, quarter
from ..functions.vocabulary import size_band
from ..operators import capabilities, facts, pricing
from ..sources import table
from .registry import doubles, query

TIERS = ((500, "0.05"), (1500, "0.03"), (None, "0.01"))


@query("""
WITH q AS (SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty, count(*) AS n FROM lineitem GROUP BY 1),
e AS (SELECT *, least(qty, 500) * 0.05 + greatest(least(qty, 1500) - 500, 0) * 0.03 + greatest(qty - 1500, 0) * 0.01 AS effort FROM q)
SELECT l_suppkey, CAST(qty AS DOUBLE) AS quantity, CAST(effort AS DOUBLE) AS effort,
  CAST(greatest(round(CAST(effort AS DECIMAL(18,4)) * 4, 0) / 4, 0.25) AS DOUBLE) AS expected FROM e
""")
def tiered_price(spark, sf_dir):
    """Marginal tiers of each supplier's quantity, rounded to quarter hours."""
    q = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))
    q = q.withColumn("effort", pricing.tiered(F.col("quantity"), TIERS))
    q = q.withColumn("expected", F.greatest(quarter(F.col("effort")), dec("0.25")))
    return doubles(q, "quantity", "effort", "expected")


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'routine' WHEN p_size <= 30 THEN 'moderate' WHEN p_size <= 45 THEN 'high' ELSE 'exceptional' END AS complexity,
  least(p_size, 10) * 0.5 + greatest(least(p_size, 30) - 10, 0) * 0.25 + greatest(p_size - 30, 0) * 0.1 AS drivers FROM part),
f AS (SELECT *, CASE complexity WHEN 'routine' THEN 0.85 WHEN 'moderate' THEN 1.0 WHEN 'high' THEN 1.25 ELSE 1.6 END AS factor FROM p)
SELECT p_partkey, complexity, CAST(greatest(round(CAST((1.5 + drivers) * factor AS DECIMAL(18,6)) * 4, 0) / 4, 0.25) AS DOUBLE) AS expected FROM f
""")
def expected_hours(spark, sf_dir):
    """Setup plus drivers, times complexity, on the increment."""
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").withColumn("complexity", F.when(size <= 10, "routine").when(size <= 30, "moderate").when(size <= 45, "high").otherwise("exceptional"))
    drivers = pricing.tiered(size.cast("decimal(18,4)"), ((10, "0.5"), (30, "0.25"), (None, "0.1")))
    return parts.select("p_partkey", "complexity", pricing.expected_hours("1.5", drivers, F.col("complexity")).cast("double").alias("expected"))


@query("""
WITH h AS (SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) / 100 * 4, 0) AS BIGINT) AS units FROM part),
n AS (SELECT *, greatest(1, CAST(ceil(units / 24.0) AS BIGINT)) AS parts FROM h),
x AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM n)
SELECT p_partkey, CAST(part AS INTEGER) AS part, CAST(parts AS INTEGER) AS parts, CAST((units // parts + CASE WHEN part <= units % parts THEN 1 ELSE 0 END) / 4.0 AS DOUBLE) AS part_hours FROM x
""")
def split_items(spark, sf_dir):
    """Expected hours dealt into work items of at most six hours."""
    parts = table(spark, sf_dir, "part").select("p_partkey", quarter((F.col("p_retailprice").cast("decimal(18,2)") / 100).cast("decimal(28,8)")).alias("expected"))
    return pricing.split_items(parts).select("p_partkey", "part", "parts", F.col("part_hours").cast("double").alias("part_hours"))


@query("""
WITH b AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,4)) AS q, CAST(1 + p_size % 5 AS BIGINT) AS parts FROM part),
x AS (SELECT *, unnest(range(1, parts + 1)) AS part, CAST(round(q / parts, 4) AS DECIMAL(18,4)) AS even FROM b)
SELECT p_partkey, CAST(part AS INTEGER) AS part, CAST(CASE WHEN part = parts THEN q - even * (parts - 1) ELSE even END AS DOUBLE) AS part_quantity FROM x
""")
def split_quantity(spark, sf_dir):
    """Quantities in even shares of four digits; the last part takes the rest."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("q"), (1 + F.col("p_size") % 5).alias("parts"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    return pricing.split_quantity(rows, "q").select("p_partkey", "part", F.col("part_quantity").cast("double").alias("part_quantity"))


@query("""
WITH o AS (SELECT l_orderkey, avg(CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.95 ELSE 0.55 END) AS p, bool_or(l_linestatus = 'F') AS tok, count(*) > 6 AS trunc FROM lineitem GROUP BY 1),
c AS (SELECT *, round(least(greatest((0.8 + CAST(round(p, 8) AS DECIMAL(18,8))) / 2 - CASE WHEN tok THEN 0.08 ELSE 0 END - CASE WHEN trunc THEN 0.04 ELSE 0 END, 0.2), 0.95)::DECIMAL(18,8), 2) AS conf FROM o)
SELECT l_orderkey, CAST(conf AS DOUBLE) AS confidence, CAST(greatest(0.35, 0.75 - (1 - conf) * 0.25) AS DOUBLE) AS low_factor, CAST(1.6 + (1 - conf) * 0.25 AS DOUBLE) AS high_factor FROM c
""")
def range_confidence(spark, sf_dir):
    """Confidence from provenance and penalties, and the range factors it widens."""
    kind = F.when(F.col("l_returnflag") == "A", "observed").when(F.col("l_returnflag") == "N", "measured").otherwise("inferred")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg(pricing.provenance_confidence(kind)), 8).alias("p"), F.bool_or(F.col("l_linestatus") == "F").alias("tok"), (F.count("*") > 6).alias("trunc")
    )
    rows = rows.withColumn("conf", pricing.confidence("0.8", F.col("p"), F.col("tok"), F.col("trunc")))
    low, high = pricing.range_factors("0.75", "1.6", F.col("conf"))
    return rows.select("l_orderkey", F.col("conf").cast("double").alias("confidence"), low.cast("double").alias("low_factor"), high.cast("double").alias("high_factor"))


@query("""
WITH i AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(18,2)) AS expected FROM lineitem)
SELECT l_returnflag, l_linestatus, CAST(sum(expected * 0.5) AS DOUBLE) AS low, CAST(sum(expected) AS DOUBLE) AS expected, CAST(sum(expected * 2) AS DOUBLE) AS high, count(*) AS items
FROM i GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def category_rollup(spark, sf_dir):
    """Three-point sums by category, and in total."""
    e = F.col("l_quantity").cast("decimal(18,2)")
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (e * dec("0.5")).alias("low"), e.alias("expected"), (e * 2).alias("high"))
    return doubles(pricing.category_rollup(items, ["l_returnflag", "l_linestatus"]), "low", "expected", "high")


@query("""
SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 1000 * 4, 0) / 4 AS DOUBLE) AS hours,
  CAST(round(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 1000 * 4, 0) / 4 * 160.5 AS DECIMAL(18,4)), 2) AS DOUBLE) AS cost FROM orders
""")
def rate_cost(spark, sf_dir):
    """Hours times the rate card's hourly rate, in cents."""
    hours = quarter((F.col("o_totalprice").cast("decimal(18,2)") / 1000).cast("decimal(28,8)"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", hours.alias("hours"))
    return doubles(rows.withColumn("cost", pricing.cost(F.col("hours"), "160.5")), "hours", "cost")


@query("""
SELECT s_suppkey, CAST(round(CAST(CAST(abs(s_acctbal) / 100 AS DECIMAL(20,4)) * CAST(72.99 / 50.53 / 0.75 AS DECIMAL(14,12)) AS DECIMAL(28,8)) / 5, 0) * 5 AS DOUBLE) AS hourly_rate FROM supplier
""")
def rate_derivation(spark, sf_dir):
    """Wages loaded and divided by utilization, to the nearest five."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", pricing.hourly_rate((F.abs("s_acctbal") / 100).cast("decimal(18,4)")).cast("double").alias("hourly_rate"))


@query("""
SELECT l_orderkey, l_linenumber, 'work-item:' || substr(sha256('seed' || chr(10) || l_orderkey || chr(10) || l_linenumber || chr(10) || l_returnflag), 1, 20) AS item_id FROM lineitem
""")
def stable_item_ids(spark, sf_dir):
    """Ids that depend on content alone."""
    token = pricing.item_id(F.lit("seed"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("work-item:"), token).alias("item_id"))


@query("""
WITH m AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS methods, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 10) AS branches, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 30) AS asyncs FROM lineitem GROUP BY 1)
SELECT l_suppkey, methods, branches, asyncs, CASE WHEN methods = 0 THEN 'routine' WHEN branches::DOUBLE / methods >= 0.75 OR asyncs::DOUBLE / methods >= 0.4 THEN 'high'
  WHEN branches::DOUBLE / methods < 0.12 AND asyncs::DOUBLE / methods < 0.08 THEN 'routine' ELSE 'moderate' END AS complexity FROM m
""")
def source_complexity(spark, sf_dir):
    """Complexity by branch and asynchronous density."""
    f, q = F.col("l_returnflag"), F.col("l_quantity")
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(f == "N").alias("methods"), F.count_if((f == "A") & (q > 10)).alias("branches"), F.count_if((f == "R") & (q > 30)).alias("asyncs")
    )
    return m.withColumn("complexity", facts.source_complexity(F.col("methods"), F.col("branches"), F.col("asyncs")))


@query("""
SELECT o_orderkey, CASE WHEN h IS NULL THEN NULL WHEN h <= 0 THEN 'zero' WHEN h <= 1 THEN 'xs' WHEN h <= 2 THEN 's' WHEN h <= 4 THEN 'm' WHEN h <= 8 THEN 'l' WHEN h <= 16 THEN 'xl' WHEN h <= 32 THEN '2xl' WHEN h <= 64 THEN '3xl' ELSE '4xl' END AS band
FROM (SELECT o_orderkey, o_totalprice / 4000 AS h FROM orders)
""")
def size_bands(spark, sf_dir):
    """Size band of each order's hours."""
    return table(spark, sf_dir, "orders").select("o_orderkey", size_band(F.col("o_totalprice") / 4000).alias("band"))


@query("""
WITH i AS (SELECT p_brand, p_size, round(CAST(p_retailprice AS DECIMAL(18,2)) / 100 * 4, 0) / 4 AS e FROM part),
g AS (SELECT p_brand, count(*) AS capabilities, sum(CAST(e AS DECIMAL(18,2))) AS expected, count(*) FILTER (p_size > 40) AS large FROM i GROUP BY 1),
t AS (SELECT sum(expected) AS total FROM g)
SELECT p_brand, capabilities, large, CAST(expected AS DOUBLE) AS expected, round(CAST(expected AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM g, t
""")
def capability_shares(spark, sf_dir):
    """Capabilities of a scope and their share of all hours."""
    e = quarter((F.col("p_retailprice").cast("decimal(18,2)") / 100).cast("decimal(28,8)"))
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("capabilities"), F.count_if(F.col("p_size") > 40).alias("large"), F.sum(e).alias("expected"))
    total = g.agg(F.sum("expected").alias("total"))
    return doubles(g.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("expected").cast("double") / F.col("total").cast("double"), 6)).drop("total"), "expected")  # one row


ESTIMATE = """f AS (SELECT 'r' || l_suppkey % 7 AS repo, l_orderkey::VARCHAR AS scope, l_returnflag AS k, CAST(l_quantity AS DECIMAL(18,4)) AS q, l_linenumber AS n FROM lineitem),
d AS (SELECT repo, scope, 'api-surface' AS rule, 'endpoints' AS driver, sum(q) AS v, 0.5 AS setup, 0.4 AS rate FROM f WHERE k = 'A' GROUP BY 1, 2 UNION ALL SELECT repo, scope, 'api-surface', 'controllers', count(*), 0.5, 0.4 FROM f WHERE k = 'A' GROUP BY 1, 2
  UNION ALL SELECT repo, scope, 'data-persistence', 'migrations', sum(q), 0.5, 0.3 FROM f WHERE k = 'N' GROUP BY 1, 2 UNION ALL SELECT repo, scope, 'data-persistence', 'db-sets', sum(n), 0.5, 0.3 FROM f WHERE k = 'N' GROUP BY 1, 2
  UNION ALL SELECT repo, scope, 'background-work', 'message-handlers', sum(q), 0.5, 0.5 FROM f WHERE k = 'R' GROUP BY 1, 2
  UNION ALL SELECT repo, scope, 'architecture-design', 'boundary-families', count(DISTINCT k), 1.25, 0.25 FROM f GROUP BY 1, 2
  UNION ALL SELECT repo, scope, 'manual-validation', 'specialized-boundaries', count(DISTINCT k), 0.5, 0.2 FROM f WHERE k <> 'A' GROUP BY 1, 2
  UNION ALL SELECT repo, scope, 'manual-validation', 'runtime-surfaces', sum(CASE k WHEN 'A' THEN greatest(q, 1) ELSE 1 END), 0.5, 0.2 FROM f WHERE k <> 'N' GROUP BY 1, 2
  UNION ALL SELECT repo, '.', 'specification-comprehension', 'semantic-families', count(DISTINCT k), 1, 0.25 FROM f GROUP BY 1 UNION ALL SELECT repo, '.', 'self-review', 'specialized-boundaries', count(DISTINCT k), 1, 0.25 FROM f GROUP BY 1),
c AS (SELECT repo, scope, rule, sum(v) AS quantity, max(setup) + sum(least(v, 10) * rate + greatest(v - 10, 0) * rate / 2) AS hours,
  CASE WHEN sum(CASE WHEN driver IN ('endpoints', 'migrations', 'message-handlers') THEN v ELSE 0 END) > max(CASE rule WHEN 'api-surface' THEN 40 ELSE 20 END) THEN 'high' ELSE 'moderate' END AS complexity FROM d GROUP BY 1, 2, 3),
e AS (SELECT *, greatest(round(CAST(hours * CASE complexity WHEN 'high' THEN 1.25 ELSE 1 END AS DECIMAL(18,6)) * 4, 0) / 4, 0.25) AS expected FROM c)"""


def line_facts(spark, sf_dir):
    """Order lines as facts: three kinds, with the quantity and the line's number as measurements."""
    flag, q = F.col("l_returnflag"), F.col("l_quantity").cast("decimal(38,10)")
    m = lambda name, x: F.struct(F.lit(name).alias("name"), x.cast("decimal(38,10)").alias("value"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_suppkey") % 7).alias("repo"),
        F.col("l_orderkey").cast("string").alias("scope"),
        F.concat_ws(":", F.lit("dotnet"), "l_orderkey", "l_linenumber").alias("id"),
        F.when(flag == "A", "api-surface").when(flag == "N", "data-access").otherwise("background-work").alias("kind"),
        F.lit("observed").alias("source_kind"),
        F.when(flag == "A", F.array(m("endpoints", q), m("controllers", F.lit(1)))).when(flag == "N", F.array(m("migrations", q), m("db-sets", F.col("l_linenumber")))).otherwise(F.array(m("message-handlers", q))).alias("measurements"),
        F.array().cast("array<string>").alias("tags"),
    )


@query(f"WITH {ESTIMATE} SELECT repo, scope, rule, complexity, CAST(quantity AS DOUBLE) AS quantity, CAST(expected AS DOUBLE) AS expected FROM e")
def estimate_capabilities(spark, sf_dir):
    """Facts to drivers to priced capabilities of all rules that they feed."""
    scoped, whole = capabilities.represented(line_facts(spark, sf_dir))
    return doubles(scoped.unionByName(whole).select("repo", "scope", "rule", "complexity", "quantity", "expected"), "quantity", "expected")


@query(f"""WITH {ESTIMATE}, p AS (SELECT *, greatest(1, CAST(ceil(expected / 6.0) AS BIGINT)) AS parts, CAST(expected * 4 AS BIGINT) AS units, CASE WHEN scope = '.' THEN 0.55 ELSE 0.6 END AS lf, CASE WHEN scope = '.' THEN 1.7 ELSE 1.65 END AS hf FROM e),
x AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM p), h AS (SELECT *, CAST((units // parts + CASE WHEN part <= units % parts THEN 1 ELSE 0 END) / 4.0 AS DECIMAL(18,2)) AS ph FROM x)
SELECT repo, rule, count(*) AS items, CAST(sum(least(round(CAST(ph * lf AS DECIMAL(18,6)) * 4, 0) / 4, ph)) AS DOUBLE) AS low, CAST(sum(ph) AS DOUBLE) AS expected, CAST(sum(greatest(round(CAST(ph * hf AS DECIMAL(18,6)) * 4, 0) / 4, ph)) AS DOUBLE) AS high FROM h GROUP BY 1, 2
""")
def estimate_items(spark, sf_dir):
    """Work items of those capabilities with their ranges, summed by repository and rule."""
    items = capabilities.estimate(line_facts(spark, sf_dir))["items"]
    return doubles(items.groupBy("repo", "rule").agg(F.count("*").alias("items"), *[F.sum(h).alias(h) for h in ("low", "expected", "high")]), "low", "expected", "high")


@query("""
WITH s AS (SELECT 'r' || l_suppkey % 7 AS repo, count(*) FILTER (l_returnflag = 'A') AS surfaces FROM lineitem GROUP BY 1)
SELECT repo, 'gap-system-tests' AS rule, surfaces::DOUBLE AS value FROM s WHERE surfaces > 0 UNION ALL SELECT repo, 'gap-documentation', 0 FROM s
""")
def estimate_gaps(spark, sf_dir):
    """Work that repositories without tests and documents lack."""
    return doubles(capabilities.gaps(line_facts(spark, sf_dir)).select("repo", "rule", "value"), "value")


GAP_FACTS = """g AS (SELECT 'r' || l_suppkey % 23 AS repo, l_suppkey % 23 AS k, l_linenumber AS n, l_quantity AS q FROM lineitem), s AS (SELECT repo, count(*) FILTER (n = 1) AS scopes, count(*) FILTER (n = 1 AND q > 45) AS runnable, count(*) FILTER (n = 2 AND k % 3 = 0) AS tests,
  count(*) FILTER (n = 2 AND k % 3 = 0 AND k % 2 = 0) AS system, count(*) FILTER (n = 5) AS surfaces, count(*) FILTER (n = 3 AND k % 4 = 0) AS docs, count(*) FILTER (n = 4 AND k % 5 = 0) AS ci FROM g GROUP BY 1)"""


@query(f"""WITH {GAP_FACTS} SELECT repo, 'gap-automated-tests' AS rule, greatest(surfaces, 1)::DOUBLE AS value FROM s WHERE scopes > 0 AND tests = 0 UNION ALL SELECT repo, 'gap-system-tests', surfaces FROM s WHERE surfaces > 0 AND system = 0
UNION ALL SELECT repo, 'gap-documentation', 0 FROM s WHERE docs = 0 UNION ALL SELECT repo, 'gap-ci', scopes FROM s WHERE ci = 0 AND (scopes > 1 OR runnable > 0)""")
def gap_rules(spark, sf_dir):
    """All four gaps: tests, system tests, documentation and CI that repositories lack."""
    k, n = F.col("l_suppkey") % 23, F.col("l_linenumber")
    kind = F.when(n == 1, "dotnet-project").when((n == 2) & (k % 3 == 0), "dotnet-test").when((n == 3) & (k % 4 == 0), "documentation").when((n == 4) & (k % 5 == 0), "ci-configuration").when(n == 5, "api-surface").otherwise("other")
    tags = F.when((n == 1) & (F.col("l_quantity") > 45), F.array(F.lit("scope:runnable"))).when((n == 2) & (k % 2 == 0), F.array(F.lit("test-type:integration"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), k).alias("repo"), kind.alias("kind"), tags.alias("tags"))
    return doubles(capabilities.gaps(rows).select("repo", "rule", "value"), "value")


@query("""
WITH f AS (SELECT 'r' || l_suppkey % 7 AS repo, l_orderkey::VARCHAR AS scope, l_linenumber AS n, CAST(l_quantity AS DECIMAL(18,4)) AS q FROM lineitem), h AS (SELECT repo, scope, CAST(sum(q) / 4 AS DECIMAL(18,4)) AS hours FROM f GROUP BY 1, 2),
m AS (SELECT repo, scope, bool_or(n = 1) AS measured, avg(CASE WHEN n = 1 THEN q * 2 END) AS a, avg(CASE WHEN n = 2 THEN q * 2 END) AS b FROM f WHERE n <= 2 GROUP BY 1, 2), p AS (SELECT *, CAST(CASE WHEN measured THEN a ELSE b END AS DECIMAL(18,4)) AS percent FROM m)
SELECT p.repo, p.scope, measured, CAST(percent AS DOUBLE) AS percent, round(CAST(greatest(hours * percent / 100, 0.01) AS DOUBLE), 3) AS value, CASE WHEN percent >= 100 THEN 'high' WHEN percent >= 80 THEN 'moderate' ELSE 'routine' END AS complexity FROM p JOIN h USING (repo, scope)
""")
def coverage_capability(spark, sf_dir):
    """Covered implementation hours of scopes; measured coverage beats a declared threshold."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("decimal(18,4)")
    key = [F.concat(F.lit("r"), F.col("l_suppkey") % 7).alias("repo"), F.col("l_orderkey").cast("string").alias("scope")]
    lines = table(spark, sf_dir, "lineitem")
    hours = lines.select(*key, q.alias("q")).groupBy("repo", "scope").agg((F.sum("q") / 4).cast("decimal(18,4)").alias("hours"))
    m = F.array(F.struct(F.lit("line-coverage").alias("name"), (q * 2).cast("decimal(38,10)").alias("value")))
    rows = lines.where(n <= 2).select(*key, F.lit("coverage").alias("kind"), F.when(n == 1, "measured").otherwise("declared-assumed").alias("source_kind"), F.array().cast("array<string>").alias("tags"), m.alias("measurements"))
    out = capabilities.coverage_drivers(rows, hours)
    return out.select("repo", "scope", "measured", F.col("percent").cast("double").alias("percent"), F.round(F.col("value").cast("double"), 3).alias("value"), "complexity")


@query("""
WITH f AS (SELECT l_suppkey % 11 AS repo, l_linenumber AS n FROM lineitem), k AS (SELECT repo, count(DISTINCT CASE n WHEN 1 THEN 'api-surface' WHEN 2 THEN 'data-access' WHEN 3 THEN 'validation' END) AS f, count(*) FILTER (n = 4) AS r, count(*) FILTER (n = 5) AS s FROM f GROUP BY 1)
SELECT repo, 'decision-surfaces' AS driver, (f + r + s)::DOUBLE AS value FROM k WHERE f + r + s > 0
""")
def recreation_design(spark, sf_dir):
    """What a recreation must decide again: boundaries, references and scopes."""
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "api-surface").when(n == 2, "data-access").when(n == 3, "validation").when(n == 4, "project-reference").when(n == 5, "dotnet-project").otherwise("other")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 11).alias("repo"), kind.alias("kind"))
    return doubles(capabilities.recreation_drivers(rows).select("repo", "driver", "value"), "value")


@query("""
WITH b AS (SELECT l_suppkey % 7 AS repo, l_orderkey::VARCHAR AS scope, sum(CAST(l_quantity AS DECIMAL(18,2))) AS v, count(*) FILTER (l_returnflag = 'N') AS c, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT repo, scope, round(CAST(v AS DOUBLE) * round(c::DOUBLE / n, 6), 4) AS value FROM b WHERE c > 0
""")
def scaled_drivers(spark, sf_dir):
    """Drivers of a source backbone times the share of its canonical production files."""
    key = [(F.col("l_suppkey") % 7).alias("repo"), F.col("l_orderkey").cast("string").alias("scope")]
    lines = table(spark, sf_dir, "lineitem").select(*key, F.col("l_quantity").cast("decimal(18,2)").alias("q"), "l_returnflag")
    sums = lines.groupBy("repo", "scope").agg(F.sum("q").cast("decimal(38,10)").alias("value"), F.round(F.count_if(F.col("l_returnflag") == "N") / F.count("*"), 6).alias("factor"))
    driven = sums.select("repo", "scope", F.lit("dotnet-source-backbone").alias("rule"), F.lit("methods").alias("driver"), "value")
    return capabilities.scaled(driven, sums.select("repo", "scope", "factor")).select("repo", "scope", F.round(F.col("value").cast("double"), 4).alias("value"))
