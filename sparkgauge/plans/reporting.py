"""Reporting plans: views, queues, top scopes, explanations, agreement and payload."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import dec
from ..operators import reports
from ..sources import table
from .registry import doubles, query


@query("""
WITH r AS (SELECT p_brand, p_partkey, CAST(p_retailprice AS DOUBLE) AS hours, p_size / 50.0 AS sure FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hours DESC, p_partkey) AS big, CASE WHEN sure < 0.75 THEN row_number() OVER (PARTITION BY p_brand, sure < 0.75 ORDER BY sure, hours DESC, p_partkey) END AS unsure FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN big <= 6 THEN big ELSE 6 + unsure END) AS place FROM b WHERE big <= 6 OR unsure <= 6)
SELECT p_brand, p_partkey, place, CASE WHEN big <= 6 AND unsure <= 6 THEN 'low-confidence+material-effort' WHEN big <= 6 THEN 'material-effort' ELSE 'low-confidence' END AS reasons FROM c WHERE place <= 12
""")
def review_queue(spark, sf_dir):
    """The largest and the least certain capabilities of each scope."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("hours"), (F.col("p_size") / 50.0).alias("sure"))
    return reports.review_queue(rows, ["p_brand"], "p_partkey", "hours", "sure").select("p_brand", "p_partkey", "place", "reasons")


@query("""
WITH s AS (SELECT l_suppkey::VARCHAR AS scope, sum(CAST(l_quantity AS DECIMAL(18,2))) AS hours FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY hours DESC, scope) AS n FROM s)
SELECT scope, CAST(hours AS DOUBLE) AS hours, 1::BIGINT AS members FROM r WHERE n <= 20 UNION ALL SELECT '(omitted)', CAST(sum(hours) AS DOUBLE), count(*) FROM r WHERE n > 20 HAVING count(*) > 0
""")
def scope_topk(spark, sf_dir):
    """The twenty largest scopes and what is left out."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("scope")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("hours"))
    return doubles(reports.top_with_rest(s, "scope", "hours"), "hours")


@query("""
WITH i AS (SELECT l_suppkey, CAST(l_quantity AS DECIMAL(18,4)) AS h, CAST(0.5 + l_discount * 4 AS DECIMAL(9,4)) AS c FROM lineitem)
SELECT l_suppkey, CAST(CASE WHEN sum(h) = 0 THEN 0 ELSE round(CAST(CAST(sum(CAST(h * c AS DECIMAL(28,8))) AS DOUBLE) / CAST(sum(h) AS DOUBLE) AS DECIMAL(18,8)), 2) END AS DOUBLE) AS confidence FROM i GROUP BY 1
""")
def weighted_confidence(spark, sf_dir):
    """Confidence weighted by hours."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", (0.5 + F.col("l_discount") * 4).cast("decimal(9,4)").alias("sure"))
    return rows.groupBy("l_suppkey").agg(reports.weighted_confidence("l_quantity", "sure").cast("double").alias("confidence"))


@query("""
SELECT regexp_replace('item:' || l_orderkey || ':part-' || lpad(l_linenumber::VARCHAR, 4, '0'), ':part-[0-9]+$', '') AS capability, count(*) AS items, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS expected FROM lineitem GROUP BY 1
""")
def capability_groups(spark, sf_dir):
    """Parts of a work item put together again."""
    item = F.concat(F.lit("item:"), F.col("l_orderkey"), F.lit(":part-"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "lineitem").select(reports.capability_of(item).alias("capability"), F.col("l_quantity").cast("decimal(18,2)").alias("e"))
    return rows.groupBy("capability").agg(F.count("*").alias("items"), F.sum("e").cast("double").alias("expected"))


@query("""
SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS payload_bytes, length(coalesce(text, '')) AS payload_chars, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS payload_tokens FROM conversations
""")
def payload_meter(spark, sf_dir):
    """Bytes, characters and tokens of each turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in reports.payload(F.col("text")).items()])


@query("""
WITH i AS (SELECT o_orderkey, unnest([o_orderkey * 10 + 1, o_orderkey * 10 + 9]) AS fact FROM orders), f AS (SELECT l_orderkey * 10 + l_linenumber AS fact, l_partkey FROM lineitem)
SELECT i.o_orderkey, i.fact, min(f.l_partkey) AS l_partkey, count(f.fact) = 0 AS missing FROM i LEFT JOIN f ON i.fact = f.fact GROUP BY 1, 2
""")
def explain_join(spark, sf_dir):
    """Evidence of each item, with what is missing marked."""
    key = F.col("o_orderkey") * 10
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.array(key + 1, key + 9).alias("evidence"))
    known = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact")).agg(F.min("l_partkey").alias("l_partkey"))
    return reports.explained(items, known, "o_orderkey", "evidence", "fact")


@query("""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS same, sum(quality) AS a1, sum(1 - toxic) AS b1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
k AS (SELECT *, same::DOUBLE / n AS seen, (a1::DOUBLE * b1 + (n - a1)::DOUBLE * (n - b1)) / (n::DOUBLE * n) AS chance FROM c)
SELECT n, same, round(seen, 6) AS agreement, round((seen - chance) / nullif(1 - chance, 0), 6) AS kappa FROM k
""")
def label_agreement(spark, sf_dir):
    """Agreement of two reviewers' verdicts."""
    rows = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean"))
    return reports.agreement(rows, "quality", "clean")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1
""")
def trend_matrix(spark, sf_dir):
    """Contributor by bucket matrix."""
    points = table(spark, sf_dir, "events").withColumn("one", F.lit(1).cast("long"))
    return reports.matrix(points, "user_id", "event_type", "one", ["click", "error", "purchase", "signup", "view"])


@query("""
SELECT l_returnflag AS category, count(*) AS items, CAST(sum(q * 0.5) AS DOUBLE) AS low, CAST(sum(q) AS DOUBLE) AS expected, CAST(sum(q * 2) AS DOUBLE) AS high, CAST(round(CAST(CAST(sum(CAST(q * c AS DECIMAL(28,8))) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS DECIMAL(18,8)), 2) AS DOUBLE) AS confidence
FROM (SELECT l_returnflag, CAST(l_quantity AS DECIMAL(18,4)) AS q, CAST(0.9 - l_discount AS DECIMAL(9,4)) AS c FROM lineitem) GROUP BY 1
""")
def category_view(spark, sf_dir):
    """Hours and confidence by category."""
    e = F.col("l_quantity").cast("decimal(18,2)")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), (e * dec("0.5")).alias("low"), e.alias("expected"), (e * 2).alias("high"), (0.9 - F.col("l_discount")).cast("decimal(9,4)").alias("confidence"))
    return doubles(reports.view(items, ["category"]), "low", "expected", "high", "confidence")


@query("""
WITH a AS (SELECT l_orderkey AS item_id, l_linenumber AS n, l_partkey AS part, CASE WHEN l_linenumber = 2 THEN '' ELSE 'why' END AS reason, CAST(l_quantity AS DECIMAL(18,2)) AS e FROM lineitem), i AS (SELECT o_orderkey AS item_id, CAST(o_orderkey % 50 AS DECIMAL(18,2)) AS e FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT a.item_id, n, part, reason, a.e - CASE WHEN n = 3 THEN 100 ELSE 1 END AS low, a.e, a.e + 1 AS high, i.e AS ie FROM a LEFT JOIN i ON i.item_id = a.item_id)
SELECT item_id, n, part, CASE WHEN ie IS NULL THEN 'unknown-item' WHEN reason = '' THEN 'no-reason' WHEN low < 0 THEN 'not-ordered' WHEN low = ie - 1 AND e = ie AND high = ie + 1 THEN 'no-change' ELSE 'ok' END AS status, CAST(e - ie AS DOUBLE) AS expected_delta FROM j
""")
def adjustment_checks(spark, sf_dir):
    """Reviewers' proposed ranges against their items."""
    e, n = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_linenumber")
    proposed = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"), (e - F.when(n == 3, 100).otherwise(1)).cast("decimal(18,2)").alias("low"), e.alias("expected"), (e + 1).cast("decimal(18,2)").alias("high"), F.when(n == 2, "").otherwise("why").alias("reason")
    )
    own = (F.col("o_orderkey") % 50).cast("decimal(18,2)")
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select("o_orderkey", own.alias("expected"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id")).join(orders, "o_orderkey")
    items = items.select("item_id", (F.col("expected") - 1).cast("decimal(18,2)").alias("low"), "expected", (F.col("expected") + 1).cast("decimal(18,2)").alias("high"))
    out = reports.adjustment_checks(proposed, items.distinct())
    at = F.split("item_id", ":")
    return out.select(at[0].cast("long").alias("item_id"), at[1].cast("int").alias("n"), at[2].cast("long").alias("part"), "status", F.col("expected_delta").cast("double").alias("expected_delta"))


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_returnflag <> 'N'), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_linenumber <= 3)
SELECT coalesce(a.k, b.k) AS l_suppkey, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) AS either, round(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL)::DOUBLE / count(*), 6) AS rate FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i GROUP BY 1
""")
def overlap_rate(spark, sf_dir):
    """How far two reviewers' choices overlap."""
    lines = table(spark, sf_dir, "lineitem")
    return reports.overlap_rate(lines.where("l_returnflag <> 'N'"), lines.where("l_linenumber <= 3"), ["l_suppkey"], "l_partkey")


@query("""
SELECT 'order-7' AS asked, o_orderkey AS item FROM orders WHERE o_custkey = 7
""")
def review_query(spark, sf_dir):
    """A reviewer asks for one capability's items; the answer is bounded."""
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), "o_custkey", F.lit(":part-"), "o_orderkey").alias("item_id"), "o_orderkey")
    found = reports.review_query("capability", "order-7", items, None, most=1000)
    return found.select(F.lit("order-7").alias("asked"), F.col("o_orderkey").alias("item"))
