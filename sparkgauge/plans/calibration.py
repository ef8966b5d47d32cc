"""Calibration plans: error metrics, ranks, quantiles, held-out baselines, distances and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, stats
from ..sources import table
from .registry import doubles, query

PAIRS = """pairs AS (SELECT o_orderkey, c_mktsegment AS segment, CAST(o_totalprice AS DECIMAL(18,2)) AS reviewed, CAST(candidate AS DECIMAL(18,4)) AS candidate FROM orders
  JOIN (SELECT l_orderkey, sum(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))) AS candidate FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""


def pairs(spark, sf_dir):
    """Reviewed totals of orders with the sum of their lines as candidates."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (F.sum((F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)"))).cast("decimal(18,4)").alias("candidate")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("reviewed"))
    segments = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return orders.join(lines, "o_orderkey").join(segments, "c_custkey").select("o_orderkey", "segment", "reviewed", "candidate")


@query(f"""
WITH {PAIRS}, e AS (SELECT *, candidate - reviewed AS d FROM pairs)
SELECT segment, count(*) AS n, floor(CAST(sum(abs(d)) AS DOUBLE) / count(*) * 10000 + 0.5) / 10000 AS mae, round(quantile_cont(abs(d)::DOUBLE, 0.5), 4) AS median_ae,
  round(sqrt(CAST(sum(CAST(d * d AS DECIMAL(38,8))) AS DOUBLE) / count(*)), 4) AS rmse, round(CAST(sum(d) AS DOUBLE) / count(*), 4) AS signed_error,
  round(CAST(sum(abs(d)) AS DOUBLE) / CAST(sum(reviewed) AS DOUBLE), 4) AS wape, round(CAST(sum(d) AS DOUBLE) / CAST(sum(reviewed) AS DOUBLE), 4) AS bias FROM e GROUP BY 1
""")
def point_metrics(spark, sf_dir):
    """Error metrics of candidates against reviewed totals."""
    return stats.point_metrics(pairs(spark, sf_dir), ["segment"], "reviewed", "candidate")


@query(f"""
WITH {PAIRS}, r AS (SELECT *, CAST(candidate * 0.7 AS DECIMAL(18,4)) AS low, CAST(candidate * 1.3 AS DECIMAL(18,4)) AS high FROM pairs)
SELECT segment, count(*) AS n, count(*) FILTER (reviewed BETWEEN low AND high) AS covered, round(count(*) FILTER (reviewed BETWEEN low AND high)::DOUBLE / count(*), 4) AS coverage,
  round(CAST(sum(high - low) AS DOUBLE) / count(*), 4) AS mean_width, round(CAST(sum(high - low) AS DOUBLE) / CAST(sum(reviewed) AS DOUBLE), 4) AS relative_width FROM r GROUP BY 1
""")
def interval_metrics(spark, sf_dir):
    """Coverage and widths of candidates' ranges."""
    c = F.col("candidate")
    rows = pairs(spark, sf_dir).withColumns({"low": (c * F.lit("0.7").cast("decimal(3,1)")).cast("decimal(18,4)"), "high": (c * F.lit("1.3").cast("decimal(3,1)")).cast("decimal(18,4)")})
    return stats.interval_metrics(rows, ["segment"], "reviewed", "low", "high")


@query("""
WITH v AS (SELECT o_custkey, count(*) AS x, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS y FROM orders GROUP BY 1), s AS (SELECT c_mktsegment AS segment, x, y FROM v JOIN customer ON o_custkey = c_custkey),
r AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY x) * 2 + count(*) OVER (PARTITION BY segment, x) - 1 AS a, rank() OVER (PARTITION BY segment ORDER BY y) * 2 + count(*) OVER (PARTITION BY segment, y) - 1 AS b FROM s),
m AS (SELECT segment, count(*) AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a * a)::DOUBLE AS saa, sum(b * b)::DOUBLE AS sbb, sum(a * b)::DOUBLE AS sab FROM r GROUP BY 1)
SELECT segment, n, round((n * sab - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)), 8) AS rho FROM m
""")
def spearman(spark, sf_dir):
    """Rank correlation of order counts and totals by segment."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("x"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("y"))
    rows = v.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")
    return stats.spearman(rows, ["segment"], "x", "y")


@query("""
SELECT c_mktsegment, quantile_disc(c_acctbal, 0.8) AS quantile, count(*) AS n FROM customer GROUP BY 1
""")
def nearest_rank_q80(spark, sf_dir):
    """Nearest-rank 80 % quantile by segment."""
    return stats.nearest_rank(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")


@query("""
WITH v AS (SELECT c_nationkey, round(abs(c_acctbal) / 100) * 100 AS e FROM customer), k AS (SELECT DISTINCT c_nationkey AS held FROM v)
SELECT held AS c_nationkey, quantile_disc(e, 0.8) AS quantile, (SELECT count(*) FROM v x WHERE x.c_nationkey = held) AS own_n FROM k JOIN v ON v.c_nationkey <> held GROUP BY 1, 3
""")
def loro_baseline(spark, sf_dir):
    """Quantile of all other nations' errors for each nation held out."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", (F.round(F.abs("c_acctbal") / 100) * 100).alias("e"))
    return stats.leave_one_out_quantile(rows, "c_nationkey", "e")


@query("""
WITH v AS (SELECT p_size AS bucket, p_brand AS repo, p_retailprice AS e FROM part),
b AS (SELECT bucket, count(*) AS n, count(DISTINCT repo) AS repos, quantile_disc(e, 0.8) AS own FROM v GROUP BY 1), g AS (SELECT quantile_disc(e, 0.8) AS everywhere FROM v)
SELECT bucket, n, repos, CASE WHEN n >= 5 AND repos >= 4 THEN own ELSE everywhere END AS quantile, CASE WHEN n >= 5 AND repos >= 4 THEN 'bucket' ELSE 'global' END AS source FROM b, g
""")
def conditioned_intervals(spark, sf_dir):
    """Quantiles by feature bucket, with a fallback where support is thin."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("bucket"), F.col("p_brand").alias("repo"), F.col("p_retailprice").alias("e"))
    return stats.conditioned_intervals(rows, "bucket", "repo", "e", 5, 4)


@query("""
WITH r AS (SELECT p_partkey, p_brand AS repo, p_type AS cat, p_size // 10 AS band, p_size % 3 AS eco FROM part),
s AS (SELECT *, count(*) OVER (PARTITION BY cat, band, eco) - count(*) OVER (PARTITION BY cat, band, eco, repo) AS s0, count(*) OVER (PARTITION BY cat, band) - count(*) OVER (PARTITION BY cat, band, repo) AS s1,
  count(*) OVER (PARTITION BY cat) - count(*) OVER (PARTITION BY cat, repo) AS s2 FROM r)
SELECT p_partkey, CASE WHEN s0 >= 3 THEN 0 WHEN s1 >= 3 THEN 1 ELSE 2 END AS level, CASE WHEN s0 >= 3 THEN s0 WHEN s1 >= 3 THEN s1 ELSE s2 END AS support FROM s
""")
def support_levels(spark, sf_dir):
    """First level with enough rows in other repositories."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("repo"), F.col("p_type").alias("cat"), F.expr("p_size div 10").alias("band"), (F.col("p_size") % 3).alias("eco"))
    return stats.support_levels(rows, "repo", [["cat", "band", "eco"], ["cat", "band"], ["cat"]]).select("p_partkey", "level", "support")


@query("""
WITH p AS (SELECT c_custkey AS key, c_nationkey AS repo, list_sort(list_distinct(list('s' || (o_orderkey % 6)))) AS f FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
d AS (SELECT a.key, b.key AS neighbour, round(1 - len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(list_concat(a.f, b.f))), 8) AS distance FROM p a JOIN p b ON a.repo <> b.repo)
SELECT key, neighbour, distance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS n FROM d) WHERE n = 1
""")
def jaccard_nearest(spark, sf_dir):
    """Nearest profile of another nation by Jaccard distance of order kinds."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.concat(F.lit("s"), F.col("o_orderkey") % 6).alias("f"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("repo"))
    profiles = orders.join(people, "key").groupBy("key", "repo").agg(F.array_sort(F.collect_set("f")).alias("features"))
    return stats.nearest_profile(profiles, "key", "repo", "features")


@query("""
WITH m AS (SELECT doc_id, len(string_split(text, ' ')) AS tokens, lang FROM documents)
SELECT lang, count(*) AS n, quantile_disc(tokens, 0.5) AS p50, quantile_disc(tokens, 0.9) AS p90, max(tokens) AS largest, round(count(*) FILTER (tokens > 200)::DOUBLE / count(*), 6) AS share_over FROM m GROUP BY 1
""")
def callable_percentiles(spark, sf_dir):
    """Nearest-rank percentiles and the share of oversized units."""
    rows = table(spark, sf_dir, "documents").select("lang", F.size(F.split("text", " ", -1)).cast("long").alias("tokens"))
    return stats.callable_shape(rows, ["lang"], "tokens", 200)


@query(f"""
WITH {PAIRS}, e AS (SELECT segment, o_orderkey, abs(candidate - reviewed) AS s FROM pairs),
w AS (SELECT *, row_number() OVER g AS rank, CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY segment) AS DOUBLE) AS sh, CAST(sum(s) OVER (g ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto, CAST(sum(s) OVER (PARTITION BY segment) AS DOUBLE) AS total
  FROM e WINDOW g AS (PARTITION BY segment ORDER BY s DESC, o_orderkey))
SELECT segment, o_orderkey, rank, floor(sh * 1000000 + 0.5) / 1000000 AS share, floor(upto / total * 1000000 + 0.5) / 1000000 AS cumulative, round((upto - CAST(s AS DOUBLE)) / total, 6) < 0.8 AS material FROM w
""")
def residual_pareto(spark, sf_dir):
    """Errors by size with cumulative shares and material ones marked."""
    rows = pairs(spark, sf_dir).select("segment", "o_orderkey", (F.col("candidate") - F.col("reviewed")).alias("error"))
    return stats.residual_pareto(rows, ["segment"], "o_orderkey", "error").select("segment", "o_orderkey", "rank", "share", "cumulative", "material")


CASES = "cases AS (SELECT s_suppkey AS case_id, CAST(s_acctbal AS DECIMAL(18,2)) AS hours FROM supplier)"


@query(f"""
WITH {CASES}, a AS (SELECT case_id AS subject, case_id + 1 AS reference, -500::DECIMAL(18,2) AS least, 4000::DECIMAL(18,2) AS most FROM cases)
SELECT subject, reference, CAST(s.hours - r.hours AS DOUBLE) AS delta, coalesce(s.hours - r.hours BETWEEN least AND most, false) AS passed FROM a JOIN cases s ON subject = s.case_id LEFT JOIN cases r ON reference = r.case_id
""")
def mutation_checks(spark, sf_dir):
    """Metamorphic assertions between pairs of cases."""
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_acctbal").cast("decimal(18,2)").alias("hours"))
    asserts = cases.select(F.col("case_id").alias("subject"), (F.col("case_id") + 1).alias("reference"), F.lit(-500).cast("decimal(18,2)").alias("least"), F.lit(4000).cast("decimal(18,2)").alias("most"))
    return stats.mutation_checks(cases, asserts).select("subject", "reference", F.col("delta").cast("double").alias("delta"), "passed")


GRAPH = "e AS (SELECT DISTINCT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation)"


def nation_graph(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("src"), ((7 * F.col("n_nationkey") + 3) % 25).alias("dst")).union(n.select("n_nationkey", "n_regionkey"))


@query(f"""
WITH {GRAPH}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, (SELECT count(DISTINCT dst) FROM e WHERE src = node) AS fan_out, (SELECT count(DISTINCT src) FROM e WHERE dst = node) AS fan_in FROM n
""")
def fan_in_out(spark, sf_dir):
    """Distinct neighbours of each node."""
    return graph.degrees(nation_graph(spark, sf_dir))


@query(f"""
WITH RECURSIVE {GRAPH}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(x, y) AS (SELECT src, dst FROM e UNION SELECT r.x, e.dst FROM r JOIN e ON r.y = e.src),
m AS (SELECT a.x, a.y FROM r a JOIN r b ON a.x = b.y AND a.y = b.x)
SELECT node, coalesce((SELECT count(DISTINCT y) FROM m WHERE x = node), 0) AS cyclic_size FROM n
""")
def scc_sizes(spark, sf_dir):
    """Sizes of the cyclic components that nodes belong to."""
    return graph.cyclic_sizes(nation_graph(spark, sf_dir)).select("node", F.col("cyclic_size").cast("long").alias("cyclic_size"))


@query(f"""
WITH RECURSIVE {GRAPH}, r(head, node) AS (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey IN (1, 6, 11) UNION SELECT r.head, e.dst FROM r JOIN e ON r.node = e.src)
SELECT head, node FROM r
""")
def head_reachability(spark, sf_dir):
    """Nodes that each head reaches."""
    start = table(spark, sf_dir, "nation").where("n_nationkey in (1, 6, 11)").select(F.col("n_nationkey").alias("node"))
    return graph.reachable(nation_graph(spark, sf_dir), start)


@query("""
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(corr(a, b), 6) END AS pearson FROM (SELECT user_id, value AS a, CAST(json_extract(props, '$.k') AS DOUBLE) AS b FROM events) GROUP BY 1 HAVING count(*) > 1
""")
def pearson_correlation(spark, sf_dir):
    """Correlation of two measures of a subject."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("a"), k.alias("b"))
    return stats.pearson(rows, ["user_id"], "a", "b").where("n > 1")


@query("""
WITH s AS (SELECT 'segment' AS dimension, c_mktsegment AS slice, c_acctbal FROM customer UNION ALL SELECT 'nation', c_nationkey::VARCHAR, c_acctbal FROM customer UNION ALL SELECT 'band', CASE WHEN abs(c_acctbal) <= 1000 THEN 'small' ELSE 'large' END, c_acctbal FROM customer)
SELECT dimension, slice, count(*) AS n, CAST(sum(abs(CAST(c_acctbal AS DECIMAL(18,2)))) AS DOUBLE) AS abs_sum FROM s GROUP BY 1, 2
""")
def slice_evaluation(spark, sf_dir):
    """One pass over three dimensions of slices."""
    c = table(spark, sf_dir, "customer")
    dims = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "band": F.when(F.abs("c_acctbal") <= 1000, "small").otherwise("large")}
    rows = stats.slices(c, dims, F.abs(F.col("c_acctbal").cast("decimal(18,2)")))
    return rows.select("dimension", "slice", "n", F.col("total").cast("double").alias("abs_sum"))


@query("""
WITH q AS (SELECT p_size AS bucket, quantile_disc(p_retailprice, 0.8) AS q80 FROM part GROUP BY 1)
SELECT count(*) AS buckets, count(*) FILTER (q80 < before) AS violations FROM (SELECT q80, lag(q80) OVER (ORDER BY bucket) AS before FROM q)
""")
def monotonic_violations(spark, sf_dir):
    """Ordered buckets whose quantile falls below the one before."""
    q = stats.nearest_rank(table(spark, sf_dir, "part").select("p_size", "p_retailprice"), ["p_size"], "p_retailprice")
    return stats.monotonic_violations(q, "p_size", "quantile")


@query("""
WITH r AS (SELECT p_partkey, p_brand AS repo, p_type AS cat, p_size // 5 AS band, p_size % 3 AS eco, p_partkey % 2 AS cx FROM part),
s AS (SELECT p_partkey, """ + ", ".join(f"""count(*) OVER ({w}) - count(*) OVER ({w}{', ' if w else 'PARTITION BY '}repo) AS o{i},
  (SELECT count(DISTINCT x.repo) FROM r x WHERE x.repo <> r.repo{c}) AS q{i}""" for i, (w, c) in enumerate((("PARTITION BY cat, band, eco, cx", " AND x.cat = r.cat AND x.band = r.band AND x.eco = r.eco AND x.cx = r.cx"), ("PARTITION BY cat, band, eco", " AND x.cat = r.cat AND x.band = r.band AND x.eco = r.eco"), ("PARTITION BY cat, band", " AND x.cat = r.cat AND x.band = r.band"), ("PARTITION BY cat", " AND x.cat = r.cat"), ("", "")))) + """ FROM r),
l AS (SELECT *, CASE WHEN o0 >= 3 AND q0 >= 2 THEN 0 WHEN o1 >= 3 AND q1 >= 2 THEN 1 WHEN o2 >= 3 AND q2 >= 2 THEN 2 WHEN o3 >= 3 AND q3 >= 2 THEN 3 ELSE 4 END AS level FROM s)
SELECT p_partkey, level, ([o0, o1, o2, o3, o4])[level + 1] AS observations, ([q0, q1, q2, q3, q4])[level + 1] AS repositories, level < 4 OR o4 >= 3 AND q4 >= 2 AS sufficient FROM l
""")
def support_hierarchy(spark, sf_dir):
    """The first of five levels with enough observations and repositories but one's own."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("repo"), F.col("p_type").alias("cat"), F.expr("p_size div 5").alias("band"), (F.col("p_size") % 3).alias("eco"), (F.col("p_partkey") % 2).alias("cx"))
    levels = [["cat", "band", "eco", "cx"], ["cat", "band", "eco"], ["cat", "band"], ["cat"], []]
    return stats.support_hierarchy(rows, "repo", levels).select("p_partkey", "level", "observations", "repositories", "sufficient")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS e, CAST(l_quantity * l_linenumber % 13 AS DECIMAL(18,2)) AS a, CAST(l_quantity * 7 % 11 AS DECIMAL(18,2)) AS b, CAST(l_partkey % 60 AS DECIMAL(18,2)) AS said FROM lineitem), d AS (SELECT *, e - a AS low, e + b AS high FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN said < low THEN 'candidate-too-high' WHEN said > high THEN 'candidate-too-low' ELSE 'covered' END AS status, CAST(greatest(low - said, said - high, 0) AS DOUBLE) AS miss, CAST(e - said AS DOUBLE) AS signed_error,
  CAST(abs(b - a) AS DOUBLE) AS asymmetry, CASE WHEN a + b = 0 THEN 0 ELSE round(CAST(abs(b - a) AS DOUBLE) / CAST(a + b AS DOUBLE), 4) END AS relative_asymmetry, a = b AS symmetric FROM d
""")
def range_diagnostics(spark, sf_dir):
    """How estimated ranges stand to what reviewers said: status, miss and asymmetry."""
    two = lambda x: x.cast("decimal(18,2)")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", two(q).alias("e"), two(q * n % 13).alias("a"), two(q * 7 % 11).alias("b"), two(F.col("l_partkey") % 60).alias("said"))
    e, said = F.col("e"), F.col("said")
    made = stats.range_diagnostic({"low": said, "expected": said, "high": said}, {"low": e - F.col("a"), "expected": e, "high": e + F.col("b")})
    out = rows.select("l_orderkey", "l_linenumber", *[made[c].alias(c) for c in ("status", "miss", "signed_error", "asymmetry", "relative_asymmetry", "symmetric")])
    return doubles(out, "miss", "signed_error", "asymmetry")
