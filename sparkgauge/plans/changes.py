"""Change plans: documents and lines as snapshots, deltas, moves, anchors and marginal hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import dec
from ..operators import change
from ..sources import table
from .registry import doubles, query

SNAPSHOTS = """
base AS (SELECT doc_id AS path, sha256(text) AS object_id FROM documents WHERE doc_id % 3 <> 0),
head AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS object_id FROM documents WHERE doc_id % 4 <> 0),
delta AS (SELECT coalesce(b.path, h.path) AS path, b.object_id AS base_object, h.object_id AS head_object,
  CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' WHEN b.object_id <> h.object_id THEN 'modified' ELSE 'unchanged' END AS status
  FROM base b FULL JOIN head h ON b.path = h.path)
"""
MOVES = """,
gone AS (SELECT base_object AS o, path, row_number() OVER (PARTITION BY base_object ORDER BY path) AS k FROM delta WHERE status = 'removed'),
new AS (SELECT head_object AS o, path, row_number() OVER (PARTITION BY head_object ORDER BY path) AS k FROM delta WHERE status = 'added'),
moves AS (SELECT gone.o AS object_id, gone.path AS previous_path, new.path FROM gone JOIN new ON gone.o = new.o AND gone.k = new.k)
"""


def snapshots(spark, sf_dir):
    """Two versions of the documents: some rows belong to one of them only, some changed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    base = docs.where("path % 3 <> 0").select("path", F.sha2("text", 256).alias("object_id"))
    head = docs.where("path % 4 <> 0").select("path", F.sha2(F.when(F.col("path") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("object_id"))
    return base, head


@query(f"WITH {SNAPSHOTS} SELECT path, base_object, head_object, status FROM delta")
def snapshot_diff(spark, sf_dir):
    """Added, removed, modified and unchanged paths."""
    return change.snapshot_delta(*snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOTS}{MOVES} SELECT object_id, previous_path, path FROM moves")
def exact_moves(spark, sf_dir):
    """Removed and added paths of one content, in turn."""
    return change.exact_moves(change.snapshot_delta(*snapshots(spark, sf_dir)))


@query(f"""WITH {SNAPSHOTS}{MOVES}
SELECT path, status, CASE WHEN path IN (SELECT path FROM moves) OR path IN (SELECT previous_path FROM moves) THEN 'move'
  WHEN status = 'added' AND head_object IN (SELECT object_id FROM base) THEN 'exact-duplicate' ELSE 'represented' END AS class FROM delta WHERE status <> 'unchanged'
""")
def path_classes(spark, sf_dir):
    """Moves, exact duplicates and represented changes."""
    base, head = snapshots(spark, sf_dir)
    return change.path_classes(change.snapshot_delta(base, head), base)


@query("""
WITH u AS (SELECT o_custkey, sum(CASE WHEN r <= 1 THEN 1 WHEN r <= 3 THEN 2 WHEN r <= 15 THEN 3 ELSE 4 END) AS units FROM (SELECT o_custkey, o_orderkey % 20 AS r FROM orders) GROUP BY 1),
m AS (SELECT *, least(24.0, least(units, 2) * 0.5 + least(greatest(units - 2, 0), 6) * 0.25 + greatest(units - 8, 0) * 0.075)::DECIMAL(18,4) AS e FROM u)
SELECT o_custkey, CAST(units AS BIGINT) AS units, CAST(e AS DOUBLE) AS hours FROM m
""")
def marginal_hours(spark, sf_dir):
    """Logical units of a change, priced at falling rates up to a cap."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(change.logical_units(F.col("o_orderkey") % 20)).alias("units"))
    return doubles(rows.withColumn("hours", change.marginal_hours(F.col("units"), "0.5", "0.25", "0.075", 24)), "hours")


@query("""
WITH e AS (SELECT o_orderkey, round(CAST(o_totalprice AS DECIMAL(18,2)) / 10000 * 4, 0) / 4 AS expected FROM orders),
d AS (SELECT o_orderkey, CAST(expected AS DECIMAL(18,2)) AS expected FROM e),
r AS (SELECT *, round(least(greatest(expected * 0.25, 0.5), 16)::DECIMAL(18,4) * 4, 0) / 4 AS removal FROM d)
SELECT o_orderkey, CAST(expected AS DOUBLE) AS expected,
  CAST(least(expected, round((expected * (0.65 - 0.3 * 0.25))::DECIMAL(18,6) * 4, 0) / 4) AS DOUBLE) AS low,
  CAST(greatest(expected, round((expected * (1.55 + 0.3 * 1.25))::DECIMAL(18,6) * 4, 0) / 4) AS DOUBLE) AS high, CAST(removal AS DOUBLE) AS removal FROM r
""")
def change_ranges(spark, sf_dir):
    """Ranges around expected hours and the price of a removal."""
    from ..functions.rounding import quarter

    e = quarter((F.col("o_totalprice").cast("decimal(18,2)") / 10000).cast("decimal(28,8)"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", e.alias("expected"))
    low, high = change.range_from_expected(F.col("expected"), "0.7")
    return doubles(rows.withColumns({"low": low, "high": high, "removal": change.removal_expected(F.col("expected"))}), "expected", "low", "high", "removal")


@query("""
WITH b AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 13)::DECIMAL(18,2) AS e FROM nation WHERE n_nationkey % 5 <> 0),
h AS (SELECT n_nationkey AS k, (n_nationkey * 11 % 17)::DECIMAL(18,2) AS e FROM nation WHERE n_nationkey % 7 <> 0),
j AS (SELECT coalesce(b.k, h.k) AS capability, coalesce(b.e, 0) AS be, coalesce(h.e, 0) AS he FROM b FULL JOIN h ON b.k = h.k),
d AS (SELECT capability, greatest(he - be, 0) AS expected, he * 0.5 - be * 0.5 AS dl, he * 2 - be * 2 AS dh,
  CASE WHEN he > be THEN 'marginal' WHEN he < be THEN 'removal' ELSE 'equal' END AS rule FROM j)
SELECT capability, rule, CAST(least(greatest(dl, 0), expected) AS DOUBLE) AS low, CAST(expected AS DOUBLE) AS expected, CAST(greatest(expected, dh) AS DOUBLE) AS high FROM d
""")
def capability_delta(spark, sf_dir):
    """Full outer join of two capability tables and the range of what is added."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("capability"))
    hours = lambda p, x: {f"{p}_low": x * dec("0.5"), f"{p}_expected": x, f"{p}_high": x * 2}
    base = n.where("capability % 5 <> 0").withColumns(hours("base", (F.col("capability") * 7 % 13).cast("decimal(18,2)")))
    head = n.where("capability % 7 <> 0").withColumns(hours("head", (F.col("capability") * 11 % 17).cast("decimal(18,2)")))
    both = base.join(head, "capability", "full_outer")
    both = both.select("capability", *[F.coalesce(c, dec(0)).alias(c) for c in both.columns if c != "capability"])
    delta = F.col("head_expected") - F.col("base_expected")
    rule = F.when(delta > 0, "marginal").when(delta < 0, "removal").otherwise("equal")
    return doubles(both.select("capability", rule.alias("rule"), *[c.alias(k) for k, c in change.positive_difference("base", "head").items()]), "low", "expected", "high")


@query(r"""
WITH l AS (SELECT doc_id, side, trim(unnest(string_split(t, chr(10))), ' ' || chr(9) || chr(11) || chr(12)) AS line FROM (
  SELECT doc_id, 'b' AS side, text AS t FROM documents UNION ALL SELECT doc_id, 'h', replace(text, ' the ', ' ') FROM documents)),
u AS (SELECT doc_id, line, count(*) FILTER (side = 'b') AS nb, count(*) FILTER (side = 'h') AS nh FROM l WHERE length(line) > 0 GROUP BY 1, 2)
SELECT doc_id, count(*) AS anchors FROM u WHERE nb = 1 AND nh = 1 GROUP BY 1
""")
def edit_anchor_lines(spark, sf_dir):
    """Lines that occur once in both versions of a text; an edited copy is the other version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    head = docs.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" ")))
    return change.anchors(docs, head, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("anchors"))


@query(None)
def edit_regions(spark, sf_dir):
    """Edited regions between anchors in common order; held against brute force in the tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    head = docs.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" ")))
    return change.edit_regions(docs, head, "doc_id", "text")


@query("""
SELECT l_partkey, count(DISTINCT l_orderkey) AS touches FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1
""")
def overlap_paths(spark, sf_dir):
    """Parts that more than one order touches."""
    return change.overlap_paths(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("""
SELECT l_orderkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
  SELECT l_orderkey, l_linenumber || '|' || l_partkey || '|' || l_suppkey AS line FROM lineitem) GROUP BY 1
""")
def patch_digest(spark, sf_dir):
    """Digest of an order's ordered lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *[F.col(c).cast("string").alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    return change.patch_digest(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH r AS (SELECT c_nationkey, c_custkey, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS w FROM customer),
s AS (SELECT *, round(CAST(CAST(1000 AS DECIMAL(18,4)) * w AS DOUBLE) / CAST(sum(w) OVER g AS DOUBLE), 2)::DECIMAL(18,4) AS share0, count(*) OVER g AS n, row_number() OVER (g ORDER BY c_custkey) AS i FROM r WINDOW g AS (PARTITION BY c_nationkey))
SELECT c_nationkey, c_custkey, CAST(CASE WHEN i = n THEN 1000 - coalesce(sum(share0) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share0 END AS DOUBLE) AS share FROM s
""")
def adjustment_shares(spark, sf_dir):
    """A total shared by weight in cents; the last takes what is left."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.abs("c_acctbal").cast("decimal(18,2)").alias("w"), F.lit(1000).alias("total"))
    return doubles(change.distribute(rows, ["c_nationkey"], ["c_custkey"], "w", "total").select("c_nationkey", "c_custkey", "share"), "share")


FOLDERS = ("src/", "vendor/", "a/Bin/", "gen/", "lib/", "third_party/x/", "web/")
NAMES = ("a.cs", "b.min.js", "c.png", "yarn.lock", "d.g.cs", "e.py", "f.bundle.js", "Cargo.lock", "g.md", "h.go", "i.rs")
NAMED = ", ".join(f"'{x}'" for x in FOLDERS), ", ".join(f"'{x}'" for x in NAMES)


@query(f"""
WITH d AS (SELECT doc_id, ([{NAMED[0]}])[doc_id % 7 + 1] || ([{NAMED[1]}])[doc_id % 11 + 1] AS path, CASE WHEN doc_id % 17 = 0 THEN 'moved' WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'removed' ELSE 'modified' END AS status, doc_id % 23 = 0 AS link, doc_id % 29 = 0 AS tagged, sha256(text) AS o FROM documents),
b AS (SELECT DISTINCT o FROM d WHERE doc_id % 2 = 0), h AS (SELECT DISTINCT o FROM d WHERE doc_id % 5 = 0)
SELECT doc_id, CASE WHEN status = 'moved' THEN 'exact-move' WHEN link THEN 'unsupported' WHEN regexp_matches(path, '^(vendor|third_party)/') OR tagged THEN 'vendored' WHEN regexp_matches(path, '\\.min\\.|\\.bundle\\.js$') THEN 'minified' WHEN path LIKE '%.png' THEN 'binary' WHEN path LIKE '%.lock' THEN 'lockfile'
  WHEN path LIKE 'a/Bin/%' THEN 'build-output' WHEN (status = 'added' AND o IN (SELECT o FROM b)) OR (status = 'removed' AND o IN (SELECT o FROM h)) THEN 'exact-duplicate' WHEN path LIKE 'gen/%' OR path LIKE '%.g.cs' THEN 'generated' ELSE 'represented' END AS class FROM d
""")
def change_classes(spark, sf_dir):
    """Ten classes of changed paths, the first rule that fits."""
    k = F.col("doc_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    o = F.sha2("text", 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(k, F.lit("/"), pick(FOLDERS), pick(NAMES)).alias("path"), o.alias("o"))
    status = F.when(k % 17 == 0, "moved").when(k % 3 == 0, "added").when(k % 3 == 1, "removed").otherwise("modified")
    tags = F.when(k % 29 == 0, F.array(F.lit("classification:vendored")))
    delta = docs.select("path", F.lit(None).cast("string").alias("previous_path"), status.alias("status"), F.when(status != "added", F.col("o")).alias("base_object"), F.when(status != "removed", F.col("o")).alias("head_object"), (k % 23 == 0).alias("is_link"), tags.alias("tags"))
    snapshot = lambda where: docs.where(where).select(F.col("o").alias("object_id"))
    out = change.change_classes(delta, snapshot("doc_id % 2 = 0"), snapshot("doc_id % 5 = 0"))
    return out.select(F.get(F.split("path", "/"), 0).cast("long").alias("doc_id"), "class")
