"""Change assembly plans: orders as changes, their lines as paths, parts and customers as what they belong to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import dec
from ..operators import assembly, change
from ..operators.evaluation import once
from ..sources import table
from .registry import cents, cents_sql, doubles, query

POINTS = ("low", "expected", "high")

TAGS = {
    "role": ("test", "documentation", "ci-configuration", "container-configuration", "project", "delivery", "source", "test"),
    "script-role": ("", "", "", "delivery", "ci", "build", "test", "", "", "", ""),
    "sql-role": ("", "", "", "", "", "test-fixture", "", "delivery", "", "", "", "", "schema"),
    "hcl-role": ("", "", "", "", "", "", "test", "", "", "", "", "", "module", "", "", "", "cli-configuration"),
    "test-type": ("", "", "end-to-end", "", "integration"),
    "notebook-role": ("", "", "", "", "", "", "", "", "", "", "", "", "", "", "", "documentation", "", "configuration", ""),
}
PATHS = ("src/App.cs", "tests/E2E/a.ts", "it/Integration/b.py", "db/migration/c.xml", "x.SQL", "smoke/d.sh", "cypress/e.js")


def picked(names, key):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


def sql_list(names, key):
    return "([" + ", ".join(f"'{n}'" for n in names) + f"])[{key} % {len(names)} + 1]"


def tagged_pages(spark, sf_dir):
    """Paths with tags of all kinds, the empty ones left out."""
    tags = F.array(*[F.when(picked(v, "page_id") != "", F.concat(F.lit(k + ":"), picked(v, "page_id"))) for k, v in TAGS.items()])
    return table(spark, sf_dir, "pages").select("page_id", picked(PATHS, "page_id").alias("path"), F.array_compact(tags).alias("tags"))


TAG_SQL = "t AS (SELECT page_id, lower(" + sql_list(PATHS, "page_id") + ") AS low, " + ", ".join(f"{sql_list(v, 'page_id')} AS {k.replace('-', '_')}" for k, v in TAGS.items()) + " FROM pages)"
FALLBACK = f"""CASE WHEN notebook_role = 'documentation' THEN '{assembly.DOCS}' WHEN notebook_role = 'configuration' THEN '{assembly.BUILD}'
  WHEN hcl_role = 'test' THEN '{assembly.INTEGRATION}' WHEN hcl_role = 'cli-configuration' THEN '{assembly.BUILD}' WHEN hcl_role <> '' THEN '{assembly.CI}'
  WHEN sql_role = 'test-fixture' THEN '{assembly.INTEGRATION}' WHEN sql_role = 'delivery' OR script_role = 'delivery' THEN '{assembly.PACKAGING}'
  WHEN script_role IN ('ci', 'infrastructure') THEN '{assembly.CI}' WHEN script_role = 'build' THEN '{assembly.BUILD}'
  WHEN script_role = 'test' THEN CASE WHEN contains(low, 'integration') OR contains(low, 'smoke') THEN '{assembly.INTEGRATION}' ELSE '{assembly.UNIT}' END
  WHEN role = 'test' THEN CASE WHEN test_type = 'end-to-end' THEN '{assembly.END_TO_END}' WHEN test_type IN ('integration', 'component') THEN '{assembly.INTEGRATION}'
    WHEN regexp_matches(low, 'e2e|endtoend|playwright|cypress') THEN '{assembly.END_TO_END}' WHEN contains(low, 'integration') THEN '{assembly.INTEGRATION}' ELSE '{assembly.UNIT}' END
  WHEN role = 'documentation' THEN '{assembly.DOCS}' WHEN role IN ('ci-configuration', 'infrastructure') THEN '{assembly.CI}' WHEN role = 'container-configuration' THEN '{assembly.PACKAGING}'
  WHEN role IN ('project', 'configuration') THEN '{assembly.BUILD}' WHEN role = 'delivery' THEN '{assembly.PACKAGING}' WHEN contains(low, 'migration') OR low LIKE '%.sql' THEN '{assembly.DATA}' ELSE '{assembly.PRODUCTION}' END"""


@query(f"WITH {TAG_SQL} SELECT page_id, {FALLBACK} AS category FROM t")
def fallback_category(spark, sf_dir):
    """Category of changed paths by tags and name, the first rule that fits."""
    return tagged_pages(spark, sf_dir).select("page_id", assembly.fallback_category(F.col("path"), F.col("tags")).alias("category"))


@query(f"""WITH {TAG_SQL}, p AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN '{assembly.DATA}' ELSE '{assembly.PRODUCTION}' END AS own FROM t)
SELECT page_id, CASE WHEN hcl_role = 'test' THEN '{assembly.INTEGRATION}' WHEN hcl_role = 'cli-configuration' THEN CASE WHEN own = '{assembly.PRODUCTION}' THEN '{assembly.BUILD}' ELSE own END
  WHEN hcl_role <> '' THEN CASE WHEN own = '{assembly.PRODUCTION}' THEN '{assembly.CI}' ELSE own END WHEN role = 'test' THEN {FALLBACK} WHEN role = 'documentation' THEN '{assembly.DOCS}'
  WHEN role = 'ci-configuration' THEN '{assembly.CI}' WHEN role IN ('container-configuration', 'delivery') THEN '{assembly.PACKAGING}' WHEN role = 'project' THEN '{assembly.BUILD}' ELSE own END AS category FROM p""")
def role_category(spark, sf_dir):
    """Category that a path's role names, within a capability's own."""
    own = F.when(F.col("page_id") % 3 == 0, assembly.DATA).otherwise(assembly.PRODUCTION)
    return tagged_pages(spark, sf_dir).select("page_id", assembly.role_category(F.col("path"), F.col("tags"), own).alias("category"))


LINES = f"""l AS (SELECT l_orderkey AS change, l_partkey AS path, ([{", ".join(f"'{c}'" for c in ('production-implementation', assembly.UNIT, assembly.DOCS, assembly.DATA))}])[l_linenumber % 4 + 1] AS category,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' ELSE 'removed' END AS status, l_suppkey % 20 AS regions, l_linenumber AS n FROM lineitem)"""
UNITS = "CASE WHEN regions <= 1 THEN 1 WHEN regions <= 3 THEN 2 WHEN regions <= 15 THEN 3 ELSE 4 END"


def changed_lines(spark, sf_dir):
    """Order lines as changed paths: category by the line's number, status by its flag, edited regions by its supplier."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("change"),
        F.col("l_partkey").alias("path"),
        picked(("production-implementation", assembly.UNIT, assembly.DOCS, assembly.DATA), "l_linenumber").alias("category"),
        F.when(flag == "A", "added").when(flag == "N", "modified").otherwise("removed").alias("status"),
        (F.col("l_suppkey") % 20).alias("regions"),
        F.col("l_linenumber").alias("n"),
    )


@query(f"""WITH {LINES}, b AS (SELECT o_orderkey AS change, {cents_sql("o_orderkey", 40000)} AS e FROM orders),
w AS (SELECT change, category, greatest(sum({UNITS}), 1) * CASE category WHEN '{assembly.DATA}' THEN 1.25 WHEN '{assembly.UNIT}' THEN 0.75 WHEN '{assembly.DOCS}' THEN 0.75 ELSE 1 END AS w FROM l GROUP BY 1, 2),
s AS (SELECT change, category, e, CAST(round(CAST(CAST(e * w AS DECIMAL(28,8)) / sum(w) OVER g AS DECIMAL(28,8)), 2) AS DECIMAL(18,4)) AS sh, row_number() OVER (g ORDER BY category) AS i, count(*) OVER g AS n FROM w JOIN b USING (change) WINDOW g AS (PARTITION BY change))
SELECT change, category, CAST(CASE WHEN i = n THEN e - coalesce(sum(sh) OVER (PARTITION BY change ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE sh END AS DOUBLE) AS expected FROM s""")
def role_partitions(spark, sf_dir):
    """A change's hours shared over its categories by logical units and weight."""
    lines = changed_lines(spark, sf_dir).withColumn("units", change.logical_units(F.col("regions")))
    e = cents(F.col("o_orderkey"), 40000)
    budgets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change"), *[e.alias(p) for p in POINTS])
    return doubles(assembly.role_partitions(budgets, lines, ["change"]).select("change", "category", "expected"), "expected")


@query(f"""
WITH o AS (SELECT o_orderkey AS id, {cents_sql("o_orderkey", 1300)} AS e FROM orders), r AS (SELECT id, CAST(e * 0.5 AS DECIMAL(18,2)) AS l, e, CAST(e * 2 AS DECIMAL(18,2)) AS h, CASE WHEN e <= 1.5 THEN 1 ELSE greatest(2, CAST(ceil(e) AS INTEGER)) END AS parts FROM o),
x AS (SELECT *, unnest(range(1, parts + 1))::INTEGER AS part, CAST(round(CAST(l / parts AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS ls, CAST(round(CAST(e / parts AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS es, CAST(round(CAST(h / parts AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS hs FROM r),
y AS (SELECT id, part, parts, CASE WHEN part = parts THEN greatest(l - least(ls * (part - 1), l), 0) ELSE least(greatest(l - least(ls * (part - 1), l), 0), ls) END AS pl, CASE WHEN part = parts THEN greatest(e - least(es * (part - 1), e), 0) ELSE least(greatest(e - least(es * (part - 1), e), 0), es) END AS pe,
  CASE WHEN part = parts THEN greatest(h - least(hs * (part - 1), h), 0) ELSE least(greatest(h - least(hs * (part - 1), h), 0), hs) END AS ph FROM x)
SELECT id, CAST(part AS INTEGER) AS part, CAST(parts AS INTEGER) AS parts, CAST(least(pl, pe) AS DOUBLE) AS low, CAST(pe AS DOUBLE) AS expected, CAST(greatest(ph, pe) AS DOUBLE) AS high FROM y
""")
def change_parts(spark, sf_dir):
    """Items of a change in parts of about an hour."""
    e = cents(F.col("o_orderkey"), 1300)
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (e * dec("0.5")).cast("decimal(18,2)").alias("low"), e.alias("expected"), (e * 2).cast("decimal(18,2)").alias("high"))
    return doubles(assembly.change_parts(items, ["id"]), *POINTS)


@query("""
WITH c AS (SELECT p_brand AS capability, p_partkey AS path FROM part), p AS (SELECT l_orderkey AS change, l_partkey AS path FROM lineitem UNION ALL SELECT l_orderkey, l_partkey - 1 FROM lineitem WHERE l_linenumber = 1)
SELECT capability, count(*) AS changes FROM (SELECT DISTINCT capability, change FROM c JOIN p USING (path)) GROUP BY 1
""")
def touching_capabilities(spark, sf_dir):
    """Capabilities and the changes that touch one of their paths, by path or previous path."""
    held = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("capability")).agg(F.collect_set("p_partkey").alias("paths"))
    n = F.col("l_linenumber")
    moved = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("path"), F.when(n == 1, F.col("l_partkey") - 1).alias("previous_path"))
    return assembly.touching(held, moved, ["capability"], ["change"]).groupBy("capability").agg(F.count("*").alias("changes"))


@query("""
WITH f AS (SELECT l_orderkey AS id, list_sort(list({'name': l_partkey, 'value': CAST(l_quantity AS INTEGER)})) AS m, list_sort(list_distinct(list(l_returnflag))) AS t,
  list_sort(list({'name': l_partkey, 'value': CAST(l_quantity AS INTEGER) + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN 1 ELSE 0 END})) AS m2, list_sort(list_distinct(list(CASE WHEN l_orderkey % 7 = 0 THEN 'x' ELSE l_returnflag END))) AS t2 FROM lineitem GROUP BY 1)
SELECT id, m = m2 AND t = t2 AS equal FROM f
""")
def material_equality(spark, sf_dir):
    """Whether two versions of a fact value alike, whatever the order of measurements and tags."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    m = lambda add: F.collect_list(F.struct(F.col("l_partkey").alias("name"), (F.col("l_quantity").cast("int") + add).alias("value")))
    later = F.when((key % 5 == 0) & (n == 2), 1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").groupBy(key.alias("id")).agg(
        m(F.lit(0)).alias("base_measurements"), m(later).alias("head_measurements"), F.collect_set("l_returnflag").alias("base_tags"), F.collect_set(F.when(key % 7 == 0, "x").otherwise(F.col("l_returnflag"))).alias("head_tags")
    )
    rows = rows.withColumns({f"{s}_{c}": F.lit("same") for s in ("base", "head") for c in ("kind", "scope")})
    return rows.select("id", assembly.equal_evidence("base", "head").alias("equal"))


@query(f"""WITH {LINES}, g AS (SELECT change, category, status, count(*) AS paths, sum({UNITS}) AS units FROM l WHERE n <> 3 GROUP BY 1, 2, 3),
f AS (SELECT *, CASE category WHEN '{assembly.DATA}' THEN 1.25 WHEN '{assembly.DOCS}' THEN 0.5 WHEN '{assembly.UNIT}' THEN 0.75 ELSE 1 END * CASE status WHEN 'modified' THEN 0.3 WHEN 'removed' THEN 0.75 ELSE 1 END AS r FROM g),
e AS (SELECT *, greatest(0.5, CAST(round(least(8, CAST(least(units, 2) * r + least(greatest(units - 2, 0), 6) * r * 0.5 + greatest(units - 8, 0) * r * 0.15 AS DECIMAL(28,8))) * 4, 0) / 4 AS DECIMAL(18,2))) AS e FROM f)
SELECT change, category, status, paths, CAST(units AS BIGINT) AS units, CAST(least(e, round(CAST(e * (0.65 - 0.42 * 0.25) AS DECIMAL(28,8)) * 4, 0) / 4) AS DOUBLE) AS low, CAST(e AS DOUBLE) AS expected, CAST(greatest(e, round(CAST(e * (1.55 + 0.42 * 1.25) AS DECIMAL(28,8)) * 4, 0) / 4) AS DOUBLE) AS high FROM e""")
def unused_evidence(spark, sf_dir):
    """Paths that no item uses, budgeted by category and status."""
    lines = changed_lines(spark, sf_dir).withColumnRenamed("n", "evidence_id")
    used = lines.where("evidence_id = 3").select("change", "evidence_id")
    return doubles(assembly.fallback_items(lines, used, ["change"]), *POINTS)


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS c FROM orders GROUP BY 1),
m AS (SELECT *, least(8, least(n, 2) * 0.5 + least(greatest(n - 2, 0), 6) * 0.25 + greatest(n - 8, 0) * 0.1) AS review, least(6, least(n, 2) * 0.5 + least(greatest(n - 2, 0), 6) * 0.2 + greatest(n - 8, 0) * 0.05) AS val FROM c),
r AS (SELECT o_custkey, 'change-comprehension' AS rule, CAST(least(4, 0.5 + (c - 1) * 0.25) AS DECIMAL(18,4)) AS e, 0.22 AS d FROM m UNION ALL SELECT o_custkey, 'change-review', CAST(review AS DECIMAL(18,4)), 0.2 FROM m
  UNION ALL SELECT o_custkey, 'change-validation', CAST(round(CAST(val AS DECIMAL(28,8)) * 4, 0) / 4 AS DECIMAL(18,4)), 0.32 FROM m UNION ALL SELECT o_custkey, 'change-recreation-design', CAST(least(4, 0.5 + c * 0.25) AS DECIMAL(18,4)), 0.32 FROM m)
SELECT o_custkey, rule, CAST(least(e, round(CAST(e * (0.65 - d * 0.25) AS DECIMAL(28,8)) * 4, 0) / 4) AS DOUBLE) AS low, CAST(e AS DOUBLE) AS expected, CAST(greatest(e, round(CAST(e * (1.55 + d * 1.25) AS DECIMAL(28,8)) * 4, 0) / 4) AS DOUBLE) AS high FROM r
""")
def overhead_items(spark, sf_dir):
    """Comprehension, review, validation and design of each change."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("represented"), F.countDistinct("o_orderpriority").alias("categories"))
    return doubles(assembly.overhead_items(rows, ["o_custkey"], recreation=True), *POINTS)


RECONCILED = f"""o AS (SELECT o_custkey AS change, o_orderkey AS component, {cents_sql("o_orderkey", 5000)} AS e, CASE WHEN o_orderpriority < '3' THEN {cents_sql("o_orderkey", 5000)} ELSE 0 END AS s FROM orders),
i AS (SELECT change, CAST(sum(CAST(e * 0.5 AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS il, CAST(sum(e) AS DECIMAL(18,2)) AS ie, CAST(sum(CAST(e * 2 AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS ih, CAST(sum(s) AS DECIMAL(18,2)) AS ishared FROM o GROUP BY 1),
f AS (SELECT change, CASE change % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.75 WHEN 2 THEN 0.95 ELSE 1.25 END AS k, * EXCLUDE (change) FROM i),
n AS (SELECT *, CAST(il * k AS DECIMAL(18,2)) AS nl, CAST(ie * k AS DECIMAL(18,2)) AS ne, CAST(ih * k AS DECIMAL(18,2)) AS nh, CAST(ishared * 0.5 AS DECIMAL(18,2)) AS nshared FROM f),
t AS (SELECT DISTINCT o_custkey AS change, l_orderkey AS component, l_partkey % 50 AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT change, path, count(*) AS n FROM t GROUP BY 1, 2),
q AS (SELECT change, count(*) FILTER (n > 1) AS "overlaps", count(*) FILTER (path >= 45) AS reverted FROM p GROUP BY 1),
r AS (SELECT n.*, coalesce("overlaps", 0) AS "overlaps", coalesce(reverted, 0) AS reverted, greatest(ishared - nshared, 0) AS excess, ne - ie AS difference, greatest(1, CAST(round(CAST(ie * 0.1 AS DECIMAL(28,8)), 2) AS DECIMAL(18,2))) AS tolerance FROM n LEFT JOIN q USING (change))"""


def reconciled_orders(spark, sf_dir):
    """A customer's orders as components of one change, with their parts as touched paths."""
    e = cents(F.col("o_orderkey"), 5000)
    orders = table(spark, sf_dir, "orders")
    components = orders.select(
        F.col("o_custkey").alias("change"), F.col("o_orderkey").alias("component"), (e * dec("0.5")).cast("decimal(18,2)").alias("low"), e.alias("expected"), (e * 2).cast("decimal(18,2)").alias("high"), F.when(F.col("o_orderpriority") < "3", e).otherwise(dec(0, "decimal(18,2)")).alias("shared")
    )
    k = F.col("change") % 4
    factor = F.when(k == 0, "1").when(k == 1, "0.75").when(k == 2, "0.95").otherwise("1.25").cast("decimal(9,4)")
    sums = components.groupBy("change").agg(*[F.sum(p).alias(p) for p in (*POINTS, "shared")])
    normalized = sums.select("change", *[(F.col(p) * factor).cast("decimal(18,2)").alias(p) for p in POINTS], (F.col("shared") * dec("0.5")).cast("decimal(18,2)").alias("shared"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("component"), (F.col("l_partkey") % 50).alias("path"))
    touches = lines.join(components.select("change", "component"), "component").select("change", "component", "path")
    return assembly.reconciliation(normalized, components, once(touches, ["change", "path"]), touches.where("path < 45").select("change", "path"), ["change"])


@query(f"""WITH {RECONCILED} SELECT change, CAST(ie AS DOUBLE) AS isolated_expected, CAST(ne AS DOUBLE) AS expected, "overlaps", reverted, CAST(excess AS DOUBLE) AS shared_excess, CAST(difference AS DOUBLE) AS difference, CAST(tolerance AS DOUBLE) AS tolerance,
  CASE WHEN abs(difference) <= tolerance THEN 'within-no-rework-tolerance' WHEN difference < 0 THEN 'normalized-below-isolated-components' ELSE 'normalized-above-isolated-components' END AS assessment FROM r""")
def change_reconcile(spark, sf_dir):
    """Isolated components against the normalized change."""
    rows = reconciled_orders(spark, sf_dir).select("change", "isolated_expected", "expected", "overlaps", "reverted", "shared_excess", "difference", "tolerance", "assessment")
    return doubles(rows, "isolated_expected", "expected", "shared_excess", "difference", "tolerance")


@query(f"""WITH {RECONCILED}, c AS (SELECT change, 0 AS place, 'shared-setup' AS kind, CAST(excess AS DECIMAL(18,4)) AS w FROM r WHERE difference < 0 AND excess > 0 UNION ALL SELECT change, 1, 'overlap', CAST("overlaps" AS DECIMAL(18,4)) FROM r WHERE difference < 0 AND "overlaps" > 0 UNION ALL SELECT change, 2, 'revert', CAST(reverted AS DECIMAL(18,4)) FROM r WHERE difference < 0 AND reverted > 0),
a AS (SELECT * FROM c UNION ALL SELECT r.change, 3, 'interaction', CAST(CASE WHEN t.w IS NULL THEN 1 ELSE greatest(1, t.w * 0.25) END AS DECIMAL(18,4)) FROM r LEFT JOIN (SELECT change, sum(w) AS w FROM c GROUP BY 1) t USING (change)),
d AS (SELECT a.change, place, kind, w, CAST(ne - ie AS DECIMAL(18,4)) AS delta, CAST(round(CAST(CAST((ne - ie) * w AS DECIMAL(28,8)) / sum(w) OVER (PARTITION BY a.change) AS DECIMAL(28,8)), 2) AS DECIMAL(18,4)) AS sh FROM a JOIN r USING (change) WHERE nl <> il OR ne <> ie OR nh <> ih)
SELECT change, kind, CAST(CASE WHEN place = 3 THEN delta - coalesce(sum(sh) OVER (PARTITION BY change ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE sh END AS DOUBLE) AS expected FROM d""")
def change_adjustments(spark, sf_dir):
    """The difference attributed to shared work, overlaps, reverts and what is left."""
    return doubles(assembly.adjustments(reconciled_orders(spark, sf_dir), ["change"]).select("change", "kind", "expected"), "expected")


@query("""
WITH f AS (SELECT page_id % 7 AS snapshot, split_part(url, '://', 2) || CASE WHEN page_id % 4 = 0 THEN '/package.json' ELSE '' END AS path, page_id % 4 = 0 AS ctx, page_id FROM pages),
g AS (SELECT snapshot, path, bool_or(ctx) AS ctx, bool_or(page_id % 10 = 1) AS changed FROM f GROUP BY 1, 2),
up AS (SELECT DISTINCT snapshot, array_to_string(string_split(path, '/')[1:n], '/') AS d FROM (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS n FROM g WHERE changed))
SELECT snapshot, path, CASE WHEN changed THEN 'changed' ELSE 'context' END AS why FROM g WHERE changed OR (ctx AND (snapshot, array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/')) IN (SELECT (snapshot, d) FROM up))
""")
def scope_pruning(spark, sf_dir):
    """Changed files and the manifests above them; everything else needs no analysis."""
    k = F.col("page_id")
    path = F.concat(F.get(F.split("url", "://"), 1), F.when(k % 4 == 0, "/package.json").otherwise(""))
    rows = table(spark, sf_dir, "pages").select((k % 7).alias("snapshot"), path.alias("path"), (k % 4 == 0).alias("is_context"), (k % 10 == 1).alias("changed"))
    rows = rows.groupBy("snapshot", "path").agg(F.bool_or("is_context").alias("is_context"), F.bool_or("changed").alias("changed"))
    delta = rows.select("snapshot", "path", F.when(F.col("changed"), "modified").otherwise("unchanged").alias("status"))
    return assembly.pruned(rows.drop("changed"), delta, ["snapshot"]).select("snapshot", "path", "why")


DELTA_CATEGORIES = ("production-implementation", "ui-implementation-and-represented-ux-decisions", "unit-testing", "repository-and-solution-setup", "architecture-and-technical-design", "manual-validation-debugging-and-hardening", "data-modeling-persistence-and-migrations")


@query(f"""
WITH l AS (SELECT l_orderkey AS change, l_linenumber AS k, {sql_list(DELTA_CATEGORIES, "(l_linenumber - 1)")} AS category, l_partkey, l_suppkey,
    CASE WHEN l_partkey % 5 <> 0 THEN {cents_sql("l_partkey", 900)} END AS b, CASE WHEN l_suppkey % 6 <> 0 THEN CASE WHEN l_partkey % 4 = 0 AND l_partkey % 5 <> 0 THEN {cents_sql("l_partkey", 900)} ELSE {cents_sql("l_suppkey", 1100)} END END AS h,
    l_linenumber % 2 = 1 AS touched, l_partkey % 3 = 0 AS material, CASE l_suppkey % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' ELSE 'removed' END AS status, l_partkey % 20 AS regions FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
u AS (SELECT *, CASE WHEN regions <= 1 THEN 1 WHEN regions <= 3 THEN 2 WHEN regions <= 15 THEN 3 ELSE 4 END AS units, CASE status WHEN 'modified' THEN 0.3 WHEN 'removed' THEN 0.75 ELSE 1 END AS sf FROM l),
c AS (SELECT change, sum(units) AS units, max(sf) AS sf, bool_or(status = 'modified') AS modified, string_agg('e' || k, '+' ORDER BY k) AS ids FROM u GROUP BY 1),
r AS (SELECT u.change, k, category, b, h, coalesce(h, 0) - coalesce(b, 0) AS d, touched, material, CASE WHEN touched THEN u.units ELSE c.units END AS n, CASE WHEN touched THEN u.sf ELSE c.sf END AS sf, CASE WHEN touched THEN status = 'modified' ELSE modified END AS modified, CASE WHEN touched THEN 'e' || k ELSE ids END AS ids
  FROM u JOIN c USING (change) WHERE (b IS NOT NULL OR h IS NOT NULL) AND category <> 'manual-validation-debugging-and-hardening' AND (category NOT IN ('repository-and-solution-setup', 'architecture-and-technical-design') OR b IS NULL OR h IS NULL)),
s AS (SELECT *, CASE WHEN d > 0 THEN 'capability-marginal' WHEN d < 0 AND touched THEN 'capability-removal' WHEN d = 0 AND touched AND b IS NOT NULL AND h IS NOT NULL AND material THEN 'capability-modification' END AS rule,
  sf * CASE WHEN k IN (2, 7) THEN 1.25 WHEN k = 3 THEN 0.75 WHEN k IN (4, 5) THEN 0.5 ELSE 1 END AS f FROM r),
p AS (SELECT *, CASE WHEN rule = 'capability-modification' OR rule = 'capability-marginal' AND (b IS NOT NULL OR modified) THEN 'm' WHEN rule = 'capability-removal' THEN 'r' ELSE 'd' END AS price,
  round(least(greatest((least(n, 2) * f + least(greatest(n - 2, 0), 6) * f * 0.5 + greatest(n - 8, 0) * f * 0.15)::DECIMAL(18,8), 0.5), 8) * 4, 0) / 4 AS me, round(least(greatest((-d * 0.25)::DECIMAL(18,4), 0.5), 16) * 4, 0) / 4 AS re FROM s WHERE rule IS NOT NULL),
e AS (SELECT *, CASE price WHEN 'm' THEN me WHEN 'r' THEN re ELSE d END::DECIMAL(18,2) AS expected, CASE price WHEN 'm' THEN 0.3 ELSE 0.38 END AS doubt FROM p)
SELECT change, 'k' || k AS capability, rule, CASE WHEN price = 'r' THEN 'Remove or simplify' WHEN rule = 'capability-modification' THEN 'Modify' WHEN b IS NOT NULL THEN 'Expand' ELSE 'Add' END AS verb,
  CAST(CASE WHEN price = 'd' THEN least(greatest(d * 0.5, 0), expected) ELSE least(expected, round((expected * (0.65 - doubt * 0.25))::DECIMAL(18,8) * 4, 0) / 4) END AS DOUBLE) AS low, CAST(expected AS DOUBLE) AS expected,
  CAST(CASE WHEN price = 'd' THEN greatest(expected, d * 2) ELSE greatest(expected, round((expected * (1.55 + doubt * 1.25))::DECIMAL(18,8) * 4, 0) / 4) END AS DOUBLE) AS high, ids AS evidence FROM e WHERE expected > 0
""")
def capability_delta_rules(spark, sf_dir):
    """Items of capabilities in two snapshots by rule: marginal, removal, modification, over all lines of all orders."""
    k, part, supplier = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    # lines go once to the partition of their change; what is asked of them stays one array, so that all readings share that exchange
    dealt = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select("l_orderkey", F.array(k.cast("long"), part, supplier).alias("_line")).repartition("l_orderkey")
    of_line = lambda i: F.get("_line", F.lit(i))
    once = dealt.groupBy("l_orderkey", of_line(0).alias("l_linenumber")).agg(F.min(of_line(1)).alias("l_partkey"), F.min(of_line(2)).alias("l_suppkey"))
    lines = once.select(
        F.col("l_orderkey").alias("change"), F.concat(F.lit("k"), k).alias("capability"), F.element_at(F.array(*map(F.lit, DELTA_CATEGORIES)), k.cast("int")).alias("category"), k.alias("k"), part.alias("part"), supplier.alias("supplier"),
        F.array(F.when(k % 2 == 1, F.concat(F.lit("p"), k)).otherwise("none")).alias("paths"),
    )
    def side(x, keep):
        e = x.cast("decimal(18,2)")
        return lines.where(keep).select("change", "capability", "category", "paths", *[(e * dec(f)).cast("decimal(18,4)").alias(c) for c, f in zip(POINTS, ("0.5", 1, 2))])

    base = side(cents(F.col("part"), 900), F.col("part") % 5 != 0)
    head = side(F.when((F.col("part") % 4 == 0) & (F.col("part") % 5 != 0), cents(F.col("part"), 900)).otherwise(cents(F.col("supplier"), 1100)), F.col("supplier") % 6 != 0)
    status = F.when(F.col("supplier") % 3 == 0, "modified").when(F.col("supplier") % 3 == 1, "added").otherwise("removed")
    paths = lines.select("change", F.concat(F.lit("e"), "k").alias("evidence_id"), F.concat(F.lit("p"), "k").alias("path"), F.lit(None).cast("string").alias("previous_path"), status.alias("status"), (F.col("part") % 20).alias("regions"))
    out = assembly.capability_deltas(base, head, paths, lines.where("part % 3 = 0"), ["change"])
    return doubles(out.withColumn("evidence", F.array_join("evidence_ids", "+")).drop("evidence_ids", "category"), *POINTS)
