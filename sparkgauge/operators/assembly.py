"""From change evidence to work items: touched capabilities, budgets by role, fallbacks, overhead, reconciliation.

Rows carry the id of their change, so any number of changes is assembled by the same joins and
grouped sums; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import dec, quarter
from ..functions.vocabulary import CHANGE_HEAVY, CHANGE_LIGHT, SHARED
from . import change as changes
from .evaluation import once
from .facts import tag_value

#: Category by short name, in the order of the decision tree's results.
UNIT, INTEGRATION, END_TO_END = "unit-testing", "integration-contract-and-component-testing", "end-to-end-and-ui-testing"
DOCS, BUILD, CI = "documentation", "build-configuration-and-developer-tooling", "ci-cd-and-infrastructure-as-code"
PACKAGING, DATA, PRODUCTION = "packaging-deployment-and-release-artifacts", "data-modeling-persistence-and-migrations", "production-implementation"
CONFIGURATION_ROLES = ("project", "solution", "package-manifest", "build-configuration", "configuration")


def fallback_category(path: Column, tags: Column) -> Column:
    """Category of a changed path that no capability explains: the first rule that fits its tags, then its name."""
    of = lambda prefix: F.coalesce(tag_value(tags, prefix + ":"), F.lit(""))
    role, script, sql, hcl, test, note = (of(p) for p in ("role", "script-role", "sql-role", "hcl-role", "test-type", "notebook-role"))
    low = F.lower(path)
    named = lambda *parts: F.greatest(*[F.instr(low, p) for p in parts], F.lit(0)) > 0
    rules = (
        (note == "documentation", DOCS),
        (note == "configuration", BUILD),
        (hcl == "test", INTEGRATION),
        (hcl == "cli-configuration", BUILD),
        (hcl != "", CI),
        (sql == "test-fixture", INTEGRATION),
        (sql == "delivery", PACKAGING),
        (script == "delivery", PACKAGING),
        (script.isin("ci", "infrastructure"), CI),
        (script == "build", BUILD),
        ((script == "test") & named("integration", "smoke"), INTEGRATION),
        (script == "test", UNIT),
        ((role == "test") & (test == "end-to-end"), END_TO_END),
        ((role == "test") & test.isin("integration", "component"), INTEGRATION),
        ((role == "test") & named("e2e", "endtoend", "playwright", "cypress"), END_TO_END),
        ((role == "test") & named("integration"), INTEGRATION),
        (role == "test", UNIT),
        (role == "documentation", DOCS),
        (role.isin("ci-configuration", "infrastructure"), CI),
        (role == "container-configuration", PACKAGING),
        (role.isin(*CONFIGURATION_ROLES), BUILD),
        (role == "delivery", PACKAGING),
        (named("migration") | low.endswith(".sql"), DATA),
    )
    out = F.when(rules[0][0], rules[0][1])
    for test_, label in rules[1:]:
        out = out.when(test_, label)
    return out.otherwise(PRODUCTION)


def role_category(path: Column, tags: Column, primary: Column) -> Column:
    """Category that a path's role names outright; otherwise the capability's own."""
    of = lambda prefix: F.coalesce(tag_value(tags, prefix + ":"), F.lit(""))
    hcl, role = of("hcl-role"), of("role")
    return (
        F.when(hcl == "test", INTEGRATION)
        .when(hcl == "cli-configuration", F.when(primary.isin(PRODUCTION, CI), BUILD).otherwise(primary))
        .when(hcl != "", F.when(primary.isin(PRODUCTION, BUILD), CI).otherwise(primary))
        .when(role == "test", fallback_category(path, tags))
        .when(role == "documentation", DOCS)
        .when(role.isin("ci-configuration", "infrastructure"), CI)
        .when(role.isin("container-configuration", "delivery"), PACKAGING)
        .when(role.isin(*CONFIGURATION_ROLES), BUILD)
        .otherwise(primary)
    )


def role_weight(category: Column) -> Column:
    return F.when(category.isin(*CHANGE_HEAVY), "1.25").when(category.isin(*CHANGE_LIGHT), "0.75").otherwise("1").cast("decimal(9,4)")


def role_partitions(budgets: DataFrame, paths: DataFrame, group: list[str], category: str = "category", units: str = "units") -> DataFrame:
    """A capability's hours shared over the categories of its paths.

    budgets: group, low, expected, high; paths: group, category, units.  Weights are logical units (one
    at least) times the category's weight; shares have two digits and the last category takes the rest.
    """
    weights = paths.groupBy(*group, category).agg((F.greatest(F.sum(units), F.lit(1)) * role_weight(F.col(category))).cast("decimal(18,4)").alias("_w"))
    rows = budgets.join(weights, group)
    for point in ("low", "expected", "high"):
        rows = changes.distribute(rows, group, [category], "_w", point).withColumn(point, F.col("share")).drop("share")
    return rows.drop("_w")


def change_parts(items: DataFrame, key: list[str]) -> DataFrame:
    """Items in parts: one up to 1.5 hours, else an hour each and two at least; shares of two digits, the last takes the rest."""
    expected = F.col("expected")
    n = F.when(expected <= dec("1.5"), 1).otherwise(F.greatest(F.lit(2), F.ceil(expected))).cast("int")
    rows = items.withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))

    def share(total: Column) -> Column:
        even = F.round((total / F.col("parts")).cast("decimal(28,8)"), 2).cast("decimal(18,2)")
        before = F.least((even * (F.col("part") - 1)).cast("decimal(18,2)"), total)  # what the parts before have taken
        left = F.greatest(total - before, dec(0))
        return F.when(F.col("part") == F.col("parts"), left).otherwise(F.least(left, even)).cast("decimal(18,2)")

    low, high = share(F.col("low")), share(F.col("high"))
    e = share(expected)
    return rows.select(*key, "part", "parts", F.least(low, e).alias("low"), e.alias("expected"), F.greatest(high, e).alias("high"))


def touching(capabilities: DataFrame, paths: DataFrame, capability: list[str], change: list[str]) -> DataFrame:
    """Array-overlap join: distinct pairs of a capability and a change that share a path, by path or by previous path.

    capabilities: capability, paths (array); paths: change, path, previous_path.
    """
    held = capabilities.select(*capability, F.explode("paths").alias("_path")).distinct()
    moved = paths.select(*change, F.explode(F.array_compact(F.array("path", "previous_path"))).alias("_path")).distinct()
    return held.join(moved, "_path").select(*capability, *change).distinct()


def equal_evidence(a: str, b: str) -> Column:
    """Do two facts value alike: kind, scope, measurements and tags, whatever their order?"""
    same = lambda c: F.col(f"{a}_{c}").eqNullSafe(F.col(f"{b}_{c}"))
    alike = lambda c: F.array_sort(F.col(f"{a}_{c}")).eqNullSafe(F.array_sort(F.col(f"{b}_{c}")))
    return same("kind") & same("scope") & alike("measurements") & alike("tags")


def delta_rule(base: Column, head: Column, touched: Column, material: Column) -> Column:
    """Rule of a capability in both snapshots: what it gained, lost, or had changed within."""
    return (
        F.when(head > base, "marginal")
        .when((head < base) & touched, "removal")
        .when((head == base) & touched & material, "modification")
    )


def fallback_items(paths: DataFrame, used: DataFrame, change: list[str], evidence: str = "evidence_id") -> DataFrame:
    """Paths that no item uses (anti join), budgeted by change, category and status.

    paths: change, evidence, category, status, regions.  Regions of a group share one marginal budget.
    """
    free = paths.join(used.select(*change, evidence).distinct(), [*change, evidence], "left_anti")
    units = F.sum(changes.logical_units(F.col("regions"))).alias("units")
    groups = free.groupBy(*change, "category", "status").agg(F.count("*").alias("paths"), units)
    c = F.col("category")
    heavy = [x for x in CHANGE_HEAVY if not x.startswith("ui-")]
    factor = F.when(c.isin(*heavy), "1.25").when(c == DOCS, "0.5").when(c.isin(UNIT, INTEGRATION, END_TO_END), "0.75").otherwise("1").cast("decimal(9,4)")
    rate = (factor * changes.status_factor(F.col("status"))).cast("decimal(18,8)")
    units = F.col("units").cast("decimal(18,0)")
    spent = F.least(units, dec(2)) * rate + F.least(F.greatest(units - 2, dec(0)), dec(6)) * rate * dec("0.5") + F.greatest(units - 8, dec(0)) * rate * dec("0.15")
    expected = F.greatest(dec("0.5"), quarter(F.least(dec(8, "decimal(28,8)"), spent.cast("decimal(28,8)")))).cast("decimal(18,2)")
    low, high = changes.range_from_expected(expected, "0.58")
    return groups.select(*change, "category", "status", "paths", "units", low.alias("low"), expected.alias("expected"), high.alias("high"))


def overhead_items(changes_: DataFrame, key: list[str], recreation: bool = False) -> DataFrame:
    """Comprehension, review, validation and (for a recreation) design of each change, from its final scope.

    changes_: key, represented (paths), categories (touched).
    """
    n, c = F.col("represented"), F.greatest(F.col("categories"), F.lit(1)).cast("decimal(18,4)")
    up_to_four = lambda x: F.least(dec(4), x.cast("decimal(18,4)"))
    rules = [
        ("change-comprehension", up_to_four(dec("0.5") + (c - 1) * dec("0.25")), "0.78"),
        ("change-review", changes.marginal_hours(n, "0.5", "0.25", "0.1", 8), "0.8"),
        ("change-validation", quarter(changes.marginal_hours(n, "0.5", "0.2", "0.05", 6)), "0.68"),
    ]
    if recreation:
        rules.append(("change-recreation-design", up_to_four(dec("0.5") + F.col("categories").cast("decimal(18,4)") * dec("0.25")), "0.68"))
    rows = []
    for rule, expected, sure in rules:
        expected = expected.cast("decimal(18,4)")
        low, high = changes.range_from_expected(expected, sure)
        rows.append(F.struct(F.lit(rule).alias("rule"), low.cast("decimal(18,4)").alias("low"), expected.alias("expected"), high.cast("decimal(18,4)").alias("high")))
    return changes_.where("represented > 0").select(*key, F.inline(F.array(*rows)))


def reconciliation(normalized: DataFrame, components: DataFrame, touches: DataFrame, final_paths: DataFrame, key: list[str]) -> DataFrame:
    """Isolated components against the normalized change: sums, tolerance, assessment and structural causes.

    normalized: key, low, expected, high, shared; components: key, component, low, expected, high, shared
    (hours of shared categories); touches: key, component, path; final_paths: key, path.
    """
    iso = components.groupBy(*key).agg(*[F.sum(p).alias(f"isolated_{p}") for p in ("low", "expected", "high", "shared")])
    at = [*key, "path"]
    # a path's first two touches tell all; in order of its key no task holds a hash map of paths
    paths = touches.repartition(*at).withColumn("_turn", F.row_number().over(Window.partitionBy(*at).orderBy("component"))).where("_turn <= 2")
    counted = paths.join(once(final_paths.select(at), at).withColumn("_final", F.lit(True)), at, "left").groupBy(*key).agg(F.count_if(F.col("_turn") == 2).alias("overlaps"), F.count_if((F.col("_turn") == 1) & F.col("_final").isNull()).alias("reverted"))
    rows = normalized.join(iso, key).join(counted, key, "left")
    difference = F.col("expected") - F.col("isolated_expected")
    tolerance = F.greatest(dec(1, "decimal(18,2)"), F.round((F.col("isolated_expected") * dec("0.1")).cast("decimal(28,8)"), 2).cast("decimal(18,2)"))
    return rows.withColumns(
        {
            "overlaps": F.coalesce("overlaps", F.lit(0)),
            "reverted": F.coalesce("reverted", F.lit(0)),
            "shared_excess": F.greatest(F.col("isolated_shared") - F.col("shared"), dec(0)),
            "difference": difference,
            "tolerance": tolerance,
            "assessment": F.when(F.abs(difference) <= tolerance, "within-no-rework-tolerance").when(difference < 0, "normalized-below-isolated-components").otherwise("normalized-above-isolated-components"),
        }
    )


def adjustments(reconciled: DataFrame, key: list[str]) -> DataFrame:
    """The difference of each reconciled change attributed to its causes, by weight; interaction takes the rest."""
    less = F.col("difference") < 0
    cause = lambda place, kind, weight, when: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), weight.cast("decimal(18,4)").alias("weight")))
    structural = F.array_compact(
        F.array(
            cause(0, "shared-setup", F.col("shared_excess"), less & (F.col("shared_excess") > 0)),
            cause(1, "overlap", F.col("overlaps"), less & (F.col("overlaps") > 0)),
            cause(2, "revert", F.col("reverted"), less & (F.col("reverted") > 0)),
        )
    )
    total = F.aggregate(structural, dec(0, "decimal(18,4)"), lambda acc, c: (acc + c.weight).cast("decimal(18,4)"))
    rest = F.when(F.size(structural) == 0, dec(1)).otherwise(F.greatest(dec(1), (total * dec("0.25")).cast("decimal(18,4)")))
    deltas = {p: F.col(p) - F.col(f"isolated_{p}") for p in ("low", "expected", "high")}
    rows = reconciled.withColumns({f"_{p}": d for p, d in deltas.items()} | {"_causes": structural, "_rest": rest})
    rows = rows.where("_low <> 0 or _expected <> 0 or _high <> 0").select(*key, "_low", "_expected", "_high", F.inline(F.concat("_causes", F.array(F.struct(F.lit(3).alias("place"), F.lit("interaction").alias("kind"), F.col("_rest").cast("decimal(18,4)").alias("weight"))))))
    for p in ("low", "expected", "high"):
        rows = changes.distribute(rows, key, ["place"], "weight", f"_{p}").withColumnRenamed("share", p).drop(f"_{p}")
    return rows.drop("place")


def shared_hours(items: DataFrame, key: list[str]) -> DataFrame:
    """Expected hours of a key's items in the categories that a coherent change needs once."""
    return items.groupBy(*key).agg(F.sum(F.when(F.col("category").isin(*SHARED), F.col("expected")).otherwise(dec(0))).alias("shared"))


def pruned(files: DataFrame, delta: DataFrame, snapshot: list[str], path: str = "path") -> DataFrame:
    """Files of a snapshot that a change needs: the changed ones, and manifests above them, as context.

    A semi-join before any analysis: what neither changed nor stands in a directory above a change goes.
    """
    changed = delta.where("status <> 'unchanged'").select(*snapshot, path).distinct()
    at = F.split(F.col(path), "/")
    above = changed.select(*snapshot, F.explode(F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda n: F.array_join(F.slice(at, 1, n), "/"))).alias("_dir")).distinct()
    folder = F.array_join(F.slice(at, 1, F.size(at) - 1), "/")
    context = files.where("is_context").withColumn("_dir", folder).join(above, [*snapshot, "_dir"], "left_semi").drop("_dir")
    direct = files.join(changed, [*snapshot, path], "left_semi")
    return direct.withColumn("why", F.lit("changed")).unionByName(context.join(changed, [*snapshot, path], "left_anti").withColumn("why", F.lit("context")))


#: Categories whose work never follows from one capability, and those that follow only from a new or a vanished one.
NO_DELTA = ("specification-comprehension-and-domain-learning", "manual-validation-debugging-and-hardening", "self-review-and-system-integration")
ONCE_DELTA = ("repository-and-solution-setup", "architecture-and-technical-design")


def modification_range(category: Column, status_factor: Column, units: Column) -> tuple[Column, Column, Column]:
    """Low, expected and high hours of changing what is there: units at falling rates, half an hour to eight."""
    rate = (changes.modification_factor(category) * status_factor).cast("decimal(18,8)")
    units = units.cast("decimal(18,0)")
    spent = F.least(units, dec(2)) * rate + F.least(F.greatest(units - 2, dec(0)), dec(6)) * rate * dec("0.5") + F.greatest(units - 8, dec(0)) * rate * dec("0.15")
    expected = quarter(F.least(F.greatest(spent.cast("decimal(28,8)"), dec("0.5", "decimal(28,8)")), dec(8, "decimal(28,8)")))
    return (changes.range_from_expected(expected, "0.7")[0], expected, changes.range_from_expected(expected, "0.7")[1])


def capability_deltas(base: DataFrame, head: DataFrame, paths: DataFrame, material: DataFrame, change: list[str], capability: str = "capability", evidence: str = "evidence_id") -> DataFrame:
    """Work items of capabilities by the rule that fits what both snapshots say of them.

    base, head: change, capability, category, low, expected, high, paths (array); paths: change, evidence,
    path, previous_path, status, regions (the represented ones); material: change, capability whose evidence differs in
    value.  More hours than before are marginal effort, priced as a modification where the capability
    was there or a file of it was; fewer are a removal if a path of it is touched; as many are a
    modification if a path is touched and the evidence differs.  Items: rule, verb, hours, evidence ids.

    What has a path, and what is said of a capability, meets in groups in place of joins by more than the change, so that
    inputs that come in partitions of the change are not shuffled again.
    """
    key = [*change, capability]
    points = ("category", "low", "expected", "high")
    base, head, paths, material = (df.dropna(subset=change) for df in (base, head, paths, material))  # no change, no evidence
    units, status = changes.logical_units(F.col("regions")), changes.status_factor(F.col("status"))
    of_path = {"_u": units, "_s": status, "_m": F.col("status") == "modified"}
    facts = paths.groupBy(*change, evidence).agg(*[F.max(c).alias(name) for name, c in of_path.items()])
    sums = lambda p, ids: [F.sum("_u").alias(f"{p}_units"), F.max("_s").alias(f"{p}_status"), F.max("_m").alias(f"{p}_modified"), F.sort_array(F.collect_set(ids)).alias(f"{p}_ids")]
    of_fact = Window.partitionBy(*change, evidence)
    moved = paths.select(*change, F.col(evidence).alias("_id"), *[F.max(c).over(of_fact).alias(name) for name, c in of_path.items()], F.explode_outer(F.array("path", "previous_path")).alias("_path"))
    held = lambda df: df.select(*change, F.explode_outer("paths").alias("_path"), F.struct(capability).alias("_of"))
    at = held(base).unionByName(held(head)).unionByName(moved.select(*change, "_path", F.struct("_id", *of_path).alias("_f")), True).where("_path is not null")
    met = at.groupBy(*change, "_path").agg(F.collect_set("_of").alias("_of"), F.collect_set("_f").alias("_f")).where("size(_of) > 0 and size(_f) > 0")
    hit = met.select(*change, F.explode("_of").alias("_of"), "_f").select(*change, f"_of.{capability}", F.explode("_f").alias("_f")).select(*key, "_f.*")
    hit = hit.where("_id is not null").groupBy(*key, "_id").agg(*[F.max(c).alias(c) for c in of_path])

    # keys that are null meet nothing
    side = lambda df, p: df.select(*key, F.when(F.col(capability).isNull(), p).alias("_alone"), F.struct(*points).alias(p))
    every = side(base, "_b").unionByName(side(head, "_h"), True).unionByName(material.select(*key, F.lit(True).alias("_material")), True).unionByName(hit, True)
    both = every.groupBy(*key, "_alone").agg(F.collect_list("_b").alias("_bs"), F.collect_list("_h").alias("_hs"), F.max("_material").alias("_material"), *sums("_t", "_id"))
    both = both.where("size(_bs) > 0 or size(_hs) > 0").withColumn("_b", F.explode_outer("_bs")).withColumn("_h", F.explode_outer("_hs"))
    both = both.withColumn("category", F.coalesce("_h.category", "_b.category")).drop("_bs", "_hs", "_alone")
    hours = lambda p, c: F.coalesce(f"_{p}.{c}", dec(0))
    b, h = F.col("_b").isNotNull(), F.col("_h").isNotNull()
    both = both.where(~F.col("category").isin(*NO_DELTA) & (~F.col("category").isin(*ONCE_DELTA) | ~b | ~h))
    rows = both.join(facts.groupBy(*change).agg(*sums("_c", evidence)), change, "left")

    touched = F.size("_t_ids") > 0
    of = lambda name: F.when(touched, F.col(f"_t_{name}")).otherwise(F.col(f"_c_{name}"))
    delta = hours("h", "expected") - hours("b", "expected")
    rule = (
        F.when(delta > 0, "capability-marginal").when((delta < 0) & touched, "capability-removal")
        .when((delta == 0) & touched & b & h & F.coalesce("_material", F.lit(False)), "capability-modification")
    )
    there = (delta > 0) & of("ids").isNotNull() & (b | of("modified"))
    changed = modification_range(F.col("category"), of("status"), of("units"))
    removed = changes.removal_expected(-delta)
    gone = (changes.range_from_expected(removed, "0.62")[0], removed, changes.range_from_expected(removed, "0.62")[1])
    diff = lambda c: hours("h", c) - hours("b", c)
    more = (F.least(F.greatest(diff("low"), dec(0)), delta), delta, F.greatest(delta, diff("high")))
    value = lambda i: F.when((rule == "capability-modification") | there, changed[i]).when(rule == "capability-removal", gone[i]).otherwise(more[i]).cast("decimal(18,4)")
    verb = F.when(rule == "capability-removal", "Remove or simplify").when(rule == "capability-modification", "Modify").when(b, "Expand").otherwise("Add")
    out = rows.select(*key, "category", rule.alias("rule"), verb.alias("verb"), *[value(i).alias(c) for i, c in enumerate(points[1:])], of("ids").alias("evidence_ids"))
    return out.where("rule is not null and expected > 0 and size(evidence_ids) > 0")
