"""From facts to capabilities, work items and reports: the estimator as joins with rule tables.

Facts have repo, scope, id, kind, source_kind, measurements (array of name and value) and
tags.  A fact contributes its measurements, and a count of itself, to families; a short table
says which family and measure feed which driver of which rule, at the fact's scope or for the
whole repository.  So all drivers of all rules come from one explode, one broadcast join with
that table and one aggregation; coefficients and marginal tiers are tables as well, and a user's
own replace the defaults.  Estimates send facts once to the place of their scope; only rules of
whole repositories are combined before their shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import dec, to_increment
from ..functions.vocabulary import CATEGORIES, ordinal
from . import pricing

ROOT = "."
FACTS = "#facts"
TECHNOLOGIES = "#technologies"

# Kinds of facts with a meaning at the boundary of a system.
SEMANTIC = ("accessibility", "api-surface", "background-work", "data-access", "integration", "security-configuration", "user-interface", "validation")
SCOPES = ("dotnet-project", "javascript-package", "ecosystem-package")
TESTS = ("dotnet-test", "ecosystem-test", "javascript-test", "sql-test", "test-suite")

# Family of facts -> rule -> driver -> measures that feed it (none named: the driver's own name).
SCOPED = {
    "entry-point": {"application-entry-point": {"entry-points": (FACTS,)}},
    "api-surface": {"api-surface": {"endpoints": ("attributed-endpoints", "minimal-api-endpoints", "endpoints"), "controllers": (), "graphql-operations": (), "route-groups": ()}},
    "user-interface": {
        "ui-surface": {
            "pages": ("pages", "page-directives"), "components": (), "ui-types": (), "forms": ("forms", "form-usages"), "state-usages": (), "effect-usages": (), "component-parameters": (), "commands": (),
            "template-structure-units": (), "template-binding-units": (), "style-structure-units": (), "responsive-surfaces": (), "design-token-units": (), "animation-theme-surfaces": (),
        }
    },
    "user-interface:assets": {"ui-surface": {"asset-files": ("files",)}},
    "data-access": {"data-persistence": {"db-contexts": (), "db-sets": (), "migrations": (), "entity-configurations": (), "repository-types": (), "data-calls": ()}},
    "integration": {"external-integration": {"boundaries": (TECHNOLOGIES,), "client-constructions": (), "integration-calls": (), "integration-namespaces": ()}},
    "security-configuration": {"security-surface": {"security-surfaces": (FACTS,), "security-configuration-calls": (), "authorization-attributes": (), "security-usages": ()}},
    "validation": {"validation-surface": {"validator-types": (), "validation-rules": (), "validation-attributes": (), "validation-usages": ()}},
    "background-work": {"background-work": {"hosted-services": (), "message-handlers": (), "functions": (), "background-usages": (), "hosted-service-registrations": ()}},
    "source:dotnet": {"dotnet-source-backbone": {"files": (), "types": (), "public-types": (), "methods": (), "public-methods": (), "async-methods": (), "branch-points": ()}},
    "source:javascript": {
        "javascript-source-backbone": {"files": (), "functions": (), "methods": (), "classes": (), "interfaces": (), "type-aliases": (), "enums": (), "async-functions": (), "branch-points": (), "exports": (), "dynamic-imports": ()}
    },
    "source:other": {"polyglot-source-backbone": {"files": (), "functions": (), "methods": (), "types": (), "public-symbols": (), "async-units": (), "branch-points": ()}},
    "scope": {"project-setup": {"scopes": (FACTS,), "target-frameworks": (), "dependencies": ("packages", "dependencies")}},
    "javascript-configuration": {"project-setup": {"configuration-options": ("compiler-options",)}},
    "production-scope": {"architecture-design": {"production-scopes": (FACTS,)}, "manual-validation": {"runnable-scopes": ("runnable",)}},
    "project-reference": {"architecture-design": {"reference-edges": (FACTS,)}},
    "presence": {"architecture-design": {"boundary-families": (FACTS,)}},
    "presence:specialized": {"manual-validation": {"specialized-boundaries": (FACTS,)}},
    "runtime": {"manual-validation": {"runtime-surfaces": ("runtime-surfaces",)}},
} | {f"tests:{t}": {f"{t}-tests": {"test-files": (FACTS,), "test-cases": ("test-methods", "test-cases"), "parameterized-cases": (), "assertions": (), "mock-usages": ()}} for t in ("unit", "integration", "end-to-end")}
REPOSITORY = {
    "production-scope": {"specification-comprehension": {"production-scopes": (FACTS,)}, "self-review": {"production-scopes": (FACTS,)}},
    "repository-presence": {"specification-comprehension": {"semantic-families": (FACTS,)}, "self-review": {"specialized-boundaries": (FACTS,)}},
    "dotnet-solution": {"solution-coordination": {"solutions": (FACTS,)}},
    "javascript-workspace": {"solution-coordination": {"workspaces": (FACTS,)}},
    "project-reference": {"solution-coordination": {"reference-edges": (FACTS,)}, "self-review": {"reference-edges": (FACTS,)}},
    "documentation": {"documentation": {"documents": ("files",), "physical-lines": ()}},
    "build-configuration": {"build-tooling": {"configuration-files": (FACTS,)}},
    "javascript-configuration": {"build-tooling": {"configuration-files": (FACTS,), "compiler-options": ()}},
    "javascript-package": {"build-tooling": {"scripts": ()}},
    "ci-configuration": {"ci-infrastructure": {"ci-files": ("files",), "physical-lines": ()}},
    "infrastructure": {"ci-infrastructure": {"infrastructure-files": ("files",), "physical-lines": ()}},
    "container-configuration": {"container-deployment": {"container-files": ("files", "container-units"), "physical-lines": ()}},
    "packable": {"packaging-release": {"packaging-surfaces": (FACTS,)}},
    "sql-delivery": {"packaging-release": {"release-configurations": (FACTS,)}},
    "delivery-automation": {"packaging-release": {"release-configurations": (FACTS,)}},
}
# A rule's base complexity, and the drivers whose sum above a limit makes it high.
COMPLEXITY = {
    "specification-comprehension": ("moderate", ("semantic-families",), 5), "project-setup": ("routine", (), None), "architecture-design": ("moderate", ("boundary-families",), 4),
    "application-entry-point": ("routine", (), None), "api-surface": ("moderate", ("endpoints", "graphql-operations"), 40), "ui-surface": ("moderate", ("pages", "forms"), 20),
    "data-persistence": ("moderate", ("migrations",), 20), "external-integration": ("moderate", ("boundaries",), 3), "security-surface": ("high", (), None),
    "background-work": ("moderate", ("hosted-services", "message-handlers", "functions", "background-usages", "hosted-service-registrations"), 20), "end-to-end-tests": ("high", (), None),
    "unit-tests": ("routine", (), None), "documentation": ("routine", (), None), "build-tooling": ("routine", ("compiler-options", "scripts"), 50),
    "container-deployment": ("moderate", ("container-files",), 5), "packaging-release": ("moderate", ("packaging-surfaces", "release-configurations"), 4),
    "manual-validation": ("moderate", ("specialized-boundaries",), 2), "self-review": ("moderate", ("production-scopes", "reference-edges"), 12),
    "gap-system-tests": ("high", (), None), "gap-documentation": ("routine", (), None), "gap-ci": ("routine", (), None),
}

#: Our own default coefficients: rule -> place of its category, setup hours, hours a unit (half of it beyond ten units).
DEFAULTS = {
    "specification-comprehension": (0, "1", "0.25"), "solution-coordination": (1, "0.5", "0.25"), "project-setup": (1, "0.95", "0.25"), "architecture-design": (2, "1.25", "0.25"), "recreation-design": (2, "1", "0.25"),
    "dotnet-source-backbone": (3, "0.25", "0.1"), "javascript-source-backbone": (3, "0.25", "0.1"), "polyglot-source-backbone": (3, "0.25", "0.1"), "application-entry-point": (3, "0.25", "0.5"),
    "background-work": (3, "0.5", "0.5"), "validation-surface": (3, "0.25", "0.2"), "api-surface": (3, "0.5", "0.4"), "ui-surface": (4, "0.5", "0.5"), "data-persistence": (5, "0.5", "0.3"),
    "external-integration": (6, "1", "0.5"), "unit-tests": (7, "0.25", "0.1"), "coverage-achievement": (7, "0.25", "0.1"), "integration-tests": (8, "0.5", "0.2"), "end-to-end-tests": (9, "0.75", "0.3"),
    "manual-validation": (10, "0.5", "0.2"), "documentation": (11, "0.25", "0.05"), "build-tooling": (12, "0.25", "0.1"), "ci-infrastructure": (13, "0.5", "0.05"), "security-surface": (14, "1", "0.5"),
    "container-deployment": (15, "0.5", "0.05"), "packaging-release": (15, "0.5", "0.5"), "self-review": (16, "1", "0.25"),
    "gap-automated-tests": (7, "2", "0.25"), "gap-system-tests": (8, "2", "0.5"), "gap-documentation": (11, "2", "0.25"), "gap-ci": (13, "1", "0.25"),
}
SUMS = 4  # partitions of sums for each of the session's shuffle partitions
LOW, HIGH, CONFIDENCE = "0.65", "1.6", "0.7"


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held by the plan itself, so that reading it starts no Python worker."""
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows))))), schema)


def driver_table(spark: SparkSession) -> DataFrame:
    """(family, measure, whole, rule, driver): what feeds what; ``whole``: for the whole repository."""
    rows = [
        (family, measure, whole, rule, driver)
        for whole, table in ((False, SCOPED), (True, REPOSITORY))
        for family, rules in table.items()
        for rule, drivers in rules.items()
        for driver, measures in drivers.items()
        for measure in measures or (driver,)
    ]
    return fixed_table(spark, rows, "family string, measure string, whole boolean, rule string, driver string")


def default_model(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, category, setup, low_factor, high_factor, rule_confidence) and their tiers (rule, over, upto, rate)."""
    rules = [(r, CATEGORIES[c], setup, LOW, HIGH, CONFIDENCE) for r, (c, setup, _) in DEFAULTS.items()]
    tiers = [x for r, (_, _, rate) in DEFAULTS.items() for x in ((r, "0", "10", rate), (r, "10", None, str(float(rate) / 2)))]
    number = lambda df, *names: df.withColumns({n: df[n].cast("decimal(9,4)") for n in names})
    return (
        number(fixed_table(spark, rules, "rule string, category string, setup string, low_factor string, high_factor string, rule_confidence string"), "setup", "low_factor", "high_factor", "rule_confidence"),
        number(fixed_table(spark, tiers, "rule string, over string, upto string, rate string"), "over", "upto", "rate"),
    )


def test_type(tags: Column) -> Column:
    """Type of a test by its tags; component tests count as integration tests."""
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    return F.when(has("test-type:end-to-end", "e2e"), "end-to-end").when(has("test-type:integration", "test-type:component", "integration"), "integration").otherwise("unit")


def runtime_surfaces(kind: Column, value) -> Column:
    """Surfaces of one fact that can be run; ``value(*names)`` is the sum of its measurements of those names."""
    of = lambda *names: F.greatest(value(*names), dec(1, "decimal(38,10)"))
    return (
        F.when(kind.isin("entry-point", "background-work"), dec(1, "decimal(38,10)"))
        .when(kind == "api-surface", of("attributed-endpoints", "minimal-api-endpoints", "endpoints", "graphql-operations"))
        .when(kind == "user-interface", of("pages", "page-directives", "components", "ui-types"))
        .otherwise(dec(0, "decimal(38,10)"))
    )


MEASURES = "array<struct<name:string,value:decimal(38,10)>>"
COUNTED = sorted({family for table in (SCOPED, REPOSITORY) for family, rules in table.items() if any(FACTS in m for drivers in rules.values() for m in drivers.values())})


def _measured(facts: DataFrame) -> DataFrame:
    """repo, scope, kind, id and tags of facts, their measurements, and what has to be looked for among those and the tags."""
    kind, named = F.col("kind"), F.coalesce("measurements", F.array().cast(MEASURES))
    if facts.schema["measurements"].dataType.simpleString() != MEASURES:
        named = F.transform(named, lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value"))).cast(MEASURES)
    value = lambda *names: F.aggregate(named, dec(0, "decimal(38,10)"), lambda acc, m: F.when(m["name"].isin(*names), (acc + m["value"]).cast("decimal(38,10)")).otherwise(acc))
    surfaces = F.when(kind.isin("entry-point", *SEMANTIC), (runtime_surfaces(kind, value) + value("runtime-surfaces")).cast("decimal(38,10)"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    technologies = F.when(kind == "integration", F.greatest(F.lit(1), F.size(F.filter(tags, lambda t: t.startswith("technology:")))))
    return facts.select("repo", "scope", "kind", F.coalesce("id", F.lit("")).alias("id"), tags.alias("tags"), named.alias("named"), surfaces.alias("surfaces"), technologies.alias("technologies"))


def _families() -> Column:
    """Array of the families of a fact: name, measures, and for families that count kinds the kind as a bit; null where it is not of one."""
    kind, tags, named = F.col("kind"), F.col("tags"), F.col("named")
    items = lambda *rows: F.array(*[F.struct(F.lit(name).alias("name"), x.cast("decimal(38,10)").alias("value")) for name, x in rows]).cast(MEASURES)
    one, technologies, runnable = (FACTS, F.lit(1)), (TECHNOLOGIES, F.col("technologies")), ("runnable", F.array_contains(tags, "scope:runnable").cast("int"))
    own = (
        F.when(kind.isin(*TESTS), F.concat(F.lit("tests:"), test_type(tags)))
        .when(kind == "source-structure", F.concat(F.lit("source:"), F.when(F.substring_index("id", ":", 1).isin("dotnet", "javascript"), F.substring_index("id", ":", 1)).otherwise("other")))
        .otherwise(kind)
    )
    beside = F.when(kind == "integration", F.concat(named, items(one, technologies))).when(kind == "production-scope", F.concat(named, items(one, runnable))).when(own.isin(*COUNTED), F.concat(named, items(one))).otherwise(named)
    production = kind.isin(*SCOPES) & ~F.array_contains(tags, "scope:test")
    only = lambda condition, name, m, kinds=None: F.when(condition, F.struct(name.alias("family"), m.alias("m"), (F.lit(None).cast("long") if kinds is None else kinds).alias("kinds")))
    # a kind counts once however many facts are of it, so it travels as a bit
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position(F.array(*map(F.lit, SEMANTIC)), kind).cast("int"))
    semantic, seen = kind.isin(*SEMANTIC), items((FACTS, F.lit(None)))
    return F.array(
        only(own.isNotNull(), own, beside),
        only(kind.isin(*SCOPES), F.lit("scope"), F.concat(named, items(one))),
        only(production, F.lit("production-scope"), F.concat(named, items(one, runnable))),
        only((kind == "user-interface") & F.array_contains(tags, "ui-asset:maintained"), F.lit("user-interface:assets"), named),
        only(F.arrays_overlap(tags, F.array(*map(F.lit, ("packable:declared-true", "package:cli-bin", "package:library-exports")))), F.lit("packable"), items(one)),
        only(F.col("surfaces").isNotNull(), F.lit("runtime"), items(("runtime-surfaces", F.col("surfaces")))),
        only(semantic, F.lit("presence"), seen, bit),
        only(kind.isin("data-access", "integration", "security-configuration", "background-work"), F.lit("presence:specialized"), seen, bit),
        only(semantic, F.lit("repository-presence"), seen, bit),
    )


def drivers_at(facts: DataFrame, whole: bool) -> DataFrame:
    """The drivers of the rules of single scopes, or of those of whole repositories: repo, scope, rule, driver, value."""
    fits = REPOSITORY if whole else SCOPED
    found = _measured(facts).select("repo", "scope", F.inline(_families())).where(F.col("family").isin(*fits))
    rows = found.select("repo", "scope", "family", "kinds", F.inline("m")).withColumnRenamed("name", "measure")
    fed = rows.join(F.broadcast(driver_table(facts.sparkSession).where(F.col("whole") == whole)), ["family", "measure"])  # a table of fixed size
    keys = ["repo", *([] if whole else ["scope"]), "rule", "driver"]
    total = F.coalesce(F.sum("value"), dec(0, "decimal(38,10)")) + F.coalesce(F.bit_count(F.bit_or("kinds")), F.lit(0))
    return fed.groupBy(*keys).agg(total.cast("decimal(38,10)").alias("value")).where("value > 0").select("repo", F.lit(ROOT).alias("scope") if whole else "scope", "rule", "driver", "value")


def drivers(facts: DataFrame) -> DataFrame:
    """(repo, scope, rule, driver, value): every driver of every rule, summed."""
    return drivers_at(facts, False).unionByName(drivers_at(facts, True))


def gaps(facts: DataFrame) -> DataFrame:
    """Drivers, like those of ``drivers``, of work that a repository lacks: tests, system tests, documentation, CI."""
    kind, tags = F.col("kind"), F.coalesce("tags", F.array().cast("array<string>"))
    production = kind.isin(*SCOPES) & ~F.array_contains(tags, "scope:test")
    outward = kind.isin("api-surface", "user-interface")
    seen = facts.groupBy("repo").agg(
        F.count_if(production).alias("scopes"),
        F.count_if(production & F.array_contains(tags, "scope:runnable")).alias("runnable"),
        F.count_if(kind.isin(*TESTS)).alias("tests"),
        F.count_if(kind.isin(*TESTS) & (test_type(tags) != "unit")).alias("system_tests"),
        F.count_if(outward).alias("surfaces"),
        F.count_if(kind == "documentation").alias("documents"),
        F.count_if(kind == "ci-configuration").alias("ci"),
    )
    gap = lambda condition, rule, driver, value: F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(driver).alias("driver"), value.cast("decimal(38,10)").alias("value")))
    found = F.array_compact(
        F.array(
            gap((F.col("scopes") > 0) & (F.col("tests") == 0), "gap-automated-tests", "runtime-surfaces", F.greatest("surfaces", F.lit(1))),
            gap((F.col("surfaces") > 0) & (F.col("system_tests") == 0), "gap-system-tests", "runtime-surfaces", F.col("surfaces")),
            gap(F.col("documents") == 0, "gap-documentation", "documents", F.lit(0)),
            gap((F.col("ci") == 0) & ((F.col("scopes") > 1) | (F.col("runnable") > 0)), "gap-ci", "production-scopes", F.col("scopes")),
        )
    )
    return seen.select("repo", F.lit(ROOT).alias("scope"), F.inline(found))


def scaled(driven: DataFrame, factors: DataFrame) -> DataFrame:
    """Drivers of source structures times their scope's factor (repo, scope, factor); others as they are."""
    backbone = F.col("rule").endswith("source-backbone")
    rows = driven.join(factors.select("repo", "scope", F.col("factor").cast("decimal(18,6)").alias("_factor")), ["repo", "scope"], "left")
    value = F.when(backbone, (F.col("value") * F.coalesce("_factor", dec(1, "decimal(18,6)"))).cast("decimal(38,10)")).otherwise(F.col("value"))
    return rows.withColumn("value", value).drop("_factor").where("value > 0")


def coverage_drivers(facts: DataFrame, source_hours: DataFrame) -> DataFrame:
    """Drivers of covered implementation: a scope's source hours times its coverage; measured beats declared.

    facts: kind coverage with measurements in percent; source_hours: repo, scope, hours of its backbone.
    """
    rows = facts.where("kind = 'coverage'").withColumn("_m", (F.col("source_kind") == "measured") | F.coalesce(F.array_contains("tags", "coverage:measured"), F.lit(False))).select("repo", "scope", "_m", "source_kind", F.explode("measurements").alias("m"))
    rows = rows.where("_m or source_kind = 'declared-assumed'")
    value = F.col("m.value").cast("decimal(38,10)")
    sums = rows.groupBy("repo", "scope").agg(F.bool_or("_m").alias("measured"), F.avg(F.when(F.col("_m"), value)).alias("_mean"), F.avg(F.when(~F.col("_m"), value)).alias("_declared"))
    percent = F.when(F.col("measured"), F.col("_mean")).otherwise(F.col("_declared")).cast("decimal(18,4)")
    out = sums.join(source_hours, ["repo", "scope"], "left").withColumn("percent", percent)
    hours = (F.coalesce("hours", dec(0)).cast("decimal(18,4)") * F.col("percent") / 100).cast("decimal(38,10)")
    level = F.when(F.col("percent") >= 100, "high").when(F.col("percent") >= 80, "moderate").otherwise("routine")
    return out.select("repo", "scope", F.lit("coverage-achievement").alias("rule"), F.lit("covered-implementation-hours").alias("driver"), F.greatest(hours, dec("0.01", "decimal(38,10)")).alias("value"), "measured", "percent", level.alias("complexity"))


def recreation_drivers(facts: DataFrame) -> DataFrame:
    """Drivers of design that a recreation must recover: kinds of boundaries and references between scopes."""
    kind = F.col("kind")
    seen = facts.groupBy("repo").agg(F.countDistinct(F.when(kind.isin(*SEMANTIC), kind)).alias("_f"), F.count_if(kind == "project-reference").alias("_r"), F.count_if(kind.isin(*SCOPES)).alias("_s"))
    return seen.select("repo", F.lit(ROOT).alias("scope"), F.lit("recreation-design").alias("rule"), F.lit("decision-surfaces").alias("driver"), (F.col("_f") + F.col("_r") + F.col("_s")).cast("decimal(38,10)").alias("value")).where("value > 0")


def capabilities(driven: DataFrame, model: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a rule and scope: drivers as a map, quantity, complexity, expected hours and the rule's factors."""
    spark = driven.sparkSession
    rules, tiers = model or default_model(spark)
    limits = [(r, base, list(names), top) for r, (base, names, top) in COMPLEXITY.items()]
    levels = fixed_table(spark, limits, "rule string, base string, weighs array<string>, high_above int")
    reach = lambda t: F.least("value", F.coalesce(t["upto"], "value")) - t["over"]
    hours = lambda t: (F.greatest(reach(t), dec(0)).cast("decimal(18,4)") * t["rate"]).cast("decimal(28,8)")
    prices = tiers.groupBy("rule").agg(F.collect_list(F.struct("over", "upto", "rate")).alias("tiers")).join(F.broadcast(levels.select("rule", "weighs")), "rule", "left")
    priced = driven.join(F.broadcast(prices), "rule").select(
        "repo", "scope", "rule", "driver", "value",
        F.aggregate("tiers", dec(0, "decimal(28,8)"), lambda acc, t: (acc + hours(t)).cast("decimal(28,8)")).alias("hours"),
        F.when(F.array_contains("weighs", F.col("driver")), F.col("value")).otherwise(dec(0)).alias("weight"),
    )
    of = lambda *names: F.sum(F.when(F.col("driver").isin(*names), F.col("value")))
    whole = priced.groupBy("repo", "scope", "rule").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("driver", F.col("value").cast("decimal(18,4)"))))).alias("drivers"),  # at most one a driver of the rule
        F.greatest(F.sum("value"), dec("0.01")).cast("decimal(18,4)").alias("quantity"),
        F.sum("hours").alias("hours"),
        F.sum("weight").alias("weight"),
        of("methods", "functions").alias("methods"),
        of("branch-points").alias("branches"),
        of("async-methods", "async-functions", "async-units").alias("asyncs"),
    )
    from .facts import source_complexity

    zero = lambda c: F.coalesce(c, F.lit(0))
    known = rules.join(F.broadcast(levels.drop("weighs")), "rule", "left")
    level = F.when(F.col("weight") > F.col("high_above"), "high").otherwise(F.coalesce("base", F.lit("moderate")))
    level = F.when(F.col("rule").endswith("source-backbone"), source_complexity(F.col("methods"), zero("branches"), zero("asyncs"))).otherwise(level)
    out = whole.join(F.broadcast(known), "rule").withColumn("complexity", level)
    factor = pricing.expected_hours(F.col("setup"), F.col("hours"), F.col("complexity"))
    return out.withColumn("expected", factor).drop("weight", "base", "high_above", "methods", "branches", "asyncs", "hours")


def by_scope(facts: DataFrame) -> DataFrame:
    """Facts sent to the place of their scope, where they are summed, priced and met with its evidence without another shuffle.

    A short fact becomes many sums, so they go to a stated number of partitions, which small ones do not lower.
    """
    return facts.repartition(SUMS * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo", "scope")


def represented(facts: DataFrame, model: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Capabilities of all single scopes, and those of whole repositories, which are combined before their shuffle; no rule is of both kinds."""
    return capabilities(drivers_at(by_scope(facts), False), model), capabilities(drivers_at(facts, True), model)


def evidence_confidence(facts: DataFrame) -> DataFrame:
    """(repo, scope, provenance, token_backed, truncated, evidence_ids) over a scope's facts."""
    has = lambda *names: F.bool_or(F.arrays_overlap("tags", F.array(*map(F.lit, names))))
    return facts.groupBy("repo", "scope").agg(
        F.round(F.avg(pricing.provenance_confidence(F.col("source_kind"))), 8).alias("provenance"),
        F.coalesce(has("syntax:token-backed", "syntax:token-fallback"), F.lit(False)).alias("token_backed"),
        F.coalesce(has("locations:truncated"), F.lit(False)).alias("truncated"),
    )


def work_items(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Capabilities as work items: confidence, three-point hours, parts of bounded size, stable ids."""
    rows = found.join(evidence, ["repo", "scope"], "left")
    known = F.coalesce("provenance", dec("0.5", "decimal(9,4)"))
    no = F.lit(False)
    sure = pricing.confidence(F.col("rule_confidence"), known, F.coalesce("token_backed", no), F.coalesce("truncated", no))
    rows = pricing.split_items(rows.withColumn("confidence", sure))
    rows = pricing.split_quantity(rows, "quantity")
    low, high = pricing.range_factors(F.col("low_factor"), F.col("high_factor"), F.col("confidence"))
    e = F.col("part_hours")
    token = pricing.item_id(F.col("repo"), F.col("rule"), F.col("scope"))
    return rows.select(
        "repo", "scope", "rule", "category", "complexity", "part", "parts",
        F.concat_ws(":", F.lit("work"), F.col("rule"), token, F.concat(F.lit("part-"), F.lpad(F.col("part").cast("string"), 4, "0"))).alias("item_id"),
        F.col("part_quantity").alias("quantity"),
        F.least(to_increment(e * low), e).alias("low"),
        e.alias("expected"),
        F.greatest(to_increment(e * high), e).alias("high"),
        "confidence",
    )


def estimate(facts: DataFrame, model: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``items`` that the evidence represents, and ``gap``: items that a finished repository would have."""
    scoped, whole = represented(facts, model)
    at_root = evidence_confidence(facts.where(F.col("scope") == ROOT))
    items = work_items(scoped, evidence_confidence(by_scope(facts))).unionByName(work_items(whole, at_root))
    return {"items": items, "gap": work_items(capabilities(gaps(facts), model), at_root)}


def totals(items: DataFrame, rate=None) -> DataFrame:
    """Hours by repository and category in canonical order, with the repository's total (category null) and its cost."""
    sums = items.rollup("repo", "category").agg(*[F.sum(h).alias(h) for h in ("low", "expected", "high")], F.count("*").alias("items")).where("repo is not null")
    out = sums.withColumn("place", F.when(F.col("category").isNotNull(), ordinal(F.col("category"), CATEGORIES)))
    return out if rate is None else out.withColumn("cost", pricing.cost(F.col("expected"), rate))
