"""Vocabularies that act as dimension tables: fixed values of the model, in canonical order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Effort categories in canonical order.
CATEGORIES = (
    "specification-comprehension-and-domain-learning",
    "repository-and-solution-setup",
    "architecture-and-technical-design",
    "production-implementation",
    "ui-implementation-and-represented-ux-decisions",
    "data-modeling-persistence-and-migrations",
    "external-integrations-and-protocols",
    "unit-testing",
    "integration-contract-and-component-testing",
    "end-to-end-and-ui-testing",
    "manual-validation-debugging-and-hardening",
    "documentation",
    "build-configuration-and-developer-tooling",
    "ci-cd-and-infrastructure-as-code",
    "security-and-accessibility",
    "packaging-deployment-and-release-artifacts",
    "self-review-and-system-integration",
)
# Categories that a coherent change needs once.
SHARED = (
    "specification-comprehension-and-domain-learning",
    "repository-and-solution-setup",
    "architecture-and-technical-design",
    "self-review-and-system-integration",
)
COMPLEXITIES = ("routine", "moderate", "high", "exceptional")
PROFILES = ("implementation", "recreation")
PROVENANCE = ("observed", "measured", "declared-assumed", "inferred")
STATUSES = ("added", "modified", "removed", "moved")
PARSER_DEPTHS = ("parser-backed", "token-backed", "structural")

# Size bands and their upper bounds.
SIZE_BANDS = (("zero", 0), ("xs", 1), ("s", 2), ("m", 4), ("l", 8), ("xl", 16), ("2xl", 32), ("3xl", 64), ("4xl", None))

# Strict upper limits of unremarkable callables.
OVERSIZED_TOKENS, HIGH_DECISIONS, DEEP_NESTING = 200, 10, 4

#: Our own defaults; a model table may replace them.
COMPLEXITY_FACTORS = {"routine": "0.85", "moderate": "1", "high": "1.25", "exceptional": "1.6"}
PROVENANCE_CONFIDENCE = {"observed": "0.9", "measured": "0.95", "declared-assumed": "0.7", "inferred": "0.55"}

# Factors of the change rules by category.
CHANGE_HEAVY = (
    "ui-implementation-and-represented-ux-decisions",
    "data-modeling-persistence-and-migrations",
    "external-integrations-and-protocols",
    "security-and-accessibility",
)
CHANGE_LIGHT = (
    "unit-testing",
    "integration-contract-and-component-testing",
    "end-to-end-and-ui-testing",
    "documentation",
    "build-configuration-and-developer-tooling",
    "ci-cd-and-infrastructure-as-code",
    "packaging-deployment-and-release-artifacts",
)
CHANGE_OVERHEAD = (
    "specification-comprehension-and-domain-learning",
    "repository-and-solution-setup",
    "architecture-and-technical-design",
    "manual-validation-debugging-and-hardening",
    "self-review-and-system-integration",
)
STATUS_FACTORS = {"modified": "0.3", "removed": "0.75"}


def ordinal(col: Column, names) -> Column:
    """Place of a name in its vocabulary; unknown names come last."""
    place = F.array_position(F.array(*map(F.lit, names)), col)
    return F.when(place > 0, place - 1).otherwise(len(names)).cast("int")


def choose(col: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(col == name, F.lit(value)).otherwise(out)
    return out


def size_band(x: Column) -> Column:
    out = F.lit(SIZE_BANDS[-1][0])
    for name, top in reversed(SIZE_BANDS[:-1]):
        out = F.when(x <= top, name).otherwise(out)
    return F.when(x.isNotNull(), out)
