"""Pricing of capabilities into work items: tiers, complexity, confidence, ranges, splitting, cost.

All of it is projection on the capability rows; only splitting multiplies rows (by the number
of parts) and only roll-ups shuffle, after partial aggregation.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import clamp, dec, to_increment
from ..functions.vocabulary import COMPLEXITY_FACTORS, PROVENANCE_CONFIDENCE, choose

#: Our own default sizing of work items, in hours.
INCREMENT, LEAST, MOST, TARGET = "0.25", "0.25", "8", "6"


def tiered(quantity: Column, tiers) -> Column:
    """Marginal price of a quantity: ``tiers`` lists (up to or None, hours per unit), ascending."""
    total, before = dec(0, "decimal(28,4)"), Decimal(0)
    for top, rate in tiers:
        reach = quantity if top is None else F.least(quantity, dec(top))
        total = (total + F.greatest(reach - dec(before), dec(0)) * dec(rate, "decimal(9,4)")).cast("decimal(28,4)")
        before = Decimal(str(top)) if top is not None else before
    return total


def expected_hours(setup, drivers: Column, complexity: Column, least=LEAST, increment=INCREMENT) -> Column:
    """(setup + drivers) times the complexity's factor, on the increment, no less than ``least``."""
    factor = choose(complexity, COMPLEXITY_FACTORS, "1").cast("decimal(9,4)")
    raw = ((dec(setup) + drivers).cast("decimal(18,4)") * factor).cast("decimal(28,8)")
    return F.greatest(to_increment(raw, increment), dec(least, "decimal(18,2)"))


def confidence(rule, provenance: Column, token_backed: Column, truncated: Column, penalty=0) -> Column:
    """Mean of the rule's and the evidence's confidence less penalties, within [0.2, 0.95], two digits."""
    lost = dec(penalty) + F.when(token_backed, dec("0.08")).otherwise(dec(0)) + F.when(truncated, dec("0.04")).otherwise(dec(0))
    return F.round(clamp(((dec(rule) + provenance) / 2).cast("decimal(28,8)") - lost, "0.2", "0.95"), 2).cast("decimal(18,2)")


def provenance_confidence(kind: Column) -> Column:
    return choose(kind, PROVENANCE_CONFIDENCE, "0.5").cast("decimal(9,4)")


def range_factors(low, high, sure: Column) -> tuple[Column, Column]:
    """Low and high factors, widened where confidence is lacking."""
    widening = ((dec(1) - sure) * dec("0.25")).cast("decimal(18,4)")
    return F.greatest(dec("0.35"), dec(low) - widening), (dec(high) + widening).cast("decimal(18,4)")


def split_items(df: DataFrame, expected: str = "expected", target=TARGET, increment=INCREMENT) -> DataFrame:
    """One row a part: ``part``, ``parts`` and ``part_hours``; whole increments, the first parts take the remainder."""
    step = Decimal(str(increment))
    units = (F.col(expected).cast("decimal(18,2)") / F.lit(step)).cast("long")
    parts = F.greatest(F.lit(1), F.ceil(F.col(expected).cast("decimal(18,2)") / dec(target)).cast("int"))
    df = df.withColumns({"parts": parts, "_units": units}).withColumn("part", F.explode(F.sequence(F.lit(1), "parts")))
    share = F.expr("_units div parts") + F.when(F.col("part") <= F.col("_units") % F.col("parts"), 1).otherwise(0)
    return df.withColumn("part_hours", (share * F.lit(step)).cast("decimal(18,2)")).drop("_units")


def split_quantity(df: DataFrame, quantity: str) -> DataFrame:
    """``part_quantity`` of rows with part and parts: even shares of four digits, the last takes the rest."""
    even = F.round(F.col(quantity).cast("decimal(18,4)") / F.col("parts"), 4).cast("decimal(18,4)")
    last = (F.col(quantity).cast("decimal(18,4)") - even * (F.col("parts") - 1)).cast("decimal(18,4)")
    return df.withColumn("part_quantity", F.when(F.col("part") == F.col("parts"), last).otherwise(even))


def item_id(*parts: Column) -> Column:
    """Stable token: the first ten bytes of the SHA-256 of the parts, in hex."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 20)


def category_rollup(df: DataFrame, keys: list[str], hours=("low", "expected", "high")) -> DataFrame:
    """Sums by key, by key prefix, and in total; rolled-up keys are null."""
    return df.rollup(*keys).agg(*[F.sum(h).alias(h) for h in hours], F.count("*").alias("items"))


def cost(hours: Column, rate) -> Column:
    return F.round((hours.cast("decimal(18,4)") * dec(rate)).cast("decimal(28,8)"), 2).cast("decimal(18,2)")


def hourly_rate(wage: Column, total_compensation="72.99", wages="50.53", utilization="0.75", step="5") -> Column:
    """Wage times loading over utilization, to the nearest step."""
    load = Decimal(total_compensation) / Decimal(wages) / Decimal(utilization)
    return to_increment((wage.cast("decimal(18,4)") * F.lit(round(load, 12)).cast("decimal(18,12)")).cast("decimal(28,8)"), step)
