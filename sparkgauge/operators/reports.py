"""Report projections: views, review queue, top scopes, explanations, packets, payload, rendering."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import dec

MATERIAL, UNCERTAIN, QUEUE, LOW_CONFIDENCE, TOP_SCOPES = 6, 6, 12, 0.75, 20
PACKET_CAPABILITIES, PACKET_FACTS = 12, 48
SOURCE_LINES, SOURCE_CHARS = 200, 65_536


def capability_of(item: Column) -> Column:
    """Id of a work item's capability: its own without the part's number."""
    return F.regexp_replace(item, r":part-\d+$", "")


def weighted_confidence(hours: str, sure: str) -> Column:
    """Confidence weighted by hours, two digits; 0 without hours."""
    total = F.sum(F.col(hours).cast("decimal(18,4)"))
    weighted = F.sum((F.col(hours).cast("decimal(18,4)") * F.col(sure).cast("decimal(9,4)")).cast("decimal(28,8)"))
    return F.when(total == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.round((weighted / total).cast("decimal(28,8)"), 2).cast("decimal(18,2)"))


def by_capability(items: DataFrame, item: str = "item_id", keys: tuple[str, ...] = ("category", "scope")) -> DataFrame:
    """Work items of one capability as a row."""
    return items.groupBy(capability_of(F.col(item)).alias("capability"), *keys).agg(
        F.count("*").alias("items"), *[F.sum(h).alias(h) for h in ("low", "expected", "high")], weighted_confidence("expected", "confidence").alias("confidence")
    )


def view(items: DataFrame, keys: list[str]) -> DataFrame:
    """Hours, items and confidence by the view's keys (none: the whole repository)."""
    return items.groupBy(*keys).agg(F.count("*").alias("items"), *[F.sum(h).alias(h) for h in ("low", "expected", "high")], weighted_confidence("expected", "confidence").alias("confidence"))


def review_queue(rows: DataFrame, group: list[str], key: str, hours: str, sure: str, reasons: Column | None = None) -> DataFrame:
    """At most 12 rows a group: the 6 largest, then the 6 least certain, with the reasons of each."""
    w = Window.partitionBy(*group)
    doubtful = F.col(sure) < LOW_CONFIDENCE
    unsure = doubtful if reasons is None else doubtful | reasons
    rows = rows.withColumns(
        {
            "_big": F.row_number().over(w.orderBy(F.desc(hours), key)),
            "_unsure": F.when(unsure, F.row_number().over(w.orderBy(F.when(unsure, 0).otherwise(1), sure, F.desc(hours), key))),
        }
    )
    material, picked = F.col("_big") <= MATERIAL, F.coalesce(F.col("_unsure") <= UNCERTAIN, F.lit(False))
    names = [F.when(material, "material-effort"), F.when(picked & doubtful, "low-confidence")]
    if reasons is not None:
        names.append(F.when(picked & reasons, "explicit-uncertainty"))
    why = F.array_join(F.array_sort(F.array_compact(F.array(*names))), "+")
    chosen = rows.where(material | picked).withColumn("reasons", why)
    place = F.row_number().over(w.orderBy(F.when(F.col("_big") <= MATERIAL, F.col("_big")).otherwise(MATERIAL + F.col("_unsure"))))
    return chosen.withColumn("place", place).where(F.col("place") <= QUEUE).drop("_big", "_unsure")


def top_with_rest(rows: DataFrame, key: str, hours: str, most: int = TOP_SCOPES) -> DataFrame:
    """The largest rows and one row for all that are left out."""
    top = rows.orderBy(F.desc(hours), key).limit(most).select(key, hours, F.lit(1).cast("long").alias("members"))
    rest = rows.join(top.select(key), key, "left_anti").agg(F.sum(hours).alias(hours), F.count("*").alias("members"))
    return top.unionByName(rest.where("members > 0").withColumn(key, F.lit("(omitted)")))


def explained(items: DataFrame, facts: DataFrame, item: str, evidence: str, fact_id: str) -> DataFrame:
    """Evidence of each item with its facts; ``missing`` where the fact is not there."""
    wanted = items.select(item, F.explode(evidence).alias(fact_id)).distinct()
    return wanted.join(facts.withColumn("_there", F.lit(True)), fact_id, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def packet(capabilities: DataFrame, facts: DataFrame, key: str, hours: str) -> tuple[DataFrame, DataFrame]:
    """Review packet: the largest capabilities and their first facts, within fixed limits."""
    top = capabilities.orderBy(F.desc(hours), key).limit(PACKET_CAPABILITIES)
    return top, facts.join(F.broadcast(top.select(key)), key, "left_semi").orderBy(key, *[c for c in facts.columns if c != key]).limit(PACKET_FACTS)


def source_slice(text: Column, first: int, last: int) -> Column:
    """Lines first to last (from 1) of a text, within 200 lines and 65,536 characters."""
    n = min(last - first + 1, SOURCE_LINES)
    return F.substring(F.array_join(F.slice(F.split(text, "\n", -1), first, n), "\n"), 1, SOURCE_CHARS)


def payload(text: Column) -> dict[str, Column]:
    """Bytes, characters, and tokens at four characters each, rounded up."""
    text = F.coalesce(text, F.lit(""))
    return {"payload_bytes": F.octet_length(text).cast("long"), "payload_chars": F.char_length(text).cast("long"), "payload_tokens": F.ceil(F.char_length(text) / F.lit(4).cast("decimal(2,0)")).cast("long")}


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Share of equal verdicts, and chance-corrected agreement, of two columns."""
    n = F.count("*")
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = cells.agg(n.alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.sum(F.col(a).cast("long")).alias("a1"), F.sum(F.col(b).cast("long")).alias("b1"))
    seen = F.col("same") / F.col("n")
    chance = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
    return sums.select("n", "same", F.round(seen, 6).alias("agreement"), F.round((seen - chance) / F.nullif(1 - chance, F.lit(0.0)), 6).alias("kappa"))


def matrix(points: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row a contributor, one column a bucket, for the trend report."""
    return points.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)


def canonical_json(row_or_rows, pretty: bool = True) -> str:
    """Canonical JSON of a small report: line feeds only, nulls left out, one at the end."""

    def plain(x):
        if hasattr(x, "asDict"):
            x = x.asDict()
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if v is not None}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return float(x) if isinstance(x, Decimal) else x

    return json.dumps(plain(row_or_rows), indent=2 if pretty else None, ensure_ascii=False, default=str) + "\n"


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A Markdown table of a report; reports are short, and ``most`` bounds what is shown."""
    rows = df.limit(most + 1).collect()
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}\n"
    body = "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows[:most])
    return head + body + ("\nFurther rows are left out.\n" if len(rows) > most else "")


def _table(rows, columns: list[str]) -> str:
    """Rows of a small report as a Markdown table."""
    cell = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    return f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n" + "".join("| " + " | ".join(cell(r[c]).replace("|", "\\|") for c in columns) + " |\n" for r in rows)


def estimate_view(items: DataFrame, kind: str, rate=None, most: int = 200) -> dict:
    """A view as a document: repository, category, scope, work-item or review; ``most`` rows and what they leave out."""
    keys = {"repository": [], "category": ["category"], "scope": ["scope"], "work-item": ["item_id", "category", "scope"], "review": ["item_id"]}[kind]
    if kind == "review":
        rows = review_queue(items.withColumn("_all", F.lit(1)), ["_all"], "item_id", "expected", "confidence").select("place", "item_id", "category", "scope", "low", "expected", "high", "confidence", "reasons").orderBy("place")
    else:
        rows = view(items, keys)
        rows = (rows if rate is None else rows.withColumns(cost_columns(rate))).orderBy(F.desc("expected"), *keys)
    shown = [r.asDict() for r in rows.limit(most + 1).collect()]
    total = items.agg(F.count("*").alias("items"), *[F.sum(h).alias(h) for h in ("low", "expected", "high")]).first().asDict()
    return {"view": kind, "total": total, "rows": shown[:most], "complete": len(shown) <= most}


def view_markdown(document: dict, title: str = "Estimate") -> str:
    """A view as Markdown: totals, the table, and a note if rows were left out."""
    t = document["total"]
    out = f"# {title}: {document['view']}\n\n{t['items']} items; low {t['low']}, expected {t['expected']}, high {t['high']} hours. Ranges are planning bounds, not probabilities.\n\n"
    if document["rows"]:
        out += _table(document["rows"], list(document["rows"][0]))
    return out + ("" if document["complete"] else "\nFurther rows are left out.\n")


def explanation(items: DataFrame, facts: DataFrame, item: str, evidence: str = "evidence_ids", fact_id: str = "id") -> dict:
    """One item with the facts behind it and the ids of those that are missing."""
    one = items.where(F.col("item_id") == item)
    found = explained(one, facts, "item_id", evidence, fact_id).orderBy(fact_id).limit(PACKET_FACTS).collect()
    row = one.first()
    if row is None:
        raise KeyError(item)
    return {"item": row.asDict(), "facts": [r.asDict() for r in found if not r["missing"]], "missing": [r[fact_id] for r in found if r["missing"]]}


def explanation_markdown(document: dict) -> str:
    i = document["item"]
    out = f"# {i['item_id']}\n\n" + "".join(f"- {k}: {v}\n" for k, v in i.items() if k != "item_id" and v is not None)
    if document["facts"]:
        out += "\n## Evidence\n\n" + _table(document["facts"], [c for c in document["facts"][0] if c not in ("missing", "item_id")])
    return out + ("\n## Missing\n\n" + "".join(f"- {m}\n" for m in document["missing"]) if document["missing"] else "")


def sections_markdown(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report of several tables: a change with its items, adjustments and paths, a portfolio with its groups and series.

    Each table shows ``most`` rows and says if there are more.
    """
    out = f"# {title}\n"
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        out += f"\n## {name}\n\n" + (_table([r.asDict() for r in rows[:most]], df.columns) if rows else "None.\n")
        out += "\nFurther rows are left out.\n" if len(rows) > most else ""
    return out


def sections_json(kind: str, sections: dict[str, DataFrame], most: int = 10_000) -> str:
    """The same report as canonical JSON; a table with more rows than ``most`` is an error, since it belongs in a file of rows."""
    out = {"kind": kind}
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [r.asDict(True) for r in rows]
    return canonical_json(out)


def review_query(kind: str, value: str, items: DataFrame, facts: DataFrame, most: int = PACKET_FACTS) -> DataFrame:
    """What a reviewer asks for: a capability's items, an item's or fact's evidence, or a scope's facts, in order and bounded."""
    if kind == "capability":
        return items.where(capability_of(F.col("item_id")) == value).orderBy("item_id").limit(most)
    if kind == "evidence":
        return facts.where(F.col("id") == value).limit(most)
    if kind == "scope":
        return facts.where((F.col("scope") == value) | F.col("scope").startswith(value.rstrip("/") + "/")).orderBy("id").limit(most)
    raise ValueError(kind)


def adjustment_checks(adjustments: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Proposed ranges against their items: deltas, and what is wrong with each.

    adjustments: key, low, expected, high, reason.
    """
    own = items.select(key, *[F.col(p).alias(f"_{p}") for p in ("low", "expected", "high")])
    rows = adjustments.join(own, key, "left")
    problem = (
        F.when(F.col("_expected").isNull(), "unknown-item")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no-reason")
        .when((F.col("low") < 0) | (F.col("low") > F.col("expected")) | (F.col("expected") > F.col("high")), "not-ordered")
        .when((F.col("low") == F.col("_low")) & (F.col("expected") == F.col("_expected")) & (F.col("high") == F.col("_high")), "no-change")
        .otherwise("ok")
    )
    return rows.select(key, problem.alias("status"), *[F.when(F.col("_expected").isNotNull(), F.col(p) - F.col(f"_{p}")).alias(f"{p}_delta") for p in ("low", "expected", "high")])


def overlap_rate(a: DataFrame, b: DataFrame, key: list[str], item: str) -> DataFrame:
    """How far two reviewers' choices overlap, by key: both, either, and the share; null where neither chose."""
    rows = a.select(*key, item).distinct().withColumn("_a", F.lit(1)).join(b.select(*key, item).distinct().withColumn("_b", F.lit(1)), [*key, item], "full_outer")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return rows.groupBy(*key).agg(both.alias("both"), F.count("*").alias("either"), F.round(both / F.count("*"), 6).alias("rate"))


def cost_columns(rate) -> dict[str, Column]:
    return {f"{h}_cost": F.round((F.col(h) * dec(rate)).cast("decimal(28,8)"), 2).cast("decimal(18,2)") for h in ("low", "expected", "high")}
