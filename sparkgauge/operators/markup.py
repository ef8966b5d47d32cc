"""Markup trees: the elements of a page with their place in the tree, and what they offer to those who cannot see or point.

Elements come as rows, so that labels meet the controls they name by a join on ids.  Void elements
and implied ends are known; comments, scripts and styles hold no elements.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reading import rows_of

SCHEMA = (
    "parent int, depth int, tag string, element_id string, target string, kind string, named boolean, aria int, labels int, alternatives int, live int, focus int, keys int, clicks int"
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])
ENDS = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}}
HOLDERS = frozenset("ul ol table select dl div section article main body".split())
CONTROLS = ("input", "select", "textarea")
# Attributes that name an element, and events of keys.
NAMING = ("aria-label", "aria-labelledby", "aria-describedby")
MOST, MOST_UNITS = 2_000, 40
_KEYS = re.compile(r"(?:on|@|v-on:|.*:)?key(?:down|up|press)(?:\..*)?")
_CLICKS = re.compile(r"(?:on|@|v-on:|.*:)?click(?:\..*)?")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def elements(source: str) -> list[tuple]:
    """Rows of SCHEMA."""
    rows, stack, open_tags, at, last = [], [], Counter(), 0, source.rfind(">")
    while at <= last:
        m = _TAG.search(source, at)
        if m is None:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            while open_tags[tag]:
                gone = stack.pop()[1]
                open_tags[gone] -= 1
                if gone == tag:
                    break
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        k = len(stack)
        while k and stack[k - 1][1] not in HOLDERS:
            k -= 1
            if stack[k][1] in ENDS.get(tag, ()):
                for _, gone in stack[k:]:
                    open_tags[gone] -= 1
                del stack[k:]
                break
        n, ident, target, kind = Counter(), None, None, None
        for a in _ATTRIBUTE.finditer(m[3]):
            name = a[1].strip("[]()").lower().removeprefix("attr.")
            value = entities.unescape(a[2] or a[3] or a[4] or "")
            n["aria"] += name.startswith("aria-") or name == "role"
            n["labels"] += name in NAMING or name in ("for", "htmlfor")
            n["named"] += name in NAMING or name == "title"
            n["alternatives"] += name == "alt"
            n["live"] += name == "aria-live"
            n["focus"] += name in ("tabindex", "autofocus")
            n["keys"] += bool(_KEYS.fullmatch(name))
            n["clicks"] += bool(_CLICKS.fullmatch(name))
            ident = value if name == "id" else ident
            target = value if name in ("for", "htmlfor") else target
            kind = value.lower() if name == "type" else kind
        n["labels"] += tag == "label"
        rows.append((stack[-1][0] if stack else -1, len(stack), tag, ident, target, kind, n["named"] > 0, *[n[c] for c in ("aria", "labels", "alternatives", "live", "focus", "keys", "clicks")]))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append((len(rows) - 1, tag))
            open_tags[tag] += 1
    return rows


def tree(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """The elements of each page in order: keys, place, SCHEMA."""
    return rows_of(pages, keys, [html], elements, SCHEMA, "place")


def accessibility(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each page: aids (attributes, labels, ...), units of effort, and gaps.

    Gaps are controls that no label names (by id, by holding them, or by an attribute), images without
    an alternative, and elements that a pointer can click but no key can work.
    """
    capped = lambda c: F.least(F.lit(MOST), F.sum(c)).cast("int").alias(c)
    control = F.col("tag").isin(*CONTROLS) & ~F.coalesce("kind", F.lit("")).isin("hidden", "submit", "button", "image", "reset")
    clickable = (F.col("clicks") > 0) & (F.col("keys") == 0) & ~F.col("tag").isin("a", "button", "input", "select", "textarea", "summary", "option", "label")
    sums = rows.groupBy(*keys).agg(
        F.count("*").cast("int").alias("elements"), F.max("depth").alias("depth"), capped("aria"), capped("labels"), capped("alternatives"), capped("live"), capped("focus"), capped("keys"),
        F.count_if((F.col("tag") == "img") & (F.col("alternatives") == 0)).cast("int").alias("images_without_alternative"), F.count_if(clickable).cast("int").alias("pointer_only"),
    )
    named = rows.where("tag = 'label' and target is not null").select(*keys, F.col("target").alias("element_id")).distinct().withColumn("_for", F.lit(True))
    holders = rows.where("tag = 'label'").select(*keys, F.col("place").alias("parent")).withColumn("_held", F.lit(True))
    free = rows.where(control).join(named, [*keys, "element_id"], "left").join(holders, [*keys, "parent"], "left")
    gaps = free.groupBy(*keys).agg(F.count("*").cast("int").alias("controls"), F.count_if(F.col("_for").isNull() & F.col("_held").isNull() & ~F.col("named")).cast("int").alias("unlabelled"))
    out = sums.join(gaps, keys, "left").na.fill(0, ["controls", "unlabelled"])
    signals = sum(F.col(c) for c in ("aria", "labels", "alternatives", "live", "focus", "keys"))
    return out.withColumn("units", F.least(F.lit(MOST_UNITS), F.floor((signals + 2) / 3)).cast("int"))
