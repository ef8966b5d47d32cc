"""URL filter: pattern rules indexed by their rarest literal token.

Rules use the common filter-list notation: ``||`` anchors at a host or any of its
subdomains, ``^`` stands for a separator or the end, ``*`` for anything.  Every rule is
filed under the one of its literal tokens that the URLs at hand use least.  A URL
fetches the rules filed under its own tokens; only those run their regular expression.

Up to ``LITERAL_RULES`` rules the index is a literal inside the projection, a table of hash slots,
so a token costs one look-up whatever the number of rules, and the whole filter is one map-only
stage; only the token counts (one row per rule token) are aggregated.  A longer list is a
table: distinct URLs meet it by a join on tokens, and the verdicts are joined back by URL.

Null and empty URLs, and those without ``://``, get empty host and path, no rule and the
default verdict.  Repeated rows stay repeated; other columns of the input are kept, except
that ``host``, ``path``, ``rule``, ``method_rule`` and ``verdict`` are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

LITERAL_RULES = 10_000
RULE = "struct<token:string,text:string,regex:string,verdict:string,host_rule:boolean>"

SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    """``host_rule`` rules run on host plus path and outrank patterns; the longest wins."""

    text: str
    verdict: str
    host_rule: bool = False

    @property
    def notation(self) -> str:
        return "||" + self.text if self.host_rule else self.text

    @property
    def regex(self) -> str:
        body = self.notation
        start = r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#]*\.)?" if body.startswith("||") else ""
        if self.host_rule:
            start = r"^(?:[^/]*\.)?"
        out = "".join({"*": ".*", "^": SEPARATOR}.get(c, re.escape(c)) for c in body.removeprefix("||"))
        return ("(?s)" if self.host_rule else "(?is)") + start + out

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that any matching URL holds whole."""
        body = self.notation
        anchored = body.startswith("||")
        body = body.removeprefix("||").lower()
        found = []
        for m in re.finditer(r"[a-z0-9]+", body):
            left = body[m.start() - 1] if m.start() else ("^" if anchored else "*")
            right = body[m.end()] if m.end() < len(body) else "*"
            if "*" not in (left, right):
                found.append(m[0])
        return found


BASE_RULES = (
    Rule("net/", "block", True),
    Rule("example.net/en/", "allow", True),
    Rule("example.com/de/", "block", True),
    Rule("org/fr/", "allow", True),
)

PATTERN_RULES = (
    Rule("^utm_source=feed^", "block"),
    Rule("^replytocom=", "block"),
    Rule("^sessionid=", "block"),
    Rule("^wp-admin/", "block"),
    Rule("^wp-login.php", "block"),
    Rule("^add-to-cart=", "block"),
    Rule("/cgi-bin/", "block"),
    Rule("^action=edit^", "block"),
    Rule("^print=1^", "block"),
    Rule("||doubleclick.net^", "block"),
    Rule("||ads.*/banner/", "block"),
    Rule("/download/*.exe^", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def rule_index(pages: DataFrame, rules, url_col: str = "url") -> dict[str, list[Rule]]:
    """Rarest token -> rules. Counts come from all URLs; one row a rule token reaches the driver."""
    bare = [r.text for r in rules if not r.tokens]
    if bare:
        raise ValueError(f"rules without a whole literal token: {bare}")
    wanted = sorted({t for r in rules for t in r.tokens})
    slots = slot_table({t: [t] for t in wanted}, "array<array<string>>")
    known = lambda t: F.array_contains(slot(slots, t, len(wanted)), t)
    tokens = F.filter(url_tokens(F.col(url_col)), known)
    counts = dict(pages.select(F.explode(tokens).alias("token")).groupBy("token").count().collect())
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(r)
    return index


def n_slots(n: int) -> int:
    return 1 << max(1, (2 * n).bit_length())


def slot_table(entries: dict[str, list], kind: str) -> Column:
    """Entries by hash slot of their token, as one literal."""
    slots = [[] for _ in range(n_slots(len(entries)))]
    for token, values in sorted(entries.items()):
        slots[zlib.crc32(token.encode()) % len(slots)] += values
    return F.from_json(F.lit(json.dumps(slots)), kind)


def slot(table: Column, token: Column, n: int) -> Column:
    """The slot of a token in a table of n entries."""
    return F.get(table, F.pmod(F.crc32(token), F.lit(n_slots(n))).cast("int"))


def _entry(token: str, r: Rule) -> dict:
    return {"token": token, "text": r.text, "regex": r.regex, "verdict": r.verdict, "host_rule": r.host_rule}


def fetched_by_join(pages: DataFrame, index: dict[str, list[Rule]], url_col: str) -> DataFrame:
    """``_fetched`` of each page by a join of distinct URLs' tokens with a table of rules."""
    spark = pages.sparkSession
    rules = spark.createDataFrame([tuple(_entry(t, r).values()) for t, rs in index.items() for r in rs], "token string, text string, regex string, verdict string, host_rule boolean")
    urls = pages.select(F.col(url_col).alias("_url")).distinct()
    asked = urls.select("_url", F.explode(url_tokens(F.col("_url"))).alias("token"))
    found = asked.join(rules, "token").groupBy("_url").agg(F.collect_list(F.struct("token", "text", "regex", "verdict", "host_rule")).alias("_fetched"))
    joined = pages.join(found, F.col(url_col) == F.col("_url"), "left").drop("_url")
    return joined.withColumn("_fetched", F.coalesce("_fetched", F.array().cast(f"array<{RULE}>")))


def filter_urls(pages: DataFrame, rules=BASE_RULES + PATTERN_RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host rules only), method_rule (any) and verdict."""
    index = rule_index(pages, rules, url_col)
    host, path = url_parts(F.col(url_col))
    if len(rules) <= LITERAL_RULES:
        table = slot_table({t: [_entry(t, r) for r in rs] for t, rs in index.items()}, f"array<array<{RULE}>>")
        own = lambda t: F.filter(slot(table, t, len(index)), lambda r: r.token == t)
        out = pages.withColumn("_fetched", F.flatten(F.transform(url_tokens(F.col(url_col)), own)))
    else:
        out = fetched_by_join(pages, index, url_col)
    out = out.withColumns({"host": host, "path": path})
    fits = F.filter(
        "_fetched",
        lambda r: F.when(r.host_rule, F.rlike(F.concat("host", "path"), r.regex)).otherwise(
            F.rlike(F.coalesce(F.col(url_col), F.lit("")), r.regex)
        ),
    )
    ranked = F.array_sort(
        F.transform(fits, lambda r: F.struct((~r.host_rule).alias("pattern"), (-F.length(r.text)).alias("rank"), r.text.alias("text"), r.verdict.alias("verdict"), r.host_rule.alias("host_rule")))
    )
    best = F.get(ranked, 0)
    return (
        out.withColumn("_best", best)
        .withColumn("rule", F.when(F.col("_best.host_rule"), F.col("_best.text")))
        .withColumn("method_rule", F.col("_best.text"))
        .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default)))
        .drop("_fetched", "_best")
    )
