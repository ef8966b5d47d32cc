"""SQL files: tokens, statements and what they hold, dialect, role and confidence.

The lexer counts the depth of nested comments and knows the four kinds of quotes with their doubled
ends, and dollar quotes by their tag; what lies in them is one token.  A statement ends at a semicolon
outside parentheses or at ``GO``.  Confidence is low where a comment, quote or parenthesis does not
end or a file has more than ``MOST_TOKENS`` tokens, medium where too many statements begin with a
word that begins none, else high.  Counts are of whole files, each at most ``MOST``.

Null and empty texts give one row of zeros.

A line that ends all that it begins reads the same wherever a statement is not within a quote or comment, so a worker keeps the tokens of short lines.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analyzers import DIALECTS
from .reading import rows_of

MOST_TOKENS = 200_000
MOST = 10_000
DDL_REACH = 2_000  # tokens of a definition in which constraints are looked for

# Words that begin statements.
STARTERS = frozenset(
    "ALTER ANALYZE ATTACH BEGIN CALL COMMIT CREATE DECLARE DELETE DELIMITER DETACH DO DROP END EXEC EXECUTE EXPLAIN GRANT IF INSERT MERGE "
    "PRAGMA RELEASE REPLACE REVOKE ROLLBACK SAVEPOINT SELECT SET START TRUNCATE UPDATE USE VACUUM WITH".split()
)
# What a definition defines, by the word that says so.
TARGETS = {
    "TABLE": "tables", "VIEW": "views", "INDEX": "indexes", "SEQUENCE": "sequences", "TYPE": "types", "DOMAIN": "types", "FUNCTION": "functions", "PROCEDURE": "procedures", "PROC": "procedures", "TRIGGER": "triggers",
}
# Signs of other systems: word -> (name, words one of which must follow, word that must come before).
SIGNALS = {
    "DBLINK": ("dblink", None, None), "OPENQUERY": ("openquery", None, None), "OPENROWSET": ("openrowset", None, None), "OPENDATASOURCE": ("opendatasource", None, None),
    "FOREIGN": ("foreign-data", ("TABLE", "SERVER", "DATA"), None), "ATTACH": ("attached-database", ("DATABASE",), None), "FEDERATED": ("federated-engine", None, "ENGINE"), "LINK": ("database-link", None, "DATABASE"),
}
# Words that count for something.
TELLING = frozenset("CREATE ALTER DROP TRUNCATE SELECT INSERT MERGE UPDATE DELETE JOIN WITH OVER BEGIN START".split()) | SIGNALS.keys()
COUNTS = (
    "statements", "unknown", "ddl", "tables", "views", "indexes", "constraints", "sequences", "types", "functions", "procedures", "triggers",
    "queries", "joins", "ctes", "subqueries", "windows", "transactions", "modifications", "signals",
)
SCORED = ("mysql-mariadb", "postgresql", "sql-server", "sqlite")  # in the order that breaks ties
SCHEMA = ", ".join(f"{c} int" for c in COUNTS) + ", dialect string, dialect_confidence string, confidence string"

_TOKEN = re.compile(
    r"(?P<word>[A-Za-z_@#][\w$@#]*)|(?P<space>\s+|--[^\r\n]*)|(?P<comment>/\*)|(?P<string>'(?:[^']|'')*+'?)|(?P<quoted>\"(?:[^\"]|\"\")*+\"?|\[(?:[^\]]|\]\])*+\]?|`(?:[^`]|``)*+`?)"
    r"|(?P<dollar>\$\w{0,64}\$)|(?P<number>[0-9][0-9._]*)|(?P<sign>->>|::|:=|->|=>|<=|>=|<>|!=|\|\||&&|.)",
    re.S | re.A,
)
_DEPTH = re.compile(r"/\*|\*/")
_ENDS = {"'": "'", '"': '"', "[": "]", "`": "`"}


def lex(text: str) -> tuple[list[str], Counter, bool]:
    """Tokens (words in capitals, ``'`` and ``"`` for what is quoted, ``0`` for numbers), counts of quotes by kind, and whether all ends are there."""
    out, quotes, whole, at, n = [], Counter(), True, 0, len(text)
    while at < n:
        end = text.find("\n", at) + 1 or n
        if text.startswith("--", at) and "\r" not in text:
            at = end
            continue
        if end - at <= KEPT_LENGTH:
            some, marks, ended = kept_line(text[at:end])
            if ended:
                out += some
                quotes.update(marks)
                at = end
                continue
        some, marks, ended, at = lexed(text, at, end)
        out += some
        quotes.update(marks)
        whole &= ended
    return out, quotes, whole


KEPT_LENGTH = 300  # characters of the longest line whose tokens are kept


@lru_cache(65_536)
def kept_line(line: str) -> tuple[list[str], Counter, bool]:
    return lexed(line, 0, len(line))[:3]


def lexed(text: str, at: int, stop: int) -> tuple[list[str], Counter, bool, int]:
    """Tokens that begin from ``at`` on before ``stop``, counts of quotes, whether their ends are there, and where the last of them ends."""
    out, quotes, whole, n = [], Counter(), True, len(text)
    while at < stop:
        m = _TOKEN.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "word":
            out.append(m[0][:128].upper())
        elif kind == "sign":
            out.append(m[0])
        elif kind == "number":
            out.append("0")
        elif kind in ("string", "quoted"):
            quotes[m[0][0]] += 1
            body = m[0][1:]
            close = _ENDS[m[0][0]]
            whole &= (len(body) - len(body.rstrip(close))) % 2 == 1
            out.append("'" if kind == "string" else '"')
        elif kind == "dollar":
            quotes["$"] += 1
            end = text.find(m[0], at)
            whole &= end >= 0
            at = n if end < 0 else end + len(m[0])
            out.append("'")
        elif kind == "comment":
            depth = 1
            while depth:
                mark = _DEPTH.search(text, at)
                if mark is None:
                    whole, at = False, n
                    break
                depth += 1 if mark[0] == "/*" else -1
                at = mark.end()
    return out, quotes, whole, at


def is_word(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_@#"


def semantics(text: str) -> tuple:
    """A row of SCHEMA."""
    t, quotes, whole = lex(text)
    n, found, signals = len(t), Counter(), set()
    words = [i for i, x in enumerate(t) if is_word(x)]
    rank = {i: k for k, i in enumerate(words)}

    def after(i: int) -> int:
        """The next word within twelve tokens behind ``i``, or -1."""
        k = rank[i] + 1
        return words[k] if k < len(words) and words[k] <= i + 12 else -1

    def next_in(i: int, values) -> bool:
        j = after(i)
        return j >= 0 and t[j] in values

    def before(i: int, value: str) -> bool:
        k = rank[i] - 1
        return k >= 0 and words[k] >= i - 6 and t[words[k]] == value

    def constraints(i: int) -> int:
        depth = total = 0
        for j in range(i, min(n, i + DDL_REACH)):
            x = t[j]
            if x == "(":
                depth += 1
            elif x == ")":
                depth -= 1
            elif x == ";" and depth <= 0:
                break
            elif x in ("PRIMARY", "FOREIGN"):
                total += next_in(j, ("KEY",))
            elif x == "CHECK" or x == "UNIQUE" and not before(j, "CREATE"):
                total += 1
        return total

    def defined(i: int) -> None:
        j = after(i)
        if t[i] == "CREATE":
            while j >= 0 and t[j] in ("OR", "REPLACE", "ALTER", "TEMP", "TEMPORARY", "UNIQUE"):
                j = after(j)
            if j >= 0 and t[j] == "MATERIALIZED" and next_in(j, ("VIEW",)):
                j = after(j)
        if j >= 0:
            if t[j] in TARGETS:
                found[TARGETS[t[j]]] += 1
                found["ddl"] += 1
            found["constraints"] += constraints(i)

    for i in words:
        x = t[i]
        if x not in TELLING:
            continue
        if x in ("CREATE", "ALTER", "DROP", "TRUNCATE"):
            defined(i)
        elif x == "SELECT":
            found["queries"] += 1
        elif x in ("INSERT", "MERGE") or x in ("UPDATE", "DELETE") and not before(i, "ON"):
            found["modifications"] += 1
        elif x == "JOIN":
            found["joins"] += 1
        elif x == "WITH":
            k = next((k for k in range(i + 1, min(n, i + 16)) if t[k] in ("AS", ";")), n)
            found["ctes"] += t[k : k + 2] == ["AS", "("]
        elif x == "OVER":
            found["windows"] += t[i + 1 : i + 2] == ["("]
        elif x == "BEGIN" and next_in(i, ("TRAN", "TRANSACTION")) or x == "START" and next_in(i, ("TRANSACTION",)):
            found["transactions"] += 1
        if x in ("SELECT", "WITH") and i and t[i - 1] == "(":
            found["subqueries"] += 1
        if x in SIGNALS:
            name, follow, lead = SIGNALS[x]
            if (follow is None or next_in(i, follow)) and (lead is None or before(i, lead)):
                signals.add(name)

    depth, first = 0, ""
    for x in [*t, None]:
        if x is None or depth == 0 and x in (";", "GO"):
            found["statements"] += bool(first)
            found["unknown"] += bool(first) and first not in STARTERS
            first = ""
        elif x in "()":
            depth += 1 if x == "(" else -1
        elif not first and is_word(x):
            first = x
    found["signals"] = len(signals)

    heard = Counter(t[i] for i in words)
    score = {d: sum(heard[w] for w in DIALECTS[d]) for d in SCORED}
    score["postgresql"] += 2 * quotes["$"]
    score["sql-server"] += quotes["["]
    score["mysql-mariadb"] += quotes["`"]
    score["sqlite"] += sum(c for w, c in heard.items() if w.startswith("SQLITE_"))
    (first, top), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    sure = "high" if top >= 4 and top - second >= 2 else "medium" if top >= 2 else "low"
    dialect = ("standard-or-unknown", "low") if not top else ("mixed-or-ambiguous", "low") if top == second else (first, sure)

    counts = [min(MOST, found[c]) for c in COUNTS]
    low = not whole or depth != 0 or n > MOST_TOKENS
    return (*counts, *dialect, "low" if low else "medium" if counts[1] > max(2, counts[0] // 4) else "high")


def analyzed(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a file: the keys and SCHEMA."""
    return rows_of(files, keys, [text], lambda t: [semantics(t)], SCHEMA)


def units(counts: DataFrame) -> DataFrame:
    """Add the units of effort of schema and of queries, and whether a file holds any data semantics."""
    half = F.ceil(sum(F.col(c) for c in ("joins", "ctes", "subqueries", "windows", "transactions")) / 2)
    return counts.withColumns({
        "schema_units": F.least(F.lit(2_000), F.col("views") + F.col("indexes") + F.col("sequences") + F.col("types") + F.ceil(F.col("constraints") / 3)).cast("int"),
        "query_units": F.least(F.lit(2_000), F.col("queries") + F.col("modifications") + half).cast("int"),
        "has_semantics": sum(F.col(c) for c in ("ddl", "queries", "modifications", "functions", "procedures", "triggers")) > 0,
    })


# Directories that tell a role.
MIGRATIONS = ("migration", "migrations", "migrate", "changelog", "changesets")
SEEDS = ("seed", "seeds", "sample-data", "sampledata")
DELIVERIES = ("deploy", "deployment", "install", "installer", "bootstrap", "provision")
DUMPS = ("dump", "dumps", "backup", "backups", "snapshot", "snapshots", "export", "exports")
FIXTURES = ("fixture", "fixtures", "test-data", "testdata")
HEAD = 131_072  # characters in which signs of a dump are looked for


def role(path: Column, text: Column, is_test: Column) -> Column:
    """What a SQL file is for: the first rule that fits; needs the counts of ``analyzed`` in the row."""
    low = F.lower(path)
    segments, name = F.filter(F.split(low, "/"), lambda x: x != ""), F.substring_index(low, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    within = lambda names: F.exists(segments, lambda x: x.isin(*names))
    head = F.lower(F.substring(text, 1, HEAD))
    kept = within((*SEEDS, *FIXTURES, "test", "tests"))
    copied = F.contains(head, F.lit("copy ")) & F.contains(head, F.lit(" from stdin;"))
    signed = head.rlike("postgresql database dump|mysql dump|dumped from database version") | copied
    dump = ~kept & (within(DUMPS) | name.rlike(r"\.(dump|bak|snapshot)\.sql$")) | signed | ~kept & (F.regexp_count(head, F.lit("insert into ")) >= 100)
    migration = stem.rlike(r"^(r__|[vu][0-9].*__|[0-9]{3,}[_.-])|migration|changelog") & (F.length(stem) > 2) | within(MIGRATIONS)
    return (
        F.when(dump, "dump").when(is_test | within(FIXTURES), "test-fixture").when(migration, "migration")
        .when(within(SEEDS) | name.startswith("seed") | F.contains(name, F.lit(".seed.")), "seed-data")
        .when(within(DELIVERIES) | name.rlike("^(install|bootstrap|provision)"), "delivery")
        .when(F.col("functions") + F.col("procedures") + F.col("triggers") > 0, "stored-program").when(F.col("ddl") > 0, "schema")
        .when(F.col("queries") + F.col("modifications") > 0, "query").otherwise("unknown")
    )
