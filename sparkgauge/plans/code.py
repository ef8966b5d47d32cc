"""Code plans: sources written from the words of every document, read by the analyzers of their language.

The words of a text choose the statements, so that SQL can state what the analyzers must find, by
adding up what each statement is known to hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import csharp, evaluation, formatting, jscode, pythoncode, sqlcode
from ..sources import table
from .registry import query

STEP = 20  # words a callable

WORDS_SQL = r"""words AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT doc_id, lang, w, (len(w) + 19) // 20 AS m FROM words),
units AS (SELECT doc_id, lang, m, i, coalesce(len(w[20 * i + 1]), 0) AS a, coalesce(len(w[20 * i + 2]), 0) AS b, coalesce(len(w[20 * i + 3]), 0) AS c FROM sizes, LATERAL (SELECT unnest(range(m)) AS i))"""


def worded(spark, sf_dir):
    """doc_id, lang, the words of each document, and how many units of STEP words they make."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda x: x != "")
    texts = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # a file costs far more to read than to send, and a table of few row groups would leave most cores idle
    rows = texts.repartition(4 * spark.sparkContext.defaultParallelism).select("doc_id", "lang", words.alias("w"))
    return rows.withColumn("m", F.expr(f"(size(w) + {STEP - 1}) div {STEP}").cast("int"))


def unit_texts(write) -> Column:
    """``write(i, a, b, c, comment)`` for every unit: its number, the lengths of its first words, its words as one text; joined."""
    size = lambda i, k: F.coalesce(F.length(F.get("w", i * STEP + k)), F.lit(0))
    each = F.when(F.col("m") > 0, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(each, lambda i: write(i, size(i, 0), size(i, 1), size(i, 2), F.array_join(F.slice("w", i * STEP + 1, STEP), " "))), "")


# C#: statement, its tokens, decisions and nesting.
CSHARP = (
    ("if (a && b) { x = 1; }", 12, 2, 1),
    ("for (;;) { if (p) y(); }", 15, 2, 2),
    ('s = "if (x) { " + @"while ""q""";', 6, 0, 0),
    ("x = c ? 1 : d ? 2 : 3;", 12, 2, 2),
    ("f(z => { if (z) w(); });", 16, 0, 0),
    ("switch (k) { case 1: case 2: g(); break; default: h(); break; }", 26, 2, 1),
)


def pick(values, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def pick_sql(column: int, k: str) -> str:
    return f"([{', '.join(str(x[column]) for x in CSHARP)}])[{k} % 6 + 1]"


def csharp_files(spark, sf_dir):
    """One class a document: a public method that calls the first of its private ones, which call others by the lengths of their words."""

    def write(i, a, b, c, comment):
        statements = F.concat_ws(" ", *[pick([x[0] for x in CSHARP], k) for k in (a, b, c)])
        calls = F.concat(F.lit(" M"), (i * 7 + a) % F.col("m"), F.lit("();"), F.when(b % 2 == 0, F.concat(F.lit(" M"), (i + b) % F.col("m"), F.lit("();"))).otherwise(""))
        return F.concat(F.lit("    private void M"), i, F.lit("()\n    {\n        // "), comment, F.lit("\n        "), statements, calls, F.lit("\n    }\n"))

    head = F.concat(F.lit("namespace N;\npublic class D"), F.coalesce(F.abs("doc_id"), F.lit(0)), F.lit("\n{\n    public void Go() { "), F.when(F.col("m") > 0, "M0();").otherwise(""), F.lit(" }\n"))
    return worded(spark, sf_dir).select("doc_id", "lang", F.concat(head, unit_texts(write), F.lit("}\n")).alias("text"))


CALLABLES_SQL = f"""calls AS (
  SELECT doc_id, lang, (i + 1)::INTEGER AS place, 'M' || i AS name, (11 + {pick_sql(1, 'a')} + {pick_sql(1, 'b')} + {pick_sql(1, 'c')} + CASE WHEN b % 2 = 0 THEN 4 ELSE 0 END)::INTEGER AS tokens,
    (1 + {pick_sql(2, 'a')} + {pick_sql(2, 'b')} + {pick_sql(2, 'c')})::INTEGER AS complexity, greatest({pick_sql(3, 'a')}, {pick_sql(3, 'b')}, {pick_sql(3, 'c')})::INTEGER AS nesting FROM units
  UNION ALL SELECT doc_id, lang, 0, 'Go', CASE WHEN m > 0 THEN 11 ELSE 7 END, 1, 0 FROM sizes)"""


@query(f"WITH {WORDS_SQL}, {CALLABLES_SQL} SELECT doc_id, place, name, tokens, complexity, nesting FROM calls")
def csharp_callables(spark, sf_dir):
    """Tokens, decision complexity and nesting of every method of C# files written from all documents."""
    return csharp.callables(csharp_files(spark, sf_dir), ["doc_id"]).select("doc_id", "place", "name", "tokens", "complexity", "nesting")


@query(f"""
WITH RECURSIVE {WORDS_SQL},
edges AS (SELECT doc_id, i AS src, (i * 7 + a) % m AS dst FROM units UNION SELECT doc_id, i, (i + b) % m FROM units WHERE b % 2 = 0),
reach(doc_id, i) AS (SELECT doc_id, 0 FROM sizes WHERE m > 0 UNION SELECT r.doc_id, e.dst FROM reach r JOIN edges e ON e.doc_id = r.doc_id AND e.src = r.i)
SELECT u.doc_id, 'M' || u.i AS name, r.i IS NOT NULL AS reachable FROM units u LEFT JOIN reach r ON r.doc_id = u.doc_id AND r.i = u.i
""")
def csharp_reachability(spark, sf_dir):
    """Private methods that a file's entry point reaches, through cycles and recursion, and those that it does not."""
    return csharp.callables(csharp_files(spark, sf_dir), ["doc_id"]).where("candidate").select("doc_id", "name", "reachable")


@query(f"""
WITH {WORDS_SQL}, {CALLABLES_SQL}
SELECT lang, quantile_disc(tokens, 0.5)::BIGINT AS size_p50, quantile_disc(tokens, 0.9)::BIGINT AS size_p90, max(tokens)::BIGINT AS size_max, round(count(*) FILTER (tokens > 200)::DOUBLE / count(*), 6) AS size_share,
  quantile_disc(complexity, 0.5)::BIGINT AS decisions_p50, quantile_disc(complexity, 0.9)::BIGINT AS decisions_p90, max(complexity)::BIGINT AS decisions_max, round(count(*) FILTER (complexity > 10)::DOUBLE / count(*), 6) AS decisions_share,
  quantile_disc(nesting, 0.5)::BIGINT AS nesting_p50, quantile_disc(nesting, 0.9)::BIGINT AS nesting_p90, max(nesting)::BIGINT AS nesting_max, round(count(*) FILTER (nesting > 4)::DOUBLE / count(*), 6) AS nesting_share, 1.0::DOUBLE AS coverage, 0.0::DOUBLE AS ambiguity
FROM calls GROUP BY 1
""")
def csharp_structure(spark, sf_dir):
    """The fourteen structural measures of each scope, from the callables of its files."""
    rows = csharp.callables(csharp_files(spark, sf_dir), ["lang"]).where("executable")
    return evaluation.callable_distribution(rows.select("lang", F.col("tokens").alias("size"), F.col("complexity").alias("decisions"), "nesting", "parsed"), ["lang"])


# SQL: statement and what it holds.
SQL_UNITS = (
    ("CREATE TABLE t (id SERIAL PRIMARY KEY, x int CHECK (x > 0), FOREIGN KEY (x) REFERENCES u (id) ON DELETE CASCADE);\n", dict(statements=1, ddl=1, tables=1, constraints=3, pg=1)),
    ("WITH c AS (SELECT a, row_number() OVER (ORDER BY b) FROM t) SELECT * FROM c JOIN (SELECT 1) d ON c.a = d.a;\n", dict(statements=1, queries=3, joins=1, ctes=1, subqueries=2, windows=1)),
    ("/* outer /* CREATE TABLE x; */ still */ INSERT\tINTO t VALUES ('it''s; SELECT', \"a;b\", [c;d]);\nGO\n", dict(statements=1, modifications=1, ms=2)),
    ("CREATE OR REPLACE FUNCTION f() RETURNS int AS $body$ BEGIN; SELECT 1; END $body$ LANGUAGE plpgsql;\n", dict(statements=1, ddl=1, functions=1, pg=3)),
    ("BEGIN TRANSACTION; UPDATE t SET x = 1; DELETE FROM t; COMMIT;\n", dict(statements=4, transactions=1, modifications=2)),
    ("CREATE UNIQUE INDEX i ON t (x); ALTER TABLE t ADD CONSTRAINT u UNIQUE (x); DROP VIEW v;\n", dict(statements=3, ddl=3, indexes=1, tables=1, views=1, constraints=1)),
    ("FROBNICATE the thing; SELECT * FROM OPENQUERY(srv, 'x');\n", dict(statements=2, unknown=1, queries=1, ms=1, s1=1)),
    ("CREATE MATERIALIZED VIEW mv AS SELECT `a` FROM t; PRAGMA x; CREATE FOREIGN TABLE ft (y int);\n", dict(statements=3, ddl=1, views=1, queries=1, my=1, lite=1, s2=1)),
    ("CREATE SEQUENCE s; CREATE DOMAIN d AS int; CREATE PROC p AS SELECT 1; CREATE TRIGGER g;\n", dict(statements=4, ddl=4, sequences=1, types=1, procedures=1, triggers=1, queries=1)),
)
SQL_PATHS = ("db/q.sql", "db/migrations/a.sql", "seeds/x.sql", "deploy/y.sql", "dumps/z.sql", "a/fixtures/f.sql", "V2__add.sql", "q/001_a.sql", "seed/dump/i.sql", "p.bak.sql")
SQL_ROLES = (None, "migration", "seed-data", "delivery", "dump", "test-fixture", "migration", "migration", "seed-data", "dump")


def sql_files(spark, sf_dir):
    """One script a document; one in seven does not end its last comment."""
    write = lambda i, a, b, c, comment: F.concat(F.lit("-- "), comment, F.lit("\n"), *[pick([x[0] for x in SQL_UNITS], k) for k in (a, b, c)])
    text = F.concat(unit_texts(write), F.when(F.col("m") % 7 == 3, "/* no end").otherwise(""))
    return worded(spark, sf_dir).select("doc_id", pick(SQL_PATHS, F.coalesce("doc_id", F.lit(0))).alias("path"), text.alias("text"))


def held_sql(units, names) -> str:
    """A table of units: number and how often each holds each of the names."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, (k, *[u[1].get(n, 0) for n in names]))) + ")" for k, u in enumerate(units)) + f") h(k, {', '.join(names)})"


SQL_COUNTS = [c for c in sqlcode.COUNTS if c != "signals"]
SQL_HELD = f"""counts AS (
  SELECT doc_id, {", ".join(f"sum(h.{c})::INTEGER AS {c}" for c in (*SQL_COUNTS, "pg", "ms", "my", "lite"))}, (max(s1) + max(s2))::INTEGER AS signals
  FROM (SELECT doc_id, unnest([a, b, c]) % {len(SQL_UNITS)} AS k FROM units) u JOIN {held_sql(SQL_UNITS, (*SQL_COUNTS, "pg", "ms", "my", "lite", "s1", "s2"))} ON h.k = u.k GROUP BY 1),
filled AS (SELECT s.doc_id, m, {", ".join(f"coalesce({c}, 0) AS {c}" for c in (*SQL_COUNTS, "signals", "pg", "ms", "my", "lite"))} FROM sizes s LEFT JOIN counts c ON c.doc_id = s.doc_id)"""


@query(f"""
WITH {WORDS_SQL}, {SQL_HELD},
ranked AS (SELECT *, list_sort([(-my, 'mysql-mariadb'), (-pg, 'postgresql'), (-ms, 'sql-server'), (-lite, 'sqlite')]) AS r FROM filled),
top AS (SELECT *, -r[1][1] AS first, -r[2][1] AS second FROM ranked)
SELECT doc_id, {", ".join(f"{c}::INTEGER AS {c}" for c in (*SQL_COUNTS, "signals"))},
  CASE WHEN first = 0 THEN 'standard-or-unknown' WHEN first = second THEN 'mixed-or-ambiguous' ELSE r[1][2] END AS dialect,
  CASE WHEN first = 0 OR first = second THEN 'low' WHEN first >= 4 AND first - second >= 2 THEN 'high' WHEN first >= 2 THEN 'medium' ELSE 'low' END AS dialect_confidence,
  CASE WHEN m % 7 = 3 THEN 'low' WHEN unknown > greatest(2, statements // 4) THEN 'medium' ELSE 'high' END AS confidence,
  least(2000, views + indexes + sequences + types + ceil(constraints / 3.0))::INTEGER AS schema_units, least(2000, queries + modifications + ceil((joins + ctes + subqueries + windows + transactions) / 2.0))::INTEGER AS query_units,
  ddl + queries + modifications + functions + procedures + triggers > 0 AS has_semantics FROM top
""")
def sql_semantics(spark, sf_dir):
    """What the statements of SQL scripts written from all documents hold, their dialect and confidence."""
    return sqlcode.units(sqlcode.analyzed(sql_files(spark, sf_dir), ["doc_id"]))


@query(f"""
WITH {WORDS_SQL}, {SQL_HELD}
SELECT doc_id, path, CASE WHEN path = 'db/q.sql' THEN CASE WHEN functions + procedures + triggers > 0 THEN 'stored-program' WHEN ddl > 0 THEN 'schema' WHEN queries + modifications > 0 THEN 'query' ELSE 'unknown' END
  ELSE (['', {", ".join(f"'{x}'" for x in SQL_ROLES[1:])}])[doc_id % 10 + 1] END AS role FROM (SELECT *, ([{", ".join(f"'{x}'" for x in SQL_PATHS)}])[doc_id % 10 + 1] AS path FROM filled)
""")
def sql_roles(spark, sf_dir):
    """What SQL scripts are for, by path, head and statements."""
    files = sql_files(spark, sf_dir)
    counted = sqlcode.analyzed(files, ["doc_id", "path", "text"])
    return counted.select("doc_id", "path", sqlcode.role(F.col("path"), F.col("text"), F.lit(False)).alias("role"))


# Python: unit and what it holds.
PYTHON_UNITS = (
    ("def f(a: int) -> int:\n    if a and b:\n        return g(a)\n    return 0\n", dict(functions=1, public_symbols=1, type_annotations=3, branch_points=2, calls=2)),
    ("class C(Base):\n    def m(self):\n        return [x for x in y\n            if x]\n    async def _p(self):\n        await z()\n", dict(classes=1, public_symbols=2, methods=2, async_units=1, type_annotations=2, branch_points=2, calls=4)),
    ("def outer():\n    class In:\n        def a(self):\n            def b():\n                pass\n", dict(functions=2, methods=1, classes=1, public_symbols=3, type_annotations=3, calls=3)),
    ('s = """\nif x:\n    def no(): pass\n"""\nassert s == \\\n    "a"\n', dict(assertions=1)),
    ('@app.get("/x")\ndef test_it():\n\tfor i in r: pass\n', dict(decorators=1, functions=1, public_symbols=1, test_cases=1, type_annotations=1, branch_points=1, calls=1)),
    ('if __name__ == "__main__":\n    main(x, y=[1,\n2])\n', dict(branch_points=1, calls=1, main=1)),
    ('import os.path as p, sys\nfrom .a import b as c\nfrom fastapi import FastAPI\napi = FastAPI()\n@api.get("/")\ndef e(): pass\n', dict(internal_imports=1, decorators=1, endpoints=1, functions=1, public_symbols=1, type_annotations=1, calls=2, four=1)),
)
PYTHON_SUMS = ("internal_imports", "functions", "methods", "classes", "public_symbols", "async_units", "branch_points", "decorators", "type_annotations", "calls", "endpoints", "test_cases", "assertions")


def python_files(spark, sf_dir):
    write = lambda i, a, b, c, comment: F.concat(F.lit("# "), comment, F.lit("\n"), *[pick([x[0] for x in PYTHON_UNITS], k) for k in (a, b, c)])
    text = F.concat(unit_texts(write), F.when(F.col("m") % 7 == 3, "x = (1\n").otherwise(""))
    return worded(spark, sf_dir).select("doc_id", F.lit("src/a.py").alias("path"), text.alias("text"))


@query(f"""
WITH {WORDS_SQL}, counts AS (
  SELECT doc_id, {", ".join(f"sum(h.{c})::INTEGER AS {c}" for c in PYTHON_SUMS)}, max(main) AS entry_points, max(four) * 4 AS imports
  FROM (SELECT doc_id, unnest([a, b, c]) % {len(PYTHON_UNITS)} AS k FROM units) u JOIN {held_sql(PYTHON_UNITS, (*PYTHON_SUMS, "main", "four"))} ON h.k = u.k GROUP BY 1)
SELECT s.doc_id, {", ".join(f"coalesce({c}, 0)::INTEGER AS {c}" for c in (*PYTHON_SUMS, "entry_points", "imports"))}, CASE WHEN m % 7 = 3 THEN 'low' ELSE 'medium' END AS confidence FROM sizes s LEFT JOIN counts c ON c.doc_id = s.doc_id
""")
def python_lines(spark, sf_dir):
    """Measures of Python files written from all documents, by logical lines."""
    return pythoncode.analyzed(python_files(spark, sf_dir), ["doc_id"]).select("doc_id", *PYTHON_SUMS, "entry_points", "imports", "confidence")


@query(f"""
WITH {WORDS_SQL}
SELECT doc_id, (['src/A.java', 'src/a.cpp', 'src/A.cs', 'src/a.txt'])[doc_id % 4 + 1] AS path, CASE WHEN doc_id % 4 = 3 OR doc_id % 3 = 1 THEN FALSE WHEN doc_id % 3 = 2 THEN TRUE ELSE doc_id % 4 < 2 OR m = 0 END AS formatting_only FROM sizes
""")
def formatting_decisions(spark, sf_dir):
    """Changed files of several languages: comments dropped and lines broken, a name changed, or a line added."""
    k = F.col("doc_id")
    broken = F.regexp_replace(F.regexp_replace("text", r"//[^\n]*", ""), r"\n", "\n\n  ")
    after = F.when(k % 3 == 0, broken).when(k % 3 == 1, F.regexp_replace("text", r"Go\(\)", "Went()")).otherwise(F.concat("text", F.lit("\n")))
    changes = csharp_files(spark, sf_dir).select("doc_id", pick(("src/A.java", "src/a.cpp", "src/A.cs", "src/a.txt"), k).alias("path"), F.col("text").alias("before"), after.alias("after"))
    return formatting.formatting_only(changes, ["doc_id", "path"])


# JavaScript: the body of a unit with its tokens, complexity and nesting as a callable's, and what it holds for the file; no semicolons but where needed.
JS_UNITS = (
    ("  if (a) b()\n  else if (c && d) e()\n", 17, 3, 2, dict(calls=2, branch_points=2)),
    ("  const x = p ? `q${r ? 1 : 2}` : /if (x) {\\/}/g\n", 17, 2, 2, dict(branch_points=2)),
    ("  for (const k of w) while (k) { k = z ?? 1 }\n", 18, 3, 2, dict(branch_points=2)),
    ("  try { app.get('/x') } catch (e) { throw new Error(\"if (x)\") }\n", 21, 1, 1, dict(calls=1, endpoints=1, branch_points=1)),
    ("  switch (v) { case 1: case 2: useState(0)\n  break\n  default: fetch('u') }\n", 23, 3, 1, dict(calls=2, state_usages=1, integration_calls=1, branch_points=3)),
    ("  do { i++ } while (i < 3)\n  y()\n", 14, 1, 1, dict(calls=1, branch_points=1)),
    ("  const g = async () => { if (h) return 1 }\n", 15, 0, 0, dict(functions=1, async_units=1, branch_points=1)),
)
JS_SUMS = ("functions", "async_units", "branch_points", "calls", "endpoints", "state_usages", "integration_calls")


def js_files(spark, sf_dir):
    """One module a document; one in seven does not end its last template."""
    write = lambda i, a, b, c, comment: F.concat(F.lit("// "), comment, F.lit("\nexport function f"), i, F.lit("(a) {\n"), *[pick([x[0] for x in JS_UNITS], k) for k in (a, b, c)], F.lit("}\n"))
    text = F.concat(F.lit("import q from 'react'\n"), unit_texts(write), F.when(F.col("m") % 7 == 3, "x = `y").otherwise(""))
    return worded(spark, sf_dir).select("doc_id", "lang", F.lit("src/a.js").alias("path"), text.alias("text"))


JS_SIZES = "(VALUES " + ", ".join(f"({k}, {u[1]}, {u[2]}, {u[3]})" for k, u in enumerate(JS_UNITS)) + ") u(k, tokens, complexity, nesting)"
JS_CALLS = f"""calls AS (SELECT doc_id, lang, m, 'f' || i AS name, (7 + x.tokens + y.tokens + z.tokens)::INTEGER AS tokens, (1 + x.complexity + y.complexity + z.complexity)::INTEGER AS complexity, greatest(x.nesting, y.nesting, z.nesting)::INTEGER AS nesting
  FROM units JOIN {JS_SIZES.replace(" u(", " x(")} ON x.k = a % 7 JOIN {JS_SIZES.replace(" u(", " y(")} ON y.k = b % 7 JOIN {JS_SIZES.replace(" u(", " z(")} ON z.k = c % 7)"""


@query(f"""
WITH {WORDS_SQL}, {JS_CALLS}
SELECT doc_id, name, tokens, complexity, nesting, m % 7 <> 3 AS parsed FROM calls
UNION ALL SELECT doc_id, 'g', 12, 2, 1, m % 7 <> 3 FROM (SELECT doc_id, m, unnest([a, b, c]) % 7 AS k FROM units) WHERE k = 6
""")
def js_callables(spark, sf_dir):
    """Tokens, decision complexity and nesting of every function of JavaScript modules written from all documents."""
    return jscode.callables(js_files(spark, sf_dir), ["doc_id"]).select("doc_id", "name", "tokens", "complexity", "nesting", "parsed")


@query(f"""
WITH {WORDS_SQL}, counts AS (
  SELECT doc_id, {", ".join(f"sum(h.{c})::INTEGER AS {c}" for c in JS_SUMS)}
  FROM (SELECT doc_id, unnest([a, b, c]) % 7 AS k FROM units) u JOIN {held_sql([(u[0], u[4]) for u in JS_UNITS], JS_SUMS)} ON h.k = u.k GROUP BY 1)
SELECT s.doc_id, 1 AS imports, m::INTEGER AS exports, (coalesce(functions, 0) + m)::INTEGER AS functions, {", ".join(f"coalesce({c}, 0)::INTEGER AS {c}" for c in JS_SUMS[1:])}, CASE WHEN m % 7 = 3 THEN 'low' ELSE 'high' END AS confidence FROM sizes s LEFT JOIN counts c ON c.doc_id = s.doc_id
""")
def js_measures(spark, sf_dir):
    """What JavaScript modules written from all documents hold."""
    return jscode.analyzed(js_files(spark, sf_dir), ["doc_id"]).select("doc_id", "imports", "exports", *JS_SUMS, "confidence")
