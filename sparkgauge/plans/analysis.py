"""Analysis plans: inventory, classification, duplicates, scopes, ignore rules and source measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyzers, classify, facts, stats
from ..sources import table
from .registry import query


@query(r"""
SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines, sha256(text) AS sha256,
  contains(text, chr(0)) OR len(regexp_extract_all(text, '[\x00-\x08\x0E-\x1A\x1C-\x1F]')) * 20 > octet_length(encode(text)) AS is_binary FROM documents
""")
def file_inventory(spark, sf_dir):
    """Bytes, lines, digest and binary test of every document's content."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return facts.inspected(rows).drop("content")


#: Paths over the pages: names of all sorts under directories of all sorts.
PATH_SQL = """
(SELECT page_id, (['src/', 'tests/', 'docs/', 'vendor/', '', 'infra/k8s/', '.github/workflows/', 'generated/', 'coverage/'])[page_id % 9 + 1] || (['Main.cs', 'readme.md', 'yarn.lock', 'app.test.ts', 'lib.min.js', 'pkg.go', 'Dockerfile', 'setup.py', 'a.csproj', 'logo.png', 'x.sln', 'makefile', 'config.yml', 'notes'])[page_id % 14 + 1] AS path, html FROM pages) AS files
"""


def page_files(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    folders = ["src/", "tests/", "docs/", "vendor/", "", "infra/k8s/", ".github/workflows/", "generated/", "coverage/"]
    names = ["Main.cs", "readme.md", "yarn.lock", "app.test.ts", "lib.min.js", "pkg.go", "Dockerfile", "setup.py", "a.csproj", "logo.png", "x.sln", "makefile", "config.yml", "notes"]
    return table(spark, sf_dir, "pages").select("page_id", F.concat(pick(folders), pick(names)).alias("path"), "html")


@query(f"""
SELECT page_id, path, CASE WHEN path LIKE 'vendor/%' THEN 'vendored' WHEN path LIKE '%.min.%' THEN 'minified' WHEN path LIKE 'generated/%' THEN 'generated' WHEN path LIKE 'coverage/%' THEN 'coverage'
  WHEN path LIKE '%yarn.lock' THEN 'dependency-lock' WHEN (path LIKE 'tests/%' AND path NOT LIKE '%Dockerfile') OR path LIKE '%.test.%' THEN 'test' WHEN path LIKE 'docs/%' OR path LIKE '%readme.md' THEN 'documentation'
  WHEN path LIKE '.github/workflows/%' THEN 'ci-configuration' WHEN path LIKE '%Dockerfile' THEN 'container-configuration' WHEN path LIKE '%k8s/%' THEN 'infrastructure' WHEN path LIKE '%.png' THEN 'binary'
  WHEN path LIKE '%setup.py' THEN 'package-manifest' WHEN path LIKE '%.csproj' THEN 'project' WHEN path LIKE '%.sln' THEN 'solution' WHEN path LIKE '%makefile' THEN 'build-configuration'
  WHEN path LIKE '%.cs' OR path LIKE '%.go' THEN 'source' WHEN path LIKE '%.yml' THEN 'configuration' ELSE 'other' END AS role FROM {PATH_SQL}
""")
def role_classify(spark, sf_dir):
    """Role of each path by the first rule that fits."""
    return page_files(spark, sf_dir).select("page_id", "path", classify.role(F.col("path")).alias("role"))


@query(f"""
SELECT page_id, path, path LIKE 'vendor/%' AND path NOT LIKE '%.md' OR path LIKE '%.lock' OR path LIKE '%/k8s/%' AS ignored FROM {PATH_SQL}
""")
def ignore_last_match(spark, sf_dir):
    """Ignore rules: the last that fits decides."""
    rules = ["# comment", "*.lock", "vendor/", "!vendor/*.md", "k8s/"]
    return classify.ignored(page_files(spark, sf_dir).select("page_id", "path"), rules)


@query("""
SELECT doc_id, contains(lower(text), '<auto-generated') OR contains(lower(text), '@generated') OR contains(lower(text), 'do not edit') OR contains(lower(text), 'generated by') AS generated FROM documents
""")
def generated_marker(spark, sf_dir):
    """Marks of generated files."""
    return table(spark, sf_dir, "documents").select("doc_id", classify.has_generated_marker(F.col("text")).alias("generated"))


@query("""
SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents
""")
def exact_duplicates(spark, sf_dir):
    """Canonical file and number of copies by content digest."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return facts.exact_duplicates(rows, ["sha256"], "doc_id")


@query("""
SELECT lang, sha256, arg_min(doc_id, doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars, list_aggregate(list_sort(list_distinct(list(source))), 'string_agg', '+') AS tags FROM (SELECT *, sha256(text) AS sha256 FROM documents) GROUP BY 1, 2
""")
def dedup_facts(spark, sf_dir):
    """First fact of each key with the union of tags."""
    rows = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha256"), "doc_id", "n_chars", F.col("source").alias("tags"))
    out = facts.deduplicated(rows, ["lang", "sha256"], ["doc_id"], "tags")
    return out.withColumn("tags", F.array_join("tags", "+"))


@query("""
WITH p AS (SELECT page_id, split_part(url, '://', 2) AS path FROM pages), s AS (SELECT DISTINCT string_split(path, '/')[1] AS d FROM p UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') FROM p WHERE path LIKE '%/en/%'),
a AS (SELECT p.page_id, p.path, array_to_string(string_split(path, '/')[1:n], '/') AS d, n FROM p, LATERAL (SELECT unnest(range(0, len(string_split(p.path, '/')))) AS n))
SELECT path, arg_max(a.d, (length(a.d), a.d)) AS scope FROM a JOIN s ON a.d = s.d GROUP BY 1
""")
def prefix_scope_join(spark, sf_dir):
    """Deepest owning directory of each path."""
    path = F.get(F.split("url", "://"), 1)
    files = table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    at = F.split("path", "/")
    scopes = files.select(F.get(at, 0).alias("directory")).union(files.where("path like '%/en/%'").select(F.array_join(F.slice(at, 1, 2), "/"))).distinct().withColumn("scope", F.col("directory"))
    return facts.owning_scope(files, scopes)


@query("""
SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text))) AS inventory_digest FROM documents GROUP BY 1
""")
def inventory_digest(spark, sf_dir):
    """Digest over a source's ordered entries."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha256"))
    return facts.inventory_digest(rows, ["source"], "doc_id", "sha256")


@query("""
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1
""")
def json_props(spark, sf_dir):
    """Aggregation over a JSON member."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("total"))


SQL_SQL = """(SELECT o_orderkey, '-- create table t' || chr(10) || 'CREATE TABLE a' || o_orderkey || ' (id int); ' || CASE o_orderkey % 3 WHEN 0 THEN 'select * from a join b on a.x = b.x; ' WHEN 1 THEN 'insert into t select ''drop table'' from (select 1); ' ELSE 'with c as (select 1) update t set x = 1; ' END || CASE WHEN o_orderkey % 4 = 0 THEN 'create or replace view v as select row_number() over (order by x) from t;' ELSE '/* delete */' END AS text FROM orders) AS files"""


@query(rf"""
WITH w AS (SELECT o_orderkey, upper(regexp_replace(text, '(?s)/\*.*?\*/|--[^\n]*|''(?:''''|[^''])*''', ' ', 'g')) AS t FROM {SQL_SQL})
SELECT o_orderkey, len(regexp_extract_all(t, '\b(?:CREATE(?:\s+(?:OR|REPLACE))*|DROP)\s+TABLE\b')) AS tables, len(regexp_extract_all(t, '\bCREATE(?:\s+(?:OR|REPLACE))*\s+VIEW\b')) AS views, len(regexp_extract_all(t, '\bSELECT\b')) AS queries,
  len(regexp_extract_all(t, '\b(?:INSERT|MERGE|UPDATE|DELETE)\b')) AS data_modifications, len(regexp_extract_all(t, '\bJOIN\b')) AS joins, len(regexp_extract_all(t, '\bWITH\s+\w+\s+AS\s*\(')) AS ctes, len(regexp_extract_all(t, '\bOVER\s*\(')) AS window_functions, len(regexp_extract_all(t, '\(\s*SELECT\b')) AS subqueries FROM w
""")
def sql_keyword_metrics(spark, sf_dir):
    """Statements by kind in SQL text, outside comments and strings."""
    k = F.col("o_orderkey")
    kinds = F.when(k % 3 == 0, "select * from a join b on a.x = b.x; ").when(k % 3 == 1, "insert into t select 'drop table' from (select 1); ").otherwise("with c as (select 1) update t set x = 1; ")
    tail = F.when(k % 4 == 0, "create or replace view v as select row_number() over (order by x) from t;").otherwise("/* delete */")
    text = F.concat(F.lit("-- create table t\nCREATE TABLE a"), k, F.lit(" (id int); "), kinds, tail)
    names = ("tables", "views", "queries", "data-modifications", "joins", "ctes", "window-functions", "subqueries")
    m = analyzers.sql_measures(F.col("text"), names)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).withColumn("m", m)
    return rows.select("o_orderkey", *[F.element_at("m", F.lit(n)).cast("long").alias(n.replace("-", "_")) for n in names])


@query(r"""
SELECT page_id, len(regexp_extract_all(t, '<[A-Za-z][\w-]*')) AS elements, len(regexp_extract_all(t, '(?i)<form\b')) AS forms, len(regexp_extract_all(t, '(?i)<img\b')) AS images, len(regexp_extract_all(t, '(?i)<(?:input|select|textarea)\b')) AS inputs
FROM (SELECT page_id, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', ' ', 'g') AS t FROM pages)
""")
def markup_metrics(spark, sf_dir):
    """Elements, forms and images of pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", analyzers.code_measures(F.col("html"), "html").alias("m"))
    return rows.select("page_id", *[F.element_at("m", F.lit(n)).cast("long").alias(n) for n in ("elements", "forms", "images", "inputs")])


@query(None)
def formatting_signatures(spark, sf_dir):
    """Digests of whole texts' tokens, blind to white space; held against brute force in the tests."""
    return table(spark, sf_dir, "documents").select("doc_id", analyzers.formatting_signature(F.col("text")).alias("signature"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.vec_id % 25 = 0 AND a.label <> b.label)
SELECT vec_id, neighbour, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS n FROM d) WHERE n = 1
""")
def embedding_nearest(spark, sf_dir):
    """Nearest profile of another label, by cosine; the asked rows are a stated set of each 25th."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return stats.nearest_vectors(v.where("id % 25 = 0"), v).withColumnRenamed("id", "vec_id")


#: Every listed name, ending and directory of the classification, with the role that the rules give it.
SAMPLES = (
    *[(f"{d}/a.cs", "other-folder") for d in ("bin", "build", "packages", ".idea", ".gradle")],
    *[(f"{d}/a.cs", "excluded") for d in classify.EXCLUDED_DIRECTORIES],
    *[(f"lib/{n}", "dependency-lock") for n in classify.LOCK_NAMES],
    *[(f"lib/{n}", "package-manifest") for n in classify.MANIFEST_NAMES],
    *[(f"src/a{e}", "source") for e in classify.LANGUAGES if e not in (".tf", ".tfvars", ".tfbackend", ".hcl", ".bats", ".psd1")],
    *[(f"src/a{e}", "infrastructure") for e in (".tf", ".tfvars", ".tfbackend", ".hcl", ".bicep")],
    *[(f"img/a{e}", "binary") for e in classify.BINARY_EXTENSIONS],
    *[(f"a/{d}/b.xyz", "vendored") for d in classify.VENDORED_SEGMENTS],
    *[(f"a/{d}/b.cs", "test") for d in classify.TEST_SEGMENTS],
    *[(f"x{e}", "project") for e in classify.PROJECT_EXTENSIONS],
    *[(f"x{e}", "solution") for e in classify.SOLUTION_EXTENSIONS],
    *[(f"cfg/x{e}", "configuration") for e in classify.CONFIG_EXTENSIONS],
    *[(f"{d}/run.sh", use) for use, (folders, _) in classify.SCRIPT_USES.items() for d in folders],
    *[(f"tools/{n}.sh", use) for use, (_, stems) in classify.SCRIPT_USES.items() for n in stems],
    *[(f"db/{d}/a.sql", "generated") for d in classify.DUMP_SEGMENTS],
    ("db/seeds/a.sql", "source"), ("src/gen/a.cs", "generated"), ("src/X.Designer.cs", "generated"), ("main.tfstate", "generated"), ("bootstrap/cache/a.php", "generated"), ("completions/a.bash", "generated"),
    ("src/FooTest.java", "test"), ("src/footest.java", "source"), ("src/FooIT.kt", "test"), ("src/a_test.cc", "test"), ("benches/a.rs", "test"), ("x.tftest.hcl", "test"), ("tests/Dockerfile", "container-configuration"),
    ("docker-compose.dev.yml", "container-configuration"), ("requirements-dev.txt", "build-configuration"), ("a/.cargo/config.toml", "build-configuration"), ("webpack.config.js", "build-configuration"), ("m.psd1", "build-configuration"),
)
#: Which samples are listed only for what they are not: no directory of these names is left out.
KEPT = {"other-folder": "source", "excluded": None}


ROLE_SAMPLES = sorted({(p, KEPT.get(r, r)) for p, r in SAMPLES if KEPT.get(r, r)})
REASON_SAMPLES = sorted([(f"a/{d}/b.cs", r) for d, r in classify.EXCLUDED_DIRECTORIES.items()] + [(".yarn/cache/x", "tool-cache"), (".nuget/packages/y", "tool-cache")]) + [(f"{d}/a.cs", None) for d in ("bin", "build", "packages", ".idea", ".gradle", ".cache")]
PER_DOCUMENT = 4  # names a document picks: the smallest table of documents comes to all of them


def picked_paths(spark, sf_dir, samples):
    """(doc_id, path): each document picks some of the sample paths by its id."""
    k = F.explode(F.sequence(F.lit(0), F.lit(PER_DOCUMENT - 1)))
    rows = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", k.alias("j"))
    at = F.abs(F.col("doc_id")) * PER_DOCUMENT + F.col("j")
    return rows.select("doc_id", F.element_at(F.array(*[F.lit(p) for p, _ in samples]), (at % len(samples) + 1).cast("int")).alias("path"))


def _picked_sql(samples, name):
    values = ", ".join(f"({i}, '{p}', " + ("NULL" if r is None else f"'{r}'") + ")" for i, (p, r) in enumerate(samples))
    return f"SELECT doc_id, path, {name} FROM (SELECT doc_id, (abs(doc_id) * {PER_DOCUMENT} + j) % {len(samples)} AS i FROM documents, (SELECT unnest(range({PER_DOCUMENT})) AS j) WHERE doc_id IS NOT NULL) JOIN (VALUES {values}) t(i, path, {name}) USING (i)"


@query(_picked_sql(ROLE_SAMPLES, "role"))
def scan_roles(spark, sf_dir):
    """Role of paths that the documents pick among every name, ending and directory that the classification lists."""
    return picked_paths(spark, sf_dir, ROLE_SAMPLES).select("doc_id", "path", classify.role(F.col("path")).alias("role"))


@query(_picked_sql(REASON_SAMPLES, "reason"))
def exclusion_reasons(spark, sf_dir):
    """Why a scan leaves out the directories of paths that the documents pick; others are scanned."""
    return picked_paths(spark, sf_dir, REASON_SAMPLES).select("doc_id", "path", classify.exclusion_reason(F.col("path")).alias("reason"))


SCRIPTS = ("tools/build.sh", "ci/run.ps1", "ops/x.sh", "release/a.bash", "x/publish.ps1", "test/a.sh", "a/run-test.sh", "misc/y.ksh", "src/a.cs", "run")


@query(f"""SELECT page_id, ([{", ".join(f"'{x}'" for x in ('build', 'ci', 'infrastructure', 'delivery', 'delivery', 'test', 'test', 'other'))}, NULL, CASE WHEN page_id % 3 = 0 THEN 'other' END])[page_id % 10 + 1] AS use FROM pages""")
def script_uses(spark, sf_dir):
    """What scripts are for, by folder and name; files without an ending by their interpreter."""
    k = F.col("page_id")
    path = F.element_at(F.array(*map(F.lit, SCRIPTS)), (k % 10 + 1).cast("int"))
    sample = F.when(k % 3 == 0, F.lit("#!/usr/bin/env bash\necho")).otherwise(F.lit("#!/usr/bin/python\n"))
    return table(spark, sf_dir, "pages").select("page_id", classify.script_role(path, sample).alias("use"))


@query("""
WITH f AS (SELECT page_id, page_id % 9 AS k, 'p' || page_id % 40 AS dir FROM pages)
SELECT page_id, CASE WHEN k = 0 AND dir <> 'p3' THEN dir WHEN k % 2 = 1 AND dir IN ('p5', 'p7', 'p9') THEN dir || '/deep' WHEN dir <> 'p3' THEN dir ELSE '.' END AS owner FROM f
""")
def exact_then_prefix(spark, sf_dir):
    """Owning scope of facts: the one that they name, else that of the deepest directory above them."""
    k = F.col("page_id")
    folder = F.concat(F.lit("p"), k % 40)
    files = table(spark, sf_dir, "pages").select("page_id", F.lit("dotnet").alias("ecosystem"), F.when(k % 9 == 0, folder).otherwise("none").alias("scope"), F.concat(folder, F.when((k % 9) % 2 == 1, "/deep/er/a.cs").otherwise("/a.cs")).alias("path"))
    names = [f"p{i}" for i in range(40) if i != 3] + ["p5/deep", "p7/deep", "p9/deep", "."]
    scopes = spark.createDataFrame([("dotnet", n, n) for n in names], "ecosystem string, scope string, directory string")
    return facts.exact_or_prefix_scope(files, scopes, ["ecosystem"]).select("page_id", "owner")


@query("""
WITH f AS (SELECT doc_id % 200 AS scope, doc_id AS path, lang = 'de' AS is_test, CASE WHEN source = (SELECT min(source) FROM documents) THEN NULL ELSE sha256(text) END AS dup FROM documents), c AS (SELECT *, dup IS NULL OR path = min(path) OVER (PARTITION BY dup) AS canonical FROM f),
s AS (SELECT scope, count(*) AS analyzed, count(*) FILTER (NOT is_test) AS production, count(*) FILTER (NOT is_test AND canonical) AS canonical FROM c GROUP BY 1)
SELECT n.scope, coalesce(analyzed, 0) AS analyzed, coalesce(production, 0) AS production, coalesce(canonical, 0) AS canonical, CASE WHEN analyzed IS NULL THEN CASE WHEN n.scope % 2 = 0 THEN 0 ELSE 1 END ELSE round(canonical::DOUBLE / analyzed, 6) END AS factor,
  CASE WHEN analyzed IS NULL THEN CASE WHEN n.scope % 2 = 0 THEN 0 ELSE 1 END ELSE coalesce(round(canonical::DOUBLE / nullif(production, 0), 6), 0) END AS production_factor, coalesce(canonical, 0) < coalesce(production, 0) AS has_duplicates FROM (SELECT unnest(range(210)) AS scope) n LEFT JOIN s ON s.scope = n.scope
""")
def structure_factors(spark, sf_dir):
    """Share of canonical production files by scope, which scales its structure measures."""
    docs = table(spark, sf_dir, "documents")
    first = docs.agg(F.min("source").alias("_s"))
    rows = docs.crossJoin(F.broadcast(first)).select((F.col("doc_id") % 200).alias("scope"), F.col("doc_id").alias("path"), (F.col("lang") == "de").alias("is_test"), F.when(F.col("source") != F.col("_s"), F.sha2("text", 256)).alias("duplicate_key"))  # one row
    scopes = spark.range(210).select(F.col("id").alias("scope"), (F.col("id") % 2 == 0).alias("is_test"))
    return facts.structure_factors(rows, scopes, ["scope"])


@query("""
WITH f AS (SELECT page_id % 60 AS repo, page_id % 8 AS k, 's' || page_id % 5 AS scope, page_id FROM pages WHERE page_id % 60 < 50 OR page_id % 8 = 7),
c AS (SELECT repo, CASE WHEN k = 0 THEN 'dotnet' WHEN k IN (1, 2) THEN 'javascript' WHEN k = 3 THEN 'python' WHEN k = 4 THEN 'sql' END AS ecosystem, CASE WHEN k = 2 THEN '.' ELSE scope END AS scope, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS rank, CASE k WHEN 0 THEN 'web' WHEN 1 THEN 'package' WHEN 2 THEN 'web-ui' WHEN 3 THEN 'package' ELSE 'data' END AS role FROM f WHERE k <= 4),
b AS (SELECT repo, ecosystem, scope, arg_min(role, rank) AS role FROM c GROUP BY 1, 2, 3) SELECT repo, ecosystem, scope, role FROM b UNION ALL SELECT DISTINCT repo, 'common', '.', 'fallback' FROM f WHERE repo NOT IN (SELECT repo FROM b)
""")
def scope_derivation(spark, sf_dir):
    """Scopes of repositories by precedence of the facts that name them, with a root where there are none."""
    k, page = F.col("page_id") % 8, F.col("page_id")
    kind = F.when(k == 0, "dotnet-project").when(k.isin(1, 2), "javascript-package").when(k == 3, "ecosystem-package").when(k == 4, "sql-repository").otherwise("file")
    ident = F.when(k == 0, F.concat(F.lit("dotnet:project:"), page)).when(k == 1, F.concat(F.lit("javascript:package:"), page)).when(k == 2, "javascript:repository").otherwise(F.concat(F.lit("x:"), page))
    tags = F.when(k == 0, F.array(F.lit("project-role:web"))).when(k == 2, F.array(F.lit("frontend-assets:present"))).when(k == 3, F.array(F.lit("scope:analyzed"), F.lit("ecosystem:python"))).when(k == 4, F.array(F.lit("scope:standalone")))
    scope = F.when(k == 2, ".").otherwise(F.concat(F.lit("s"), page % 5))
    rows = table(spark, sf_dir, "pages").where("page_id % 60 < 50 or page_id % 8 = 7").select((page % 60).alias("repo"), ident.alias("id"), kind.alias("kind"), scope.alias("scope"), tags.alias("tags"))
    return facts.derived_scopes(rows).select("repo", "ecosystem", "scope", "role")


@query(r"""
WITH p AS (SELECT page_id, (['a!b.log', '!keep.log', '#x.tmp', 'sub/a.tmp', 'sub/deep/keep.tmp', 'build/x', 'sub/build/y', 'src/a.log'])[page_id % 8 + 1] AS path FROM pages)
SELECT page_id, path, path IN ('!keep.log', '#x.tmp', 'sub/a.tmp', 'build/x', 'src/a.log', 'a!b.log') AS ignored FROM p
""")
def ignore_nested(spark, sf_dir):
    """Ignore rules with escapes, and rule files of directories below the root that hold there only."""
    names = ["a!b.log", "!keep.log", "#x.tmp", "sub/a.tmp", "sub/deep/keep.tmp", "build/x", "sub/build/y", "src/a.log"]
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return classify.ignored(rows, ["*.log", "!!keep.log", "\\!keep.log", "\\#x.tmp", "/build/"], below={"sub": ["*.tmp"], "sub/deep": ["!keep.tmp"]})


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN NULL ELSE CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'test' WHEN doc_id % 3 = 1 THEN 'source' ELSE 'unknown' END || '|' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'none' END || '|' || sha256(text) END AS duplicate_key FROM documents
""")
def duplicate_keys(spark, sf_dir):
    """Role family, language and digest that exact duplicates share, from the tags of file facts."""
    k = F.col("doc_id")
    tags = F.array_compact(F.array(
        F.when(k % 3 == 0, "role:test").when(k % 3 == 1, "role:source"), F.when(k % 5 == 0, "classification:test"), F.when(k % 2 == 0, F.concat(F.lit("language:"), "lang")),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)), F.when(k % 7 == 0, "content:binary"),
    ))
    return table(spark, sf_dir, "documents").select("doc_id", facts.duplicate_key(tags).alias("duplicate_key"))
