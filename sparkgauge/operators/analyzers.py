"""Source analyzers: measures of code files by language, as column expressions.

A language is a row of a table of patterns (comments and strings, branches, callables, types,
tests, ...).  Comments and strings are taken out first; every measure is then a count of
a pattern in what is left, so analysis is one map-only stage inside the JVM.  Unknown
constructs lower the parser's confidence and never fail the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C_LIKE = r"""(?s)/\*.*?(?:\*/|\z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
HASH = r"""(?s)\"\"\".*?(?:\"\"\"|\z)|'''.*?(?:'''|\z)|#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
MARKUP = r"(?s)<!--.*?(?:-->|\z)"
SQL_NOISE = r"(?s)/\*.*?(?:\*/|\z)|--[^\n]*|\$([A-Za-z_]*)\$.*?\$\1\$|'(?:''|[^'])*'"


@dataclass(frozen=True)
class Language:
    """Patterns of one language; every one counts in text without comments and strings."""

    noise: str
    measures: dict[str, str] = field(default_factory=dict)
    raw: dict[str, str] = field(default_factory=dict)  # counted in the whole text


_C_BRANCH = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?])"

LANGUAGES = {
    "csharp": Language(C_LIKE, {
        "branch-points": _C_BRANCH + r"|\bforeach\b", "types": r"\b(?:class|struct|record|interface|enum)\s+\w+",
        "methods": r"\b(?:public|private|protected|internal|static|async|override|virtual)\s+[\w<>\[\],.?\s]+?\s\w+\s*(?:<[^>]*>)?\([^;{)]*\)\s*(?:where[^{]*)?(?:\{|=>)",
        "async-units": r"\basync\b", "public-symbols": r"\bpublic\b", "imports": r"(?m)^\s*using\s+[\w.]+\s*;", "assertions": r"\bAssert\.\w+|\.Should\(\)",
        "test-cases": r"\[(?:Fact|Theory|Test|TestMethod|TestCase)\b", "endpoints": r"\.Map(?:Get|Post|Put|Delete|Patch)\(|\[Http(?:Get|Post|Put|Delete|Patch)", "controllers": r"\bclass\s+\w+Controller\b",
        "db-sets": r"\bDbSet<", "data-calls": r"\.(?:SaveChanges|SaveChangesAsync|ExecuteSqlRaw|FromSql)\w*\(", "integration-calls": r"\bHttpClient\b", "security-usages": r"\[Authorize\b|\[AllowAnonymous\b",
        "validation-rules": r"\.RuleFor\(|\[(?:Required|Range|MaxLength|StringLength)\b", "background-usages": r"\bBackgroundService\b|\bIHostedService\b"}),
    "javascript": Language(C_LIKE, {
        "branch-points": _C_BRANCH, "types": r"\b(?:class|interface|enum|type)\s+\w+", "methods": r"\bfunction\b|=>|(?m)^\s+(?:async\s+)?\w+\([^)]*\)\s*\{",
        "async-units": r"\basync\b|\bawait\b", "public-symbols": r"\bexport\b", "imports": r"\bimport\b|\brequire\s*\(", "assertions": r"\bexpect\s*\(|\bassert\b",
        "test-cases": r"\b(?:it|test)\s*\(", "endpoints": r"\b(?:app|router)\.(?:get|post|put|delete|patch)\s*\(", "components": r"\bfunction\s+[A-Z]\w*\s*\(|\bconst\s+[A-Z]\w*\s*=\s*\(",
        "forms": r"<form\b", "integration-calls": r"\bfetch\s*\(|\baxios\b"}),
    "python": Language(HASH, {
        "branch-points": r"\b(?:if|elif|for|while|try|except|match|case|and|or)\b", "types": r"(?m)^\s*class\s+\w+", "functions": r"(?m)^(?:async\s+)?def\s+\w+", "methods": r"(?m)^[ \t]+(?:async\s+)?def\s+\w+",
        "async-units": r"\basync\s+(?:def|for|with)\b", "public-symbols": r"(?m)^(?:async\s+)?(?:def|class)\s+[A-Za-z]\w*", "imports": r"(?m)^\s*(?:import|from)\s+[\w.]+", "assertions": r"\bassert\b",
        "test-cases": r"(?m)^\s*(?:async\s+)?def\s+test_\w+", "mock-usages": r"\b(?:Mock|MagicMock|patch)\s*\(", "endpoints": r"(?m)^\s*@\w+\.(?:get|post|put|delete|patch|route)\s*\("},
        {"entry-points": r"""__name__\s*==\s*["']__main__["']"""}),
    "go": Language(C_LIKE + r"|`[^`]*`", {
        "branch-points": r"\b(?:if|for|case|select)\b|&&|\|\|", "types": r"(?m)^\s*type\s+\w+", "functions": r"(?m)^func\s+\w+", "methods": r"(?m)^func\s*\([^)]*\)\s*\w+", "async-units": r"\bgo\s+\w+|\bchan\b",
        "public-symbols": r"(?m)^(?:func|type|var|const)\s+[A-Z]\w*", "imports": r"\bimport\b", "test-cases": r"(?m)^func\s+Test\w*", "entry-points": r"(?m)^func\s+main\s*\("}),
    "java": Language(C_LIKE, {
        "branch-points": _C_BRANCH, "types": r"\b(?:class|interface|enum|record)\s+\w+", "methods": r"\b(?:public|private|protected|static)\s+[\w<>\[\],.?\s]+?\s\w+\s*\([^;{)]*\)\s*(?:throws[^{]*)?\{",
        "public-symbols": r"\bpublic\b", "imports": r"(?m)^\s*import\s+", "assertions": r"\bassert\w*\s*\(", "test-cases": r"@(?:Test|ParameterizedTest)\b", "endpoints": r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\b",
        "entry-points": r"\bstatic\s+void\s+main\b"}),
    "kotlin": Language(C_LIKE, {
        "branch-points": r"\b(?:if|for|while|when|catch)\b|&&|\|\||\?:", "types": r"\b(?:class|interface|object)\s+\w+", "functions": r"\bfun\s+", "async-units": r"\bsuspend\b", "imports": r"(?m)^\s*import\s+", "test-cases": r"@Test\b"}),
    "php": Language(C_LIKE + r"|#(?!\[)[^\n]*", {
        "branch-points": _C_BRANCH + r"|\b(?:elseif|foreach)\b", "types": r"\b(?:class|interface|trait|enum)\s+\w+", "functions": r"\bfunction\b", "public-symbols": r"\bpublic\b", "imports": r"(?m)^\s*use\s+",
        "test-cases": r"\bfunction\s+test\w+", "endpoints": r"\bRoute::(?:get|post|put|delete|patch)\b"}),
    "rust": Language(r"""(?s)/\*.*?(?:\*/|\z)|//[^\n]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'""", {
        "branch-points": r"\b(?:if|for|while|loop|match)\b|&&|\|\||=>", "types": r"\b(?:struct|enum|trait|union)\s+\w+", "functions": r"\bfn\s+\w+", "async-units": r"\basync\b|\.await\b", "public-symbols": r"\bpub\b",
        "imports": r"(?m)^\s*use\s+", "assertions": r"\bassert(?:_eq|_ne)?!", "test-cases": r"#\[(?:\w+::)?test\b", "unsafe-blocks": r"\bunsafe\b", "entry-points": r"\bfn\s+main\s*\("}),
    "shell": Language(r"""#[^\n]*|"(?:\\.|[^"\\])*"|'[^']*'""", {
        "branch-points": r"\b(?:if|elif|for|while|until|case)\b|&&|\|\|", "functions": r"(?m)^\s*(?:function\s+[\w-]+|[\w-]+\s*\(\))", "commands": r"(?m)^\s*[A-Za-z_./][\w./-]*", "pipelines": r"(?<!\|)\|(?!\|)"}),
    "powershell": Language(r"""(?s)<#.*?(?:#>|\z)|#[^\n]*|"(?:`.|[^"`])*"|'[^']*'""", {
        "branch-points": r"(?i)\b(?:if|elseif|for|foreach|while|switch|catch)\b", "functions": r"(?im)^\s*function\s+[\w-]+", "commands": r"\b[A-Z][a-z]+-[A-Z]\w+"}),
    "terraform": Language(r"""(?s)/\*.*?(?:\*/|\z)|#[^\n]*|//[^\n]*""", {
        "resources": r"(?m)^\s*resource\s+\"", "data-sources": r"(?m)^\s*data\s+\"", "modules": r"(?m)^\s*module\s+\"", "variables": r"(?m)^\s*variable\s+\"", "outputs": r"(?m)^\s*output\s+\"", "providers": r"(?m)^\s*provider\s+\"",
        "branch-points": r"\bfor_each\b|\bcount\s*=|\?"}),
    "dockerfile": Language(r"(?m)^\s*#[^\n]*", {
        "stages": r"(?im)^\s*FROM\s+", "instructions": r"(?im)^\s*(?:FROM|RUN|COPY|ADD|ENV|ARG|CMD|ENTRYPOINT|EXPOSE|WORKDIR|USER|VOLUME|HEALTHCHECK|LABEL|SHELL|ONBUILD|STOPSIGNAL)\b", "runs": r"(?im)^\s*RUN\s+", "ports": r"(?im)^\s*EXPOSE\s+"}),
    "cpp": Language(C_LIKE, {
        "branch-points": _C_BRANCH, "types": r"\b(?:class|struct|enum|union)\s+\w+", "functions": r"(?m)^[\w:<>*&~\s]+\s[\w:~]+\s*\([^;{)]*\)\s*(?:const)?\s*\{", "templates": r"\btemplate\s*<", "imports": r"(?m)^\s*#\s*include\b",
        "test-cases": r"\b(?:TEST|TEST_F|TEST_P|TEST_CASE)\s*\(", "macros": r"(?m)^\s*#\s*define\b"}),
    "html": Language(MARKUP, {
        "elements": r"<[A-Za-z][\w-]*", "forms": r"(?i)<form\b", "inputs": r"(?i)<(?:input|select|textarea)\b", "images": r"(?i)<img\b", "labels": r"(?i)<label\b", "aria-attributes": r"(?i)\baria-[a-z]+\s*=", "alternative-texts": r"(?i)\balt\s*="}),
    "css": Language(r"(?s)/\*.*?(?:\*/|\z)", {"rules": r"\{", "media-queries": r"@media\b", "animations": r"@keyframes\b", "custom-properties": r"--[\w-]+\s*:"}),
    "sql": Language(SQL_NOISE, {}),
}
LANGUAGES["typescript"] = LANGUAGES["javascript"]
LANGUAGES["c"] = LANGUAGES["cpp"]
LANGUAGES["hcl"] = LANGUAGES["terraform"]
LANGUAGES["scss"] = LANGUAGES["css"]

#: Names of all measures, in order.
MEASURES = sorted({m for x in LANGUAGES.values() for m in (*x.measures, *x.raw)})


def without_noise(text: Column, language: str) -> Column:
    return F.regexp_replace(text, LANGUAGES[language].noise, " ")


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once for a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def code_measures(text: Column, language: str) -> Column:
    """Map of measure to count of one language; comments and strings are taken out once."""
    spec = LANGUAGES[language]
    raw = [x for m, p in spec.raw.items() for x in (F.lit(m), F.regexp_count(text, F.lit(p)))]
    if not spec.measures:
        return F.create_map(*raw) if raw else F.create_map().cast("map<string,int>")
    return once(without_noise(text, language), lambda bare: F.create_map(*[x for m, p in spec.measures.items() for x in (F.lit(m), F.regexp_count(bare, F.lit(p)))], *raw))


def analyzed(files: DataFrame, language: str = "language", text: str = "text") -> DataFrame:
    """``measures`` of every file whose language is known."""
    out = F.create_map().cast("map<string,int>")
    for name in LANGUAGES:
        own = sql_measures(F.col(text)) if name == "sql" else code_measures(F.col(text), name)
        out = F.when(F.col(language) == name, own).otherwise(out)
    return files.withColumn("measures", out)


# Words that score a dialect.
DIALECTS = {
    "mysql-mariadb": ("AUTO_INCREMENT", "DELIMITER", "UNSIGNED", "SQL_MODE"),
    "postgresql": ("ILIKE", "JSONB", "PLPGSQL", "SERIAL", "BIGSERIAL"),
    "sql-server": ("GO", "NVARCHAR", "RAISERROR", "OPENQUERY", "TRY", "CATCH"),
    "sqlite": ("PRAGMA", "AUTOINCREMENT", "VACUUM"),
}


def _sql_words(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, SQL_NOISE, " "))


def sql_measures(text: Column, names=None) -> Column:
    """Statements by kind, joins, common tables, windows, subqueries and transactions of SQL text; all, or those named."""
    ddl = r"\b(?:CREATE(?:\s+(?:OR|REPLACE|ALTER|TEMP|TEMPORARY|UNIQUE))*|ALTER|DROP|TRUNCATE)\s+"
    pairs = {
        "tables": ddl + r"TABLE\b", "views": ddl + r"(?:MATERIALIZED\s+)?VIEW\b", "indexes": ddl + r"INDEX\b", "sequences": ddl + r"SEQUENCE\b", "types": ddl + r"(?:TYPE|DOMAIN)\b",
        "functions": ddl + r"FUNCTION\b", "procedures": ddl + r"PROC(?:EDURE)?\b", "triggers": ddl + r"TRIGGER\b", "queries": r"\bSELECT\b", "data-modifications": r"\b(?:INSERT|MERGE)\b|(?<!\bON\s)\b(?:UPDATE|DELETE)\b",
        "joins": r"\bJOIN\b", "ctes": r"\bWITH\s+(?:RECURSIVE\s+)?\w+\s*(?:\([^)]*\)\s*)?AS\s*\(", "window-functions": r"\bOVER\s*\(", "subqueries": r"\(\s*SELECT\b", "transactions": r"\bBEGIN\s+TRAN(?:SACTION)?\b|\bSTART\s+TRANSACTION\b",
        "statements": r"[^;\s][^;]*(?:;|$)", "integration-signals": r"\b(?:DBLINK|OPENQUERY|OPENROWSET|FOREIGN)\b",
    }
    wanted = {m: p for m, p in pairs.items() if names is None or m in names}
    return once(_sql_words(text), lambda bare: F.create_map(*[x for m, p in wanted.items() for x in (F.lit(m), F.regexp_count(bare, F.lit(p)))]))


def sql_dialect(text: Column) -> Column:
    """The dialect of most telling words; ties are ambiguous, none is unknown."""
    bare = _sql_words(text)
    extra = {"postgresql": 2 * F.regexp_count(text, F.lit(r"\$([A-Za-z_]*)\$.*?\$\1\$")), "sql-server": F.regexp_count(text, F.lit(r"\[\w+\]")), "mysql-mariadb": F.regexp_count(text, F.lit("`[^`]+`"))}
    scores = [F.struct((-(F.regexp_count(bare, F.lit(r"\b(?:" + "|".join(ws) + r")\b")) + extra.get(n, F.lit(0)))).alias("score"), F.lit(n).alias("name")) for n, ws in DIALECTS.items()]
    ranked = F.array_sort(F.array(*scores))
    first, second = F.get(ranked, 0), F.get(ranked, 1)
    return F.when(first["score"] == 0, "standard-or-unknown").when(first["score"] == second["score"], "mixed-or-ambiguous").otherwise(first["name"])


def sql_role(path: Column, text: Column) -> Column:
    """Role of a SQL file; the first rule that fits."""
    low, bare = F.lower(path), _sql_words(text)
    has = lambda p: bare.rlike(p)
    return (
        F.when(F.regexp_count(F.lower(F.substring(text, 1, 131_072)), F.lit("insert into ")) >= 100, "dump")
        .when(low.rlike(r"(^|/)(tests?|fixtures?|test-?data)(/|$)"), "test-fixture")
        .when(low.rlike(r"(^|/)migrations?(/|$)"), "migration")
        .when(low.rlike(r"(^|/)seeds?(/|$)|(^|/)seed[^/]*$"), "seed-data")
        .when(low.rlike(r"(^|/)(deploy|release|delivery)[^/]*(/|$)"), "delivery")
        .when(has(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROC(?:EDURE)?|TRIGGER)\b"), "stored-program")
        .when(has(r"\b(?:CREATE|ALTER)\s+(?:\w+\s+)?(?:TABLE|VIEW|INDEX|SEQUENCE|TYPE)\b"), "schema")
        .when(has(r"\bSELECT\b"), "query")
        .otherwise("unknown")
    )


def parser_confidence(text: Column, language: str) -> Column:
    """Low where brackets do not balance outside comments and strings, else high."""
    bare = without_noise(text, language)
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    return F.when((count("(") == count(")")) & (count("{") == count("}")) & (count("[") == count("]")), "high").otherwise("low")


def formatting_signature(text: Column, language: str = "csharp") -> Column:
    """Digest of a text's tokens: white space outside comments and strings does not count.

    Leading white space counts where the language gives it meaning.
    """
    spec = LANGUAGES.get(language, LANGUAGES["csharp"])
    indent = r"(?m)^[ \t]+(?=\S)|" if language == "python" else ""
    tokens = F.regexp_extract_all(text, F.lit(f"{indent}{spec.noise}" + r"|\w+|[^\s\w]"), 0)
    return F.sha2(F.array_join(tokens, "\u0001"), 256)


def custom_regions(text: Column) -> Column:
    """Hand-written parts of generated code between balanced marks; none if the marks do not balance."""
    opened, closed = F.regexp_count(text, F.lit("<custom-code>")), F.regexp_count(text, F.lit("</custom-code>"))
    found = F.regexp_extract_all(text, F.lit(r"(?s)<custom-code>((?:(?!</?custom-code>).)*)</custom-code>"), 1)
    return F.when((opened == closed) & (F.size(found) == opened), found).otherwise(F.array().cast("array<string>"))


def module_edges(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Edges from an infrastructure directory to the local modules it uses: src, dst."""
    source = F.regexp_extract_all(F.col(text), F.lit(r"(?s)\bmodule\s+\"[^\"]+\"\s*\{[^}]*?\bsource\s*=\s*\"(\.[^\"]*)\""), 1)
    here = F.regexp_replace(F.col(path), r"/?[^/]*$", "")
    rows = files.select(here.alias("src"), F.explode(source).alias("to"))
    joined = F.split(F.concat_ws("/", F.when(F.col("src") != "", F.col("src")), F.col("to")), "/")
    walk = F.aggregate(joined, F.array().cast("array<string>"), lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return rows.select("src", F.array_join(walk, "/").alias("dst")).distinct()


def notebook_code(text: Column) -> Column:
    """Code cells of a notebook as one text."""
    cells = F.from_json(text, "struct<cells:array<struct<cell_type:string,source:array<string>>>>")["cells"]
    return F.array_join(F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.array_join(c["source"], "")), "\n")
