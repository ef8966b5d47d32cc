"""Infrastructure files: HCL block trees and the graph of modules, Dockerfile stages, Compose builds.

One pass over a file gives its blocks and attributes, or its instructions, as rows; what they mean,
whom a file belongs to and what a reference leads to are joins over those rows, so that a tree of
any size is resolved by shuffles on directories and names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facts, graph
from .formatting import STYLES, Unfinished, quote_end
from .reading import rows_of

HCL_SCHEMA = (
    "parent int, depth int, is_block boolean, name string, labels array<string>, literal string, line int, tokens int, traversals int, functions int, conditionals int, loops int, templates int, heredocs int, balanced boolean"
)
_TEMPLATE = re.compile(r"(?<!\$)\$\{|(?<!%)%\{")


def hcl_tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, place) of the tokens of an HCL source; comments are none, a heredoc is one string."""
    spec, at = STYLES["hcl"].token, 0
    while at < len(text):
        m = spec.match(text, at)
        kind, begin, at = m.lastgroup, at, m.end()
        if m["here"]:
            yield "heredoc", m["here"], begin
            yield "line", "\n", at
        elif kind == "quote":
            at = quote_end(text, begin)
            yield "string", text[begin + 1 : at - 1], begin
        elif kind == "bad":
            raise Unfinished
        elif kind not in ("space", "keep"):
            yield kind, m[0], begin


def hcl_rows(text: str) -> list[tuple]:
    """Rows of HCL_SCHEMA: every block and attribute, each behind the block that holds it."""
    tokens, whole = [], True
    try:
        tokens.extend(hcl_tokens(text))
    except Unfinished:
        whole = False
    rows: list[list] = []
    within, i, n = [-1], 0, len(tokens)
    line, seen = 1, 0
    while i < n:
        kind, value, place = tokens[i]
        if kind == "line":
            i += 1
            continue
        if value == "}" and kind == "sign":
            whole &= len(within) > 1
            del within[max(1, len(within) - 1) :]
            i += 1
            continue
        line += text.count("\n", seen, place)
        seen = place
        j = i
        while j < n and tokens[j][0] in ("word", "string"):
            j += 1
        sign = tokens[j][1] if j < n and tokens[j][0] == "sign" else ""
        if kind != "word" or sign not in ("=", "{"):  # unknown: to the end of the line
            whole = False
            while i < n and tokens[i][0] != "line":
                i += 1
            continue
        head = [within[-1], len(within) - 1]
        if sign == "{":
            rows.append([*head, True, value, [t[1] for t in tokens[i + 1 : j]], None, line, 0, 0, 0, 0, 0, 0, 0])
            within.append(len(rows) - 1)
            i = j + 1
            continue
        end, depth = j + 1, 0
        while end < n and (depth or tokens[end][0] != "line") and (depth or tokens[end][:2] != ("sign", "}")):
            if tokens[end][0] == "sign":
                depth += (tokens[end][1] in "([{") - (tokens[end][1] in ")]}") if len(tokens[end][1]) == 1 else 0
            end += 1
        whole &= depth == 0
        made = [t for t in tokens[j + 1 : end] if t[0] != "line"]
        templates = sum(t[0] in ("string", "heredoc") and bool(_TEMPLATE.search(t[1])) for t in made)
        literal = made[0][1] if len(made) == 1 and made[0][0] == "string" and not templates else None
        calls = sum(a[0] == "word" and b[1] == "(" for a, b in zip(made, made[1:]))
        signs = [t[1] for t in made if t[0] == "sign"]
        loops = sum(t[:2] == ("word", "for") for t in made)
        rows.append([*head, False, value, [], literal, line, len(made), signs.count("."), calls, signs.count("?"), loops, templates, sum(t[0] == "heredoc" for t in made)])
        i = end
    whole &= len(within) == 1
    return [(*r, whole) for r in rows]


def hcl(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys of each file with its blocks and attributes in order (``place``); a file without any has no rows."""
    return rows_of(files, keys, [text], hcl_rows, HCL_SCHEMA, "place")


# Blocks at the top of a file, by what they count for.
TOP_BLOCKS = {
    "resources": "resource", "data_sources": "data", "module_calls": "module", "variables": "variable", "outputs": "output", "providers": "provider", "terraform_blocks": "terraform", "test_runs": "run",
}
INNER_BLOCKS = {"lifecycle_blocks": "lifecycle", "dynamic_blocks": "dynamic", "provisioners": "provisioner", "validation_rules": "validation"}


def terraform_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each file's blocks, attributes and kinds of expressions."""
    block, name, depth = F.col("is_block"), F.col("name"), F.col("depth")
    of = lambda c: F.count_if(c).cast("int")
    return rows.groupBy(*keys).agg(
        of(block).alias("blocks"), of(~block).alias("attributes"), *[of(block & (depth == 0) & (name == b)).alias(c) for c, b in TOP_BLOCKS.items()],
        *[of(block & (depth > 0) & (name == b)).alias(c) for c, b in INNER_BLOCKS.items()], of(~block & (name == "description")).alias("descriptions"),
        *[F.sum(c).cast("int").alias(c) for c in ("traversals", "functions", "conditionals", "loops", "templates", "heredocs")], F.bool_and("balanced").alias("balanced"),
    )


def directory(path: Column) -> Column:
    """The directory of a path; the root is empty."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def resolved(base: Column, relative: Column) -> Column:
    """A relative path from a directory, without dots; null if it leads out of the tree."""
    steps = F.filter(F.concat(F.split(base, "/"), F.split(F.replace(relative, F.lit("\\"), F.lit("/")), "/")), lambda s: ~s.isin("", "."))
    none = F.lit(None).cast("array<string>")
    walk = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda at, s: F.when(at.isNull() | (s == "..") & (F.size(at) < 1), none).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))),
    )
    away = relative.startswith("/") | F.contains(relative, F.lit(":"))
    return F.when(~away, F.array_join(walk, "/"))


def module_owners(files: DataFrame, path: str = "path") -> DataFrame:
    """The module directory that each file belongs to: the deepest at or above it that holds configuration, else its own."""
    low = F.lower(path)
    defines = low.rlike(r"\.(tf|hcl)$") & ~low.rlike(r"\.(tftest|tfmock)\.hcl$|(^|/)\.terraform\.lock\.hcl$|(^|/)tests?/")
    own = files.select(path, directory(F.col(path)).alias("_own"))
    homes = own.where(defines).select(F.col("_own").alias("directory")).distinct().withColumn("scope", F.col("directory"))
    found = facts.owning_scope(files.select(path).distinct(), homes, path)
    return own.join(found, path, "left").select(path, F.coalesce("scope", "_own").alias("module"))


def module_references(rows: DataFrame, owners: DataFrame, path: str = "path") -> DataFrame:
    """Local references of modules: module, target (null if outside), path, line, outside, missing."""
    calls = rows.where("is_block and depth = 0 and name = 'module'").select(path, F.col("place").alias("parent"))
    sources = rows.where(r"not is_block and name = 'source' and literal rlike '^\\.\\.?(/|$)'").select(path, "parent", "line", F.split_part("literal", F.lit("?"), F.lit(1)).alias("_source"))
    uses = sources.join(calls, [path, "parent"], "left_semi").join(owners, path)
    uses = uses.withColumn("target", resolved(F.col("module"), F.col("_source")))
    known = owners.select(F.col("module").alias("target")).distinct().withColumn("_known", F.lit(True))
    joined = uses.join(known, "target", "left")
    return joined.select("module", "target", path, "line", F.col("target").isNull().alias("outside"), (F.col("target").isNotNull() & F.col("_known").isNull()).alias("missing"))


def module_cycles(references: DataFrame) -> DataFrame:
    """(module, cyclic_size): how many modules are on cycles with each that refers or is referred to; 0 off cycles."""
    edges = references.where("not outside and not missing").select(F.col("module").alias("src"), F.col("target").alias("dst"))
    return graph.cyclic_sizes(edges).select(F.col("node").alias("module"), "cyclic_size")


# Dockerfiles


def instructions(text: str) -> list[tuple]:
    """(instruction, words, stage) of every logical line; stages count from 0, -1 stands before the first."""
    escape, out, stage, lines, begun = "\\", [], -1, iter(re.split(r"\r\n?|\n", text)), False
    for line in lines:
        bare = line.strip()
        if not bare or bare.startswith("#"):
            m = None if begun else re.fullmatch(r"#\s*escape\s*=\s*([\\`])", bare, re.I)
            escape = m[1] if m else escape
            continue
        begun, whole = True, bare
        while whole.endswith(escape):
            more = next((x.strip() for x in lines if x.strip() and not x.strip().startswith("#")), "")
            whole = f"{whole[:-1].rstrip()} {more}".strip()
            if not more:
                break
        for end in re.findall(r"<<-?[\"']?(\w+)", whole) if re.match(r"(?i)(run|copy|add)\s", whole) else ():
            for x in lines:
                if x.strip() == end:
                    break
        word, _, rest = whole.replace("\t", " ").partition(" ")
        stage += word.upper() == "FROM"
        out.append((word.upper(), [w for w in re.findall(r"(?:\"(?:[^\"\\]|\\.)*\"|'[^']*'|\\.|[^\s\"'])+", rest)], stage))
    return out


def dockerfile(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return rows_of(files, keys, [text], instructions, "instruction string, words array<string>, stage int", "place")


def stage_references(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What each stage builds on or copies from: kind (base or copy), name, target stage (null if none), outcome.

    A name is a stage if an earlier FROM (for copies, or the current one) gave it, or it is a number
    in a copy; names that hold a variable are unresolved, all others are images from elsewhere.
    """
    plain = F.filter("words", lambda w: ~w.startswith("--"))
    bases = rows.where("instruction = 'FROM'").withColumn("name", F.get(plain, 0)).where("name is not null")
    place = F.array_position(F.transform("words", F.upper), "AS").cast("int")
    aliases = bases.select(*keys, F.col("stage").alias("_at"), F.get("words", F.when(place > 0, place)).alias("name")).where("name is not null")
    first = F.get(F.filter("words", lambda w: F.lower(w).startswith("--from=")), 0)
    copies = rows.where("instruction in ('COPY', 'ADD')").withColumn("name", F.substring(first, 8, 1 << 30)).where("name is not null")
    uses = bases.select(*keys, "place", "stage", "name", F.lit("base").alias("kind")).unionByName(copies.select(*keys, "place", "stage", "name", F.lit("copy").alias("kind")))
    in_time = (F.col("_at") < F.col("stage")) | (F.col("_at") == F.col("stage")) & (F.col("kind") == "copy")
    held = uses.join(aliases, [*keys, "name"]).where(in_time).groupBy(*keys, "place").agg(F.max("_at").alias("_target"))
    out = uses.join(held, [*keys, "place"], "left")
    number = F.when((F.col("kind") == "copy") & F.col("name").rlike("^[0-9]{1,9}$"), F.col("name").cast("int"))
    target = F.coalesce("_target", number)
    outcome = F.when(F.contains("name", F.lit("$")), "unresolved").when(target.isNotNull(), "stage").otherwise("image")
    return out.select(*keys, "place", "stage", "kind", "name", F.when(outcome == "stage", target).alias("target"), outcome.alias("outcome"))


# Instructions that count for themselves.
COUNTED = {"runs": "RUN", "copies": "COPY", "adds": "ADD", "work_directories": "WORKDIR", "users": "USER", "health_checks": "HEALTHCHECK"}
KNOWN = "FROM RUN COPY ADD ARG ENV WORKDIR USER EXPOSE VOLUME HEALTHCHECK CMD ENTRYPOINT LABEL SHELL STOPSIGNAL ONBUILD MAINTAINER".split()


def docker_counts(rows: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each Dockerfile's instructions, stages and references."""
    of = lambda c: F.count_if(c).cast("int")
    i, words = F.col("instruction"), F.greatest(F.lit(1), F.size("words"))
    mounts = lambda p: F.size(F.filter("words", lambda w: F.lower(w).startswith("--mount=") & F.lower(w).rlike(p)))
    total = lambda c, x: F.sum(F.when(c, x).otherwise(0)).cast("int")
    counts = rows.groupBy(*keys).agg(
        F.count("*").cast("int").alias("instructions"), of(i == "FROM").alias("stages"), *[of(i == w).alias(c) for c, w in COUNTED.items()], of(i.isin("CMD", "ENTRYPOINT")).alias("runtime_commands"),
        total(i == "ARG", words).alias("arguments"), total(i == "EXPOSE", words).alias("exposed_ports"), total(i == "RUN", mounts("type=(secret|ssh)")).alias("secret_mounts"), total(i == "RUN", mounts("type=(cache|bind)")).alias("cache_mounts"),
        of(~i.isin(*KNOWN)).alias("unknown"),
    )
    found = references.groupBy(*keys).agg(of(F.col("outcome") == "stage").alias("stage_references"), F.count_distinct(F.when(F.col("outcome") == "image", F.col("name"))).cast("int").alias("images"), of(F.col("outcome") == "unresolved").alias("unresolved"))
    return counts.join(found, keys, "left").na.fill(0, ["stage_references", "images", "unresolved"])


# Compose files


def builds(text: str) -> list[tuple]:
    """(service, context, dockerfile) of every build of a Compose file; null where it is not stated."""
    out, path, service = [], [], None  # path: (indent, key) of the open mappings

    def plain(value: str) -> str | None:
        value = re.sub(r"\s+#.*$", "", value).strip()
        return (value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1 else value) or None

    for raw in re.split(r"\r\n?|\n", text):
        m = re.match(r"( *)(?!#)([\w.-]+|\"[^\"]*\"|'[^']*')\s*:(?:\s+(.*)|$)", raw)
        if m is None:
            continue
        indent, key, value = len(m[1]), plain(m[2]), plain(m[3] or "")
        while path and path[-1][0] >= indent:
            path.pop()
        names = [k for _, k in path]
        path.append((indent, key))
        if len(names) == 2 and names[0] == "services" and key == "build":
            service = [names[1], value, None]
            out.append(service)
        elif len(names) == 3 and names[0] == "services" and names[2] == "build" and key in ("context", "dockerfile"):
            service[1 if key == "context" else 2] = value
    return [tuple(x) for x in out]


def compose_builds(files: DataFrame, tree: DataFrame, path: str = "path", text: str = "text", repo: list[str] | None = None) -> DataFrame:
    """Where each build of each Compose file leads: service, target, outcome (resolved, missing, unresolved, external).

    ``tree`` lists all paths; ``repo`` names columns within which paths are looked up.
    """
    keys = [*(repo or []), path]
    rows = rows_of(files, keys, [text], builds, "service string, context string, dockerfile string")
    context, docker = F.coalesce("context", F.lit(".")), F.coalesce("dockerfile", F.lit("Dockerfile"))
    home = resolved(directory(F.col(path)), context)
    away = F.lower(context).rlike("^(https?|git|ssh|docker-image)://|^service:")
    dynamic = F.contains(context, F.lit("$")) | F.contains(docker, F.lit("$"))
    rows = rows.withColumn("target", F.when(~dynamic & ~away, resolved(home, docker)))
    known = tree.select(*(repo or []), F.col(path).alias("target")).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, [*(repo or []), "target"], "left")
    outcome = F.when(dynamic, "unresolved").when(away, "external").when(F.col("target").isNull(), "unresolved").when(F.col("_known").isNull(), "missing").otherwise("resolved")
    return joined.select(*keys, "service", "target", outcome.alias("outcome"))
