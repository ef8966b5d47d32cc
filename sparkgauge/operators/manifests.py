"""Build manifests: Cargo tables, and the command calls of CMake and Meson, as targets and dependencies.

A manifest is read into rows once; workspaces, local projects and the edges between them are joins
over directories.  What is not a literal is counted as unresolved, and a manifest that cannot be read
gives one row that says so.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .infrastructure import directory, resolved
from .reading import rows_of

SCHEMA = "kind string, name string, detail string, value string"
DEPENDENCIES = {"dependencies": "runtime", "dev-dependencies": "development", "build-dependencies": "build"}
TARGETS = ("bin", "example", "test", "bench")


def cargo(text: str) -> Iterator[tuple]:
    """(kind, name, detail, value): package, workspace, member, exclude, target, feature, dependency, unresolved, malformed."""
    try:
        doc = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        yield "malformed", None, None, None
        return
    table = lambda x: x if isinstance(x, dict) else {}
    package = table(doc.get("package"))
    if package:
        name = package.get("name")
        yield "package", name if isinstance(name, str) else None, None, str(package.get("edition", ""))
        if package.get("build"):
            yield "build-script", None, None, package["build"] if isinstance(package["build"], str) else "build.rs"
        yield from (("unresolved", k, "package", "workspace") for k, v in package.items() if table(v).get("workspace"))
    if "workspace" in doc:
        yield "workspace", None, None, None
        for kind, key in (("member", "members"), ("exclude", "exclude")):
            yield from ((kind, None, None, x) for x in table(doc["workspace"]).get(key, []) if isinstance(x, str))
    if "lib" in doc:
        lib = table(doc["lib"])
        yield "target", lib.get("name"), "proc-macro" if lib.get("proc-macro") else "lib", lib.get("path")
    for kind in TARGETS:
        for x in doc.get(kind, []) if isinstance(doc.get(kind), list) else []:
            yield "target", table(x).get("name"), kind, table(x).get("path")
    for name in table(doc.get("features")):
        yield "feature", name, None, None
    places = [("", doc), ("workspace", table(doc.get("workspace"))), *((f"target.{k}", table(v)) for k, v in table(doc.get("target")).items())]
    for place, held in places:
        for key, kind in DEPENDENCIES.items():
            for name, spec in table(held.get(key)).items():
                spec = table(spec)
                yield "dependency", spec.get("package", name), "workspace" if place == "workspace" else kind, spec.get("path")
                if spec.get("workspace") or place.startswith("target."):
                    yield "unresolved", name, kind, place or "workspace"


_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_ARGUMENT = re.compile(r"\[(?P<f>=*)\[(?P<raw>.*?)\](?P=f)\]|\"(?P<quoted>(?:[^\"\\]|\\.)*)\"|'(?P<single>(?:[^'\\]|\\.)*)'|(?P<bare>[^\s()\"'\[\],#]+)|(?P<sign>[()\[\],])|#(?P<comment>[^\r\n]*)|(?P<space>\s+)|.", re.S)


def calls(text: str) -> Iterator[tuple[str, list[str]]]:
    """(name in lower case, arguments) of every command call, comments and strings seen for what they are."""
    at, name, depth, args, last = 0, "", 0, [], ""
    while at < len(text):
        block = re.compile(r"#\[(=*)\[.*?\]\1\]", re.S).match(text, at)
        if block:
            at = block.end()
            continue
        m = _ARGUMENT.match(text, at)
        at = m.end()
        if m["space"] is not None or m["comment"] is not None:
            continue
        if m["sign"] == "(":
            if depth == 0:
                name, args = last.lower(), []
            depth += 1
        elif m["sign"] == ")":
            depth = max(0, depth - 1)
            if depth == 0 and name:
                yield name, args
                name = ""
        else:
            value = next((m[g] for g in ("raw", "quoted", "single", "bare") if m[g] is not None), None)
            if depth and value is not None:
                args.append(value)
            last = m["bare"] or ""


def literal(value: str) -> bool:
    return bool(value) and not re.search(r"[$@<>*?]|\+=|==", value)


CMAKE_WORDS = frozenset("PUBLIC PRIVATE INTERFACE STATIC SHARED MODULE OBJECT EXCLUDE_FROM_ALL WIN32 MACOSX_BUNDLE REQUIRED COMPONENTS CONFIG QUIET debug optimized general".split())
CMAKE_TARGETS = {"add_executable": "executable", "add_library": "library"}
MESON_TARGETS = {"executable": "executable", "library": "library", "shared_library": "library", "static_library": "library"}
COUNTED = {"add_test": "test", "test": "test", "benchmark": "benchmark", "install": "install", "install_headers": "install", "install_data": "install", "add_custom_command": "generation", "configure_file": "generation", "custom_target": "generation", "generator": "generation"}


def commands(path: str, text: str) -> Iterator[tuple]:
    """Rows of SCHEMA of a CMake or Meson file: target, dependency, subdirectory, test, benchmark, install, generation, standard, unresolved."""
    cmake = not path.lower().rsplit("/", 1)[-1].startswith("meson")
    known: dict[str, list[str]] = {}

    def expand(values: list[str]) -> list[str]:
        out = []
        for v in values:
            m = re.fullmatch(r"\$\{(\w+)\}", v)
            out += known.get(m[1], [v]) if m else [v]
        return out

    for name, args in calls(text):
        targets = CMAKE_TARGETS if cmake else MESON_TARGETS
        if name == "set" and cmake and len(args) > 1 and all(map(literal, args)):
            known[args[0]] = args[1:]
            m = re.fullmatch("CMAKE_(C|CXX)_STANDARD", args[0].upper())
            if m:
                yield "standard", None, None, ("c++" if m[1] == "CXX" else "c") + args[1]
        elif name in targets:
            if not args or not literal(args[0]):
                yield "unresolved", None, name, args[0] if args else None
                continue
            yield "target", args[0], "plugin" if "MODULE" in args else targets[name], None
            for source in expand(args[1:]):
                if not literal(source):
                    yield "unresolved", args[0], "source", source
                elif re.search(r"\.\w+$", source):
                    yield "source", args[0], None, source
        elif name == "target_link_libraries" and cmake:
            for value in expand(args[1:]):
                if value not in CMAKE_WORDS:
                    yield ("dependency", value, "link", args[0]) if literal(value) else ("unresolved", value, "link", None)
        elif name == ("find_package" if cmake else "dependency") and args:
            yield ("dependency", args[0], "external", None) if literal(args[0]) else ("unresolved", args[0], "external", None)
        elif name == ("add_subdirectory" if cmake else "subdir") and args:
            yield ("subdirectory", None, None, args[0]) if literal(args[0]) else ("unresolved", None, "subdirectory", args[0])
        elif name in COUNTED:
            yield COUNTED[name], args[0] if args else None, None, None


def manifest_rows(path: str, text: str) -> list[tuple]:
    return list(cargo(text) if path.lower().endswith(".toml") else commands(path, text))


def manifests(files: DataFrame, keys: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """The rows of each manifest: keys, path, place, SCHEMA."""
    return rows_of(files, [*keys, path], [path, text], manifest_rows, SCHEMA, "place")


def project_edges(rows: DataFrame, repo: list[str], path: str = "path") -> DataFrame:
    """Edges between projects of a tree: src and dst directories, kind, outcome (local, missing, outside).

    A path of a dependency and a subdirectory lead to the directory of another manifest.
    """
    home = directory(F.col(path))
    uses = rows.where("kind = 'subdirectory' or kind = 'dependency' and value is not null and detail <> 'link'")
    uses = uses.select(*repo, home.alias("src"), "kind", resolved(home, F.col("value")).alias("dst"))
    known = rows.select(*repo, home.alias("dst")).distinct().withColumn("_known", F.lit(True))
    out = uses.distinct().join(known, [*repo, "dst"], "left")
    outcome = F.when(F.col("dst").isNull(), "outside").when(F.col("_known").isNull(), "missing").otherwise("local")
    return out.select(*repo, "src", "dst", "kind", outcome.alias("outcome"))


def workspace_members(rows: DataFrame, repo: list[str], path: str = "path") -> DataFrame:
    """Packages with the nearest workspace at or above them that lists them: package directory, workspace directory (null if none).

    Members are patterns of one directory level a ``*``; a pattern of ``exclude`` takes back.
    """
    home = directory(F.col(path))
    packages = rows.where("kind = 'package'").select(*repo, home.alias("package")).distinct()
    spaces = rows.where("kind in ('workspace', 'member', 'exclude')").groupBy(*repo, home.alias("workspace")).agg(
        F.count_if(F.col("kind") == "workspace").alias("_n"), F.collect_set(F.when(F.col("kind") == "member", F.col("value"))).alias("_in"), F.collect_set(F.when(F.col("kind") == "exclude", F.col("value"))).alias("_out")
    ).where("_n > 0")
    at = F.split("package", "/")
    up = packages.withColumn("workspace", F.explode(F.transform(F.sequence(F.lit(0), F.size(at)), lambda n: F.array_join(F.slice(at, 1, n), "/")))).distinct()
    rest = F.when(F.col("workspace") == "", F.col("package")).otherwise(F.expr("substr(package, length(workspace) + 2)"))
    fits = lambda patterns: F.exists(patterns, lambda p: F.rlike(rest, F.concat(F.lit("^"), F.replace(F.regexp_replace(p, r"([.+()\[\]{}^$|\\])", r"\\$1"), F.lit("*"), F.lit("[^/]*")), F.lit("/?$"))))
    listed = up.join(spaces, [*repo, "workspace"]).where((F.col("workspace") == F.col("package")) | fits(F.col("_in")) & ~fits(F.col("_out")))
    best = listed.groupBy(*repo, "package").agg(F.max_by("workspace", F.length("workspace")).alias("workspace"))
    return packages.join(best, [*repo, "package"], "left")
