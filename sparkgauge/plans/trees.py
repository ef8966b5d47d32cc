"""Plans over generated trees: scripts and what runs them, build manifests, and the element trees of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests, markup, scripts
from ..sources import table
from .code import pick
from .registry import query

FORM = (
    '<form><label for="a{0}">A</label><input id="a{0}"><label>B <select></select></label><input type=hidden><input aria-label="c"></form>',
    '<div onclick="x()"><img src=a><img src=b alt=""></div><span @click="y" @keydown.enter="y" tabindex=0>z</span><textarea><b></textarea>',
    '<div aria-live=polite role="status"></div><!-- <img> --><script>"<img>"</script><ul><li>1<li>2</ul><button onclick=z()>ok</button>',
)
#: elements, aria, labels, alternatives, live, focus, keys, controls, unlabelled, images without alternative, pointer only
FORM_COUNTS = ((7, 1, 4, 0, 0, 0, 0, 3, 0, 0, 0), (5, 0, 0, 1, 0, 1, 1, 1, 1, 1, 1), (6, 2, 0, 0, 1, 0, 0, 0, 0, 0, 0))


@query(f"""
WITH p AS (SELECT page_id, html, page_id % 3 AS k FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT k, unnest(v) AS f FROM (VALUES {", ".join(f"({k}, [{{'e': {c[0]}, 'a': {c[1]}, 'l': {c[2]}, 't': {c[3]}, 'i': {c[4]}, 'o': {c[5]}, 'y': {c[6]}, 'c': {c[7]}, 'u': {c[8]}, 'g': {c[9]}, 'p': {c[10]}}}])" for k, c in enumerate(FORM_COUNTS))}) t(k, v))
SELECT page_id, (f.e + len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g'), '<[A-Za-z][A-Za-z0-9]*')) + 2)::INTEGER AS elements, f.a AS aria, f.l AS labels, f.t AS alternatives, f.i AS live, f.o AS focus, f.y AS keys,
  f.c AS controls, f.u AS unlabelled, f.g AS images_without_alternative, f.p AS pointer_only, least(40, (f.a + f.l + f.t + f.i + f.o + f.y + 2) // 3)::INTEGER AS units FROM p JOIN h USING (k)
""")
def markup_accessibility(spark, sf_dir):
    """Element trees of all pages, with a form or widgets added to each: labels met with their controls, aids and gaps."""
    added = F.replace(pick(FORM, F.col("page_id")), F.lit("{0}"), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").where("page_id is not null").select("page_id", F.concat(added, F.coalesce("html", F.lit(""))).alias("html"))
    out = markup.accessibility(markup.tree(pages, ["page_id"]), ["page_id"])
    return out.select("page_id", "elements", "aria", "labels", "alternatives", "live", "focus", "keys", "controls", "unlabelled", "images_without_alternative", "pointer_only", "units")


@query("""
WITH p AS (SELECT page_id AS repo, CASE page_id % 4 WHEN 0 THEN 'ci' WHEN 1 THEN 'test' WHEN 2 THEN 'delivery' ELSE 'build' END AS own, coalesce(len(url), 0) % 2 AS u FROM pages WHERE page_id IS NOT NULL)
SELECT repo, script, CASE WHEN u = 1 THEN list_sort([own, 'infrastructure']) ELSE [own] END AS roles FROM p, (SELECT unnest(['tools/run.sh', 'tools/lib/Helper.sh', 'last.sh']) AS script)
""")
def script_invocations(spark, sf_dir):
    """Roles of scripts by what runs them, spread over a cycle of scripts that run each other, in a tree for every page."""
    pages = table(spark, sf_dir, "pages").where("page_id is not null")
    repo, k, u = F.col("page_id").alias("repo"), F.col("page_id") % 4, F.coalesce(F.length("url"), F.lit(0)) % 2
    head = F.when(k == 0, "steps:\n  - run: ./tools/run.sh --all\n").when(k == 1, '{"scripts": {"test": "bash tools/run.sh"}}').when(k == 2, "release:\n\ttools\\run.sh\n").otherwise("go:\n\tsh 'tools/run.sh'\n")
    role = F.when(k == 0, "ci-configuration").otherwise("package-manifest")
    files = [
        (F.lit("ci/x.yml"), role, head),
        (F.when(u == 1, "Dockerfile").otherwise("readme.txt"), F.when(u == 1, "container-configuration").otherwise("documentation"), F.when(u == 1, "RUN sh /last.sh last.sh").otherwise("none")),
        (F.lit("tools/run.sh"), F.lit("source"), F.lit(". lib/helper.sh\n../last.sh no\n")),
        (F.lit("tools/lib/Helper.sh"), F.lit("source"), F.lit("sh LAST.sh; sh Helper.sh\n")),
        (F.lit("last.sh"), F.lit("source"), F.lit("tools/run.sh\n")),
    ]
    rows = None
    for path, of, text in files:
        one = pages.select(repo, path.alias("path"), of.alias("role"), text.alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    own = rows.where(scripts.is_script(F.col("path")))
    refs = scripts.references(rows, own, ["repo"])
    return scripts.role_list(scripts.invocation_roles(refs, own, ["repo"]), ["repo"])


@query("""
WITH d AS (SELECT doc_id, doc_id % 3 AS k FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, '' AS src, 'crates/a' AS dst, 'dependency' AS kind, 'local' AS outcome FROM d WHERE k = 0
UNION ALL SELECT doc_id, 'crates/a', NULL, 'dependency', 'outside' FROM d WHERE k = 0
UNION ALL SELECT doc_id, '', 'lib', 'subdirectory', 'local' FROM d WHERE k > 0
UNION ALL SELECT doc_id, '', 'gone', 'subdirectory', 'missing' FROM d WHERE k > 0
""")
def manifest_edges(spark, sf_dir):
    """Edges between local projects of Cargo, CMake and Meson trees, one tree a document."""
    return manifests.project_edges(manifests.manifests(manifest_files(spark, sf_dir), ["doc_id"]), ["doc_id"])


@query("""
WITH d AS (SELECT doc_id, doc_id % 3 AS k FROM documents WHERE doc_id IS NOT NULL), c AS (SELECT * FROM (VALUES
  (0, 'package', 2), (0, 'workspace', 1), (0, 'member', 1), (0, 'exclude', 1), (0, 'target', 3), (0, 'feature', 2), (0, 'dependency', 6), (0, 'unresolved', 2),
  (1, 'target', 3), (1, 'source', 3), (1, 'dependency', 3), (1, 'subdirectory', 2), (1, 'test', 1), (1, 'standard', 1), (1, 'unresolved', 2), (1, 'generation', 1), (1, 'install', 1),
  (2, 'target', 3), (2, 'source', 3), (2, 'dependency', 1), (2, 'subdirectory', 2), (2, 'test', 1), (2, 'benchmark', 1), (2, 'generation', 1)) t(k, kind, n))
SELECT doc_id, kind, n::BIGINT AS n FROM d JOIN c USING (k)
""")
def manifest_rows(spark, sf_dir):
    """Targets, dependencies and what else manifests hold, by kind."""
    return manifests.manifests(manifest_files(spark, sf_dir), ["doc_id"]).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


CARGO = '''# [package] no
[package]
name = "root"
edition.workspace = true
[workspace]
members = [
  "crates/*", # all
]
exclude = ["crates/x"]
[workspace.dependencies]
serde = "1"
[[bin]]
name = "b"
[[test]]
name = "t"
[features]
default = ["x"]
x = []
[dependencies]
a = { path = "crates/a", package = "aa" }
"quoted#" = """1"""
[dependencies.z]
version = "1"
[target.'cfg(unix)'.dev-dependencies]
u = "1"
'''
CARGO_A = '[package]\nname = "a"\n[lib]\nproc-macro = true\n[dependencies]\nout = { path = "../../../x" }\n'
CMAKE = '''cmake_minimum_required(VERSION 3.1) # add_library(no)
#[[ add_library(no2) ]]
set(SRC a.cpp b.cpp)
set(CMAKE_CXX_STANDARD 17)
add_executable(app ${SRC} $<1:c.cpp>)
add_library(lib1 MODULE "d.cpp")
ADD_LIBRARY(${NAME} e.cpp)
target_link_libraries(app PRIVATE lib1 fmt::fmt)
find_package(Boost REQUIRED)
add_subdirectory(lib) add_subdirectory("gone")
add_test(NAME t COMMAND app) configure_file(a b) install(TARGETS app)
message("add_library(no3)" [=[ add_library(no4) ]=])
'''
MESON = '''project('p', 'cpp') # executable('no')
executable('app', 'a.cpp', ['b.cpp'], dependencies: dependency('zlib'))
static_library('l', 'c.cpp')
dependency('zlib')
test('t', app) benchmark('b', app) custom_target('g')
subdir('lib')
subdir('gone')
'''


def manifest_files(spark, sf_dir):
    """(doc_id, path, text): a tree a document, of Cargo, CMake or Meson files, with its text in comments."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    k = F.col("doc_id") % 3
    words = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1F\x7F]+|\]", " "), F.lit("\n"))
    name = F.when(k == 0, "Cargo.toml").when(k == 1, "CMakeLists.txt").otherwise("meson.build")
    top = docs.select("doc_id", name.alias("path"), F.concat(words, F.when(k == 0, CARGO).when(k == 1, CMAKE).otherwise(MESON)).alias("text"))
    below = docs.select("doc_id", F.concat(F.when(k == 0, "crates/a/").otherwise("lib/"), name).alias("path"), F.when(k == 0, CARGO_A).when(k == 1, "add_library(inner STATIC)").otherwise("shared_library('inner')").alias("text"))
    return top.unionByName(below)
