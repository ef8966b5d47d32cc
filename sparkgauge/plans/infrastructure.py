"""Infrastructure plans: module trees, build stages and Compose files named after the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infrastructure as infra
from ..sources import table
from .code import pick
from .registry import query

#: A module for two of three documents, a file of values below it for the third.
MODULES_SQL = """
d AS (SELECT doc_id, doc_id // 3 AS k, doc_id % 5 AS r, coalesce(len(text), 0) AS size FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT *, 'envs/e' || k % 20 || '/m' || CASE WHEN doc_id % 3 = 2 THEN doc_id - 1 || '/vars' ELSE doc_id::VARCHAR END AS dir FROM d),
homes AS (SELECT DISTINCT dir FROM f WHERE doc_id % 3 < 2),
o AS (SELECT f.*, f.dir || CASE WHEN doc_id % 3 = 2 THEN '/x.tfvars' ELSE '/main.tf' END AS path, coalesce(h.dir, f.dir) AS module FROM f LEFT JOIN homes h ON h.dir = CASE WHEN doc_id % 3 = 2 THEN left(f.dir, len(f.dir) - 5) ELSE f.dir END)"""

TAIL = '''locals {
  x = <<-EOT
    module "no" { source = "./no" }
  EOT
  y = "${lookup({ a = "}" }, "a")}" # module "b" {
}
resource "r" "s" {
  count = var.on ? 1 : 0
  dynamic "t" {
    for_each = [for v in var.w : v.x if f(v)]
    content {}
  }
  description = "d"
}
'''


def module_files(spark, sf_dir):
    """(path, text): each module calls another by a relative, outer or remote source."""
    k, group = F.col("doc_id"), F.expr("doc_id div 3")
    base = F.concat(F.lit("envs/e"), group % 20, F.lit("/m"))
    path = F.when(k % 3 == 2, F.concat(base, k - 1, F.lit("/vars/x.tfvars"))).otherwise(F.concat(base, k, F.lit("/main.tf")))
    source = F.when(k % 5 == 0, F.concat(F.lit("../m"), group * 3 + 1)).when(k % 5 == 1, F.concat(F.lit("../m"), group * 3)).when(k % 5 == 2, "../../../../x").when(k % 5 == 3, "git::https://h//y").otherwise("./sub")
    text = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "), F.lit('\nmodule "a" {\n  source = "'), source, F.lit('"\n}\n'), F.lit(TAIL))
    return table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", path.alias("path"), text.alias("text"))


@query(f"""
WITH {MODULES_SQL},
s AS (SELECT *, regexp_replace(module, '/[^/]*$', '') AS up, CASE r WHEN 0 THEN up || '/m' || (k * 3 + 1) WHEN 1 THEN up || '/m' || (k * 3) WHEN 2 THEN CASE WHEN ends_with(module, '/vars') THEN 'x' END WHEN 4 THEN module || '/sub' END AS goal FROM o WHERE r <> 3)
SELECT module, goal AS target, path, 3 AS line, goal IS NULL AS outside, goal IS NOT NULL AND goal NOT IN (SELECT module FROM o) AS missing FROM s
""")
def terraform_modules(spark, sf_dir):
    """Where each module's local references lead, from block trees of files written from all documents."""
    files = module_files(spark, sf_dir)
    return infra.module_references(infra.hcl(files, ["path"]), infra.module_owners(files))


@query(f"""
WITH {MODULES_SQL},
e AS (SELECT DISTINCT module AS a, regexp_replace(module, '/[^/]*$', '') || '/m' || (k * 3 + 1 - r) AS b FROM o WHERE r < 2), g AS (SELECT * FROM e WHERE b IN (SELECT module FROM o)),
n AS (SELECT a AS module FROM g UNION SELECT b FROM g)
SELECT module, CASE WHEN EXISTS (SELECT 1 FROM g x JOIN g y ON x.b = y.a AND y.b = x.a WHERE x.a = n.module AND x.b <> n.module) THEN 2 WHEN EXISTS (SELECT 1 FROM g WHERE a = n.module AND b = n.module) THEN 1 ELSE 0 END AS cyclic_size FROM n
""")
def terraform_cycles(spark, sf_dir):
    """How many modules lie on cycles of references."""
    files = module_files(spark, sf_dir)
    return infra.module_cycles(infra.module_references(infra.hcl(files, ["path"]), infra.module_owners(files)))


@query("""
SELECT doc_id, 5 AS blocks, 6 AS attributes, 1 AS resources, 1 AS module_calls, 1 AS dynamic_blocks, 1 AS descriptions, 3 AS traversals, 1 AS functions, 1 AS conditionals, 1 AS loops, 1 AS templates, 1 AS heredocs, TRUE AS balanced FROM documents WHERE doc_id IS NOT NULL
""")
def terraform_counts(spark, sf_dir):
    """Blocks, attributes and expressions of HCL files with heredocs, templates and comments that look like code."""
    rows = infra.terraform_counts(infra.hcl(module_files(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return rows.select("doc_id", "blocks", "attributes", "resources", "module_calls", "dynamic_blocks", "descriptions", "traversals", "functions", "conditionals", "loops", "templates", "heredocs", "balanced")


DOCKER = (
    "COPY --from=base /a /b\n", "COPY --from=0 /a \\\n  # between\n  /b\n", "COPY --from=alpine:3 x y\n", "RUN --mount=type=cache,target=/c --mount=type=secret,id=s a && \\\n    b\n",
    "RUN <<EOF\nFROM no AS none\nCOPY --from=none a b\nEOF\n", "COPY --from=$X a b\n", "EXPOSE 80 443\n",
)


def docker_files(spark, sf_dir):
    """One Dockerfile a page: three stages, with instructions chosen by the lengths of its url and html."""
    a, b = F.coalesce(F.length("url"), F.lit(0)), F.coalesce(F.length("html"), F.lit(0))
    last = F.when(a % 2 == 0, "base").otherwise(F.concat(F.lit("img"), a % 10))
    text = F.concat(F.lit("# escape=\\\nARG V=1\nFROM img:$V AS base\n"), pick(DOCKER, a), F.lit("FROM debian AS mid\n"), pick(DOCKER, b), F.lit("FROM --platform=x "), last, F.lit('\nCMD ["run", "x"]\n'))
    return table(spark, sf_dir, "pages").select("page_id", "url", text.alias("text"))


@query("""
WITH p AS (SELECT page_id, coalesce(len(url), 0) AS a, coalesce(len(html), 0) AS b FROM pages), q AS (SELECT *, a % 7 AS x, b % 7 AS y FROM p)
SELECT page_id, (7 + 0)::INTEGER AS instructions, 3 AS stages, ((x IN (3, 4))::INTEGER + (y IN (3, 4))::INTEGER) AS runs, ((x IN (0, 1, 2, 5))::INTEGER + (y IN (0, 1, 2, 5))::INTEGER) AS copies, 1 AS runtime_commands, 1 AS arguments,
  2 * ((x = 6)::INTEGER + (y = 6)::INTEGER) AS exposed_ports, (x = 3)::INTEGER + (y = 3)::INTEGER AS secret_mounts, (x = 3)::INTEGER + (y = 3)::INTEGER AS cache_mounts,
  (x < 2)::INTEGER + (y < 2)::INTEGER + (a % 2 = 0)::INTEGER AS stage_references, 1 + (a % 2 = 1)::INTEGER + (x = 2 OR y = 2)::INTEGER AS images, 1 + (x = 5)::INTEGER + (y = 5)::INTEGER AS unresolved FROM q
""")
def docker_stages(spark, sf_dir):
    """Instructions, stages and what they refer to, of Dockerfiles written from all pages."""
    rows = infra.dockerfile(docker_files(spark, sf_dir), ["page_id"])
    out = infra.docker_counts(rows, infra.stage_references(rows, ["page_id"]), ["page_id"])
    return out.select("page_id", "instructions", "stages", "runs", "copies", "runtime_commands", "arguments", "exposed_ports", "secret_mounts", "cache_mounts", "stage_references", "images", "unresolved")


@query("""
WITH p AS (SELECT page_id, page_id % 6 AS k, coalesce(len(url), 0) % 3 AS u FROM pages WHERE page_id IS NOT NULL),
t AS (SELECT 'r' || page_id || '/app/Dockerfile' AS path FROM p WHERE u <> 0)
SELECT 'r' || page_id || '/compose.yml' AS path, 'web' AS service, CASE WHEN k IN (0, 1) THEN 'r' || page_id || '/app/Dockerfile' WHEN k = 2 THEN 'r' || page_id || '/app/other.Dockerfile' END AS target,
  CASE k WHEN 3 THEN 'unresolved' WHEN 4 THEN 'external' WHEN 5 THEN 'unresolved' ELSE CASE WHEN k < 2 AND u <> 0 THEN 'resolved' ELSE 'missing' END END AS outcome FROM p
""")
def compose_builds(spark, sf_dir):
    """Where the builds of Compose files lead in a tree in which some Dockerfiles are missing."""
    pages = table(spark, sf_dir, "pages").where("page_id is not null")
    root, k = F.concat(F.lit("r"), "page_id"), F.col("page_id") % 6
    build = pick(("build: ./app # here\n", "build:\n      context: app/../app\n      args:\n        context: no\n", "build:\n      dockerfile: 'other.Dockerfile'\n      context: \"./app\"\n", "build: ${DIR}\n", "build: https://h/x.git\n", "build: ../../x\n"), k)
    text = F.concat(F.lit("version: '3'\nservices:\n  db:\n    image: x\n  web:\n    "), build, F.lit("    ports:\n      - '80:80'\nvolumes:\n  build: {}\n"))
    tree = pages.where("coalesce(length(url), 0) % 3 <> 0").select(F.concat(root, F.lit("/app/Dockerfile")).alias("path"))
    return infra.compose_builds(pages.select(F.concat(root, F.lit("/compose.yml")).alias("path"), text.alias("text")), tree)
