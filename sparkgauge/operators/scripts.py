"""Who runs which script: references in build, CI and script files resolved to paths, and roles spread along them.

Candidates of a text (words of path characters, and quoted texts) are exploded and joined with the
paths of all scripts: as they stand, below the directory of the file that names them, and, if only
one path fits, whatever the case.  A script takes the role of what runs it; a script that runs
another passes its roles on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _cut
from .infrastructure import directory
from .reading import rows_of

WINDOW = 96  # characters before a reference in which words tell its role
# Words of the surroundings, and the roles that they tell, the first of equally near ones winning.
ROLE_WORDS = {
    "build": "build", "test": "test", "deploy": "infrastructure", "provision": "infrastructure", "release": "delivery", "publish": "delivery", "package": "delivery", "pack": "delivery", "ci": "ci", "pipeline": "ci",
}
FILE_ROLES = {"ci-configuration": "ci", "infrastructure": "infrastructure", "container-configuration": "infrastructure", "build-configuration": "build"}
_WORD = re.compile(r"[\w./+@-]+")
_QUOTED = re.compile(r"\"([^\"\r\n]+)\"|'([^'\r\n]+)'")


def candidates(text: str) -> Iterator[tuple[str, int, str]]:
    """(candidate, place, role told by the nearest word before it) of everything that may name a path."""
    text = text.replace("\\", "/")
    found: dict[str, int] = {}
    for at, value in sorted([(m.start(), m[0]) for m in _WORD.finditer(text)] + [(m.start() + 1, m[1] or m[2]) for m in _QUOTED.finditer(text)]):
        value = value.strip()
        while value.startswith("./"):
            value = value[2:]
        if value and not value.startswith(("../", "/")) and "/../" not in value:
            found.setdefault(value, at)
    low = text.lower()
    for value, at in found.items():
        window = low[max(0, at - WINDOW) : at]
        near = max(ROLE_WORDS, key=lambda w: window.rfind(w))
        yield value, at, ROLE_WORDS[near] if near in window else "build"


def references(files: DataFrame, scripts: DataFrame, repo: list[str], path: str = "path", text: str = "text", role: str = "role") -> DataFrame:
    """Each script that a file names: repo, path, script, place, role (by the kind of the file, else by the words around)."""
    rows = rows_of(files, [*repo, path, role], [text], lambda t: list(candidates(t)), "candidate string, at int, told string")
    rows = rows.withColumn("_below", F.when(directory(F.col(path)) != "", F.concat_ws("/", directory(F.col(path)), "candidate")))
    known = scripts.select(*repo, F.col(path).alias("script")).distinct()
    fold = known.withColumn("_low", F.lower("script"))
    single = fold.groupBy(*repo, "_low").agg(F.min("script").alias("script"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    tries = [("candidate", 0), ("_below", 1)]
    exact = [rows.withColumn("script", F.col(c)).join(known, [*repo, "script"]).withColumn("_rank", F.lit(i)) for c, i in tries]
    loose = [rows.withColumn("_low", F.lower(F.col(c))).join(single, [*repo, "_low"]).withColumn("_rank", F.lit(i + 2)).drop("_low") for c, i in tries]
    names = [*repo, path, role, "candidate", "at", "told", "script", "_rank"]
    found = exact[0].select(names)
    for more in (exact[1], *loose):
        found = found.unionByName(more.select(names))
    one = found.groupBy(*repo, path, role, "candidate", "at", "told").agg(F.min_by("script", "_rank").alias("script"))
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FILE_ROLES.items() for x in kv]), F.col(role)), F.col("told"))
    first = one.groupBy(*repo, path, "script").agg(F.min("at").alias("place"), F.min_by(own, "at").alias("role"))
    return first.where(F.col(path) != F.col("script"))


def invocation_roles(refs: DataFrame, scripts: DataFrame, repo: list[str], path: str = "path") -> DataFrame:
    """Roles of every script that anything runs: repo, script, role, depth (0 where what runs it is no script)."""
    key = [*repo, "script", "role"]
    own = scripts.select(*repo, F.col(path).alias("_by")).distinct().withColumn("_is", F.lit(True))
    by = refs.select(*repo, F.col(path).alias("_by"), "script", "role").join(own, [*repo, "_by"], "left")
    edges = _cut(by.where("_is").select(*repo, "_by", "script").distinct())
    seen = front = _cut(by.where("_is is null").select(*key).distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():  # a job a step of the longest chain of scripts that run scripts
        depth += 1
        step = front.withColumnRenamed("script", "_by").join(edges, [*repo, "_by"]).select(*key).distinct()
        front = _cut(step.join(seen, key, "left_anti").withColumn("depth", F.lit(depth)))
        seen = _cut(seen.unionByName(front))
    return seen


def role_list(roles: DataFrame, repo: list[str]) -> DataFrame:
    """Scripts with their roles as one sorted array."""
    return roles.groupBy(*repo, "script").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def is_script(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(sh|bash|ksh|bats|ps1|psm1)$")
