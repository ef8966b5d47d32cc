"""A source tree as a Python data source that never opens what it leaves out.

The planner walks the directories with their rule files in force, each from its own directory down:
excluded and ignored directories are not entered, links below the root are refused, and only
rule files are opened.  What is kept is dealt into partitions by bytes; executors read the contents, or,
with ``content`` off, nothing at all, so that a scan can first ask which files changed.

Rows are the kept files (``reason`` null) and what was left out with the reason.  The root must be
a folder that the driver and the executors see under one path.  A file that goes away or cannot be
read after the walk becomes a row with the reason ``unreadable``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import classify

SCHEMA = "path string, is_directory boolean, length long, modified timestamp, content binary, reason string"
PART_BYTES = 64 * 1024 * 1024
PART_FILES = 5_000
BATCH_BYTES = 16 * 1024 * 1024


@dataclass
class Entry:
    path: str
    is_directory: bool
    length: int | None = None
    modified: int | None = None  # microseconds
    reason: str | None = None


def excluded(path: str) -> str | None:
    """Why a directory is left out by its name or place."""
    low = path.lower()
    return classify.EXCLUDED_PATHS.get(low) or classify.EXCLUDED_DIRECTORIES.get(low.rsplit("/", 1)[-1])


def walk(root: str, rule_files: tuple[str, ...] = (".gitignore",), extra: tuple[str, ...] = ()) -> Iterator[Entry]:
    """Entries of a tree, depth first in order of names; ``extra`` are rules of the root that come last there."""
    if os.path.islink(root.rstrip("/")):
        raise ValueError(f"{root} is a link")
    if not os.path.isdir(root):
        raise FileNotFoundError(root)

    def rules_of(base: str) -> list[tuple[re.Pattern, bool]]:
        lines = []
        for name in rule_files:
            at = os.path.join(root, base, name)
            if os.path.isfile(at) and not os.path.islink(at):
                with open(at, encoding="utf-8-sig", errors="replace") as f:
                    lines += f.read().splitlines()
        made = (classify.ignore_rule(x, base) for x in lines + list(() if base else extra) if len(x) <= 4096)
        return [(re.compile(regex), negated) for regex, negated in filter(None, made)]

    def ignored(rules, path: str) -> bool:
        return next((not negated for regex, negated in reversed(rules) if regex.fullmatch(path)), False)

    pending = [("", [])]
    while pending:
        base, above = pending.pop()
        try:
            rules = [*above, *rules_of(base)]
            with os.scandir(os.path.join(root, base)) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError:
            yield Entry(base, True, reason="unreadable")
            continue
        below = []
        for e in entries:
            path = f"{base}/{e.name}" if base else e.name
            folder = e.is_dir(follow_symlinks=False)
            if e.is_symlink():
                yield Entry(path, e.is_dir(), reason="filesystem-link")
            elif folder and (reason := excluded(path)):
                yield Entry(path, True, reason=reason)
            elif ignored(rules, path + "/" * folder):
                yield Entry(path, folder, reason="ignore-rule")
            elif folder:
                below.append((path, rules))
            else:
                try:
                    stat = e.stat(follow_symlinks=False)
                except OSError:
                    yield Entry(path, False, reason="unreadable")
                    continue
                regular = e.is_file(follow_symlinks=False)
                yield Entry(path, False, stat.st_size, stat.st_mtime_ns // 1000, None if regular else "special-file")
        pending.extend(reversed(below))


class Part(InputPartition):
    def __init__(self, entries: list[Entry]):
        super().__init__(len(entries))
        self.entries = entries


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        self.content = options.get("content", "true").lower() == "true"
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.rule_files = tuple(x for x in options.get("rule_files", ".gitignore").split(",") if x)
        self.extra = tuple(options.get("rules", "").splitlines())

    def partitions(self) -> list[InputPartition]:
        parts, some, held = [], [], 0
        for e in walk(self.root, self.rule_files, self.extra):
            if some and (held + (e.length or 0) > self.part_bytes or len(some) >= PART_FILES):
                parts.append(Part(some))
                some, held = [], 0
            some.append(e)
            held += e.length or 0
        return [*parts, Part(some)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("is_directory", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("reason", pa.string())])
        rows, held = [], 0
        for e in partition.entries:
            content, reason = None, e.reason
            if self.content and reason is None:
                try:
                    with open(os.path.join(self.root, e.path), "rb") as f:
                        content = f.read()
                except OSError:
                    reason = "unreadable"
            at = None if e.modified is None else datetime.fromtimestamp(e.modified // 1_000_000, timezone.utc).replace(microsecond=e.modified % 1_000_000)
            rows.append((e.path, e.is_directory, e.length, at, content, reason))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``; options: content, part_bytes, rule_files, rules."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def pruned_tree(spark: SparkSession, root: str, content: bool = True, rules: list[str] = (), **options) -> DataFrame:
    """The rows of a tree: kept files, and what was left out with the reason."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("content", str(content).lower()).option("rules", "\n".join(rules))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(root)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Listed files with their contents, read where the rows are; a file that went away has none."""
    local = root.removeprefix("file://")

    @F.arrow_udf("binary")
    def read(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in paths:
            out = []
            for p in some.to_pylist():
                try:
                    with open(os.path.join(local, p), "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pa.array(out, pa.large_binary() if sum(len(x or b"") for x in out) > 2**31 - 1 else pa.binary())

    return files.withColumn("content", read("path"))


def changed_files(spark: SparkSession, root: str, cache: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(files to scan anew with contents, rows of ``cache`` that still hold): told by path, length and time, before any file is opened."""
    listed = pruned_tree(spark, root, content=False, **options).where("reason is null").select("path", "length", "modified")
    key = ["path", "length", "modified"]
    return with_content(listed.join(cache.select(key), key, "left_anti"), root), cache.join(listed, key, "left_semi")
