"""Evidence facts: tags, measurements, duplicates, scopes, grouping, inventory digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.isNotNull())))


def tag_value(tags: Column, prefix: str) -> Column:
    """Value of the first tag with the prefix, or null."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(prefix)), 0), len(prefix) + 1, 1 << 30)


def measurement(measurements: Column, name: str) -> Column:
    """Sum of the measurements of a name; 0 if there is none."""
    own = F.filter(measurements, lambda m: m["name"] == name)
    return F.aggregate(own, F.lit(0).cast("decimal(38,10)"), lambda acc, m: (acc + m["value"]).cast("decimal(38,10)"))


def inspected(files: DataFrame, content: str = "content") -> DataFrame:
    """bytes, lines (line feeds, plus one for a last line without), sha256 and is_binary of binary contents."""
    body = F.col(content)
    as_text = F.decode(body, "ISO-8859-1")  # one character a byte
    feeds = F.regexp_count(as_text, F.lit("\n"))
    odd = F.regexp_count(as_text, F.lit(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"))
    size = F.octet_length(body)
    bom = as_text.rlike(r"^(\xEF\xBB\xBF|\xFF\xFE|\xFE\xFF|\x00\x00\xFE\xFF)")
    return files.withColumns(
        {
            "bytes": size.cast("long"),
            "lines": (feeds + F.when((size > 0) & ~as_text.endswith("\n"), 1).otherwise(0)).cast("long"),
            "sha256": F.sha2(body, 256),
            "is_binary": ~bom & (as_text.contains("\u0000") | (odd * 20 > size)),
        }
    )


def decoded(content: Column) -> Column:
    """Text of bytes by their byte-order mark; UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 4))
    tail = lambda n: F.substring(content, n + 1, 1 << 30)
    return (
        F.when(head.isin("FFFE0000", "0000FEFF"), F.decode(content, "UTF-32"))  # reads the mark itself
        .when(head.startswith("FFFE"), F.decode(tail(2), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(tail(2), "UTF-16BE"))
        .when(head.startswith("EFBBBF"), F.decode(tail(3), "UTF-8"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def text_lines(text: Column) -> Column:
    """Line feeds, plus one for a last line without."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def duplicate_key(tags: Column) -> Column:
    """Family of roles, language and digest of a file, which exact duplicates share; null for what is not maintained or has no digest."""
    role = F.coalesce(tag_value(tags, "role:"), F.lit("unknown"))
    family = F.when((role == "test") | F.array_contains(tags, "classification:test"), "test").otherwise(role)
    out = F.arrays_overlap(tags, F.array(*map(F.lit, ("classification:generated", "classification:minified", "classification:vendored", "content:binary"))))
    digest = tag_value(tags, "sha256:")
    return F.when(digest.isNotNull() & ~out, F.concat_ws("|", family, F.coalesce(tag_value(tags, "language:"), F.lit("none")), digest))


def exact_duplicates(files: DataFrame, key: list[str], path: str) -> DataFrame:
    """``canonical``: the smallest path of those with the same key; ``copies``: how many there are.

    Grouped first (combined before the shuffle), then joined back: a key that a third of all
    rows share is a skewed join that can be split, not one window.
    """
    groups = files.groupBy(*key).agg(F.min(path).alias("canonical"), F.count("*").alias("copies"))
    return files.join(groups, key)


def deduplicated(facts: DataFrame, key: list[str], order: list[str], tags: str) -> DataFrame:
    """The first fact of each key with the union of all its tags."""
    rest = [c for c in facts.columns if c not in (*key, tags)]
    return facts.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), F.array_sort(F.collect_set(tags)).alias(tags)
    ).select(*key, "_first.*", tags)


def ancestors(path: Column) -> Column:
    """All directories above a path, shortest first; the empty one is the root."""
    at = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda n: F.array_join(F.slice(at, 1, n), "/"))


def owning_scope(files: DataFrame, scopes: DataFrame, path: str = "path", directory: str = "directory", scope: str = "scope") -> DataFrame:
    """Longest-prefix join: each path with the scope of the deepest directory above it (ties by scope)."""
    up = files.select(path, F.explode(ancestors(F.col(path))).alias(directory))
    return up.join(scopes, directory).groupBy(path).agg(F.max_by(F.col(scope), F.struct(F.length(directory), F.col(scope))).alias(scope))


def grouped_by_scope(facts: DataFrame, scope: str = "scope", measurements: str = "measurements", tags: str = "tags", fact_id: str = "id") -> DataFrame:
    """Facts of a scope as one row: summed measurements as a map, united tags, evidence ids."""
    sums = facts.select(scope, F.explode(measurements).alias("m")).groupBy(scope, F.col("m.name").alias("name")).agg(F.sum("m.value").alias("value"))
    maps = sums.groupBy(scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("drivers"))
    rest = facts.groupBy(scope).agg(F.count("*").alias("facts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(tags)))).alias("tags"), F.array_sort(F.collect_set(fact_id)).alias("evidence_ids"))
    return rest.join(maps, scope, "left")


def unsupported(facts: DataFrame, kinds, kind: str = "kind") -> DataFrame:
    """Diagnostics for facts of unknown kinds."""
    return facts.where(~F.col(kind).isin(*kinds)).select(F.lit("unknown-fact-kind").alias("code"), F.lit("warning").alias("severity"), kind)


def inventory_digest(files: DataFrame, group: list[str], path: str, digest: str) -> DataFrame:
    """SHA-256 over a group's ordered (path, digest) entries.

    Entries are sorted by Spark, which spills, and fed to a running digest, so a group needs
    no memory for its entries; one group's digest is one task, since SHA-256 has no parallel form.
    """
    import hashlib

    entry = F.concat_ws(":", F.col(path).cast("string"), F.col(digest))
    rows = files.select(*group, entry.alias("_entry")).repartition(*group).sortWithinPartitions(*group, "_entry")

    def run(batches):
        import pyarrow as pa

        key, sha, types = None, None, None

        def out():
            columns = [pa.array([v], t) for v, t in zip(key, types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([sha.hexdigest()])], names=[*group, "inventory_digest"])

        for batch in batches:
            types = types or [batch.schema.field(g).type for g in group]
            *keys, entries = (c.to_pylist() for c in batch.columns)
            for k, e in zip(zip(*keys), entries):
                if sha is None or k != key:
                    if sha is not None:
                        yield out()
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(e.encode())
        if sha is not None:
            yield out()

    fields = ", ".join(f"`{g}` {files.schema[g].dataType.simpleString()}" for g in group)
    return rows.mapInArrow(run, f"{fields}, inventory_digest string")


def source_complexity(methods: Column, branches: Column, asyncs: Column) -> Column:
    """Routine, moderate or high, by branches and asynchronous units a method."""
    m = F.nullif(methods, F.lit(0)).cast("double")
    return (
        F.when(F.coalesce(methods, F.lit(0)) == 0, "routine")
        .when((branches / m >= 0.75) | (asyncs / m >= 0.4), "high")
        .when((branches / m < 0.12) & (asyncs / m < 0.08), "routine")
        .otherwise("moderate")
    )


def scope_precedence(candidates: DataFrame, key: list[str], rank: str, tie: str) -> DataFrame:
    """Scopes by precedence: of several candidates of one key the one of the lowest rank stays, then the smallest ``tie``."""
    rest = [c for c in candidates.columns if c not in key]
    return candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(rank, tie)).alias("_s")).select(*key, "_s.*")


def derived_scopes(facts: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, ecosystem, scope, directory, role) from scope-bearing facts, one for each ecosystem and scope.

    Projects come before packages, these before repository-wide front ends, ecosystem packages and
    stand-alone SQL; a repository without any gets a fallback at its root.
    """
    kind, tags, fact = F.col("kind"), F.coalesce("tags", F.array().cast("array<string>")), F.col("id")
    tag = lambda name: tag_value(tags, name + ":")
    has = lambda t: F.array_contains(tags, t)
    eco = F.coalesce(tag("ecosystem"), F.lit("common"))
    folder = F.regexp_replace(F.regexp_replace("scope", r"/?[^/]*\.[a-z]+proj$", ""), "^$", ".")
    of = lambda rank, ecosystem, role, directory: F.struct(F.lit(rank).alias("rank"), ecosystem.alias("ecosystem"), role.alias("role"), directory.alias("directory"))
    found = (
        F.when((kind == "dotnet-project") & fact.startswith("dotnet:project:"), of(0, F.lit("dotnet"), F.coalesce(tag("project-role"), F.lit("project")), folder))
        .when((kind == "javascript-package") & fact.startswith("javascript:package:"), of(1, F.lit("javascript"), F.coalesce(tag("package-role"), F.lit("package")), F.col("scope")))
        .when((kind == "javascript-package") & (fact == "javascript:repository") & has("frontend-assets:present"), of(2, F.lit("javascript"), F.coalesce(tag("package-role"), F.lit("web-ui")), F.lit(".")))
        .when((kind == "ecosystem-package") & has("scope:analyzed"), of(3, eco, F.coalesce(tag("package-role"), F.lit("package")), F.col("scope")))
        .when((kind == "sql-repository") & has("scope:standalone"), of(4, F.lit("sql"), F.lit("data"), F.lit(".")))
    )
    rows = facts.select(repo, "scope", "id", found.alias("_f")).where("_f is not null").select(repo, "scope", "id", "_f.*")
    named = scope_precedence(rows, [repo, "ecosystem", "scope"], "rank", "id")
    bare = facts.select(repo).distinct().join(named.select(repo).distinct(), repo, "left_anti")
    root = bare.select(repo, F.lit("common").alias("ecosystem"), F.lit(".").alias("scope"), F.lit(9).alias("rank"), F.lit("fallback").alias("id"), F.lit("fallback").alias("role"), F.lit(".").alias("directory"))
    return named.unionByName(root).drop("rank")


def exact_or_prefix_scope(facts: DataFrame, scopes: DataFrame, key: list[str], path: str = "path", scope: str = "scope", directory: str = "directory") -> DataFrame:
    """``owner``: the scope a fact names itself if there is one of its key, else that of the deepest directory above its path.

    key: columns that scope and fact must share, the ecosystem say.  Facts keep their rows; none fits: null.
    """
    named = scopes.select(*key, F.col(scope), F.col(scope).alias("_exact")).distinct()
    rows = facts.withColumn("_row", F.monotonically_increasing_id()).join(named, [*key, scope], "left")
    up = rows.where("_exact is null").select("_row", *key, F.explode(F.transform(ancestors(F.col(path)), lambda d: F.when(d == "", ".").otherwise(d))).alias("_dir"))
    held = scopes.select(*key, F.col(directory).alias("_dir"), F.col(scope).alias("_scope"))
    deep = up.join(held, [*key, "_dir"]).groupBy(*key, "_row").agg(F.max_by("_scope", F.struct(F.when(F.col("_dir") == ".", -1).otherwise(F.length("_dir")), F.col("_scope"))).alias("_deep"))
    return rows.join(deep, [*key, "_row"], "left").withColumn("owner", F.coalesce("_exact", "_deep")).drop("_row", "_exact", "_deep")


def structure_factors(files: DataFrame, scopes: DataFrame, key: list[str]) -> DataFrame:
    """By scope: analyzed, production and canonical production files, and the factor that production-only and whole structures take.

    files: key, path, is_test, duplicate_key (null for none); scopes: key, is_test.  A duplicate is
    canonical once, at its smallest path.  A scope without analyzed files has factor 0 for tests, else 1.
    """
    first = files.where("duplicate_key is not null").groupBy("duplicate_key").agg(F.min("path").alias("_first"))
    rows = files.join(first, "duplicate_key", "left").withColumn("_canonical", F.col("_first").isNull() | (F.col("_first") == F.col("path")))
    made = ~F.col("is_test")
    sums = rows.groupBy(*key).agg(F.count("*").alias("analyzed"), F.count_if(made).alias("production"), F.count_if(made & F.col("_canonical")).alias("canonical"))
    out = scopes.select(*key, F.col("is_test").alias("_test")).join(sums, key, "left").na.fill(0, ["analyzed", "production", "canonical"])
    over = lambda n: F.when(F.col("analyzed") == 0, F.when(F.col("_test"), 0.0).otherwise(1.0)).otherwise(F.coalesce(F.col("canonical") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)))
    return out.select(*key, "analyzed", "production", "canonical", F.round(over("analyzed"), 6).alias("factor"), F.round(over("production"), 6).alias("production_factor"), (F.col("canonical") < F.col("production")).alias("has_duplicates"))
