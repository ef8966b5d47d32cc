"""Operators on small fixtures whose results are worked out by hand."""

from decimal import Decimal

from pyspark.sql import functions as F

from sparkgauge import streaming
from sparkgauge.functions import rounding
from sparkgauge.operators import analyzers, capabilities, change, classify, facts, graph, portfolio, pricing, reports, stats
from sparkgauge.sources import commits, coverage, documents, files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_rounding_half_away(spark):
    x = F.lit(Decimal("1.125"))
    assert one(spark, rounding.quarter(x)) == Decimal("1.25")
    assert one(spark, rounding.quarter(F.lit(Decimal("-1.125")))) == Decimal("-1.25")
    assert one(spark, rounding.ratio(F.lit(1), F.lit(0), 2)) is None


def test_tiers_and_split(spark):
    assert float(one(spark, pricing.tiered(F.lit(12).cast("decimal(18,4)"), ((10, "0.5"), (None, "0.1"))))) == 5.2
    got = pricing.split_items(spark.createDataFrame([("a", Decimal("13.25"))], "k string, expected decimal(18,2)")).orderBy("part").collect()
    assert [float(r.part_hours) for r in got] == [4.5, 4.5, 4.25]


def test_recoverable_points(spark):
    """Known points: one routine scope of setup costs an hour after the routine factor's rounding."""
    assert float(one(spark, pricing.expected_hours("1.2", rounding.dec(0), F.lit("routine")))) == 1.0
    assert float(one(spark, pricing.hourly_rate(rounding.dec("82.68")))) == 160.0


def test_roles(spark):
    want = {
        "vendor/a.js": "vendored", "a.min.js": "minified", "src/generated/x.cs": "generated", "coverage/lcov.info": "coverage", "yarn.lock": "dependency-lock",
        "tests/a.py": "test", "docs/a.md": "documentation", ".github/workflows/ci.yml": "ci-configuration", "Dockerfile": "container-configuration",
        "infra/main.tf": "infrastructure", "logo.png": "binary", "package.json": "package-manifest", "a.csproj": "project", "a.sln": "solution", "Makefile": "build-configuration",
        "src/a.cs": "source", "app.config": "configuration", "noext": "other",
    }
    df = spark.createDataFrame([(k,) for k in want], "path string")
    assert {r.path: r.role for r in df.select("path", classify.role(F.col("path")).alias("role")).collect()} == want


def test_ignore_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a.log", "keep/a.log", "keep/important.log", "build/x", "src/build2", "a/b/c.tmp")], "path string")
    got = {r.path: r.ignored for r in classify.ignored(df, ["*.log", "!important.log", "build/", "a/**/*.tmp", ""]).collect()}
    assert got == {"a.log": True, "keep/a.log": True, "keep/important.log": False, "build/x": True, "src/build2": False, "a/b/c.tmp": True}


def test_scan_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"def f():\n    return 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "node_modules/x.js").write_bytes(b"x")
    got = {r.path: r for r in files.scan(files.tree(spark, str(tmp_path))).collect()}
    assert set(got) == {"src/a.py", "src/b.bin"}
    assert got["src/a.py"].lines == 2 and got["src/a.py"].language == "python" and got["src/b.bin"].is_binary
    again = files.cached_scan(files.tree(spark, str(tmp_path)), files.scan(files.tree(spark, str(tmp_path))))
    assert again.count() == 2


def test_inspection(spark):
    df = spark.createDataFrame([(b"",), (b"a\nb",), (b"a\n",), (b"\xff\xfeh\x00i\x00",)], "content binary")
    got = facts.inspected(df).collect()
    assert [r.lines for r in got][:3] == [0, 2, 1] and not got[3].is_binary
    assert df.select(facts.decoded(F.col("content")).alias("t")).collect()[3].t == "hi"


def test_scopes_and_measures(spark):
    f = spark.createDataFrame([("src/a/x.cs",), ("src/y.cs",), ("z",)], "path string")
    s = spark.createDataFrame([("", "root"), ("src", "s"), ("src/a", "sa")], "directory string, scope string")
    assert {r.path: r.scope for r in facts.owning_scope(f, s).collect()} == {"src/a/x.cs": "sa", "src/y.cs": "s", "z": "root"}
    m = spark.createDataFrame([("1", "s", [("files", Decimal(2)), ("files", Decimal(3))], ["b", "a", "a", "role:x"])], "id string, scope string, measurements array<struct<name:string,value:decimal(38,10)>>, tags array<string>")
    r = m.select(facts.measurement(F.col("measurements"), "files").alias("n"), facts.measurement(F.col("measurements"), "none").alias("z"), facts.tag_value(F.col("tags"), "role:").alias("role"), facts.normalized_tags(F.col("tags")).alias("t")).first()
    assert (r.n, r.z, r.role, r.t) == (5, 0, "x", ["a", "b", "role:x"])
    assert facts.grouped_by_scope(m).first().drivers == {"files": Decimal(5)}


def test_edit_regions(spark):
    base = spark.createDataFrame([("k", "a\nb\nc\nd\ne"), ("same", "a\nb"), ("empty", "")], "k string, t string")
    head = spark.createDataFrame([("k", "a\nX\nc\nd\nY\nZ"), ("same", "a\r\n b"), ("empty", "")], "k string, t string")
    assert {r.k: r.regions for r in change.edit_regions(base, head, "k", "t").collect()} == {"k": 2, "same": 1, "empty": 1}


def test_marginal_and_ranges(spark):
    hours = [float(one(spark, change.marginal_hours(F.lit(n), 1, "0.5", "0.1", 6))) for n in (1, 2, 8, 10, 1000)]
    assert hours == [1, 2, 5, 5.2, 6]
    low, high = change.range_from_expected(rounding.dec(4), 1)
    assert (float(one(spark, low)), float(one(spark, high))) == (2.5, 6.25)


def test_largest_remainder_sums(spark):
    df = spark.createDataFrame([("g", i, 1, 100) for i in range(7)], "g string, id int, w int, total long")
    got = portfolio.largest_remainder(df, ["g"], "w", "total", "id").orderBy("id").collect()
    assert [r.cents for r in got] == [15, 15, 14, 14, 14, 14, 14]


def test_bucket_join_both_ways(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' as ts union all select timestamp_ntz'2024-01-03 00:00:00'")
    buckets = spark.sql("select 'a' as b, timestamp_ntz'2024-01-01 00:00:00' as since, timestamp_ntz'2024-01-03 00:00:00' as until union all select 'b', timestamp_ntz'2024-01-03 00:00:00', timestamp_ntz'2024-01-04 00:00:00'")
    for most in (10, 1):
        assert sorted(r.b for r in portfolio.bucket_join(rows, buckets, "ts", most).collect()) == ["a", "b"]
    assert portfolio.gap_check(buckets).count() == 0


def test_reverts(spark):
    df = spark.createDataFrame([("p", 1, "a", "b"), ("p", 2, "b", "a"), ("q", 1, "a", "b"), ("q", 2, "c", "d")], "path string, n int, base string, head string")
    got = {r.path: (r.continuous, r.reverted) for r in portfolio.exact_reverts(df, ["path"], ["n"], "base", "head").collect()}
    assert got == {"p": (True, True), "q": (False, False)}
    assert portfolio.opposing_effects(df, "n", "path", "base", "head").collect()[0].undoing == 2


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    got = {r.node: r.cyclic_size for r in graph.cyclic_sizes(e).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 1, 7: 0}
    assert {r.component for r in graph.connected_components(e).collect()} == {1, 6}


def test_chains_are_peeled_without_broadcasts(spark):
    from sparkgauge.operators import graph

    # a chain downwards, which once took a round a node, a cycle with a tail on either side, and a self loop
    e = spark.createDataFrame([(i + 1, i) for i in range(20, 32)] + [(1, 2), (2, 3), (3, 1), (9, 1), (3, 8), (5, 5)], "src long, dst long")
    spark.sparkContext.setJobGroup("peeled", "")
    got = {r.node: (r.component, r.cyclic_size) for r in graph.cyclic_sizes(e).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: (3, 3) for i in (1, 2, 3)} | {5: (5, 1)} | {i: (i, 0) for i in (8, 9, *range(20, 33))}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("peeled"))
    assert jobs < 200, jobs


def test_statistics(spark):
    df = spark.createDataFrame([("g", i) for i in (1, 2, 3, 4)], "g string, v int")
    assert stats.nearest_rank(df, ["g"], "v").first()["quantile"] == 4
    loo = {r.h: r["quantile"] for r in stats.leave_one_out_quantile(spark.createDataFrame([("a", 1), ("a", 9), ("b", 5), ("c", 7)], "h string, v int"), "h", "v").collect()}
    assert loo == {"a": 7, "b": 9, "c": 9}
    assert one(spark, stats.jaccard_distance(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0.0


def test_analyzers(spark):
    py = 'import os\nclass A:\n    def m(self):\n        if x and y:  # if\n            return "if"\ndef test_f():\n    assert 1\nif __name__ == "__main__":\n    pass\n'
    m = one(spark, analyzers.code_measures(F.lit(py), "python"))
    assert (m["types"], m["methods"], m["functions"], m["assertions"], m["test-cases"], m["entry-points"], m["branch-points"]) == (1, 1, 1, 1, 1, 1, 3)
    assert one(spark, analyzers.sql_dialect(F.lit("create table t (a jsonb); select 1 where a ilike 'x'"))) == "postgresql"
    assert one(spark, analyzers.sql_role(F.lit("db/migrations/1.sql"), F.lit("create table t(a int)"))) == "migration"
    same = [one(spark, analyzers.formatting_signature(F.lit(t))) for t in ("int a=1; // x", "int  a =\n1; // x", "int a=2; // x")]
    assert same[0] == same[1] != same[2]
    tf = spark.createDataFrame([("env/prod/main.tf", 'module "a" {\n  source = "../../modules/a"\n}')], "path string, text string")
    assert tuple(analyzers.module_edges(tf).first()) == ("env/prod", "modules/a")
    assert one(spark, analyzers.custom_regions(F.lit("a<custom-code>x</custom-code>b"))) == ["x"]


def test_coverage_sources(spark):
    text = "SF:a.c\nDA:1,1\nDA:2,0\nend_of_record\nSF:a.c\nLF:10\nLH:5\nend_of_record\nSF:b.c\nBRDA:1,0,0,-\nBRDA:1,0,1,3\nend_of_record\n"
    got = {r.source: r for r in coverage.lcov(spark.createDataFrame([(text,)], "text string")).collect()}
    assert (got["a.c"].lines_found, got["a.c"].lines_hit) == (12, 6) and (got["b.c"].branches_found, got["b.c"].branches_hit) == (2, 1)
    xml = '<coverage line-rate="0.5"><packages><package><classes><class filename="a.c"><lines><line number="1" hits="0"/><line number="2" hits="3"/></lines></class></classes></package></packages></coverage>'
    r = coverage.cobertura(spark.createDataFrame([(xml,)], "text string")).first()
    assert (r.source, r.lines_found, r.lines_hit) == ("a.c", 2, 1)


def test_commit_log(spark):
    log = "\x1e".join("\x00".join(x) for x in [("c1", "", "Ada", "ada@x", "1704067200", "1704067200", "fix\n\nCo-authored-by: Bo <bo@x>"), ("c2", "c1 c0", "Bo", "bo@x", "1704153600", "1704153600", "merge")])
    c = commits.parsed(spark.createDataFrame([(log,)], "text string"))
    people = spark.createDataFrame([("B", "bo@x"), ("A", "Ada <ada@x>")], "contributor string, alias string")
    pick = lambda **k: sorted(tuple(r) for r in commits.selected(c, people, "2024-01-01", "2024-02-01", **k).collect())
    assert pick() == [("c1", "A"), ("c1", "B")]
    assert pick(coauthors=False, merges="first-parent") == [("c1", "A"), ("c2", "B")]


def test_evidence_documents(spark, tmp_path):
    import json

    (tmp_path / "e.json").write_text(json.dumps({"schemaVersion": "1", "repository": {"name": "r", "scope": ".", "ecosystems": ["x"], "sourceDigest": "d"}, "facts": [{"id": "f1", "kind": "file", "measurements": [{"name": "files", "value": 3}], "tags": []}], "diagnostics": []}))
    bundle = documents.evidence(spark, str(tmp_path / "e.json"))
    assert bundle["facts"].first().measurements[0].value == 3 and documents.duplicate_ids(bundle["facts"]).count() == 0


def test_reports(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "k string, h double")
    assert "| a | 2.0 |" in reports.markdown(df, "T")
    assert reports.canonical_json({"a": 1, "b": None}, False) == '{"a": 1}\n'
    assert one(spark, reports.source_slice(F.lit("a\nb\nc"), 2, 3)) == "b\nc"


def test_streaming_buckets(spark, tmp_path):
    from .conftest import SMALL

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = streaming.bucketed(streaming.read_events(spark, str(tmp_path / "in"), events.schema))
    streaming.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = streaming.bucketed(events)
    assert got.count() > 0 and got.exceptAll(want).count() == 0


FACT = "repo string, scope string, id string, kind string, source_kind string, measurements array<struct<name:string,value:decimal(38,10)>>, tags array<string>"


def test_estimate_of_a_small_repository(spark):
    """Known points: one production scope is understood for 1.25 hours, set up for 1 and reviewed for 1.25."""
    from sparkgauge import api

    facts = spark.createDataFrame(
        [
            ("r", "src", "dotnet:p", "dotnet-project", "observed", [("packages", Decimal(0))], ["scope:runnable"]),
            ("bare", "x", "dotnet:q", "dotnet-project", "inferred", None, None),
            ("r", "src", "dotnet:a", "api-surface", "observed", [("endpoints", Decimal(50)), ("unheard-of", Decimal(7))], []),
        ],
        FACT,
    )
    got = api.estimate(facts, rate="100")
    rows = {(r.repo, r.rule): r for r in got["items"].where("part = 1").collect()}
    assert float(rows["bare", "specification-comprehension"].expected) == 1.25
    assert float(rows["bare", "project-setup"].expected) == 1.0
    assert float(rows["bare", "self-review"].expected) == 1.25
    assert rows["r", "api-surface"].complexity == "high"
    # (0.5 + 10 * 0.4 + 40 * 0.2) * 1.25 = 15.625 -> 15.75 hours in three parts
    assert rows["r", "api-surface"].parts == 3
    assert all(r.low <= r.expected <= r.high for r in rows.values())
    gap = {(r.repo, r.rule) for r in got["gap"].collect()}
    assert gap == {("r", "gap-automated-tests"), ("r", "gap-system-tests"), ("r", "gap-documentation"), ("r", "gap-ci"), ("bare", "gap-automated-tests"), ("bare", "gap-documentation")}
    total = {(r.repo, r.category): r for r in got["totals"].collect()}
    items = got["items"].groupBy("repo").agg(F.sum("expected").alias("e")).collect()
    assert {r.repo: r.e for r in items} == {k[0]: v.expected for k, v in total.items() if k[1] is None}
    assert float(total["bare", None].cost) == 100 * float(total["bare", None].expected)
    assert capabilities.drivers(facts.limit(0)).count() == 0


def test_estimate_grows_with_evidence(spark):
    """More endpoints never cost less, and a copy of the facts under another name costs the same."""
    fact = lambda repo, n: (repo, "s", "dotnet:a", "api-surface", "observed", [("endpoints", Decimal(n))], [])
    facts = spark.createDataFrame([fact("a", 3), fact("b", 4), fact("c", 4)], FACT)
    got = {r.repo: r.expected for r in capabilities.capabilities(capabilities.drivers(facts)).where("rule = 'api-surface'").collect()}
    assert got["a"] <= got["b"] == got["c"]


def test_estimate_sums_scopes_in_one_place(spark):
    """Facts are shuffled by scope once, no step sorts its groups, kinds count once, and no rule is both of a scope and of a repository."""
    rules = lambda table: {r for rules in table.values() for r in rules}
    assert not rules(capabilities.SCOPED) & rules(capabilities.REPOSITORY)
    fact = lambda scope, kind, n: ("r", scope, "dotnet:a", kind, "observed", [("endpoints", Decimal(n)), ("runtime-surfaces", Decimal(3))], [])
    facts = spark.createDataFrame([fact("s", "api-surface", 3), fact("s", "api-surface", 4), fact("s", "data-access", 1), fact("t", "api-surface", 0)], FACT)
    got = {(r.scope, r.driver): float(r.value) for r in capabilities.drivers(facts).collect()}
    assert got == {("s", "endpoints"): 7, ("t", "boundary-families"): 1, ("t", "runtime-surfaces"): 4, ("s", "boundary-families"): 2, ("s", "specialized-boundaries"): 1, ("s", "runtime-surfaces"): 16, (".", "semantic-families"): 2, (".", "specialized-boundaries"): 2}
    scoped, _ = capabilities.represented(facts)
    plan = scoped.drop("drivers")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(repo") == 1 and "SortAggregate" not in plan


def test_no_window_over_a_whole_table(spark):
    """Ranks, gaps and digests over ranges and sorted batches: right results, and no task that takes all rows."""
    import contextlib
    import hashlib
    import io
    import math
    import random

    random.seed(4)
    data = [(random.randrange(7), random.randrange(5), float(random.randrange(400))) for _ in range(3000)]
    rows = spark.createDataFrame(data, "held int, repo int, v double")

    def quantile(values):
        return sorted(values)[math.ceil(round(0.8 * len(values), 6)) - 1]

    got = {r.held: (r.quantile, r.own_n) for r in stats.leave_one_out_quantile(rows, "held", "v").collect()}
    assert got == {h: (quantile([v for g, _, v in data if g != h]), sum(g == h for g, _, _ in data)) for h in range(7)}
    spread = stats.conditioned_intervals(rows, "held", "repo", "v", 10_000)
    assert {r.quantile for r in spread.collect()} == {quantile([v for *_, v in data])}

    times = [(i, 10 * i, 10 * i + (10 if i % 9 else 7)) for i in range(500)]
    at = lambda c: F.timestamp_seconds(c).alias(c)
    buckets = spark.createDataFrame(times, "k int, since long, until long").select("k", at("since"), at("until"))
    gaps = portfolio.gap_check(buckets)
    assert sorted(r.k for r in gaps.collect()) == [i for i in range(1, 500) if i % 9 == 1]

    files = spark.createDataFrame([(g, i, f"d{i % 3}") for i in range(30_000) for g in ((None, "b")[i % 2],)], "g string, p int, d string")
    digests = facts.inventory_digest(files, ["g"], "p", "d")
    want = {g: hashlib.sha256("\n".join(sorted(f"{i}:d{i % 3}" for i in range(k, 30_000, 2))).encode()).hexdigest() for k, g in enumerate((None, "b"))}
    assert {r.g: r.inventory_digest for r in digests.collect()} == want
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        digests.explain()
    assert "collect_list" not in plan.getvalue()
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        spread.explain("formatted")
        gaps.explain("formatted")
    assert "_all" not in plan.getvalue() and "[since#" not in plan.getvalue().replace(" ", "").partition("windowspecdefinition(since")[2]


def test_once_tells_rows_apart_without_a_hash_map(spark):
    from sparkgauge.operators import evaluation

    data = [(1, "a", 7), (1, "a", 7), (None, "a", 7), (None, "a", 7), (1, None, 7), (1, "a", 8), (2, "b", None), (2, "b", None)]
    df = spark.createDataFrame(data, "record int, item string, target int")
    once = evaluation.once(df, ["record", "item"])
    assert sorted(map(str, once.collect())) == sorted(map(str, df.distinct().collect()))
    items = df.select("record", "item", F.lit("c").alias("category"), *[F.lit(1).cast("decimal(18,2)").alias(p) for p in evaluation.POINTS])
    targets = df.select("record", "target", F.lit("c").alias("category"), *[F.lit(1).cast("decimal(18,2)").alias(p) for p in evaluation.POINTS])
    plan = evaluation.resolved_targets(targets, df, items)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[record" not in "".join(line for line in plan.split("\n") if "Aggregate" in line and "item" in line)
