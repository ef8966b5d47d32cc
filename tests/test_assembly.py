"""Assembly, scopes, evaluation, snapshots and renderers: known values and brute force on small rows."""

import itertools
import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkgauge import api, plans
from sparkgauge.operators import analyzers, assembly, capabilities, change, classify, evaluation, facts, portfolio, reports, series, stats
from sparkgauge.sources import coverage, documents, files, snapshots

from .conftest import SMALL


def test_formatting_signatures_of_whole_texts(spark):
    """Against tokens found by Python on every document: digits, accents and quotes all count."""
    import hashlib

    token = re.compile(analyzers.C_LIKE.replace(r"\z", r"\Z") + r"|\w+|[^\s\w]", re.ASCII)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.s for r in docs.select("doc_id", analyzers.formatting_signature(F.col("text")).alias("s")).collect()}
    for r in docs.collect():
        want = hashlib.sha256("\u0001".join(m[0] for m in token.finditer(r.text)).encode()).hexdigest()
        assert got[r.doc_id] == want


def brute_regions(a: str, b: str) -> set[int]:
    """Gaps between the lines of each longest increasing chain of lines unique in both, by trying all chains."""
    lines = [[x.strip(" \t\v\f") for x in re.sub("\r\n?", "\n", t).split("\n")] for t in (a, b)]
    lines = [[x for x in t if x] for t in lines]
    at = [(i, lines[1].index(x)) for i, x in enumerate(lines[0]) if lines[0].count(x) == lines[1].count(x) == 1]
    chains = [c for n in range(len(at) + 1) for c in itertools.combinations(at, n) if all(x[1] < y[1] for x, y in zip(c, c[1:]))]
    longest = max(map(len, chains))
    ends = lambda c: [(-1, -1), *c, (len(lines[0]), len(lines[1]))]
    gaps = lambda c: sum(b0 - a0 > 1 or b1 - a1 > 1 for (a0, a1), (b0, b1) in zip(ends(c), ends(c)[1:]))
    return {min(1000, max(1, gaps(c))) for c in chains if len(c) == longest}


def test_edit_regions_are_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(40):
        a = [f"line {rng.randrange(12)}" for _ in range(rng.randrange(0, 9))]
        b = [x for x in a if rng.random() < 0.8] + [f"new {rng.randrange(5)}" for _ in range(rng.randrange(3))]
        rng.shuffle(b) if k % 5 == 0 else None
        rows.append((k, "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: r.regions for r in change.edit_regions(df.select("k", F.col("a").alias("t")), df.select("k", F.col("b").alias("t")), "k", "t").collect()}
    assert set(got) == {k for k, _, _ in rows}
    for k, a, b in rows:
        assert got[k] in brute_regions(a, b)


def test_encodings(spark):
    text = "añ\n"
    rows = [("utf-8", text.encode()), ("mark", b"\xef\xbb\xbf" + text.encode()), ("16le", b"\xff\xfe" + text.encode("utf-16-le")), ("16be", b"\xfe\xff" + text.encode("utf-16-be")), ("32le", b"\xff\xfe\x00\x00" + text.encode("utf-32-le")), ("32be", b"\x00\x00\xfe\xff" + text.encode("utf-32-be"))]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k string, content binary")
    assert {r.k: r.t for r in df.select("k", facts.decoded(F.col("content")).alias("t")).collect()} == {k: text for k, _ in rows}
    assert not any(r.is_binary for r in facts.inspected(df).where("k <> 'utf-8'").collect())


def test_links_are_no_roots(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real/a.py").write_text("x = 1\n")
    (tmp_path / "link").symlink_to(tmp_path / "real")
    with pytest.raises(ValueError):
        files.tree(spark, str(tmp_path / "link"))
    snap = snapshots.directory_snapshot(spark, str(tmp_path / "real")).collect()
    assert [(r.path, r.length) for r in snap] == [("a.py", 6)]


def bundle(tmp_path, name, facts_):
    doc = {"schemaVersion": "1", "repository": {"name": "r", "scope": ".", "ecosystems": [], "sourceDigest": "d"}, "facts": facts_, "diagnostics": []}
    (tmp_path / name).write_text(json.dumps(doc))
    return str(tmp_path / name)


def test_evidence_snapshots_are_checked(spark, tmp_path):
    fact = lambda i: {"id": f"f{i}", "kind": "file", "scope": f"s{i}", "summary": "", "provenance": {"sourceKind": "observed"}, "locations": [], "measurements": [], "tags": []}
    a, b, c = bundle(tmp_path, "a.json", [fact(1), fact(2)]), bundle(tmp_path, "b.json", [fact(2), fact(1)]), bundle(tmp_path, "c.json", [fact(1)])
    digest = {p: snapshots.evidence_digest(documents.evidence(spark, p)["facts"]).first()["digest"] for p in (a, b, c)}
    assert digest[a] == digest[b] != digest[c]  # the order of facts does not matter
    base, head = snapshots.evidence_snapshot(spark, a, c, digest[a], digest[c])
    assert base.count() == 2 and head.count() == 1
    with pytest.raises(ValueError):
        snapshots.evidence_snapshot(spark, a, c, digest[a], digest[a])


def test_results_are_stored_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert snapshots.stored(spark, str(tmp_path), "sha256:x", make).count() == 3
    assert len(made) == 1


def test_manifests(spark, tmp_path):
    one = {"id": "a", "label": "A", "sinceInclusive": "2024-01-01T00:00:00Z", "untilExclusive": "2024-02-01T00:00:00Z"}
    (tmp_path / "b.json").write_text(json.dumps({"buckets": [one]}))
    assert documents.buckets(spark, str(tmp_path / "b.json")).collect()[0].bucket == "a"
    (tmp_path / "bad.json").write_text(json.dumps({"buckets": [one, one]}))
    with pytest.raises(ValueError):
        documents.buckets(spark, str(tmp_path / "bad.json"))
    (tmp_path / "c.json").write_text(json.dumps({"entries": [{"bucketId": "a", "contributorId": "x", "hours": 8}]}))
    assert documents.capacity(spark, str(tmp_path / "c.json")).first().hours == Decimal("8.00")


def test_cobertura_branches(spark):
    xml = '<coverage><packages><package><classes><class filename="a.cs"><lines><line number="1" hits="2" condition-coverage="50% (1/2)"/><line number="2" hits="0"/><line number="1" hits="0" condition-coverage="100% (2/2)"/></lines></class></classes></package></packages></coverage>'
    r = coverage.cobertura(spark.createDataFrame([(xml,)], "text string")).first()
    assert (r.lines_found, r.lines_hit, r.branches_found, r.branches_hit) == (2, 1, 2, 2)


def test_formatting_only_changes(spark):
    df = spark.createDataFrame([(1, "int f( ) {return 1;}", "int f() {\n  return 1;\n}"), (2, 's = "a b"', 's = "a  b"'), (3, "a b", "a c")], "k int, base string, head string")
    same = analyzers.formatting_signature(F.col("base")) == analyzers.formatting_signature(F.col("head"))
    assert {r.k: r.same for r in df.select("k", same.alias("same")).collect()} == {1: True, 2: False, 3: False}


def items(spark):
    rows = [("a:part-0001", "documentation", "s1", 1, 2, 3, 0.9), ("a:part-0002", "documentation", "s1", 1, 2, 3, 0.5), ("b", "unit-testing", "s2", 2, 4, 8, 0.8)]
    df = spark.createDataFrame(rows, "item_id string, category string, scope string, low int, expected int, high int, confidence double")
    return df.withColumns({p: F.col(p).cast("decimal(18,2)") for p in ("low", "expected", "high")})


def test_renderers(spark):
    for view in ("repository", "category", "scope", "work-item", "review"):
        text = api.report(items(spark), view, rate="100")
        assert "planning bounds" in text and "8.00" in text
        doc = json.loads(api.report(items(spark), view, "json"))
        assert doc["view"] == view and doc["total"]["items"] == 3 and doc["complete"]
    evidence = items(spark).withColumn("evidence_ids", F.array(F.lit("f1"), F.lit("f9")))
    known = spark.createDataFrame([("f1", "file", "s|1")], "id string, kind string, summary string")
    doc = reports.explanation(evidence, known, "b")
    text = reports.explanation_markdown(doc)
    assert doc["missing"] == ["f9"] and "s\\|1" in text and "- f9" in text
    with pytest.raises(KeyError):
        reports.explanation(evidence, known, "zzz")
    report = reports.sections_markdown("Change", {"Items": items(spark), "Adjustments": items(spark).limit(0)}, most=2)
    assert report.startswith("# Change\n") and "Further rows" in report and "None." in report
    assert json.loads(reports.sections_json("change", {"items": items(spark)}))["items"][0]["category"] == "documentation"
    with pytest.raises(ValueError):
        reports.sections_json("change", {"items": items(spark)}, most=1)
    assert reports.review_query("capability", "a", items(spark), known).count() == 2
    assert reports.review_query("evidence", "f1", items(spark), known).count() == 1


def test_verbs(spark):
    assert api.version() and "facts" in api.schema("evidence") and set(api.model(spark)) == {"rules", "tiers", "drivers"}
    one = spark.createDataFrame([("r", "t", "c", 8, 10, 12)], "record string, target string, category string, low int, expected int, high int")
    one = one.withColumns({p: F.col(p).cast("decimal(18,2)") for p in ("low", "expected", "high")})
    got = api.calibration(one, one.select("record", "target", F.lit("i").alias("item")), one.select("record", F.lit("i").alias("item"), "category", "low", "expected", "high"))
    metrics = {(r.level, r.slice): r for r in got["metrics"].collect()}
    assert set(metrics) == {("repository", "all"), ("category", "c"), ("work-item", "all")} and all(r.mae == 0 and r.coverage == 1 and r.fully_covered == 1 for r in metrics.values())
    m = got["matches"].first()
    assert (m.targets, m.matched_targets, m.items, m.matched_items, m.category_mismatches) == (1, 1, 1, 1, 0)


def test_parts_of_items(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5, 2.0), ("b", 1.0, 2.25, 5.0)], "k string, low double, expected double, high double").withColumns({p: F.col(p).cast("decimal(18,2)") for p in ("low", "expected", "high")})
    got = assembly.change_parts(df, ["k"]).orderBy("k", "part").collect()
    assert [(r.k, float(r.low), float(r.expected), float(r.high)) for r in got] == [("a", 1.0, 1.5, 2.0), ("b", 0.33, 0.75, 1.67), ("b", 0.33, 0.75, 1.67), ("b", 0.34, 0.75, 1.66)]


def test_shares_add_up(spark):
    """Whatever is dealt adds up to what was there: partitions, contributions, adjustments, series."""
    budget = spark.createDataFrame([("c", 1, 10, 20)], "k string, low int, expected int, high int")
    paths = spark.createDataFrame([("c", "documentation", 1), ("c", "unit-testing", 2), ("c", "production-implementation", 4)], "k string, category string, units int")
    got = assembly.role_partitions(budget, paths, ["k"]).agg(*[F.sum(p).alias(p) for p in ("low", "expected", "high")]).first()
    assert tuple(map(float, got)) == (1, 10, 20)
    effects = spark.createDataFrame([("c", f"p{i}") for i in range(7)], "k string, path string")
    got = series.contributions(budget.withColumns({p: F.col(p).cast("decimal(18,2)") for p in ("low", "expected", "high")}), effects, ["k"]).agg(F.sum("expected")).first()[0]
    assert got == 10


def test_opposing_and_duplicates(spark):
    steps = spark.createDataFrame([(1, "p", "a", "b"), (2, "p", "b", "a"), (3, "p", "b", "a"), (4, "p", "a", "a"), (5, "q", "b", "a")], "n int, path string, base string, head string")
    assert sorted((r.undone, r.undoing) for r in portfolio.opposing_effects(steps, "n", "path", "base", "head").collect()) == [(1, 2), (1, 3)]
    items_ = spark.createDataFrame([(1, "d", 5.0), (2, "d", 7.0), (3, None, 1.0), (4, None, 1.0)], "id int, digest string, hours double")
    kept = portfolio.duplicate_keeper(items_, "digest", [-F.col("hours"), F.col("id")])
    assert {r.id for r in kept.where("kept").collect()} == {2, 3, 4}


def test_nearest_profiles_in_blocks(spark):
    """Blocks of any size give what a comparison of all pairs gives."""
    import random

    rng = random.Random(2)
    rows = [(i, f"r{i % 3}", rng.choice("xy"), rng.randrange(9), rng.randrange(4), sorted({rng.choice("abcde") for _ in range(rng.randrange(4))})) for i in range(40)]
    df = spark.createDataFrame(rows, "key int, repo string, cat string, size int, cx int, f array<string>")

    def far(a, b):
        x, y = set(a[5]), set(b[5])
        j = 1 - len(x & y) / len(x | y) if x | y else 0.0
        return round(((a[2] != b[2]) + abs(a[3] - b[3]) / 8 + abs(a[4] - b[4]) / 3 + j) / 4, 8)

    want = {a[0]: min((far(a, b), b[0]) for b in rows if b[1] != a[1]) for a in rows}
    for block in (2_048, 7):
        got = {r.key: (r.distance, r.neighbour) for r in stats.nearest_profile(df, "key", "repo", "f", "cat", "size", "cx", block=block).collect()}
        assert {k: round(v[0], 6) for k, v in got.items()} == {k: round(v[0], 6) for k, v in want.items()}
    alone = df.where("repo = 'r0'")
    assert stats.nearest_profile(alone, "key", "repo", "f").count() == 0


def test_scan_roles_cover_the_lists(spark):
    """Content decides about binaries, and a notebook's text does not make it generated."""
    df = spark.createDataFrame([("a.txt2", True, ""), ("n.ipynb", False, "@generated"), ("x.py", False, "# do not edit")], "path string, b boolean, text string")
    got = {r.path: r.role for r in df.select("path", classify.role(F.col("path"), sample=F.col("text"), binary=F.col("b")).alias("role")).collect()}
    assert got == {"a.txt2": "binary", "n.ipynb": "source", "x.py": "generated"}


def test_coverage_beats_declarations(spark):
    rows = [("r", "s", "coverage", "measured", [("x", Decimal(50))], []), ("r", "s", "coverage", "declared-assumed", [("x", Decimal(90))], []), ("r", "t", "coverage", "declared-assumed", [("x", Decimal(100))], []), ("r", "u", "coverage", "inferred", [("x", Decimal(10))], [])]
    df = spark.createDataFrame(rows, "repo string, scope string, kind string, source_kind string, measurements array<struct<name:string,value:decimal(38,10)>>, tags array<string>")
    hours = spark.createDataFrame([("r", "s", Decimal(40)), ("r", "t", Decimal(10))], "repo string, scope string, hours decimal(18,4)")
    got = {r.scope: (float(r.value), r.complexity, r.measured) for r in capabilities.coverage_drivers(df, hours).collect()}
    assert got == {"s": (20.0, "routine", True), "t": (10.0, "high", False)}
    priced = capabilities.capabilities(capabilities.coverage_drivers(df, hours).select("repo", "scope", "rule", "driver", "value"))
    assert priced.count() == 2


def test_intervals(spark):
    df = spark.createDataFrame([(3.0, 5.0), (5.0, 2.0), (0.0, 0.0)], "e double, h double").select(F.col("e").cast("decimal(18,2)").alias("e"), F.col("h").cast("decimal(18,2)").alias("h"))
    low, high = evaluation.symmetric_interval(F.col("e"), F.col("h"))
    rows = df.select("e", low.alias("l"), high.alias("u")).select("*", evaluation.policy_compliant(F.col("l"), F.col("e"), F.col("u")).alias("ok"), evaluation.normalized_width(F.col("l"), F.col("e"), F.col("u")).cast("double").alias("w")).collect()
    assert [(float(r.l), float(r.u), r.ok) for r in rows] == [(0, 8, True), (3, 7, True), (0, 0, True)] and [r.w for r in rows][1:] == [0.8, 0.0]


def test_edit_regions_read_batches_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, "a\nb"), (2, "a\nb\nc", "a\nx\nc")], "k int, a string, b string")
    out = change.edit_regions(df.select("k", F.col("a").alias("t")), df.select("k", F.col("b").alias("t")), "k", "t")
    assert {r.k: r.regions for r in out.collect()} == {1: 1, 2: 1}
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_capability_deltas_are_dealt_once(spark):
    """Lines go once to the partition of their change; no step behind that asks for another exchange."""
    plan = plans.QUERIES["capability_delta_rules"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_capability_deltas_of_odd_keys(spark):
    """Null capabilities meet nothing, rows of one key meet each other, rows without a change go."""
    kind = "change string, capability string, category string, low decimal(18,4), expected decimal(18,4), high decimal(18,4), paths array<string>"
    row = lambda change, capability, hours, *paths: (change, capability, "production-implementation", Decimal(hours), Decimal(hours), Decimal(hours), list(paths))
    base = spark.createDataFrame([row("c", None, 1, "a"), row("c", "k", 1, "a"), row("c", "k", 2, "b"), row(None, "k", 1, "a")], kind)
    head = spark.createDataFrame([row("c", None, 3, "a"), row("c", "k", 5, "a"), row(None, "k", 9, "a")], kind)
    paths = spark.createDataFrame([("c", "e1", "a", None, "added", 2), ("c", "e1", "z", "b", "added", 9), ("c", None, "a", None, "added", 9), (None, "e1", "a", None, "added", 2)], "change string, evidence_id string, path string, previous_path string, status string, regions int")
    material = spark.createDataFrame([("c", "k")], "change string, capability string")
    out = assembly.capability_deltas(base, head, paths, material, ["change"]).collect()
    assert sorted((str(r.capability), r.rule, r.verb, r.evidence_ids) for r in out) == [
        ("None", "capability-marginal", "Add", ["e1"]), ("k", "capability-marginal", "Expand", ["e1"]), ("k", "capability-marginal", "Expand", ["e1"])
    ]


def test_targets_of_dealt_records(spark):
    """Partitions of records find what joins find: repeated and null keys, items twice, targets without references."""
    hours = lambda e: (Decimal(e), Decimal(e + 1), Decimal(e + 2))
    points = "low decimal(18,2), expected decimal(18,2), high decimal(18,2)"
    targets = spark.createDataFrame([(1, "t", "A", *hours(1)), (1, "t", "B", *hours(2)), (1, "u", "A", *hours(3)), (1, None, "A", *hours(4)), (2, "t", "A", *hours(5)), (None, "t", "A", *hours(6))], f"record int, target string, category string, {points}")
    references = spark.createDataFrame([(1, "t", "i"), (1, "t", "i"), (1, "t", "j"), (1, "t", None), (1, "v", "i"), (2, "t", "i"), (None, "t", "i"), (1, None, "i"), (2, "t", "n")], "record int, target string, item string")
    items = spark.createDataFrame([(1, "i", "A", *hours(7)), (1, "i", "A", *hours(8)), (1, "j", None, *hours(9)), (1, None, "A", *hours(10)), (None, "i", "A", *hours(11)), (2, "i", "A", *hours(12)), (3, "i", "A", *hours(13))], f"record int, item string, category string, {points}")
    by_record = [df.repartition("record") for df in (targets, references, items)]
    one, two = evaluation.resolved_targets(targets, references, items), evaluation.resolved_targets(*by_record, dealt=True)
    assert sorted(one.columns) == sorted(two.columns) and one.count() == 6
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


def test_change_evaluation_shuffles_lines_by_record(spark):
    """No exchange asks for the items of a record or for candidates beside that of the records, where nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.QUERIES["change_evaluation"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "REPARTITION_BY_COL" in plan and not re.search(r"Exchange hashpartitioning\((record#\w+, (item|target)|candidate)", plan)
