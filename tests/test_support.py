"""Distances of profiles against brute force over all pairs, and edge cases by hand."""

import random
from fractions import Fraction

from sparkgauge.operators import support

SCHEMA = f"repo string, record string, item string, category string, size int, complexity int, ecosystems array<string>, features {support.FEATURE}"


def six(x):
    return Fraction(int(x * 1_000_000 + Fraction(1, 2)), 1_000_000)


def brute(rows):
    groups = {}
    for r in rows:
        profile = (r[3], r[4], r[5], tuple(sorted(set(r[6]))), tuple(r[7]))
        groups.setdefault((r[0], profile), []).append((r[1], r[2]))
    out = {}
    for (repo, p), own in groups.items():
        best = None
        for (other, q), there in groups.items():
            if other == repo:
                continue
            union = len({*p[3], *q[3]})
            jaccard = 1 - Fraction(len({*p[3]} & {*q[3]}), union) if union else 0
            structural = six(((p[0] != q[0]) + Fraction(abs(p[1] - q[1]), 8) + Fraction(abs(p[2] - q[2]), 3) + jaccard) / 4)
            parts = [1 if a[0] != b[0] else Fraction(abs(a[1] - b[1]), a[2]) if a[0] == "available" else 0 for a, b in zip(p[4], q[4])]
            feature = six(sum(parts, Fraction(0)) / len(parts))
            score = six((4 * structural + len(parts) * feature) / (4 + len(parts)))
            best = min(best or (score + 1,), (score, other, *min(there), structural, feature, q))
        elsewhere = lambda q: [len(x) for (o, z), x in groups.items() if z == q and o != repo]
        exact, near = elsewhere(p), elsewhere(best[6]) if best else []
        out[repo, min(own)] = (len(own), *map(float, best[:1]), float(best[4]), float(best[5]), sum(exact), len(exact), *best[1:4], sum(near), len(near)) if best else None
    return out



def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        repo = "hot" if rng.random() < 0.4 else f"r{rng.randrange(6)}"
        features = [(rng.choice(["available", "available", "missing", "unknown"]), rng.randrange(4), 3), ("available", rng.randrange(3), 2), (rng.choice(["available", "missing"]), rng.randrange(8), 7)]
        rows.append((repo, f"rec{rng.randrange(9)}", f"i{i}", rng.choice(["a", "b", "c"]), rng.randrange(9), rng.randrange(4), rng.sample(["x", "y", "z"], rng.randrange(3)), [f if f[0] == "available" else (f[0], 0, f[2]) for f in features]))
    rows += [(f"r{i % 3}", "same", f"s{i}", "d", 8, 0, [], rows[0][7]) for i in range(7)]  # one profile in three repositories
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    first = {}
    for r in rows:
        key = (r[0], (r[3], r[4], r[5], tuple(sorted(set(r[6]))), tuple(r[7])))
        first[key] = min(first.get(key, (r[1], r[2])), (r[1], r[2]))
    out = support.support_distance(df, block=16).toPandas()
    assert len(out) == len(want) == len(first)
    columns = ["observations", "score", "structural_distance", "feature_distance", "exact_observations", "exact_repositories", "nearest_repo", "nearest_record", "nearest_item", "nearest_observations", "nearest_repositories"]
    assert sorted(map(tuple, out[["repo", *columns]].values.tolist())) == sorted((k[0], *v) for k, v in want.items())


def test_no_other_repository_and_no_rows(spark):
    rows = [("r", "a", "1", None, 0, 0, [], [("available", 1, 3)]), ("r", "a", "2", "c", 8, 3, ["x"], [("missing", 0, 3)])]
    got = support.support_distance(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2 and all(r.score is None and r.nearest_repo is None and r.exact_observations == 0 for r in got)
    assert support.support_distance(spark.createDataFrame([], SCHEMA)).count() == 0


def test_residual_ranges_with_hot_group_ties_and_nulls(spark):
    from sparkgauge.operators import stats

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), i, rng.choice([0.0, 0.0, 5.0, -5.0, float(rng.randrange(-50, 50))])) for i in range(400)] + [("z", 1000, 0.0), ("hot", 1001, None)]
    got = stats.residual_pareto(spark.createDataFrame(rows, "g string, k long, e double"), ["g"], "k", "e").collect()
    assert len(got) == len(rows)
    for g in ("hot", "a", None, "z"):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -abs(r[2] or 0), r[1]))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.rank)
        assert [(r.k, r.rank) for r in mine] == [(r[1], i + 1) for i, r in enumerate(want)]
        total, upto = sum(abs(r[2] or 0) for r in want), 0
        for m, r in zip(mine, want):
            upto += abs(r[2] or 0)
            assert m.cumulative is None if not total else abs(m.cumulative - upto / total) < 1e-6
