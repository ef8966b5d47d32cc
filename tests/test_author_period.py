"""Author-period and portfolio manifests, and the commits that they select."""

import copy
import json

import pytest

from sparkgauge.sources import commits, documents

GOOD = {
    "selection": {"sinceInclusive": "2024-01-01T00:00:00Z", "untilExclusive": "2024-02-01T00:00:00Z", "timeZone": "UTC", "dateField": "author", "mergePolicy": "exclude", "coauthorPolicy": "include"},
    "contributors": [{"id": "ann", "aliases": ["Ann", "ann@x.org"]}, {"id": "bob", "aliases": ["bob@x.org"]}],
    "repositories": [{"id": "r", "repositoryPath": "a/r", "heads": [{"id": "main", "objectId": "f00"}, {"id": "dev", "objectId": "f01"}]}],
}


def written(tmp_path, doc):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(doc))
    return str(path)


def test_author_period_manifest(spark, tmp_path):
    got = documents.author_period(spark, written(tmp_path, GOOD))
    assert sorted(map(tuple, got["contributors"].collect())) == [("ann", "Ann"), ("ann", "ann@x.org"), ("bob", "bob@x.org")]
    assert sorted(map(tuple, got["heads"].collect())) == [("r", "a/r", "dev", "f01"), ("r", "a/r", "main", "f00")]
    assert got["selection"].first().timeZone == "UTC"


@pytest.mark.parametrize("spoil", [
    lambda d: d["selection"].update(untilExclusive="2024-01-01T00:00:00Z"), lambda d: d["selection"].update(mergePolicy="all"), lambda d: d["selection"].update(timeZone=" UTC"),
    lambda d: d["selection"].update(intervalSemantics="closed"), lambda d: d["contributors"].append({"id": "ann", "aliases": ["z"]}), lambda d: d["contributors"][1]["aliases"].append("ANN"),
    lambda d: d["contributors"].clear(), lambda d: d["repositories"][0]["heads"].clear(), lambda d: d["contributors"][0].update(aliases=[f"a{i}" for i in range(17)]), lambda d: d.pop("selection"),
])
def test_unsound_manifests_fail(spark, tmp_path, spoil):
    doc = copy.deepcopy(GOOD)
    spoil(doc)
    with pytest.raises(ValueError):
        documents.author_period(spark, written(tmp_path, doc))


def test_portfolio_manifest(spark, tmp_path):
    item = {"id": "a", "repositoryId": "r", "repositoryPath": "p", "pullRequest": "7"}
    assert documents.portfolio_items(spark, written(tmp_path, {"items": [item]})).first().pullRequest == "7"
    for bad in ([], [item, item], [item | {"id": "b", "pullRequest": " "}], [item | {"gitHubRepository": ""}]):
        with pytest.raises(ValueError):
            documents.portfolio_items(spark, written(tmp_path, {"items": bad}))


def test_selection(spark):
    who = {"a": ("Ann", "ann@x.org"), "b": ("Bob", "BOB@x.org"), "z": ("Zed", "z@x.org")}
    log = [  # id, parents, author, second of January 2024, coauthors
        ("1", [], "a", 1, ""), ("2", ["1"], "a", 2, ""), ("3", ["2"], "z", 3, ""), ("4", ["3"], "z", 4, "b"), ("5", ["4"], "a", 5, "bz"), ("6", ["5", "3"], "b", 6, ""), ("7", ["5"], "b", 6, ""), ("8", ["7"], "a", 40 * 86400, ""),
    ]
    rows = [(r, i, p, *who[a], 1704067200 + t, [who[c] for c in co]) for r in ("r", None) for i, p, a, t, co in log]
    made = spark.createDataFrame(rows, "repo string, object_id string, parents array<string>, author_name string, author_email string, t long, coauthors array<struct<name:string,email:string>>").selectExpr("*", "timestamp_seconds(t) as author_ts")
    people = spark.createDataFrame([("ann", "ANN"), ("ann", "ann@x.org"), ("bob", "bob@x.org")], "contributor string, alias string")
    run = lambda **k: {r.object_id: (r.kind[0], "".join(m.contributor[0] for m in r.matches), r.excluded, [a[:2] for a in r.ambiguity]) for r in commits.author_period(made.where("repo = 'r'"), people, "2024-01-01", "2024-02-01", **k).collect()}
    assert run() == {"1": ("d", "a", False, []), "2": ("d", "a", False, []), "4": ("c", "b", False, ["co", "pr"]), "5": ("d", "ab", False, ["co", "ma"]), "7": ("d", "b", False, []), "6": ("d", "b", True, [])}
    assert run(merges="first-parent")["6"] == ("d", "b", False, ["me"]) and run(merges="first-parent")["7"][3] == ["pr"]
    assert set(run(coauthors=False)) == {"1", "2", "5", "6", "7"}
