"""Scripts, manifests and element trees on awkward inputs."""

from sparkgauge.operators import manifests, markup, scripts


def test_script_candidates():
    got = {c: (at, r) for c, at, r in scripts.candidates("test: ./a.sh ../b.sh /c.sh x/../d.sh 'e f.sh' tools\\g.ps1\n" + " " * 120 + "h.sh")}
    assert {"a.sh", "e f.sh", "tools/g.ps1", "h.sh"} <= set(got) and not {"../b.sh", "b.sh", "/c.sh", "x/../d.sh"} & set(got)
    assert got["a.sh"][1] == "test" and got["h.sh"][1] == "build"
    assert dict((c, r) for c, _, r in scripts.candidates("deploy now, then publish x.sh"))["x.sh"] == "delivery"


def test_script_references(spark):
    files = spark.createDataFrame([(1, "ci/a.yml", "ci-configuration", "run build.sh and Deep/X.sh"), (1, "ci/deep/b", None, "../no.sh x.SH"), (1, "n", None, None), (2, "ci/a.yml", "ci-configuration", "build.sh")], "repo int, path string, role string, text string")
    known = spark.createDataFrame([(1, "build.sh"), (1, "ci/deep/x.sh"), (1, "deep/x.sh"), (1, "DEEP/x.sh"), (1, "no.sh")], "repo int, path string")
    got = {(r.repo, r.path, r.script, r.role) for r in scripts.references(files, known, ["repo"]).collect()}
    assert got == {(1, "ci/a.yml", "build.sh", "ci"), (1, "ci/a.yml", "ci/deep/x.sh", "ci"), (1, "ci/deep/b", "ci/deep/x.sh", "build")}


def test_cargo():
    rows = list(manifests.cargo('[package]\nname = "a"\nbuild = "b.rs"\n[[bin]]\nname = "x"\npath = "p.rs"\n[dependencies.y]\npackage = "yy"\npath = "../y"\n[workspace.dependencies]\nz = "1"\n'))
    assert rows == [("package", "a", None, ""), ("build-script", None, None, "b.rs"), ("workspace", None, None, None), ("target", "x", "bin", "p.rs"), ("dependency", "yy", "runtime", "../y"), ("dependency", "z", "workspace", None)]
    assert list(manifests.cargo("a = ")) == [("malformed", None, None, None)] and list(manifests.cargo("")) == []


def test_calls():
    assert list(manifests.calls("f(a \"b c\" # g(x)\n d) #[[ h(i) ]] j([=[k(]]l]=] m(n)) o(")) == [("f", ["a", "b c", "d"]), ("j", ["k(]]l", "m", "n"])]


def test_workspaces(spark):
    files = [("Cargo.toml", '[workspace]\nmembers = ["crates/*", "one"]\nexclude = ["crates/out"]\n'), ("crates/a/Cargo.toml", '[package]\nname = "a"'), ("crates/out/Cargo.toml", '[package]\nname = "out"'), ("crates/a/b/Cargo.toml", '[package]\nname = "b"'), ("one/Cargo.toml", '[package]\nname = "one"\n[workspace]\n'), ("two/Cargo.toml", '[package]\nname = "two"')]
    rows = manifests.manifests(spark.createDataFrame([(1, *f) for f in files], "repo int, path string, text string"), ["repo"])
    assert {(r.package, r.workspace) for r in manifests.workspace_members(rows, ["repo"]).collect()} == {("crates/a", ""), ("crates/out", None), ("crates/a/b", None), ("one", "one"), ("two", None)}


def test_elements():
    rows = markup.elements("<ul><li>a<li><b x='>'>c</b></ul></div><IMG alt><!-- <p> --><script><i></script><td><p>d<p>e")
    assert [(r[2], r[0], r[1]) for r in rows] == [("ul", -1, 0), ("li", 0, 1), ("li", 0, 1), ("b", 2, 2), ("img", -1, 0), ("script", -1, 0), ("td", -1, 0), ("p", 6, 1), ("p", 6, 1)]
    assert markup.elements("") == [] and markup.elements("<a <b") == [] and markup.elements("x > y") == []


def test_accessibility_gaps(spark):
    html = "<label for=a>A</label><input id=a><input id=b title=t><input id=c><label><input></label><input type=submit><div v-on:click=x><p (click)='x' (keyup.enter)='y'><a onclick=z>q</a>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<input>"), (1, "<b>")], "id int, html string")
    got = {r.id: r for r in markup.accessibility(markup.tree(pages, ["id"]), ["id"]).collect()}
    assert set(got) == {1, 3} and (got[1].controls, got[1].unlabelled, got[1].pointer_only) == (4, 1, 1) and got[3].unlabelled == 1
