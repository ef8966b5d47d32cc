"""The pruned tree source: what it lists, what it leaves out and never opens, and the cache."""

import os

import pytest

from sparkgauge.sources import files, sourcetree


@pytest.fixture
def tree(tmp_path):
    def put(path, text=""):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)

    put(".gitignore", "*.log\n/build/\n!keep.log\n# c\n\\#x\n")
    put("a.py", "print(1)\n")
    put("keep.log"), put("x.log"), put("#x"), put("build/y.py"), put("sub/build/z.py", "z"), put("sub/.gitignore", "*.tmp\n!keep.tmp\n/only\n"), put("sub/a.tmp"), put("sub/keep.tmp"), put("sub/deep/only"), put("only"), put("sub/only")
    put("node_modules/m/i.js", "x"), put("NODE_MODULES2/i.js", "x"), put("src/Obj/o.cs"), put(".yarn/cache/c"), put(".yarn/other")
    for at in ("node_modules/never", "build/never", "src/Obj/never"):
        os.mkfifo(tmp_path / at)  # opening it would never end
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    os.symlink(tmp_path / "sub", tmp_path / "linked")
    return tmp_path


KEPT = {".gitignore", "a.py", "keep.log", "sub/build/z.py", "sub/.gitignore", "sub/keep.tmp", "sub/deep/only", "only", "NODE_MODULES2/i.js", ".yarn/other"}
LEFT = {
    "x.log": "ignore-rule", "#x": "ignore-rule", "build": "ignore-rule", "sub/a.tmp": "ignore-rule", "sub/only": "ignore-rule", "node_modules": "vendored-dependencies", "src/Obj": "build-output", ".yarn/cache": "tool-cache",
    "link.py": "filesystem-link", "linked": "filesystem-link",
}


def test_walk(tree):
    found = list(sourcetree.walk(str(tree)))
    assert {e.path for e in found if e.reason is None} == KEPT
    assert {e.path: e.reason for e in found if e.reason} == LEFT
    assert {e.path for e in sourcetree.walk(str(tree), (), ("*.py", "sub/"))} >= {"build/y.py", "x.log"} and not any(e.path.endswith(".py") and not e.reason for e in sourcetree.walk(str(tree), (), ("*.py",)))
    with pytest.raises(ValueError):
        list(sourcetree.walk(str(tree / "linked")))
    with pytest.raises(FileNotFoundError):
        list(sourcetree.walk(str(tree / "none")))


def test_rows_and_partitions(spark, tree):
    for part_bytes in (1, 1 << 26):
        rows = sourcetree.pruned_tree(spark, str(tree), part_bytes=part_bytes)
        assert (rows.rdd.getNumPartitions() > 1) == (part_bytes == 1)
        got = {r.path: r for r in rows.collect()}
        assert {p for p, r in got.items() if r.reason is None} == KEPT and {p: r.reason for p, r in got.items() if r.reason} == LEFT
        assert got["a.py"].content == b"print(1)\n" and got["a.py"].length == 9 and got["x.log"].content is None
    empty = tree / "empty"
    empty.mkdir()
    assert sourcetree.pruned_tree(spark, str(empty)).count() == 0


def test_cache_spares_unchanged_files(spark, tree):
    first = files.scan_tree(spark, str(tree)).cache()
    assert {r.path for r in first.collect()} == KEPT
    digest = {r.path: r.sha256 for r in first.collect()}
    stat = os.stat(tree / "a.py")
    (tree / "a.py").write_text("print(2)\n")  # another text of the same length and time: not opened, so not seen
    os.utime(tree / "a.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (tree / "only").write_text("now longer")
    (tree / "keep.log").unlink()
    again = {r.path: r.sha256 for r in files.scan_tree(spark, str(tree), first).collect()}
    assert set(again) == KEPT - {"keep.log"} and again["a.py"] == digest["a.py"] and again["only"] != digest["only"]
    first.unpersist()


def test_scan_verb_walks_folders(spark, tree):
    from sparkgauge import api

    assert {r.path for r in api.scan(spark, str(tree), ["*.py"]).collect()} == KEPT - {"a.py", "sub/build/z.py"}
