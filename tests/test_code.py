"""Code analyzers on awkward sources, against values read off by hand."""

import pytest

from sparkgauge.operators import csharp, pythoncode, sqlcode
from sparkgauge.plans import code

from .conftest import SMALL

SOURCE = r'''
#if DEBUG
class Hidden { void X() { if (a) b(); } }
#elif !TRACE && (DEBUG || true)
[Attr(1)]
public class A<T> : Base where T : class
{
    private int _f = G(x => x > 1 ? 2 : 3);
    public int P { get; set; } = 4;
    public int Q => P > 1 && P < 3 ? 1 : 2;
    public A(int x) : base(x) { if (x > 0) { } }
    [Fact] public void M1() { if (a && b) { x = 1; } else if (c) y(); else z(); }
    int M2(int? p) => p is null ? 1 : 2;
    bool M3() => a && b || c;
    string M4(object o) => o switch { int i when i > 0 && i < 3 => "a", string s => s.Length > 1 ? "b" : "c", _ => "d", };
    void M5() { do { i++; } while (i < 3); while (j) j--; foreach (var q in w) for (;;) break; }
    void M6() { try { } catch (X e) when (e.A || e.B) { if (x) y(); } catch { } finally { } }
    void M7() { switch (k) { case 1: case 2: a(); break; case 3 when p ? q : r: { b(); } break; default: c(); break; } }
    void M8() { list.ForEach(z => { if (z) w(); }); int L(int v) { return v > 1 ? 1 : 2; } Func<int> d = delegate { while (true) { } }; x = a ?? b; }
    void M9() { var s = $"a{(x ? 1 : 2)}b{y:0.00}c{{d}}" + @"if ""(x)"" {" + """raw "if" { """ + '\''; int? n = null; foo?.bar?[1]; }
    async Task<List<int?>> M10<U>(Dictionary<string, int> d, (int, int) t) where U : class { await foreach (var x in y) { if (a ? b ? c : d : e) { } } return null; }
    void I.M11() { }
    (int, string) M12() { return (1, ""); }
    abstract void M13();
    public static A operator +(A a, A b) { if (a) return b; }
    enum E { A, B }
    class Inner { void N1() { if (x) { if (y) { while (z) { } } } } }
}
#endif
'''
# name: tokens, complexity, nesting
WANT = {
    "M1": (36, 4, 2), "M2": (16, 1, 0), "M3": (11, 2, 0), "M4": (42, 6, 2), "M5": (40, 5, 2), "M6": (40, 5, 2), "M7": (49, 5, 2), "M8": (63, 1, 0), "M9": (50, 2, 1),
    "M10": (62, 5, 4), "M11": (8, 1, 0), "M12": (17, 1, 0), "M13": (6, 0, 0), "N1": (24, 4, 3),
}


def test_csharp_structure_of_awkward_source():
    got = csharp.callables_of(SOURCE)
    assert {r[0]: r[2:5] for r in got} == WANT
    assert all(r[8] for r in got) and got[0][1] == 12  # parsed; the line of the first name
    assert [r[0] for r in got if not r[5]] == ["M13"]


def test_csharp_reachability():
    source = """
    record R(int X) { private void A() { B(); } private void B() { A(); } private void C() { C(); } public void Go() => A(); private void D() {} string S = "D"; private static void Main() {}
      private void E() { F(); } private void F() {} [Fact] private void G() {} private partial void H(); void J() {} private void K(int x) {} private void K() {} int Y = nameof(K).Length; }
    partial class P { private void Q() {} } class B2 : Base { private void Q2() {} } class O { private void Q3() {} class I { private void Q4() { Q3(); } } }
    """
    live = {(r[0], r[6], r[7]) for r in csharp.callables_of(source)}
    dead = {n for n, _, ok in live if not ok}
    assert dead == {"C", "E", "F", "Q3", "Q4"}
    assert {n for n, candidate, _ in live if not candidate} == {"Go", "Main", "G", "H", "J", "Q", "Q2"}


@pytest.mark.parametrize("bad", ["class A { void F() { ", "}}}((", 'class A { string s = "abc', '$"{', "/* x", "class A { void F( }", "#if (", "class A { void F() { case", "class A{void F(){do", "class A{void F(){catch", "class A{int F()=>", "class A{void F(){x?", "switch", "=>", "delegate", ""])
def test_csharp_broken_sources_never_fail(bad):
    assert all(not r[8] for r in csharp.callables_of(bad))


def test_csharp_deep_and_long_sources():
    deep = "class A { void F() {" + "if (a) { " * 5_000 + "}" * 5_000 + "} void G() {" + "if (a) x(); else " * 5_000 + "y(); } }"
    assert [r[2:5] for r in csharp.callables_of(deep)] == [(30_006, 5_001, 5_000), (45_010, 5_001, 5_000)]


def test_csharp_files_with_nulls(spark):
    rows = [(1, "class A { void F() { if (x) y(); } }", "n"), (2, None, "n"), (3, "", "n"), (None, "class A { void F() { if (x) y(); } }", "n"), (1, "class A { void F() { if (x) y(); } }", "n")]
    files = spark.createDataFrame(rows, "id int, text string, other string")
    assert sorted(map(str, csharp.callables(files, ["id"]).select("id", "place", "name", "complexity").collect())) == sorted(
        [f"Row(id={i}, place=0, name='F', complexity=2)" for i in (1, None, 1)]
    )
    assert csharp.callables(files.limit(0), ["id"]).count() == 0


def sql(text):
    return dict(zip([c.split()[0] for c in sqlcode.SCHEMA.split(", ")], sqlcode.semantics(text)))


@pytest.mark.parametrize(
    "text, want",
    [
        ("", {"statements": 0, "confidence": "high", "dialect": "standard-or-unknown"}),
        ("select 1; select '", {"statements": 2, "queries": 2, "confidence": "low"}),
        ("select ')' , \")\" , [)] , `)` , $a$ ) $a$ ;", {"queries": 1, "confidence": "high"}),
        ("/* a /* b */ select 1;", {"queries": 0, "confidence": "low"}),
        ("/* a /* b */ c */ select 1 -- ; select 2\n;", {"queries": 1, "statements": 1, "confidence": "high"}),
        ("select (1; select 2", {"statements": 1, "confidence": "low"}),
        ("x; y; z; select 1", {"statements": 4, "unknown": 3, "confidence": "medium"}),
        ("insert into t select 1\nGO\nupdate t set x = 1\ngo\n", {"statements": 2, "modifications": 2, "dialect": "sql-server", "dialect_confidence": "medium"}),
        ("create table a (x int references b on delete cascade on update no action, unique (x));", {"modifications": 0, "constraints": 1, "tables": 1}),
        ("create temp view v as with recursive r(a) as (select 1) select * from r;", {"views": 1, "ctes": 1, "subqueries": 1, "queries": 2}),
        ("create or alter procedure p as begin tran; commit", {"procedures": 2, "transactions": 1, "statements": 2}),
        ("alter materialized view v; drop domain d; truncate table t;", {"views": 0, "types": 1, "tables": 1, "ddl": 2}),
        ("select sqlite_version(); create database link l; engine = federated", {"dialect": "sqlite", "signals": 2}),
        ("select $x$ never ends", {"confidence": "low", "queries": 1}),
        ("'' ' it''s' ''''", {"confidence": "high"}),
        (";" * 300_000, {"statements": 0, "confidence": "low"}),
    ],
)
def test_sql_statements(text, want):
    got = sql(text)
    assert {k: got[k] for k in want} == want


def python(text, path="a.py"):
    got = dict(zip([c.split()[0] for c in pythoncode.SCHEMA.split(", ")], pythoncode.measures(path, text)))
    return {k: v for k, v in got.items() if v}


@pytest.mark.parametrize(
    "text, want",
    [
        ("", {}),
        ("class A:\n  class B:\n    def m(self): pass\n  def n(self):\n    def inner(): pass\n    return inner\ndef f(): pass\n", {"classes": 2, "methods": 2, "functions": 2, "public_symbols": 5, "type_annotations": 4, "calls": 4}),
        ("if a:\n    class A:\n        if b:\n            def m(self): pass\n", {"classes": 1, "methods": 1, "public_symbols": 2, "type_annotations": 1, "calls": 1, "branch_points": 2}),
        ("def f(a,\n   b):\n  x = (a or\nb)\n", {"functions": 1, "public_symbols": 1, "type_annotations": 1, "calls": 1, "branch_points": 1}),
        ("import numpy as np\nnp.array([1])\nx = np.zeros(3)\nx.sum()\n", {"imports": 1, "calls": 3, "analysis_calls": 3}),
        ("from unittest import mock\nm = mock.patch('a')\n@pytest.mark.skip\nasync def test_a():\n    assert await g()\n", {"imports": 1, "calls": 3, "mock_usages": 1, "decorators": 1, "functions": 1, "async_units": 1, "public_symbols": 1, "test_cases": 1, "type_annotations": 1, "assertions": 1}),
        ("from pydantic import BaseModel\nclass M(BaseModel):\n    pass\n__all__ = ['M', \"N\"]\n", {"imports": 1, "classes": 1, "public_symbols": 3, "validation_types": 1, "calls": 1, "validation_rules": 0}),
        ("x = f'{a}' r\"\\d\" b'''\n'''\ny = \\\n  1\n", {}),
    ],
)
def test_python_lines(text, want):
    got = python(text)
    assert got.pop("confidence") == "medium"
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("text", ["x = 'abc\n", "x = '''abc", "f(", ")", "if a:\n    b\n  c\n", "x = 'a\\"])
def test_python_faults(text):
    assert python(text)["confidence"] == "low"


def test_python_entry_points():
    assert python("x", "pkg/__main__.py")["entry_points"] == 1 and "entry_points" not in python("x", "main.py")


def test_code_files_with_nulls(spark):
    files = spark.createDataFrame([(1, None, None), (None, "a.py", "def f(): pass"), (None, "a.py", "def f(): pass")], "id int, path string, text string")
    assert sorted(r.functions for r in pythoncode.analyzed(files, ["id"]).collect()) == [0, 1, 1]
    assert sorted(r.statements for r in sqlcode.analyzed(files, ["id", "path"]).collect()) == [0, 1, 1]
    assert sqlcode.analyzed(files.limit(0), ["id"]).count() == 0


def test_sql_roles(spark):
    many = "insert into t values (1);\n" * 100
    cases = [("a/dumps/x.sql", "", False, "dump"), ("seeds/dumps/x.sql", "", False, "seed-data"), ("x.bak.sql", "", False, "dump"), ("x.sql", many, False, "dump"), ("tests/x.sql", many, False, "query"), ("x.sql", many, True, "dump"), ("tests/x.sql", "-- MySQL dump", True, "dump"), ("x.sql", "select 1", True, "test-fixture"), ("R__a.sql", "", False, "migration"), ("v1_a.sql", "", False, "unknown"), ("V1__a.sql", "", False, "migration"), ("12_a.sql", "", False, "unknown"), ("012-a.sql", "", False, "migration"), ("a/Migrate/b.sql", "", False, "migration"), ("my.seed.sql", "", False, "seed-data"), ("deploy/a.sql", "", False, "delivery"), ("install_a.sql", "", False, "delivery"), ("a.sql", "create trigger t", False, "stored-program"), ("a.sql", "drop table t", False, "schema"), ("a.sql", "update t set x=1", False, "query"), ("a.sql", "copy t (a) from stdin;", False, "dump")]
    files = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, path string, text string, is_test boolean, want string")
    counted = sqlcode.analyzed(files, ["id", "path", "text", "is_test", "want"])
    from pyspark.sql import functions as F

    got = counted.select("path", "want", sqlcode.role(F.col("path"), F.col("text"), F.col("is_test")).alias("role"))
    assert [(r.path, r.role, r.want) for r in got.collect() if r.role != r.want] == []


def test_files_spread_over_all_cores(spark):
    for files in (code.js_files, code.csharp_files, code.python_files, code.sql_files):
        assert files(spark, SMALL).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_csharp_bodies_of_one_shape_are_measured_once():
    source = "class C {\n" + "".join(f"  private void M{i}() {{ if (a{i} && b) {{ N{i}(); }} }}\n" for i in range(300)) + "}\n"
    csharp.shaped.cache_clear()
    assert {r[2:5] for r in csharp.callables_of(source)} == {(19, 3, 1)} and csharp.shaped.cache_info().misses == 1


def test_python_lines_are_read_once():
    pythoncode.kept_line.cache_clear()
    got = dict(zip((*pythoncode.COUNTS, "confidence"), pythoncode.measures("a.py", "def f(a):\n    if a: g(a)\n" * 300 + 's = """\ndef f(a):\n"""\nx = [\nif_]\n')))
    assert (got["functions"], got["branch_points"], got["calls"], got["confidence"]) == (300, 300, 600, "medium")
    assert pythoncode.kept_line.cache_info().misses < 10


def test_sql_lines_are_read_once():
    sqlcode.kept_line.cache_clear()
    got = dict(zip(sqlcode.COUNTS, sqlcode.semantics("SELECT a FROM t;\n" * 300 + "/*\nSELECT a FROM t;\n*/ SELECT '\nSELECT a FROM t;\n';\n")))
    assert (got["statements"], got["queries"]) == (301, 301) and sqlcode.kept_line.cache_info().misses < 10
