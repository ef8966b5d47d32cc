"""Formatting-only decisions by language, on hand-made pairs."""

import json

import pytest

from sparkgauge.operators import formatting

SAME = [
    ("a.go", "package a\nfunc f() {\n\tx := 1 // c\n\treturn x\n}\n", "package a\n\nfunc f() {\n  x:=1;\n  return x /* d */\n}"),
    ("a.go", "x := `a\n  b`\n", "x  :=  `a\n  b`"),
    ("A.java", 'class A { /* c */ int x = 1; String s = """\n  a "b" """; }', 'class A\n{\n  int x = 1; // d\n  String s = """\n  a "b" """;\n}'),
    ("A.java", "/** Doc  of\n it */ class A {}", "/** Doc of it */\nclass A { }"),
    ("a.kt", "fun f(a: Int,) { /* x /* y */ z */ return\n1 }", "fun f(\n  a: Int\n) { return // c\n 1; }"),
    ("a.kt", 'val s = """a\n $b "c" """', 'val s="""a\n $b "c" """;'),
    ("a.rs", "fn f<'a>(x: &'a str) { let c = 'x'; let s = r#\"a \"q\" // b\"#; /* a /* b */ c */ }", "fn f<'a>(x:&'a str){\n let c='x';\n let s=r#\"a \"q\" // b\"#;\n}"),
    ("a.cpp", 'int f() { auto s = R"x(a )" b)x"; return 1\'000; } // c\n#define A \\\n  1\nint y;', 'int f()\n{\n  auto s = R"x(a )" b)x";\n  return 1\'000;\n}\n#define A 1\nint y;'),
    ("a.php", "<h1> a </h1>\n<?php $x = 1; // c ?>b<?= $x ?>", "<h1> a </h1>\n<?php\n$x=1; ?>b<?=$x?>"),
    ("a.php", "<?php $x = <<<EOT\n a  'b\n EOT; f('#');", "<?php\n  $x=<<<EOT\n a  'b\n EOT;  # d\nf('#');"),
    ("a.tf", 'resource "a" "b" {\n  x = "${f("}")}"\n}\n', 'resource "a"   "b" {\n\n\n      x="${f("}")}"\n}'),
    ("a.tf", "x = <<EOT\n a  b\nEOT\ny = 1\n", "x   =   <<EOT\n a  b\nEOT\n\ny=1"),
    ("a.sql", "select  1, 'a''b' /* x /* y */ z */ from t", "select 1,'a''b'\n/* x /* y */ z */\nfrom t"),
    ("a.sh", "#!/bin/sh\nif a; then\n  b 'c d' # e\nfi\n", "#!/bin/sh\n\nif a\nthen\n\nb   'c d'\nfi"),
    ("a.sh", "f() {\n  a \\\n    b\n}\n", "f() { a b; }"),
    ("a.ps1", "#Requires -Version 5\nGet-Item 'A' <# c #> | Out-Null\n", "#requires -version 5\nget-item 'A'  |  out-null # d"),
    ("a.py", "def f(a,\n      b):\n    return [1,\n2]  # c\n", "# d\ndef f(a, b):\n        return [1, 2]\n"),
    ("Dockerfile", "# escape=`\nFROM a as b\nRUN x `\n  # c\n  y\n", "#escape=`\nfrom  a as b\n\n  run x y"),
    ("docker-compose.yml", "a:\n  b: 'x # y'   # c\n  - d\n", "a:\n    b:   'x # y'\n    -  d\n\n"),
    (".dockerignore", "# a\n x \n\ny", "x\ny\n# b"),
    ("a.cs", "int  x = 1;\n\tstring s = \"a  b\";", "int x = 1; string s = \"a  b\";"),
    ("a.ipynb", json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1 # c\n", "y=2"], "outputs": [1], "execution_count": 1}], "metadata": {"kernelspec": {"name": "python3"}}}), json.dumps({"cells": [{"cell_type": "code", "source": "x=1\ny = 2", "outputs": []}], "metadata": {"kernelspec": {"name": "python3"}}}, indent=2)),
]
OTHER = [
    ("a.go", "func f() int {\nreturn\n1 }", "func f() int {\nreturn 1 }"),
    ("a.go", "//go:build a\npackage a", "package a"),
    ("a.go", 'import "C"\n/* a */', 'import "C"\n/* b */'),
    ("A.java", "/** a */ class A {}", "/** b */ class A {}"),
    ("A.java", 'String s = "a  b";', 'String s = "a b";'),
    ("A.java", "class A {", "class A  {"),
    ("A.java", "char c = '\\u0041';", "char  c = '\\u0041';"),
    ("a.kt", "fun f() { return\n1 }", "fun f() { return 1 }"),
    ("a.kt", "f(/* a", "f( /* a"),
    ("a.rs", 'let s = r"a  b";', 'let s = r"a b";'),
    ("a.rs", 'let s = r##"a"#;', 'let  s = r##"a"#;'),
    ("a.cpp", "#define A 1\nint x;", "#define A 1 int x;"),
    ("a.php", "<b> a</b><?php f();", "<b>a</b><?php f();"),
    ("a.tf", "a = 1\nb = 2", "a = 1 b = 2"),
    ("a.tf", "a = 1 # x", "a = 1 # y"),
    ("a.sql", "select 1 -- a", "select 1 -- b"),
    ("a.sql", "select ab", "select a b"),
    ("a.sh", "a; b", "a b"),
    ("a.sh", "cat <<E\nx\nE", "cat  <<E\nx\nE"),
    ("a.sh", "echo a#b", "echo a"),
    ("a.ps1", "$x = @'\na\n'@", "$x =  @'\na\n'@"),
    ("a.py", "if a:\n    b\nc\n", "if a:\n    b\n    c\n"),
    ("a.py", "x = (", "x  = ("),
    ("Dockerfile", "RUN a", "RUN b"),
    ("Dockerfile", "RUN <<E\na\nE", "RUN  <<E\na\nE"),
    ("compose.yaml", "a: |\n  x", "a:  |\n  x"),
    ("docker-compose.yml", "a:\n  b:\n    c: 1\n", "a:\n  b:\n  c: 1\n"),
    ("a.cs", "// a\nx", "// b\nx"),
    ("a.txt", "a  b", "a b"),
    ("a.ipynb", "{", "{ "),
    ("a.go", "x\0", "x \0"),
]


@pytest.mark.parametrize("path, before, after", SAME)
def test_formatted_only(path, before, after):
    assert formatting.signature(path, before) is not None
    assert formatting.signature(path, before) == formatting.signature(path, after)


@pytest.mark.parametrize("path, before, after", OTHER)
def test_not_formatted_only(path, before, after):
    one = formatting.signature(path, before)
    assert one is None or one != formatting.signature(path, after)


def test_pairs_as_rows(spark):
    rows = [(i, p, a, b) for i, (p, a, b) in enumerate(SAME + OTHER)] + [(-1, None, None, "x"), (-2, "a.go", None, "")]
    changes = spark.createDataFrame(rows, "id int, path string, before string, after string")
    got = {r.id: r.formatting_only for r in formatting.formatting_only(changes, ["id"]).collect()}
    assert got == {**{i: i < len(SAME) for i in range(len(SAME + OTHER))}, -1: False, -2: True}


@pytest.mark.parametrize("style", ["java", "cpp"])
def test_easy_runs_are_read_at_once(style):
    from dataclasses import replace

    spec = formatting.STYLES[style]
    run = "void f() { if (a && b) { x += 1.5e+3; } }\n" * 50
    assert len(list(formatting.tokens(run, spec))) == 1
    odd = ("x = u8\"a\" + 'b'; // c\n  y[1'0] <<= 2;\n", "#define A (\nint b;\n # if\n", "a / b /* c */ - d\\\n", "(]", "f(\"\"\"", "{ ( }", "/** d */ a->b\x0b(c)", "w" * 100 + "(1);")
    for text in (run, *odd, *(run + x for x in odd)):
        signed = []
        for one in (spec, replace(spec, easy=None)):
            try:
                signed.append("\x1f".join(formatting.tokens(text, one)))
            except formatting.Unfinished:
                signed.append(None)
        assert signed[0] == signed[1], text[-60:]


def test_many_brackets():
    for text, sound in (("(" * 50_000 + ")" * 50_000, True), ("([{" * 9_000 + "}])" * 9_000, True), ("()[]{}(" * 9_000, False), ("([)]", False), (")", False), ("", True)):
        assert formatting.balanced(text) is sound
