"""Block trees, stage graphs and builds on awkward sources."""

from sparkgauge.operators import infrastructure as infra


def names(text):
    return [(r[0], r[1], r[3], r[5]) for r in infra.hcl_rows(text)], (infra.hcl_rows(text) or [[None]])[-1][-1]


def test_hcl_blocks():
    rows, whole = names('a "b" c {\n  d = "x"\n  e { f = "${g("}", "{")}" }\n  h = {\n    i = 1\n  }\n}\nj = <<-E\n  k = {\n  E\nl { # {\n}\n')
    assert rows == [(-1, 0, "a", None), (0, 1, "d", "x"), (0, 1, "e", None), (2, 2, "f", None), (0, 1, "h", None), (-1, 0, "j", None), (-1, 0, "l", None)] and whole
    assert infra.hcl_rows('a "b" c {}')[0][4] == ["b", "c"]


def test_hcl_broken():
    for bad in ("a {", "}", 'a = "x', "a = (", "= 1", "a b", "a = <<E\nx", "/* x", "a = ${"):
        assert not names(bad)[1] or not infra.hcl_rows(bad)
    assert infra.hcl_rows("") == []


def test_docker_instructions():
    text = "# escape=`\nfrom a AS b\n\nRUN x `\n  # c\n\n  y\nCOPY <<E /f\nFROM no\nE\nFROM b\nCOPY --from=b \"a b\" c\n"
    assert infra.instructions(text) == [
        ("FROM", ["a", "AS", "b"], 0), ("RUN", ["x", "y"], 0), ("COPY", ["<<E", "/f"], 0), ("FROM", ["b"], 1), ("COPY", ["--from=b", '"a b"', "c"], 1),
    ]
    assert infra.instructions("RUN a \\") == [("RUN", ["a"], -1)] and infra.instructions("") == []


def test_stage_references(spark):
    text = "FROM base AS base\nFROM base\nFROM late\nFROM x AS late\nCOPY --from=late a b\nCOPY --from=1 a b\nCOPY --from=$V a b\nADD --from=other a b\nFROM --platform=p late as base\nCOPY --from=base a b\nFROM\n"
    files = spark.createDataFrame([(1, text), (2, None), (1, "")], "id int, text string")
    got = infra.stage_references(infra.dockerfile(files, ["id"]), ["id"]).orderBy("place").collect()
    assert [(r.name, r.target, r.outcome) for r in got] == [
        ("base", None, "image"), ("base", 0, "stage"), ("late", None, "image"), ("x", None, "image"), ("late", 3, "stage"), ("1", 1, "stage"), ("$V", None, "unresolved"), ("other", None, "image"), ("late", 3, "stage"), ("base", 4, "stage"),
    ]


def test_compose_builds():
    text = "# x\nservices:\n  a:\n    build: .\n  b:\n    build:\n      dockerfile: D # y\n      context: '../c'\n    environment:\n      build: no\n  c:\n    image: x\n'build': no\nbuild:\n  context: no\n"
    assert infra.builds(text) == [("a", ".", None), ("b", "../c", "D")]


def test_modules(spark):
    files = [("main.tf", 'module "a" {\n  source = "./m?x=1"\n}\n'), ("m/a.tf", 'module "b" {\n  source = "../m/"\n}\nmodule "c" {\n  source = "../n"\n}'), ("n/a.hcl", 'module "d" {\n  source = "../m"\n}'), ("n/deep/x.tfvars", 'source = "./no"'), ("tests/t.tf", ""), ("z/y.tfvars", "")]
    table = spark.createDataFrame(files, "path string, text string")
    owners = {r.path: r.module for r in infra.module_owners(table).collect()}
    assert owners == {"main.tf": "", "m/a.tf": "m", "n/a.hcl": "n", "n/deep/x.tfvars": "n", "tests/t.tf": "", "z/y.tfvars": ""}
    references = infra.module_references(infra.hcl(table, ["path"]), infra.module_owners(table))
    assert {(r.module, r.target, r.outside, r.missing) for r in references.collect()} == {("", "m", False, False), ("m", "m", False, False), ("m", "n", False, False), ("n", "m", False, False)}
    assert {(r.module, r.cyclic_size) for r in infra.module_cycles(references).collect()} == {("", 0), ("m", 2), ("n", 2)}
