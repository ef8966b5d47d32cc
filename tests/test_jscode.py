"""JavaScript and TypeScript by hand: awkward sources against values read off by eye."""

import pytest

from sparkgauge.operators import jscode

SOURCE = r"""#!/usr/bin/env node
import a from "b";
const re = /if (x) { \/ [/"] }/g, q = a / b / c;
function f(x) { if (x) return 1; else if (y) return 2; for (const z of w) while (q) { z() } }
const g = async (x) => x ? y ? 1 : 2 : 3;
class A extends B {
  static #p = 1
  constructor() { super(); this.x = () => { if (a) b() } }
  get v() { return `a${x ? `${y && z}` : 2}b` }
  async *m<T>(a: T, b?: string): Promise<T> { switch (a) { case 1: case 2: if (x) y(); break; default: z() } }
  abstract q(): void;
}
function asi() {
  if (a)
    b()
  else
    c()
  while (d)
    e()
  const x = a ? b
    : c
  do { y() } while (z)
  try { q() } catch { r() } finally { s() }
  foo.catch(() => 1).if(2)
  return x ?? y || z
}
const o = { h() { return 1 }, k: function () { }, 'l'(x) { if (x) { } }, z: p ? r => r || 1 : 2 };
"""
# name, tokens, complexity, nesting
WANT = [
    ("f", 38, 5, 2), ("g", 14, 3, 2), ("constructor", 24, 1, 0), ("x", 8 + 4, 2, 1), ("v", 22, 3, 1), ("m", 44, 5, 2),
    ("asi", 80, 8, 1), ("", 4, 1, 0), ("h", 6, 1, 0), ("k", 5, 1, 0), ("", 11, 2, 1), ("", 5, 2, 0),
]

JSX = """const C = ({ a }) => {
  const x = a < b && c > d
  return (<div className="x" on={() => a ? b() : c()}>
     don't {a ? <b>it's if (x) {y && z}</b> : null} <br/> <></> <form/>
  </div>)
}
"""


def test_callables():
    got = jscode.callables_of(SOURCE, "a.ts")
    assert [(r[0], *r[2:5]) for r in got] == WANT
    assert all(r[5] for r in got) and [r[1] for r in got][:3] == [4, 5, 8]


def test_elements_hold_code_and_text():
    assert [(r[0], *r[3:]) for r in jscode.callables_of(JSX, "a.tsx")] == [("C", 4, 1, True), ("", 2, 1, True)]
    got = dict(zip(jscode.MEASURES, jscode.measures_of(JSX, "a.tsx")[0]))
    assert (got["jsx_elements"], got["form_usages"], got["calls"]) == (5, 1, 2)


def test_measures():
    source = r"""
import a, { b } from "react"
import type { T } from 'zod';
const s = require("knex"), lazy = import("./x");
type U = { a?: string; b: number }
interface I { x: string
 y: number }
export enum E { A, B }
@Controller("x")
export class C extends D {
  @Get(":id") async one(@Param() p) { return await db.users.findMany({ a: 1 }) }
  run = async () => { await fetch(`a${b}`) }
}
app.get("/a", (q, r) => r.send(1)); router.route("/b")
export default function () { const [v, w] = useState(0); useEffect(() => {}, []) }
describe("d", () => { it("x", () => { expect(f(1)).toBe(2) }) })
schema.parse(x); new Foo(1)
"""
    *values, families, confidence = jscode.measures_of(source, "a.ts")[0]
    want = dict(imports=3, dynamic_imports=1, exports=3, functions=7, methods=1, async_units=2, classes=1, interfaces=1, type_aliases=1, enums=1, calls=17, decorators=3, endpoints=3, controllers=1)
    want |= dict(state_usages=1, effect_usages=1, data_calls=1, integration_calls=1, validation_usages=1, test_cases=1, test_suites=1, assertions=1)
    assert {m: v for m, v in zip(jscode.MEASURES, values) if v} == want
    assert (families, confidence) == (["data", "ui", "validation"], "high")


def test_families_by_prefix_and_case():
    assert [jscode.family(p) for p in ("@aws-sdk/client-s3", "@nestjs/core", "React", "react-x", "")] == ["integration", "server", "ui", None, None]


@pytest.mark.parametrize("bad", ["function f() {", "`${", "/* x", "'abc", "}}((", "const x = <a>{", "if (", "for await ("])
def test_broken_sources_lower_confidence(bad):
    for path in ("a.js", "a.ts"):
        assert jscode.measures_of(bad, path)[0][-1] == "low" or bad == "const x = <a>{"
        assert not any(r[-1] for r in jscode.callables_of(bad, path))


@pytest.mark.parametrize("odd", ["", "do", "try {} catch", "x =>", "=> x", "function", "class", "async", "a ? b", "@", "import", "case x", "for await", ": ? :", "퟿ "])
def test_odd_sources_never_fail(odd):
    jscode.measures_of(odd), jscode.callables_of(odd)


def test_deep_and_long_sources():
    deep = "function f() {" + "if (a) { " * 5_000 + "}" * 5_000 + "}\nconst g = () => {" + "if (a) x(); else " * 5_000 + "y() }"
    assert [r[2:5] for r in jscode.callables_of(deep)] == [(30_006, 5_001, 5_000), (45_008, 5_001, 5_000)]


def test_files_with_nulls(spark):
    one = "const f = x => x ? 1 : 2"
    files = spark.createDataFrame([(1, one, "a.js"), (2, None, "a.js"), (3, "", None), (None, one, None), (1, one, "a.js")], "id int, text string, path string")
    rows = jscode.callables(files, ["id"]).select("id", "place", "name", "complexity").collect()
    assert sorted(map(str, rows)) == sorted(f"Row(id={i}, place=0, name='f', complexity=2)" for i in (1, None, 1))
    assert jscode.analyzed(files, ["id"]).where("functions = 1 and confidence = 'high'").count() == 3
    assert jscode.analyzed(files.limit(0), ["id"]).count() == jscode.callables(files.limit(0), ["id"]).count() == 0


def many(n: int) -> str:
    return "import q from 'react'\n" + "".join(f"// {i}\nexport function f{i}(a) {{\n  if (a) b()\n}}\n" for i in range(n))


def test_equal_pieces_are_measured_once():
    jscode.measured.cache_clear()
    got = dict(zip(jscode.MEASURES, jscode.measures_of(many(500))[0]))
    assert (got["imports"], got["exports"], got["functions"], got["branch_points"], got["calls"]) == (1, 500, 500, 500, 500)
    assert jscode.measured.cache_info().misses <= 3
    store = "import x from 'knex'\nexport function f() { insert() }\n"
    assert dict(zip(jscode.MEASURES, jscode.measures_of(store)[0]))["data_calls"] == 1  # a family counts for the pieces behind it too


def test_equal_pieces_are_read_once():
    jscode.structured.cache_clear()
    rows = jscode.callables_of(many(500))
    assert [r[:2] for r in rows] == [(f"f{i}", 4 * i + 3) for i in range(500)] and {r[2:] for r in rows} == {(14, 2, 1, True)}
    assert jscode.structured.cache_info().misses <= 3


@pytest.mark.parametrize("source, want", [("const a = `\nexport function f() {}\n`\nfunction g() {}", [("g", 4)]), ("/*\nexport function f() {}\n*/function g() {}", [("g", 3)]), ("if (a)\nfunction g() {}\nclass C {\nm() {} }", [("g", 2), ("m", 4)]), ("do {}\nfunction g() {}", [("g", 2)])])
def test_pieces_that_do_not_end(source, want):
    assert [r[:2] for r in jscode.callables_of(source)] == want
