"""Python files: logical lines by indentation and brackets, and the measures of what they say.

Physical lines join while a bracket, a triple-quoted string or a backslash is open; a stack of
indents gives each logical line its depth.  A ``def`` is a method if the nearest class around it is
deeper than the nearest function.  Names are resolved by imports and by what a name was last assigned
from, so that calls and decorators of known libraries count whatever their alias.

Confidence is low where a string or bracket does not end, an indent fits none before it, or a file
has more than ``MOST_TOKENS`` tokens; else medium, since nothing is executed.  Null texts are empty.

A physical line that ends all that it begins reads the same wherever it stands, so a worker keeps what it read of short ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .reading import rows_of

MOST_TOKENS = 250_000
COUNTS = (
    "imports", "internal_imports", "functions", "methods", "classes", "public_symbols", "async_units", "branch_points", "decorators", "type_annotations", "calls", "entry_points",
    "endpoints", "api_types", "cli_commands", "data_models", "data_calls", "migrations", "integration_calls", "security_usages", "background_usages", "validation_types", "validation_rules",
    "test_cases", "parameterized_cases", "assertions", "mock_usages", "analysis_calls", "visualization_calls",
)
SCHEMA = ", ".join(f"{c} int" for c in COUNTS) + ", confidence string"

# Words, libraries, and what names of theirs count for.
KEYWORDS = frozenset("and as assert async await break case class continue def del elif else except False finally for from global if import in is lambda match None nonlocal not or pass raise return True try while with yield".split())
BRANCHES = frozenset("if elif for while try except match case and or".split())
LIBRARIES = (
    "fastapi flask django sqlalchemy alembic requests httpx boto3 celery rq argparse click typer pytest unittest pydantic marshmallow passlib bcrypt jose google azure openai "
    "numpy pandas polars scipy sklearn tensorflow torch matplotlib seaborn plotly bokeh altair"
).split()
#: measure -> (libraries one of which is imported, beginnings of names one of which fits)
USES = {
    "data_calls": (("sqlalchemy", "django"), ("sqlalchemy.", "django.db.")),
    "integration_calls": (("requests", "httpx", "boto3", "google", "azure", "openai"), ("requests.", "httpx.", "boto3.", "botocore.", "google.cloud.", "azure.", "openai.")),
    "security_usages": (("jose", "passlib", "bcrypt", "fastapi", "django"), ("jwt.", "pyjwt.", "jose.", "passlib.", "bcrypt.", "fastapi.security.", "django.contrib.auth.")),
    "background_usages": (("celery", "rq"), ("celery.", "rq.")),
    "validation_rules": (("pydantic", "marshmallow"), ("pydantic.", "marshmallow.")),
    "analysis_calls": (("numpy", "pandas", "polars", "scipy", "sklearn", "tensorflow", "torch"), ("numpy.", "pandas.", "polars.", "scipy.", "sklearn.", "tensorflow.", "torch.")),
    "visualization_calls": (("matplotlib", "seaborn", "plotly", "bokeh", "altair"), ("matplotlib.", "seaborn.", "plotly.", "bokeh.", "altair.")),
}
ROUTERS = ("fastapi.fastapi.", "fastapi.apirouter.", "flask.flask.", "flask.blueprint.")
ROUTES = (".get", ".post", ".put", ".delete", ".patch", ".route", ".websocket", ".api_route")
URLS = ("django.urls.path", "django.urls.re_path")
PARSERS = ("argparse.argumentparser",)
COMMANDS = ("click.command", "click.group", "typer.typer.command", "typer.typer.callback")

_TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\#[^\r\n]*)|(?P<line>\r\n?|\n)|(?P<join>\\(?:\r\n?|\n))"
    r"|(?P<string>[rRbBuUfF]{0,3}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^'\\]|\\.|'(?!''))*+(?:''')?|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*+\"?|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+'?))"
    r"|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|@=|.)",
    re.S,
)
_WHOLE = re.compile(r"[a-zA-Z]*(\"\"\"|'''|\"|')(.*)\1", re.S)


class Line:
    """The tokens of a logical line, and what is counted in it whatever its file."""

    def __init__(self, tokens: list[str], width: int = 0):
        self.tokens, self.width = tokens, width
        self.branches, self.asserts = sum(t in BRANCHES for t in tokens), tokens.count("assert")
        self.called = [name for _, j, name in names(tokens) if tokens[j : j + 1] == ["("]]
        self.named = len(tokens) > 2 and is_name(tokens[0]) and tokens[1] == "="


def unended(string: str) -> bool:
    w = _WHOLE.fullmatch(string)
    return w is None or bool(len(w[2]) - len(w[2].rstrip("\\")) & 1)


def whole_line(text: str) -> Line | None:
    """A physical line that is a logical line by itself; None if it may be part of a longer one or has a fault."""
    if '"""' in text or "'''" in text:
        return None
    tokens, brackets, at, width = [], 0, 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, value, begin, at = m.lastgroup, m[0], at, m.end()
        if kind == "space":
            continue
        if not tokens:
            width = len(text[:begin].replace("\f", " ").expandtabs(8))
        if value in ("(", "[", "{"):
            brackets += 1
        elif value in (")", "]", "}"):
            brackets -= 1
        if brackets < 0 or kind in ("line", "join") or value == "\\" or kind == "string" and unended(value):
            return None
        tokens.append(value)
    return None if brackets else Line(tokens, width)


KEPT_LENGTH = 200  # characters of the longest line that is kept
kept_line = lru_cache(65_536)(whole_line)


def logical_lines(text: str, faults: set[str]) -> Iterator[tuple[int, list[str]]]:
    """(depth, tokens) of every logical line; a string keeps its quotes.  The tokens are not to be changed."""
    return ((depth, line.tokens) for depth, line in lines_of(text, faults))


def lines_of(text: str, faults: set[str]) -> Iterator[tuple[int, Line]]:
    """(depth, line) of every logical line."""
    indents, line, depth, at, n, brackets, fresh, total = [0], [], 0, 0, len(text), 0, True, 0
    bare = "\r" not in text

    def deep(width: int) -> int:
        if width > indents[-1]:
            indents.append(width)
        while width < indents[-1]:
            indents.pop()
        if width != indents[-1]:
            faults.add("indentation")
        return len(indents) - 1

    while at < n:
        if bare and fresh and not line and not brackets and (not at or text[at - 1] == "\n"):
            end = text.find("\n", at)
            end = n if end < 0 else end
            if text[at] == "#":
                at = end + 1
                continue
            found = (kept_line if end - at <= KEPT_LENGTH else whole_line)(text[at:end])
            if found:
                if found.tokens:
                    depth = deep(found.width)
                    total += len(found.tokens)
                    yield depth, found
                at = end + 1
                continue
        m = _TOKEN.match(text, at)
        kind, value, begin, at = m.lastgroup, m[0], at, m.end()
        if kind == "line":
            if not brackets:
                if line:
                    yield depth, Line(line)
                line, fresh = [], True
            continue
        if kind in ("space", "join"):
            fresh &= kind == "space"
            continue
        if fresh and not brackets:
            start = max(text.rfind("\n", 0, begin), text.rfind("\r", 0, begin)) + 1
            depth, fresh = deep(len(text[start:begin].replace("\f", " ").expandtabs(8))), False
        if kind == "string":
            if unended(value):
                faults.add("string")
        elif value in ("(", "[", "{"):
            brackets += 1
        elif value in (")", "]", "}"):
            if not brackets:
                faults.add("brackets")
            brackets = max(0, brackets - 1)
        line.append(value)
        total += 1
    if line:
        yield depth, Line(line)
    if brackets:
        faults.add("brackets")
    if total > MOST_TOKENS:
        faults.add("length")


def is_name(token: str) -> bool:
    return (token[0].isalpha() or token[0] == "_") and token not in KEYWORDS and token[-1] not in "\"'"


def names(line: list[str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, dotted name) of every name of a line."""
    i = 0
    while i < len(line):
        if is_name(line[i]):
            j = i + 1
            while j + 1 < len(line) and line[j] == "." and is_name(line[j + 1]):
                j += 2
            yield i, j, ".".join(line[i:j:2])
            i = j
        else:
            i += 1


@lru_cache(65_536)
def counted(name: str, decorator: bool, has: frozenset[str]) -> tuple[str, ...]:
    """Measures that the use of a name counts for in a file with these libraries."""
    low, out = name.lower(), []
    if has & {"fastapi", "flask", "django"} and (decorator and low.startswith(ROUTERS) and low.endswith(ROUTES) or low.startswith(URLS)):
        out.append("endpoints")
    if has & {"argparse", "click", "typer"} and (low.startswith(PARSERS) or decorator and low.startswith(COMMANDS)):
        out.append("cli_commands")
    out += [measure for measure, (libraries, starts) in USES.items() if has.intersection(libraries) and low.startswith(starts)]
    if "alembic" in has and low.startswith("alembic."):
        out += ["data_calls", "migrations"]
    if "pytest" in has and "pytest.mark.parametrize" in low:
        out.append("parameterized_cases")
    if "unittest" in has and ("unittest.mock" in low or low.endswith((".mock", ".patch"))):
        out.append("mock_usages")
    return tuple(out)


class File:
    """What is known of a file while its lines are read."""

    def __init__(self, path: str):
        self.path, self.n = path, Counter()
        self.aliases: dict[str, str] = {}
        self.instances: dict[str, str] = {}
        self.modules: set[str] = set()
        self.libraries: frozenset[str] = frozenset()
        self.around: list[tuple[int, str]] = []  # (depth, "class" or "def") of what encloses a line, by depth

    def resolve(self, name: str) -> str:
        root, dot, rest = name.partition(".")
        return self.instances.get(root, self.aliases.get(root, root)) + dot + rest

    def imported(self, module: str) -> None:
        if module:
            self.modules.add(module)
            self.n["internal_imports"] += module[0] == "."
            low = module.lstrip(".").lower()
            self.libraries |= {x for x in LIBRARIES if low == x or low.startswith(x + ".")}

    def imports(self, line: list[str]) -> None:
        if line[0] == "import":
            start = 1
            while start < len(line):
                i, j, name = next(names(line[start:]), (1, 0, ""))
                if i:
                    break
                j += start
                alias = line[j + 1] if line[j : j + 1] == ["as"] and j + 1 < len(line) else name.split(".")[0]
                self.aliases[alias] = name
                self.imported(name)
                start = line.index(",", j) + 1 if "," in line[j:] else len(line)
        elif "import" in line[2:]:
            at = line.index("import", 2)
            module = "".join(line[1:at])
            self.imported(module)
            i = at + 1
            while i < len(line):
                if is_name(line[i]):
                    name, renamed = line[i], line[i + 1 : i + 2] == ["as"] and i + 2 < len(line)
                    self.aliases[line[i + 2] if renamed else name] = f"{module.lstrip('.')}.{name}"
                    i += 2 * renamed
                i += 1

    def used(self, name: str, decorator: bool) -> None:
        if self.libraries:
            for measure in counted(name, decorator, self.libraries):
                self.n[measure] = 1 if measure == "migrations" else self.n[measure] + 1

    def based(self, name: str) -> None:
        low, has, n = name.lower(), self.libraries, self.n
        n["validation_types"] += "pydantic" in has and "pydantic.basemodel" in low
        n["data_models"] += "sqlalchemy" in has and "sqlalchemy" in low or "django" in has and "django.db.models.model" in low
        n["api_types"] += any(x in has and y in low for x, y in (("fastapi", "fastapi"), ("flask", "flask"), ("django", "django.views")))

    def read(self, depth: int, whole: Line) -> None:
        line = whole.tokens
        n, first = self.n, line[0]
        while self.around and self.around[-1][0] >= depth:
            self.around.pop()
        if first in ("import", "from"):
            self.imports(line)
        if first == "@":
            i, _, name = next(names(line[1:]), (1, 0, ""))
            if not i:
                n["decorators"] += 1
                self.used(self.resolve(name), True)
        waits = first == "async" and len(line) > 1
        if line[waits] == "def" and len(line) > waits + 1:
            name = line[waits + 1]
            method = bool(self.around) and self.around[-1][1] == "class"
            inner = any(k == "def" for _, k in self.around)
            n["methods" if method else "functions"] += 1
            n["async_units"] += waits
            n["public_symbols"] += name[0] != "_" and (method or not inner)
            n["test_cases"] += name.startswith("test_")
            n["type_annotations"] += line.count(":") + line.count("->")
            self.around.append((depth, "def"))
        elif first == "class" and len(line) > 1:
            n["classes"] += 1
            n["public_symbols"] += line[1][0] != "_"
            at = line.index("(") + 1 if "(" in line else len(line)
            i, _, base = next(names(line[at:]), (1, 0, ""))
            self.based("" if i else self.resolve(base))
            self.around.append((depth, "class"))
        n["branch_points"] += whole.branches
        n["assertions"] += whole.asserts
        if first != "@":
            n["calls"] += len(whole.called)
            target = first if whole.named else ""
            for name in whole.called:
                name = self.resolve(name)
                self.used(name, False)
                if target:
                    self.instances[target], target = name, ""
        guard = line[:3] == ["if", "__name__", "=="] and len(line) > 3 and line[3][-1] in "\"'" and "__main__" in line[3]
        if guard or self.path == "__main__.py" or self.path.endswith("/__main__.py"):
            n["entry_points"] = 1
        if "__all__" in line:
            n["public_symbols"] += sum(t[-1] in "\"'" for t in line)


def measures(path: str, text: str) -> tuple:
    """A row of SCHEMA."""
    file, faults = File(path), set()
    for depth, line in lines_of(text, faults):
        file.read(depth, line)
    file.n["imports"] = len(file.modules)
    return (*[int(file.n[c]) for c in COUNTS], "low" if faults else "medium")


def analyzed(files: DataFrame, keys: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """One row a file: the keys and SCHEMA."""
    return rows_of(files, keys, [path, text], lambda p, t: [measures(p, t)], SCHEMA)
