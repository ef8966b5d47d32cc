"""Formatting signatures by language: whether two versions of a file differ in formatting only.

A language is a style: one pattern for its tokens and a few rules about lines.  Comments go,
but for documentation and directives, which stay with their white space collapsed; strings stay as they
are, whatever ends them (fences of raw strings, heredoc words, doubled quotes), and nested comments are
counted.  A source whose strings, comments or brackets do not end has no signature, and one without
a signature never counts as formatted only.

Where lines mean something they stay tokens: Go's implicit semicolons, a jump before a line's end in
Kotlin, every line in HCL, statements in shells, indentation in Python and Compose, instructions in
Dockerfiles.  A notebook's signature is of its code and markdown cells; outputs and counts are none of it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .pythoncode import logical_lines
from .reading import rows_of

_C_COMMENT = r"(?P<doc>//[/!][^\r\n]*|/\*[*!](?:[^*]|\*(?!/))*+\*/)|(?P<drop>//[^\r\n]*|/\*(?:[^*]|\*(?!/))*+\*/)"
_QUOTED = r"\"(?:[^\"\\\r\n]|\\.)*+\"|'(?:[^'\\\r\n]|\\.)*+'"
_NAME, _NUMBER = r"[^\W\d]\w*", r"\d(?:[\w.]|(?<=[eEpP])[+-])*+|\.\d(?:[\w.]|(?<=[eE])[+-])*+"
_SIGNS = r"<<=|>>>=|>>=|&\^=|\.\.\.|\.\.=|<=>|===|!==|\?\?=|\*\*=|->|=>|::|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\?\?|\?\.|\?:|\.\.|&\^|##|."


@dataclass(frozen=True)
class Style:
    token: re.Pattern
    lines: str = ""  # which rule about lines holds
    refused: re.Pattern | None = None  # sources that have no signature
    nested: bool = False  # comments nest
    brackets: bool = True
    fold: bool = False  # letters in either case are the same
    easy: re.Pattern | None = None  # tokens within a word, where the style can read a run without quotes, slashes, backslashes and number signs at once


def style(*parts: str, **rules) -> Style:
    return Style(re.compile("|".join(parts), re.S), **rules)


_RUN = re.compile(r"[^\"'/\\#]+")
_EASY = re.compile(rf"{_NAME}|{_NUMBER}|{_SIGNS[:-1]}\S")
_NO_BRACKETS = re.compile(r"[^()\[\]{}]+")
_PAIRED = re.compile(r"\(\)|\[\]|\{\}")

STYLES = {
    "go": style(
        r"(?P<line>\r\n?|\n)|(?P<drop>[ \t\f]+)|(?P<doc>//(?:go:|\ \+build)[^\r\n]*)|(?P<drop2>//[^\r\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*+\*/)",
        rf"(?P<string>`[^`]*+`|{_QUOTED})|(?P<bad>[`\"']|/\*)|(?P<word>{_NAME})|(?P<number>{_NUMBER})|(?P<sign>{_SIGNS})", lines="go",
    ),
    "java": style(rf"(?P<space>\s+)|{_C_COMMENT}", rf"(?P<string>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|{_QUOTED})|(?P<bad>[\"']|/\*)|(?P<word>{_NAME})|(?P<number>{_NUMBER})|(?P<sign>{_SIGNS})", refused=re.compile(r"\\u"), easy=_EASY),
    "kotlin": style(
        r"(?P<line>\r\n?|\n)|(?P<space>[^\S\r\n]+)|(?P<doc>///[^\r\n]*)|(?P<drop>//[^\r\n]*)|(?P<open>/\*)",
        rf"(?P<string>\"\"\"(?:[^\"]|\"(?!\"\"))*+\"\"\"\"*|`[^`\r\n]*`|{_QUOTED})|(?P<bad>[\"'`])|(?P<word>{_NAME})|(?P<number>{_NUMBER})|(?P<sign>{_SIGNS})", lines="kotlin", nested=True,
    ),
    "rust": style(
        r"(?P<space>\s+)|(?P<doc>//[/!][^\r\n]*)|(?P<drop>//[^\r\n]*)|(?P<open>/\*)",
        rf"(?P<string>(?:br|cr|r)(?P<fence>\#*)\".*?\"(?P=fence)(?!\#)|[bc]?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\r\n]|\\[^\r\n][^'\r\n]*)')|(?P<bad>(?:br|cr|r)\#*\"|\"|'\\)|(?P<word>r\#{_NAME}|'?{_NAME})|(?P<number>{_NUMBER})|(?P<sign>{_SIGNS})", nested=True,
    ),
    "cpp": style(
        r"(?P<join>\\(?:\r\n?|\n))|(?P<line>\r\n?|\n)|(?P<space>[^\S\r\n]+)|" + _C_COMMENT,
        rf"(?P<string>(?:u8|[uUL])?R\"(?P<fence>[^\s()\\]{{0,16}})\(.*?\)(?P=fence)\"|(?:u8|[uUL])?(?:{_QUOTED}))|(?P<bad>(?:u8|[uUL])?R\"|[\"']|/\*)|(?P<word>{_NAME})|(?P<number>\.?\d(?:[\w.]|'(?=\w)|(?<=[eEpP])[+-])*+)|(?P<sign>{_SIGNS})", lines="cpp", easy=re.compile(rf"{_NAME}|\.?\d(?:[\w.]|(?<=[eEpP])[+-])*+|{_SIGNS[:-1]}\S"),
    ),
    "php": style(
        r"(?P<close>\?>)|(?P<space>\s+)|(?P<doc>/\*\*(?:[^*]|\*(?!/))*+\*/)|(?P<drop>(?://|\#(?!\[))(?:(?!\?>)[^\r\n])*|/\*(?:[^*]|\*(?!/))*+\*/)",
        rf"(?P<string><<<[ \t]*(?P<q>[\"']?)(?P<fence>\w+)(?P=q)[ \t]*\r?\n(?:.*?\n)??[ \t]*(?P=fence)\b|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|`(?:[^`\\]|\\.)*+`)|(?P<bad>[\"'`]|<<<|/\*)|(?P<word>\$?[^\W\d\\][\w\\]*|\\[\w\\]*)|(?P<number>{_NUMBER})|(?P<sign>{_SIGNS})", lines="php",
    ),
    "hcl": style(
        r"(?P<line>\r\n?|\n)|(?P<space>[^\S\r\n]+)|(?P<keep>(?:\#|//)[^\r\n]*|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<here><<-?(?P<fence>\w+)[ \t]*\r?\n(?:.*?\n)??[ \t]*(?P=fence)[ \t]*(?=\r?\n|\Z))",
        rf"(?P<bad><<|/\*)|(?P<quote>\")|(?P<word>[^\W\d][\w-]*)|(?P<number>{_NUMBER})|(?P<sign>=>|==|!=|<=|>=|&&|\|\||\.\.\.|.)", lines="hcl",
    ),
    "sql": style(r"(?P<space>\s+)|(?P<keep>--[^\r\n]*)|(?P<open>/\*)", r"(?P<string>'(?:[^'\\]|\\.|'')*+'|\"(?:[^\"\\]|\\.|\"\")*+\"|`(?:[^`\\]|\\.|``)*+`|\[(?:[^\]]|\]\])*+\]|(?P<fence>\$\w{0,64}\$).*?(?P=fence))|(?P<bad>['\"`\[]|\$\w*\$)|(?P<word>[\w$@#]+)|(?P<sign>->>|::|:=|->|=>|<=|>=|<>|!=|\|\||&&|.)", nested=True, brackets=False),
    "shell": style(
        r"(?P<join>\\(?:\r\n?|\n))|(?P<line>\r\n?|\n)|(?P<space>[ \t\f]+)|(?P<keep>\A\#![^\r\n]*)|(?P<drop>(?<![^\s;|&<>(){}])\#[^\r\n]*)",
        r"(?P<string>'[^']*+'|\"(?:[^\"\\]|\\.)*+\"|`(?:[^`\\]|\\.)*+`)|(?P<bad>['\"`])|(?P<sign>;;&|&&|\|\||;;|;&|\|&|>>|<&|>&|[;|&<>(){}])|(?P<word>(?:[^\s'\"`;|&<>(){}\\]|\\(?![\r\n]))+)", lines="shell", refused=re.compile("<<"), brackets=False,
    ),
    "powershell": style(
        r"(?P<join>`(?:\r\n?|\n))|(?P<line>\r\n?|\n)|(?P<space>[ \t\f]+)|(?P<drop2><\#(?:[^\#]|\#(?!>))*+\#>)|(?P<keep>\A\#![^\r\n]*|(?<![^\s;|&<>()\[\]{},=:])\#(?i:requires)[^\r\n]*)|(?P<drop>(?<![^\s;|&<>()\[\]{},=:])\#[^\r\n]*)",
        r"(?P<string>'(?:[^']|'')*+'|\"(?:[^\"`]|`.|\"\")*+\")|(?P<bad>['\"]|<\#)|(?P<sign>&&|\|\||>>|[;|&><()\[\]{},=:])|(?P<word>(?:[^\s'\"`;|&<>()\[\]{},=:]|`(?![\r\n]))+)", lines="shell", refused=re.compile("@[\"']"), brackets=False, fold=True,
    ),
}

# Words behind which Go ends a statement at a line's end: no keywords but these.
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()) - frozenset("break continue fallthrough return".split())
JUMPS = frozenset(["return", "throw", "break", "continue"])
PAIRS = {")": "(", "]": "[", "}": "{"}
_WORDS: dict[re.Pattern, "Words"] = {}  # what a worker keeps by style
_DEPTH = re.compile(r"/\*|\*/")
_CGO = re.compile(r'\bimport\s*(?:\([^)]*?)?"C"')
_PHP_TAG = re.compile(r"<\?(?:php(?!\w)|=)?", re.I)
_IN_QUOTE = re.compile(r"(?:[^\"\\$%]|\\.|[$%](?!\{))*+", re.S)


class Unfinished(Exception):
    """A source that has no signature."""


def collapsed(text: str) -> str:
    return " ".join(text.split())


def comment_end(text: str, at: int) -> int:
    """Where a nested comment ends whose opening mark ends at ``at``."""
    depth = 1
    while depth:
        mark = _DEPTH.search(text, at)
        if mark is None:
            raise Unfinished
        depth += 1 if mark[0] == "/*" else -1
        at = mark.end()
    return at


def quote_end(text: str, at: int) -> int:
    """Where an HCL string ends that begins at ``at``: its templates hold code, with strings of their own."""
    stack = ['"']
    at += 1
    while stack:
        if at >= len(text):
            raise Unfinished
        if stack[-1] == '"':
            at = _IN_QUOTE.match(text, at).end()
            if text[at : at + 1] == '"':
                stack.pop()
                at += 1
            elif text[at : at + 1] in ("$", "%"):
                stack.append("{")
                at += 2
            else:
                raise Unfinished
        else:
            c = text[at]
            if c in '"{':
                stack.append(c)
            elif c == "}":
                stack.pop()
            at += 1
    return at


def easy_run(text: str, at: int) -> str:
    """The run without quotes, slashes, backslashes and number signs from ``at`` that ends where a token ends."""
    m = _RUN.match(text, at)
    if m is None:
        return ""
    run, stop = m[0], m.end()
    if stop < len(text) and text[stop] in "\"'":  # what stands against a quote may belong to it
        words = run.split()
        run = run if not words or run[-1:].isspace() else run[: -len(words[-1])]
    return run


def balanced(marks: str) -> bool:
    """Does each bracket close the one that it should, with none left open?"""
    found, stack = len(marks), []
    while 8 * found > len(marks):  # most close level by level
        marks, found = _PAIRED.subn("", marks)
    for x in marks:
        if x not in PAIRS:
            stack.append(x)
        elif not stack or stack.pop() != PAIRS[x]:
            return False
    return not stack


class Words(dict):
    """Words between white space, each with its tokens, joined, and its brackets; a bounded number of short ones is kept."""

    KEPT, LONGEST = 65_536, 64

    def __init__(self, token: re.Pattern):
        self.token = token

    def __missing__(self, word: str) -> tuple[str, str]:
        value = "\x1f".join(self.token.findall(word)), _NO_BRACKETS.sub("", word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[word] = value
        return value


def tokens(text: str, spec: Style) -> Iterator[str]:
    """The tokens of a source that its signature is made of; those of a run may come as one, joined as the signature joins them."""
    if spec.refused and spec.refused.search(text):
        raise Unfinished
    at, n, marks, rule = 0, len(text), [], spec.lines
    words = _WORDS.setdefault(spec.easy, Words(spec.easy)) if spec.easy else None
    before, broken, directive, ended = "", False, False, False  # the last token; whether a line ended since; within a C directive; a Go statement may end
    cgo = rule == "go" and _CGO.search(text)
    if rule == "php" and "<?" in text:
        at = yield_html = 0
        tag = _PHP_TAG.search(text)
        if tag.start():
            yield "html:" + text[yield_html : tag.start()]
        yield tag[0].lower()
        at = tag.end()
    while at < n:
        if spec.easy and not directive and (run := easy_run(text, at)):
            at += len(run)
            some = run.split()
            if some:
                joined, brackets = zip(*map(words.__getitem__, some))
                yield "\x1f".join(joined)
                marks += brackets
                before, broken = some[-1], False
            space = run[len(run.rstrip()) :] if some else run
            broken |= "\n" in space or "\r" in space
            continue
        m = spec.token.match(text, at)
        kind, value, begin, at = m.lastgroup, m[0], at, m.end()
        if kind in ("fence", "q"):
            kind = "here" if m.groupdict().get("here") else "string"
        if kind in ("space", "drop", "drop2", "join"):
            broken |= rule == "kotlin" and kind == "drop"
            continue
        if kind == "bad":
            raise Unfinished
        if kind == "open":
            at = comment_end(text, at)
            value = text[begin:at]
            broken |= "\n" in value
            if value.startswith("/**") and len(value) > 4 or rule == "" and value.startswith("/*!"):
                kind = "doc"
            elif spec.token is STYLES["sql"].token:
                kind = "keep"
            else:
                continue
        if kind == "block":  # Go
            if cgo:
                yield value
            if "\n" in value and ended:
                yield ";"
                ended = False
            continue
        if kind == "line":
            if rule == "go" and ended:
                yield ";"
                ended = False
            if rule == "cpp" and directive:
                yield "end of directive"
                directive = False
            if rule == "shell":
                value, kind = ";", "sign"
            else:
                broken = True
                continue
        if kind in ("doc", "keep"):
            value = collapsed(value) if kind == "doc" else value.rstrip()
            value = value.lower() if spec.fold else value
        if rule == "hcl" and broken and before:
            yield "line"
        if rule == "kotlin" and broken and before in JUMPS:
            yield "line"
        if kind == "close":  # PHP
            yield value
            tag = _PHP_TAG.search(text, at)
            stop = tag.start() if tag else n
            if stop > at:
                yield "html:" + text[at:stop]
            if tag:
                yield tag[0].lower()
            at, before = tag.end() if tag else n, value
            continue
        if kind == "quote":  # HCL
            at = quote_end(text, begin)
            value = text[begin:at]
        if rule == "cpp" and value == "#" and (broken or not before):
            directive = True
        if spec.brackets and not directive and kind == "sign":
            if value in "()[]{}":
                marks.append(value)
        broken = kind == "here"
        if rule == "go":
            ended = kind in ("string", "number") or kind == "word" and value not in GO_WORDS or value in ("++", "--", ")", "]", "}")
        if rule == "kotlin" and kind == "sign" and (value == ";" or value == "," and trailing(text, at)):
            before = value
            continue
        if rule == "shell":
            if value == ";":
                if before not in ("", ";", "{"):
                    before = ";"
                continue
            if before == ";" and value not in ("{", "}"):
                yield ";"
            value = value.lower() if spec.fold and kind in ("word", "sign") else value
        yield value
        before = value
    if not balanced("".join(marks)):
        raise Unfinished
    if ended:
        yield ";"


def trailing(text: str, at: int) -> bool:
    """Whether nothing but white space and comments lies between ``at`` and a closing bracket."""
    spec = STYLES["kotlin"]
    while at < len(text):
        m = spec.token.match(text, at)
        if m.lastgroup == "open":
            at = comment_end(text, m.end())
        elif m.lastgroup in ("line", "space", "doc", "drop"):
            at = m.end()
        else:
            return m[0] in PAIRS
    return False


def python_tokens(text: str) -> Iterator[str]:
    faults: set[str] = set()
    for depth, line in logical_lines(text, faults):
        yield str(depth)
        yield from line
    if faults - {"length"}:
        raise Unfinished


_STAYS = re.compile(r"""//[^\r\n]*[\r\n]?|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|"(?:[^"\\]|\\.)*+(?:"|\Z)|'(?:[^'\\]|\\.)*+(?:'|\Z)|`(?:[^`\\]|\\.)*+(?:`|\Z)""", re.S)


def default_tokens(text: str) -> Iterator[str]:
    """White space outside strings and comments counts once; both stay as they are."""

    def between(gap: str) -> str:
        inner = " ".join(gap.split())
        return f"{' ' * gap[0].isspace()}{inner}{' ' * gap[-1].isspace()}" if inner else " " * bool(gap)

    out, at = [], 0
    for m in _STAYS.finditer(text):
        out += between(text[at : m.start()]), m[0]
        at = m.end()
    yield "".join([*out, between(text[at:])]).strip()


def docker_tokens(text: str) -> Iterator[str]:
    escape, begun, lines = "\\", False, iter(re.split(r"\r\n?|\n", text))
    for line in lines:
        bare = line.strip()
        if bare.startswith("#") or not bare:
            m = None if begun else re.fullmatch(r"#\s*(syntax|escape|check)\s*=\s*(.*?)", bare, re.I)
            if m and (m[1].lower() != "escape" or m[2] in ("\\", "`")):
                escape = m[2] if m[1].lower() == "escape" else escape
                yield f"{m[1].lower()}={m[2]}"
            continue
        begun, whole = True, line.lstrip()
        while whole.rstrip().endswith(escape):
            more = next((x.lstrip() for x in lines if x.strip() and not x.lstrip().startswith("#")), None)
            if more is None:
                raise Unfinished
            whole = f"{whole.rstrip()[:-1].rstrip()} {more}".lstrip()
        word, _, rest = whole.replace("\t", " ", 1).partition(" ") if "\t" in whole.split(" ", 1)[0] else whole.partition(" ")
        if "<<" in whole or not re.fullmatch("[A-Za-z]+", word.strip()):
            raise Unfinished
        yield word.strip().upper()
        yield rest.strip()


def compose_tokens(text: str) -> Iterator[str]:
    indents: list[int] = []
    for raw in re.split(r"\r\n?|\n", text):
        bare = raw.lstrip(" ")
        m = re.fullmatch(r"((?:[^'\"#]|'(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|(?<!\s)#)*?)\s*(?:(?:(?<=\s)|^)#.*)?", bare)
        if m is None or bare.startswith("\t"):
            raise Unfinished
        content = m[1].rstrip()
        if not content:
            continue
        if re.search(r"(?:^|[:\s-])[|>][+-]?\d?[+-]?$", content):
            raise Unfinished
        indent = len(raw) - len(bare)
        if not indents or indent > indents[-1]:
            indents.append(indent)
        elif indent not in indents:
            raise Unfinished
        del indents[indents.index(indent) + 1 :]
        yield str(len(indents) - 1)
        yield re.sub(r"^((?:-\s+)*)([\w.$/-]+|\"[^\"]*\"|'[^']*')\s*:\s+", lambda k: re.sub(r"\s+", " ", k[1]) + k[2] + ": ", re.sub(r"^-\s+", "- ", content))


def notebook_tokens(text: str) -> Iterator[str]:
    """Language, then the code and markdown cells, the first of each text, with their tags."""
    try:
        book = json.loads(text)
        cells = book["cells"]
        meta = book.get("metadata", {})
        said = [meta.get("language_info", {}).get("name", ""), meta.get("kernelspec", {}).get("language", ""), meta.get("kernelspec", {}).get("name", "")]
        families = {f for f in ("python" if "python" in str(x).lower() else str(x).strip().lower() for x in said) if f}
        yield "python" if families == {"python"} else "unknown" if not families else "+".join(sorted(families))
        seen = set()
        for cell in cells:
            source = cell["source"] if isinstance(cell["source"], str) else "".join(cell["source"])
            kind = cell["cell_type"]
            if kind == "code":
                source = re.sub(r"(?m)^\s*[%!].*$", "", source) if "python" in families or not families else source
                made = "\x1e".join(python_tokens(source))
            elif kind == "markdown":
                made = re.sub(r"\r\n?", "\n", source)
            else:
                continue
            if (kind, made) not in seen:
                seen.add((kind, made))
                yield from (kind, made, *sorted(map(str, cell.get("metadata", {}).get("tags", []))))
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
        raise Unfinished from e


def ignore_tokens(text: str) -> Iterator[str]:
    return (x.strip() for x in re.split(r"\r\n?|\n", text) if x.strip() and not x.strip().startswith("#"))


READERS: dict[str, Callable[[str], Iterator[str]]] = {
    **{k: (lambda text, s=s: tokens(text, s)) for k, s in STYLES.items()},
    "python": python_tokens, "default": default_tokens, "dockerfile": docker_tokens, "compose": compose_tokens, "dockerignore": ignore_tokens, "notebook": notebook_tokens,
}
# Endings and names by style.
ENDINGS = {
    "default": ".cs .js .jsx .mjs .cjs .ts .tsx .mts .cts", "python": ".py .pyi", "notebook": ".ipynb", "go": ".go", "java": ".java", "kotlin": ".kt .kts", "php": ".php", "rust": ".rs", "sql": ".sql",
    "cpp": ".c .cc .cpp .cxx .cppm .ixx .h .hh .hpp .hxx .inl .ipp .tpp", "hcl": ".tf .tfvars .tfbackend .hcl", "shell": ".sh .bash .ksh .bats", "powershell": ".ps1 .psm1 .psd1",
}
_BY_ENDING = {e: k for k, v in ENDINGS.items() for e in v.split()}


def style_of(path: str, head: str = "") -> str:
    """The style of a file by name, or by its interpreter; empty if formatting is not told apart there."""
    name = path.rsplit("/", 1)[-1].lower()
    if name == "dockerfile" or name.startswith("dockerfile.") or name.endswith(".dockerfile"):
        return "dockerfile"
    if name.startswith(("compose.", "docker-compose.")) and name.endswith((".yml", ".yaml")):
        return "compose"
    if name in (".dockerignore", ".terraformrc", "terraform.rc"):
        return "dockerignore" if name == ".dockerignore" else "hcl"
    if name in (".bashrc", ".bash_profile", ".profile", ".kshrc"):
        return "shell"
    dot = name.rfind(".")
    if dot < 0 and head.startswith("#!"):
        return "powershell" if "pwsh" in head.split("\n")[0] else "shell" if re.search(r"\b(?:ba|k|da)?sh\b", head.split("\n")[0]) else ""
    return _BY_ENDING.get(name[dot:], "") if dot >= 0 else ""


def signature(path: str, text: str) -> str | None:
    """Digest of a file's tokens; none where formatting cannot be told from content."""
    kind = style_of(path, text[:200])
    if not kind or "\0" in text:
        return None
    try:
        return hashlib.sha256("\x1f".join(READERS[kind](text)).encode("utf-8", "surrogatepass")).hexdigest()
    except Unfinished:
        return None


def signatures(files: DataFrame, keys: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """The keys of each file, its style, and its signature (null if it has none)."""
    return rows_of(files, keys, [path, text], lambda p, t: [(style_of(p, t[:200]), signature(p, t))], "style string, signature string")


def formatting_only(changes: DataFrame, keys: list[str], path: str = "path", before: str = "before", after: str = "after") -> DataFrame:
    """The keys of each changed file, and whether its versions differ in formatting only."""

    def read(p: str, a: str, b: str) -> list[tuple]:
        one = signature(p, a)
        return [(one is not None and one == signature(p, b),)]

    return rows_of(changes, keys, [path, before, after], read, "formatting_only boolean")
