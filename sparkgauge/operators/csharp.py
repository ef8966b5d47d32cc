"""Callable structure and reachability of C# files, one row a callable.

A file is lexed once: comments, directives and disabled regions are no tokens, strings are one, and
the holes of interpolated strings are code again (the lexer keeps a stack of the strings that it is
in).  One pass from the right over the tokens finds where a statement that began at each of them would
end; decisions then are intervals of tokens, and nesting is how many of them overlap.  Everything is
linear in the file and free of recursion, so depth of nesting is no limit.

Complexity is one plus the decisions: if, loops, catch, conditional expressions, arms and sections of a
switch, and the short-circuit operators, which do not nest.  What lies in lambdas and local
functions counts for the size only.  The outermost operator of an expression body is the body itself
and no decision in it.

A private method that nothing in its file names, outside of methods that are themselves never
named, is unreachable; methods that frameworks or other parts of a type may call (attributes, bases,
``partial``, ``extern``, ``Main``) are always kept.  A name in a string counts, for reflection.

Files whose brackets do not match give their callables with ``parsed`` false.  Null texts have none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from .reading import rows_of

SCHEMA = "name string, line int, tokens int, complexity int, nesting int, executable boolean, candidate boolean, reachable boolean, parsed boolean"

_SCAN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))"
    r"|(?P<text>(?P<marks>\$+@?|@\$?)?(?P<fence>\"{3,}|\"))"
    r"|(?P<char>'(?:\\.|[^'\\\n])*+'?)"
    r"|(?P<word>@?[^\W\d]\w*)"
    r"|(?P<number>\.?\d(?:[\w]|\.(?=\d)|(?<=[eE])[+-](?=\d))*)"
    r"|(?P<sign>>>=|\?\?=|<<=|=>|&&|\|\||\?\?|::|\+\+|--|->|==|!=|<=|>=|[-+*/%&|^]=|<<(?!<)|\.\.|(?<=\s)>>(?=\s)|.)",
    re.S,
)
#: A run without strings, characters, marks of names and comments of several lines, and its tokens.
_EASY = re.compile(r"(?:[^\"'/$@?]|/(?![/*])|//[^\n]*|\?\?=?|\?(?![.\[]))*+")
_EASY_TOKEN = re.compile(
    r"\s+|//[^\n]*|[^\W\d]\w*|\.?\d(?:[\w]|\.(?=\d)|(?<=[eE])[+-](?=\d))*"
    r"|>>=|\?\?=|<<=|=>|&&|\|\||\?\?|::|\+\+|--|->|==|!=|<=|>=|[-+*/%&|^]=|<<(?!<)|\.\.|(?<=\s)>>(?=\s)|.",
    re.S,
)
_DIRECTIVE = re.compile(r"(?m)^[ \t]*#[ \t]*(\w*)([^\n]*)$")
_LOGIC = re.compile(r"&&|\|\||==|!=|!|\(|\)|\w+")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "h{": "h}"}, {")", "]", "}", "h}"}

MODIFIERS = frozenset("public private protected internal static async override virtual abstract sealed readonly extern unsafe new partial volatile required file".split())
TYPES = frozenset("class struct interface record".split())
#: Words in front of a name with arguments that make it a call or an expression, never a local function.
NO_TYPE = frozenset("return new await throw yield else in is as case when out ref do goto not and or typeof nameof default sizeof checked unchecked if while for foreach switch lock using fixed catch".split())
HEADED = frozenset("for foreach while lock using fixed if switch catch".split())


@dataclass
class Tokens:
    kind: list[str] = field(default_factory=list)  # w word, n number, s string, p punctuation
    text: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)

    def add(self, kind: str, text: str, at: int) -> None:
        self.kind.append(kind), self.text.append(text), self.at.append(at)


def enabled(source: str) -> str:
    """The source with directives and the regions that they disable blanked; no symbols are defined but by the file."""
    if "#" not in source:
        return source
    out, at, stack, symbols = [], 0, [], set()  # stack: (taken now, taken before)

    def holds(text: str) -> bool:
        words = {"&&": "and", "||": "or", "!": "not", "true": "True", "false": "False"}
        made = " ".join(words.get(t, t if t in ("==", "!=", "(", ")") else str(t in symbols)) for t in _LOGIC.findall(text.split("//")[0]))
        try:
            return bool(eval(made, {"__builtins__": {}}))  # noqa: S307 - only constants and logic remain
        except SyntaxError:
            return False

    blank = lambda t: re.sub(r"[^\n]", " ", t)
    for m in _DIRECTIVE.finditer(source):
        piece = source[at : m.start()]
        on = all(s[0] for s in stack)
        out += [piece if on else blank(piece), blank(m[0])]
        at = m.end()
        if m[1] == "if":
            now = on and holds(m[2])
            stack.append((now, now or not on))
        elif m[1] in ("elif", "else") and stack:
            before = stack[-1][1]
            now = not before and (m[1] == "else" or holds(m[2]))
            stack[-1] = (now, before or now)
        elif m[1] == "endif" and stack:
            stack.pop()
        elif m[1] == "define" and on:
            symbols.add(m[2].strip())
    piece = source[at:]
    out.append(piece if all(s[0] for s in stack) else blank(piece))
    return "".join(out)


class _Kinds(dict):
    """Kinds of easy tokens by their text; white space and comments have none."""

    def __missing__(self, x: str) -> str:
        kind = "" if x[0].isspace() or x[:2] == "//" else "n" if x[0].isdecimal() or x[0] == "." and x[1:2].isdecimal() else "w" if x[0] == "_" or x[0].isalnum() else "p"
        if len(self) < 50_000 and len(x) < 50:
            self[x] = kind
        return kind


_KINDS = _Kinds()


def lex(source: str) -> tuple[Tokens, bool]:
    """Tokens of a source, and whether every string and comment ends."""
    out, n, at, whole = Tokens(), len(source), 0, True
    words, kinds, places = out.text.append, out.kind.append, out.at.append
    holes: list[list] = []  # strings that the lexer is within: [fence, dollars, verbatim, open brackets]

    def text(fence: str, dollars: int, verbatim: bool, at: int) -> int:
        """Read the text of an interpolated string from ``at`` to its next hole or its end."""
        nonlocal whole
        start, raw = at, len(fence) > 2
        while at < n:
            c = source[at]
            if c == '"' and source.startswith(fence, at) and not (verbatim and not raw and source.startswith('""', at)):
                if at > start:
                    out.add("s", source[start:at], start)
                out.add("p", "end", at)
                holes.pop()
                return at + len(fence)
            if c == "{":
                run = len(source) - len(source[at:].lstrip("{")) - at if raw else 2 if source.startswith("{{", at) else 1
                if run >= dollars if raw else run == 1:
                    at += run - dollars if raw else 0
                    if at > start:
                        out.add("s", source[start:at], start)
                    out.add("p", "h{", at)
                    return at + (dollars if raw else 1)
                at += run
            elif c == '"' and verbatim and not raw:
                at += 2
            elif c == "\\" and not verbatim and not raw:
                at += 2
            elif c == "\n" and not verbatim and not raw:
                break
            else:
                at += 1
        whole = False
        holes.pop()
        return at

    while at < n:
        if not holes:  # what needs no look around, in one go
            m = _EASY.match(source, at)
            if m.end() > at:
                begin, at = at, m.end()
                for value in _EASY_TOKEN.findall(source, begin, at):
                    kind = _KINDS[value]
                    if kind:
                        words(value), kinds(kind), places(begin)
                    begin += len(value)
                continue
        m = _SCAN.match(source, at)
        kind, value = m.lastgroup, m[0]
        if kind == "space" and not value.startswith("/*"):
            at = m.end()
            continue
        if kind == "word":
            words(value), kinds("w"), places(at)
            at = m.end()
            continue
        if holes and kind == "sign" and not holes[-1][3]:
            if value == "}":
                fence, dollars, verbatim, _ = holes[-1]
                out.add("p", "h}", at)
                at = text(fence, dollars, verbatim, at + (dollars if len(fence) > 2 else 1))
                continue
            if value == ":":  # the format of a hole
                out.add("p", "format", at)
                end = source.find("}", at)
                end = n if end < 0 else end
                out.add("s", source[at + 1 : end], at + 1)
                at = end
                continue
        begin, at = at, m.end()
        if m["space"] is not None:
            whole &= not value.startswith("/*") or value.endswith("*/") and len(value) > 3
        elif m["text"] is not None:
            marks, fence = m["marks"] or "", m["fence"]
            if "$" in marks:
                out.add("p", "start", begin)
                holes.append([fence, marks.count("$"), "@" in marks, 0])
                at = text(fence, marks.count("$"), "@" in marks, at)
                continue
            if len(fence) > 2:
                end = source.find(fence, at)
                stop = n if end < 0 else end + len(fence)
            else:
                body = re.compile(r'(?:[^"]|"")*+"' if marks else r'(?:\\.|[^"\\\n])*+"', re.S).match(source, at)
                end, stop = (0, body.end()) if body else (-1, at)
            whole &= end >= 0
            out.add("s", source[at : stop - len(fence)] if end >= 0 else source[at:stop], begin)
            at = stop
        elif m["char"] is not None:
            out.add("c", value, begin)
        elif m["number"] is not None:
            out.add("n", value, begin)
        else:
            if holes:
                holes[-1][3] += (value in "([{") - (value in ")]}") if len(value) == 1 else 0
            if value == "?" and source[at : at + 1] in (".", "["):
                value = "?" + source[at]  # a conditional access, whose dot or bracket is a token of its own
                out.add("p", "?.", begin)
            else:
                out.add("p", value, begin)
    return out, whole and not holes


#: Tokens from which a statement's end is told by more than the token behind.
MARKED = HEADED | CLOSE | OPEN.keys() | frozenset("; , do try finally await checked unchecked unsafe".split())


def matched(t: list[str]) -> tuple[list[int], bool]:
    """The partner of every bracket (itself where it has none), and whether all have one."""
    match, stack, sound = list(range(len(t))), [], True
    for i, x in enumerate(t):
        if x in OPEN:
            stack.append(i)
        elif x in CLOSE:
            if stack and OPEN[t[stack[-1]]] == x:
                j = stack.pop()
                match[i], match[j] = j, i
            else:
                sound = False
    return match, sound and not stack


def statement_ends(t: list[str], match: list[int]) -> tuple[list[int], list[int]]:
    """For each token: where a statement that begins there ends (exclusive), and its level's next semicolon, comma or closing bracket."""
    n = len(t)
    end, semi, stop = [n] * (n + 3), [n] * (n + 3), [n] * (n + 3)
    t = [*t, "", "", ""]
    for i in range(n - 1, -1, -1):
        x = t[i]
        if x not in MARKED and t[i + 1] != ":":
            semi[i] = e = semi[i + 1]
            stop[i] = stop[i + 1]
            end[i] = e + 1 if e < n and t[e] == ";" else min(n, e)
            continue
        over = match[i] + 1 if x in OPEN and match[i] > i else i + 1
        semi[i] = i if x == ";" or x in CLOSE else semi[over]
        stop[i] = i if x in (";", ",") or x in CLOSE else stop[over]
        headed = x in HEADED and t[i + 1] == "(" and match[i + 1] > i
        body = match[i + 1] + 1 if headed else 0
        if x == "{":
            end[i] = over
        elif x == "if" and headed:
            end[i] = end[body]
            if t[min(end[i], n)] == "else":
                end[i] = end[end[i] + 1]
        elif x == "switch" and headed:
            end[i] = match[body] + 1 if t[body] == "{" else semi[i] + 1
        elif headed and x != "catch":
            end[i] = end[body]
        elif x == "do":
            e = end[i + 1]
            end[i] = min(n, match[e + 1] + 2) if e + 1 < n and t[e] == "while" and t[e + 1] == "(" else e
        elif x in ("try", "finally"):
            e = end[i + 1]
            while t[min(e, n)] in ("catch", "finally"):
                e = clause_end(t, match, e)
            end[i] = e
        elif x == "await" and t[i + 1] in ("foreach", "using") or x in ("checked", "unchecked", "unsafe") and t[i + 1] == "{":
            end[i] = end[i + 1]
        elif t[i + 1] == ":" and x[:1].isidentifier() and x != "default":
            end[i] = end[i + 2]
        else:
            end[i] = min(n, semi[i] + (t[semi[i]] == ";"))
    return end, stop


def clause_end(t: list[str], match: list[int], i: int) -> int:
    """Where a catch or finally clause that begins at ``i`` ends."""
    j = i + 1
    while t[j] in ("(", "when"):
        j = match[j] + 1 if t[j] == "(" and match[j] > j else j + 1
    return match[j] + 1 if t[j] == "{" and match[j] > j else j


#: Tokens that a body's measures look at.
TELLING = frozenset("for foreach if while do catch switch delegate => ( && ||".split())
#: Tokens behind which a new expression begins.
BREAKS = frozenset("( [ { h{ , ; = => return throw yield : ? case when in ?? ??= += -= *= /= %= &= |= ^= <<= >>= && || !".split()) - {"??", "&&", "||", "!"}


def conditionals(t: list[str], lo: int, hi: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Intervals of conditional expressions, and the colons that belong to them."""
    found, colons = [], set()
    levels = [[lo, []]]  # [where the expression began, conditionals that are open: [start, paired]]

    def finish(level, i, keep=0):
        for start, paired in level[1][keep:]:
            if paired:
                found.append((start, i))
        del level[1][keep:]

    for i in range(lo, hi):
        x = t[i]
        level = levels[-1]
        if x in OPEN:
            levels.append([i + 1, []])
            continue
        if x in CLOSE:
            finish(level, i)
            if len(levels) > 1:
                levels.pop()
            if x == "}":
                levels[-1][0] = i + 1 if not levels[-1][1] else levels[-1][0]
            continue
        if x == "?":
            level[1].append([level[0], False])
        elif x == ":":
            k = next((k for k in range(len(level[1]) - 1, -1, -1) if not level[1][k][1]), None)
            if k is not None:
                finish(level, i, k + 1)
                level[1][k][1] = True
                colons.add(i)
        elif x in (",", ";"):
            finish(level, i)
        elif x == "=":
            level[1][:] = [c for c in level[1] if c[1]]
        if x in BREAKS:
            level[0] = i + 1
    for level in levels:
        finish(level, hi)
    return found, colons


def function_end(t: list[str], match: list[int], stop: list[int], close: int) -> int:
    """Where a function whose parameters end at ``close`` ends; 0 if there is none."""
    j = close + 1
    if t[j : j + 1] == ["where"]:
        while j < len(t) and t[j] not in ("{", "=>", ";"):
            j = match[j] + 1 if t[j] in ("(", "[") and match[j] > j else j + 1
    if t[j : j + 1] == ["{"]:
        return match[j] + 1
    if t[j : j + 1] == ["=>"]:
        return stop[j + 1] + 1
    return 0


def named(t: list[str], kind: list[str], i: int, lo: int) -> int:
    """Index of the name in front of parameters that begin at ``i`` (behind type parameters too), or -1."""
    j = i - 1
    if j > lo and t[j] == ">":
        depth = 0
        while j > lo:
            depth += (t[j] == ">") - (t[j] == "<")
            j -= 1
            if not depth:
                break
    return j if j >= lo and kind[j] == "w" and t[j] not in NO_TYPE and t[j] not in MODIFIERS else -1


def measured(tokens: Tokens, match: list[int], end: list[int], stop: list[int], lo: int, hi: int, block: bool) -> tuple[int, int]:
    """Complexity and nesting of a body, tokens lo to hi."""
    t, kind = tokens.text, tokens.kind
    spans, own = conditionals(t, lo, hi) if "?" in t[lo:hi] else ([], set())
    root = (lo, hi) in spans
    if not block:
        spans = [s for s in spans if s != (lo, hi)]
    nested, arms, plain = [], set(), []
    trailing = set()  # the while of a do
    for i in range(lo, hi):
        x = t[i]
        if x not in TELLING:
            continue
        if kind[i] == "w":
            if x in ("for", "foreach", "if") or x == "while" and i not in trailing:
                if t[i + 1 : i + 2] == ["("]:
                    spans.append((i, min(end[i], hi)))
            elif x == "do" and t[i - 1] != ".":
                spans.append((i, min(end[i], hi)))
                trailing.add(end[i + 1])
            elif x == "catch":
                spans.append((i, min(clause_end(t + ["", ""] if i + 2 >= len(t) else t, match, i), hi)))
            elif x == "switch" and t[i + 1 : i + 2] == ["("] and match[i + 1] + 1 < hi and t[match[i + 1] + 1] == "{" and t[i - 1] in ("{", "}", ";", ":", ")", "else", "do"):
                spans += sections(t, match, own, match[i + 1] + 1)
            elif x == "switch" and t[i + 1 : i + 2] == ["{"]:
                found = switch_arms(t, match, i + 1)
                spans += [s[:2] for s in found]
                arms |= {s[2] for s in found}
            elif x == "delegate":
                j = match[i + 1] + 1 if t[i + 1] == "(" else i + 1
                if t[j] == "{":
                    nested.append((i, match[j] + 1))
        elif x == "=>" and i not in arms:
            j = match[i - 1] if t[i - 1] == ")" else i - 1
            last = match[i + 1] + 1 if t[i + 1] == "{" else stop[i + 1]
            if (j, last) != (lo, hi):
                nested.append((j, last))
        elif x == "(" and match[i] > i:
            name = named(t, kind, i, lo)
            before = t[name - 1] if name > lo else ""
            if name > lo and (kind[name - 1] == "w" and before not in NO_TYPE or before in (">", "]", "?", "*")) and t[name - 1] != ".":
                last = function_end(t, match, stop, match[i])
                if last and last <= hi and not (t[match[i] + 1] == "=>" and match[i] + 1 in arms):
                    nested.append((name, last))
        elif x in ("&&", "||"):
            plain.append(i)
    if not block and not root:
        plain = without_root(t, match, lo, hi, plain)
    nested.sort()
    outer, top = [], -1
    for a, b in nested:
        if a >= top:
            outer.append((a, b))
            top = b
    inside = lambda i: any(a <= i < b for a, b in outer) if len(outer) < 8 else _within(outer, i)
    spans = sorted((s for s in set(spans) if not inside(s[0])), key=lambda s: (s[0], -s[1]))
    deepest, open_ends = 0, []
    for a, b in spans:
        while open_ends and open_ends[-1] <= a:
            open_ends.pop()
        open_ends.append(b)
        deepest = max(deepest, len(open_ends))
    return 1 + len(spans) + sum(not inside(i) for i in plain), deepest


TOLD = TELLING | BREAKS | MARKED | MODIFIERS | TYPES | NO_TYPE | frozenset("where else case default when end start format h{ h} > < ] ? * . : ~ ?. ?[ | & ||".split())


class _Shapes(dict):
    """What a body's measures see of a token: itself where they may ask for it, else that it is a name or something else."""

    def __missing__(self, x: str) -> str:
        shape = x if x in TOLD else "a" if x[:1].isidentifier() else "0"
        if len(self) < 50_000 and len(x) < 50:
            self[x] = shape
        return shape


_SHAPES = _Shapes()


@lru_cache(32_768)
def shaped(marks: str, last: bool, block: bool) -> tuple[int, int]:
    """Complexity and nesting of a body by its tokens' kinds and shapes, the token in front of it first, the one behind it last if there is one.

    What a body measures follows from these alone, so bodies of one shape are measured once a worker.
    """
    rows = marks.split("\x1f")
    tokens = Tokens([x[0] for x in rows], [x[1:] for x in rows])
    match, _ = matched(tokens.text)
    end, stop = statement_ends(tokens.text, match)
    return measured(tokens, match, end, stop, 1, len(rows) - last, block)


def _within(outer: list[tuple[int, int]], i: int) -> bool:
    from bisect import bisect_right

    k = bisect_right(outer, (i, 1 << 60)) - 1
    return k >= 0 and i < outer[k][1]


def without_root(t: list[str], match: list[int], lo: int, hi: int, plain: list[int]) -> list[int]:
    """The short-circuit operators but the one that is the whole expression."""
    level, i = [], lo
    while i < hi:
        level.append(i)
        i = match[i] + 1 if t[i] in OPEN and match[i] > i else i + 1
    if any(t[i] in ("=", "??", "=>", "throw") or t[i].endswith("=") and len(t[i]) > 1 and t[i] not in ("==", "!=", "<=", ">=") for i in level):
        return plain
    roots = [i for i in level if t[i] == "||"] or [i for i in level if t[i] == "&&"]
    return [i for i in plain if i != roots[-1]] if roots else plain


def sections(t: list[str], match: list[int], own: set[int], brace: int) -> list[tuple[int, int]]:
    """Sections of a switch statement: runs of labels with what follows."""
    starts, i, last = [], brace + 1, -1
    close = match[brace]
    while i < close:
        if t[i] == "case" or t[i] == "default" and t[i + 1] == ":":
            if last != i - 1 or not starts:
                starts.append(i)
            j = i + 1
            while j < close and (t[j] != ":" or j in own):
                j = match[j] + 1 if t[j] in OPEN and match[j] > j else j + 1
            last = i = j
        i = match[i] + 1 if t[i] in OPEN and match[i] > i else i + 1
    return list(zip(starts, [*starts[1:], close]))


def switch_arms(t: list[str], match: list[int], brace: int) -> list[tuple[int, int, int]]:
    """Arms of a switch expression: (start, end, place of its arrow)."""
    out, start, arrow, i = [], brace + 1, -1, brace + 1
    while i <= match[brace]:
        if i == match[brace] or t[i] == "," and arrow >= 0:
            if arrow >= 0:
                out.append((start, i, arrow))
            start, arrow = i + 1, -1
        elif t[i] == "=>" and arrow < 0:
            arrow = i
        i = match[i] + 1 if t[i] in OPEN and match[i] > i else i + 1
    return out


@dataclass
class Method:
    name: str
    start: int
    end: int
    line: int
    body: tuple[int, int, bool] | None  # tokens from, to, whether a block
    candidate: bool
    name_at: int


def methods(tokens: Tokens, match: list[int], source: str) -> list[Method]:
    """Methods of all types, outermost first; bodies are not entered."""
    t, kind, n = tokens.text, tokens.kind, len(tokens.text)
    out: list[Method] = []
    types: list[tuple[int, bool, bool]] = []  # (closing brace, is a type, its private methods may be unreachable)
    i = start = 0
    line, seen = 1, 0
    while i < n:
        x = t[i]
        while types and i >= types[-1][0]:
            types.pop()
            i += 1
            start = i
            x = t[i] if i < n else ""
        if i >= n:
            break
        if x in ("(", "[") and match[i] > i:
            i = match[i] + 1
        elif x == ";":
            method = declared(tokens, match, start, i, types) if types and types[-1][1] else None
            if method:
                out.append(method)
                method.end = i + 1
            i += 1
            start = i
        elif x == "=":
            while i < n and t[i] != ";" and t[i] not in CLOSE:
                i = match[i] + 1 if t[i] in OPEN and match[i] > i else i + 1
        elif x == "=>" or x == "{":
            in_type = bool(types) and types[-1][1]
            method = declared(tokens, match, start, i, types) if in_type else None
            head = t[start:i]
            if method is None and x == "{" and match[i] > i:
                word = next((w for k, w in enumerate(head) if w in TYPES and (k == 0 or head[k - 1] not in (":", ",", "where"))), "")
                if word or "namespace" in head:
                    bare = not in_type or types[-1][2]
                    sound = ":" not in upto(head, "where") and "partial" not in head and head[:1] != ["["]
                    types.append((match[i], bool(word), bare and sound if word else True))
                    i += 1
                    start = i
                    continue
            if x == "{":
                end = match[i] + 1 if match[i] > i else i + 1
                body = (i + 1, end - 1, True)
            else:
                end = i + 1
                while end < n and t[end] != ";" and t[end] not in CLOSE:
                    end = match[end] + 1 if t[end] in OPEN and match[end] > end else end + 1
                body = (i + 1, min(end, n), False)
                end = min(n, end + 1)
            if method:
                method.body, method.end = body, end
                out.append(method)
            i = end
            if not (i < n and t[i] == "=" and x == "{"):  # the initial value of a property
                start = i
        else:
            i += 1
    for m in out:
        line += source.count("\n", seen, tokens.at[m.name_at])
        seen = tokens.at[m.name_at]
        m.line = line
    return out


def upto(words: list[str], mark: str) -> list[str]:
    return words[: words.index(mark)] if mark in words else words


def declared(tokens: Tokens, match: list[int], lo: int, hi: int, types: list) -> Method | None:
    """The method that a member's head (tokens lo to hi) declares, if it declares one."""
    t, kind = tokens.text, tokens.kind
    i = lo
    while i < hi and t[i] == "[" and match[i] > i:
        i = match[i] + 1
    attributes, first = i > lo, i
    words = set(t[i:hi])
    if words & {"operator", "delegate", "event", "this"} and "(" in words and ("operator" in words or "delegate" in words):
        return None
    while i < hi:
        if t[i] == "(" and match[i] > i:
            name = named(t, kind, i, first)
            if name > first:
                begin = name
                while begin - 2 >= first and t[begin - 1] in (".", "::"):
                    begin -= 2
                    while begin > first and t[begin] == ">":
                        begin -= 1
                kept = [k for k in range(first, begin) if t[k] not in MODIFIERS]
                if kept and t[begin - 1] not in ("~", "=", ".") and not set(t[k] for k in kept) & TYPES:
                    modifiers = set(t[first:begin])
                    bounded = "private" in modifiers and t[name] != "Main" and not modifiers & {"partial", "extern"} and not attributes and types[-1][2]
                    return Method(t[name].lstrip("@"), lo, hi, 0, None, bounded, name)
                return None
            i = match[i] + 1
        elif t[i] == "[" and match[i] > i:
            i = match[i] + 1
        else:
            i += 1
    return None


def reached(tokens: Tokens, found: list[Method]) -> list[bool]:
    """Which methods are reachable: all but candidates that nothing reachable names."""
    by_name: dict[str, list[int]] = {}
    for k, m in enumerate(found):
        if m.candidate:
            by_name.setdefault(m.name, []).append(k)
    if not by_name:
        return [True] * len(found)
    owner, declares = {}, {found[k].name_at for ks in by_name.values() for k in ks}
    uses: dict[int, set[str]] = {}
    spans = sorted((found[k].start, found[k].end, k) for ks in by_name.values() for k in ks)
    at = 0
    for i, (kind, text) in enumerate(zip(tokens.kind, tokens.text)):
        if kind in "ws" and i not in declares:
            name = text.lstrip("@") if kind == "w" else text
            if name in by_name:
                while at < len(spans) and spans[at][1] <= i:
                    at += 1
                owner = spans[at][2] if at < len(spans) and spans[at][0] <= i else -1
                uses.setdefault(owner, set()).add(name)
    seen, pending = set(), [-1]
    while pending:
        for name in uses.get(pending.pop(), ()):
            for k in by_name[name]:
                if k not in seen:
                    seen.add(k)
                    pending.append(k)
    return [not m.candidate or k in seen for k, m in enumerate(found)]


def callables_of(source: str) -> list[tuple]:
    """Rows of SCHEMA for one file."""
    source = enabled(source)
    tokens, whole = lex(source)
    match, sound = matched(tokens.text)
    found = methods(tokens, match, source)
    out = []
    if whole and sound:
        marks = list(map(str.__add__, tokens.kind, map(_SHAPES.__getitem__, tokens.text)))
        sizes = lambda lo, hi, block: (shaped if hi - lo < 2_000 else shaped.__wrapped__)("\x1f".join(marks[lo - 1 : hi + 1]), hi < len(marks), block)
    else:
        end, stop = statement_ends(tokens.text, match)
        sizes = lambda *body: measured(tokens, match, end, stop, *body)
    for m, live in zip(found, reached(tokens, found)):
        complexity, nesting = sizes(*m.body) if m.body else (0, 0)
        out.append((m.name, m.line, m.end - m.start, complexity, nesting, m.body is not None, m.candidate, live, whole and sound))
    return out


def callables(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a method of each file: the keys, its place, and SCHEMA."""
    return rows_of(files, keys, [text], callables_of, SCHEMA, "place")
