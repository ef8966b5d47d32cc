"""JavaScript and TypeScript: callables with their structure, and measures of a file.

A file is lexed once.  What a slash begins follows from the token before it; the holes of template
literals and of JSX are code again, so the lexer keeps a stack of what it is within.  Semicolons that line ends stand for
are put in as empty tokens, which no size counts.  Then one pass from the right tells where a statement
that begins at a token would end, and one from the left where conditional expressions and arrow functions end.
Decisions are intervals of tokens; each belongs to the innermost callable that it begins in, and
nesting is how many intervals of one callable overlap.  All of it is linear and free of recursion.

Callables are functions, arrow functions and methods; a method's size begins at its parameters.  Complexity is one plus
the decisions: if, loops, catch, conditional expressions, each case and default of a switch, and && || ??, which do not nest.

Limits: function types written with an arrow count as arrow functions, types by ``? :`` as conditional
expressions.  Files whose brackets do not match or whose literals do not end have ``parsed`` false.

A file is read in pieces where a line begins with a word that begins a declaration: a piece whose brackets, literals and last statement
end reads the same by itself as within its file, so a worker keeps what it read of short pieces, and equal ones are lexed once.
Where a piece does not end so, the rest of the file is read as one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame

from .csharp import CLOSE, OPEN, matched
from .reading import rows_of

SCHEMA = "name string, line int, tokens int, complexity int, nesting int, parsed boolean"

_SCAN = re.compile(
    r"[ \t]*(?:(?P<space>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))"
    r"|(?P<text>\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?)"
    r"|(?P<word>#?(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<number>\.?\d(?:\w|\.(?=\w)|(?<=[eE])[+-](?=\d))*)"
    r"|(?P<optional>\?(?=\s*[:),;\]]))"
    r"|(?P<sign>>>>=|>>>|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|==|!=|<=|>=|\*\*|[-+*/%&|^]=|<<|.))",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*+", re.S)
_TAG = re.compile(r"(?P<space>\s+|/\*.*?\*/|//[^\n]*)|(?P<text>\"[^\"]*\"?|'[^']*'?)|(?P<word>[^\s<>/={}\"']+)|(?P<sign>/>|.)", re.S)
_CHILD = re.compile(r"[^<{]*")
_JSX = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*(?:,|extends\b))(?=[\s/>]))")

# Words of the language.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await default extends".split())
UNFINISHED = BEFORE_VALUE - {"return", "yield"} | frozenset("let const var function class export import async static get set if for while with switch try finally catch interface enum type public private protected readonly abstract declare namespace from as satisfies implements".split())
HEADED = frozenset("if for while with switch catch".split())
NO_CALL = HEADED | BEFORE_VALUE - {"of"} | frozenset("function async import let const var class".split())
CONTINUES = frozenset("; , . ?. ( [ { ) ] } h} ? ?o : = => && || ?? == != === !== < > <= >= + - * / % ** & | ^ << >> >>> += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= in instanceof of as satisfies".split())
ASSIGNS = frozenset("= += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??=".split())
BREAKS = frozenset("( [ { h{ , ; => : ? ... return throw yield await case else do".split()) | ASSIGNS


class Tokens:
    """Kinds (w word, n number, s text, r regular expression, x of a tag, p other, v a semicolon put in), texts and places."""

    def __init__(self, source: str, jsx: bool = True):
        self.source, self.jsx = source, jsx
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.broken: list[bool] = []  # does a line end before the token?
        self.headers: set[int] = set()  # closing brackets of conditions and the like
        self.whole = True
        self._lex()

    def _add(self, kind: str, text: str, at: int, broken: bool = False) -> None:
        self.kind.append(kind), self.text.append(text), self.at.append(at), self.broken.append(broken)

    def _value_next(self, closed: bool) -> bool:
        """May a value begin behind the last token?  ``closed``: does the last bracket, if one came last, leave a statement open?"""
        if not self.kind:
            return True
        kind, text = self.kind[-1], self.text[-1]
        if kind == "w":
            return text in BEFORE_VALUE and self.text[-2:-1] != ["."]
        if kind != "p":
            return False
        return closed if text in (")", "}") else text not in ("]", "++", "--", "`end")

    def _lex(self) -> None:
        source, n, at = self.source, len(self.source), 0
        if source.startswith("#!"):
            at = source.find("\n") if "\n" in source else n
        within: list[list] = []  # [template, tag or child, open brackets, open elements]
        brackets: list[bool] = []  # of each open bracket: does a statement begin behind its partner?
        closed = broken = False
        while at < n:
            m = _SCAN.match(source, at)
            kind = m.lastgroup
            value, begin, at = m[kind], m.start(kind), m.end()
            if kind == "space":
                broken |= "\n" in value
                if value.startswith("/*") and (len(value) < 4 or not value.endswith("*/")):
                    self.whole = False
                continue
            if kind == "word":
                self._add("w", value, begin, broken)
            elif kind == "number":
                self._add("n", value, begin, broken)
            elif kind == "text":
                self.whole &= len(value) > 1 and value[-1] == value[0]
                self._add("s", value, begin, broken)
            elif kind == "optional":
                self._add("p", "?o", begin, broken)
            elif value == "`":
                self._add("p", "`", begin, broken)
                at = self._template(at, within)
            elif value in ("/", "/=") and self._value_next(closed):
                r = _REGEX.match(source, begin)
                self._add("r" if r else "p", r[0] if r else value, begin, broken)
                at = r.end() if r else at
            elif value == "<" and self.jsx and self._value_next(closed) and _JSX.match(source, begin):
                at = self._element(begin, "child", 0, within)
            elif value == "}" and within and within[-1][1] == 0:
                state, _, depth = within.pop()
                self._add("p", "h}", begin, broken)
                at = self._template(at, within) if state == "template" else self._element(at, state, depth, within)
            else:
                if value in ("(", "[", "{"):
                    before = self.text[-1] if self.text else ";"
                    if value == "(":
                        brackets.append(before in HEADED and self.text[-2:-1] not in (["."], ["?."]) or self.text[-2:] == ["for", "await"])
                    else:
                        held = brackets[-1] if brackets and before == ":" else True
                        brackets.append(value == "{" and held and not (self.kind and (self.kind[-1] == "w" and before in BEFORE_VALUE - {"else", "do", "default"} or self.kind[-1] == "p" and before not in (";", "{", "}", ")", "=>", ":", "h}"))))
                    if within:
                        within[-1][1] += 1
                elif value in (")", "]", "}"):
                    closed = brackets.pop() if brackets else True
                    if value == ")" and closed:
                        self.headers.add(len(self.kind))
                    if within:
                        within[-1][1] -= 1
                self._add("p", value, begin, broken)
            broken = False
        self.whole &= not within

    def _template(self, at: int, within: list[list]) -> int:
        """Read the text of a template from ``at`` to its next hole or its end."""
        m = _TEMPLATE.match(self.source, at)
        if m.end() > at:
            self._add("s", m[0], at)
        at = m.end()
        if self.source.startswith("`", at):
            self._add("p", "`end", at)
            return at + 1
        if self.source.startswith("${", at):
            self._add("p", "h{", at)
            within.append(["template", 0, 0])
            return at + 2
        self.whole = False
        return len(self.source)

    def _element(self, at: int, state: str, depth: int, within: list[list]) -> int:
        """Read tags and text from ``at`` to the next hole or the end of the outermost element."""
        source, n = self.source, len(self.source)
        closing = False
        while at < n:
            if state == "child":
                m = _CHILD.match(source, at)
                if m[0].strip():
                    self._add("s", m[0], at)
                at = m.end()
                if at >= n:
                    break
                if source[at] == "{":
                    self._add("p", "h{", at)
                    within.append(["child", 0, depth])
                    return at + 1
                closing = source.startswith("</", at)
                self._add("x", "</" if closing else "<", at)
                at += 2 if closing else 1
                state = "tag"
                continue
            m = _TAG.match(source, at)
            value, kind = m[0], m.lastgroup
            if kind != "space":
                if value == "{":
                    self._add("p", "h{", at)
                    within.append(["tag", 0, depth])
                    return at + 1
                self._add("x", value, at)
            at = m.end()
            if value in (">", "/>") and kind == "sign":
                depth += 0 if value == "/>" else -1 if closing else 1
                if depth <= 0:
                    return at
                state = "child"
        self.whole = False
        return n


def with_line_ends(tokens: Tokens) -> tuple[list[str], list[str], list[int], set[int]]:
    """Texts, kinds, how many real tokens stand before each, and closing brackets of headers, with semicolons put in where line ends stand for them."""
    t, kind, real, headers, opened = [], [], [], set(), []
    kinds, broken, closing = tokens.kind, tokens.broken, tokens.headers
    done: list[str] = []  # what stood before the bracket that closed last
    for i, x in enumerate(tokens.text):
        if broken[i] and t and (not opened or opened[-1][0] in ("{", "h{")):
            last, last_kind = t[-1], kind[-1]
            ends = last_kind in "nsrx" or last_kind == "w" and (last not in UNFINISHED or t[-2:-1] in (["."], ["?."])) or last in ("]", "++", "--", "`end") or last == ")" and len(t) - 1 not in headers or last == "}" and done[-1:] != ["do"]
            starts = x not in CONTINUES or kinds[i] != "p" and x not in ("in", "instanceof", "of", "as", "satisfies")
            if ends and starts and x not in ("catch", "finally") and not (x == "else" and last == "}") and not (x == "`"):
                t.append(";"), kind.append("v"), real.append(i)
        k = kinds[i]
        if k == "p":
            if x in OPEN:
                opened.append((x, t[-1] if t else ""))
            elif x in CLOSE and opened:
                done = [opened.pop()[1]]
            if i in closing:
                headers.add(len(t))
        t.append("''" if k == "s" or k == "r" else x)
        kind.append(k)
        real.append(i)
    return t, kind, [*real, len(tokens.text)], headers


def statement_ends(t: list[str], match: list[int]) -> list[int]:
    """For each token: where a statement that begins there ends (exclusive)."""
    n = len(t)
    end, semi = [n] * (n + 3), [n] * (n + 3)
    t = [*t, "", "", ""]
    for i in range(n - 1, -1, -1):
        x = t[i]
        over = match[i] + 1 if x in OPEN and match[i] > i else i + 1
        semi[i] = i if x == ";" or x in CLOSE else semi[over]
        head = i + 2 if x == "for" and t[i + 1] == "await" else i + 1
        headed = x in HEADED and t[head] == "(" and match[head] > head
        if x == "{":
            end[i] = over
        elif headed and x in ("if", "for", "while", "with", "switch"):
            end[i] = end[match[head] + 1]
            if x == "if" and t[min(end[i], n)] == "else":
                end[i] = end[end[i] + 1]
        elif x == "do":
            e = end[i + 1]
            end[i] = min(n, match[e + 1] + 1) if t[min(e, n)] == "while" and t[e + 1] == "(" else e
        elif x in ("try", "finally"):
            e = end[i + 1]
            while t[min(e, n)] in ("catch", "finally"):
                e = catch_end(t, match, e)
            end[i] = e
        elif x in ("function", "class") or x == "async" and t[i + 1] == "function":
            j = i + 1
            while j < n and t[j] not in ("{", ";") and t[j] not in CLOSE:
                j = match[j] + 1 if t[j] in OPEN and match[j] > j else j + 1
            end[i] = match[j] + 1 if t[j] == "{" else min(n, j + (t[j] == ";"))
        elif t[i + 1] == ":" and x[:1].isidentifier() and x != "default":
            end[i] = end[i + 2]
        else:
            end[i] = min(n, semi[i] + (t[semi[i]] == ";"))
    return end


def catch_end(t: list[str], match: list[int], i: int) -> int:
    """Where the clause that begins at ``i`` ends."""
    j = i + 1
    if t[j] == "(":
        j = match[j] + 1
    return match[j] + 1 if j < len(match) and t[j] == "{" and match[j] > j else j


def expressions(t: list[str], match: list[int], headers: set[int]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Intervals of conditional expressions, and where the function of each arrow with no block ends."""
    found: list[tuple[int, int]] = []
    arrows: dict[int, int] = {}
    levels: list[list] = [[0, [], []]]  # [where the expression began, what is open: [arrow or start, is an arrow, paired], conditionals without their colon]

    def finish(level, i, keep=0):
        for start, arrow, paired in level[1][keep:]:
            if arrow:
                arrows[start] = i
            elif paired:
                found.append((start, i))
        del level[1][keep:]
        if not keep:
            level[2].clear()

    for i, x in enumerate(t):
        level = levels[-1]
        if x in OPEN:
            levels.append([i + 1, [], []])
            continue
        if x in CLOSE:
            finish(level, i)
            if len(levels) > 1:
                levels.pop()
            if i in headers or x == "}" and not levels[-1][1]:
                levels[-1][0] = i + 1
            continue
        if x == "?":
            level[2].append(len(level[1]))
            level[1].append([level[0], False, False])
        elif x == ":":
            if level[2]:
                k = level[2].pop()
                finish(level, i, k + 1)
                level[1][k][2] = True
        elif x == "=>":
            if t[i + 1 : i + 2] == ["{"]:
                arrows[i] = match[i + 1] + 1
            else:
                level[1].append([i, True, False])
        elif x in (",", ";"):
            finish(level, i)
        if x in BREAKS:
            level[0] = i + 1
    for level in levels:
        finish(level, len(t))
    return found, arrows


def arrow_start(t: list[str], kind: list[str], match: list[int], i: int) -> int:
    """Where the parameters of an arrow begin, ``async`` included; a written result type is passed over."""
    j = i - 1
    if j >= 0 and t[j] != ")" or j >= 0 and match[j] == j:
        k = j
        while k > 0 and t[k] not in (",", ";", "=", "(", "[", "{", "=>", "return", "?") and not (t[k] == ":" and t[k - 1] == ")"):
            k = match[k] - 1 if t[k] in CLOSE and match[k] < k else k - 1
        before = match[k - 1] - 1 if k > 0 and t[k] == ":" else -1
        if k > 0 and t[k] == ":" and not (before >= 0 and kind[before] == "w" and t[before] not in ("async", "return", "default")):
            j = k - 1
    j = match[j] if j >= 0 and t[j] == ")" else max(j, 0)
    return j - 1 if j and t[j - 1] == "async" else j


def given_name(t: list[str], kind: list[str], i: int) -> str:
    """The name that what begins at ``i`` is assigned to."""
    if i > 1 and t[i - 1] in ("=", ":") and kind[i - 2] == "w":
        return t[i - 2]
    return ""


def callables_in(t: list[str], kind: list[str], match: list[int], arrows: dict[int, int]) -> list[tuple[int, int, str, str]]:
    """(start, end, name, kind: function, arrow or method) of all functions, arrow functions and methods with a body."""
    out, n = [], len(t)
    for i, x in enumerate(t):
        if x == "function" and kind[i] == "w" and t[i - 1 : i] not in (["."], ["?."]):
            j = i + 1
            while j < n and t[j] != "(" and t[j] != ";":
                j += 1
            name = next((t[k] for k in range(i + 1, min(j, n)) if kind[k] == "w"), "")
            end = body_end(t, match, j)
            start = i - 1 if i and t[i - 1] == "async" else i
            if end:
                out.append((start, end, name or given_name(t, kind, start), "function"))
        elif x == "=>" and i in arrows:
            start = arrow_start(t, kind, match, i)
            out.append((start, arrows[i], given_name(t, kind, start), "arrow"))
        elif x == "(" and i and match[i] > i:
            j = i - 1
            if t[j] == ">":  # type parameters
                while j > 0 and t[j] not in ("<", ";", "(", ")", "{", "}"):
                    j -= 1
                j -= 1 if t[j] == "<" else j + 1
            named = j >= 0 and (kind[j] == "w" and t[j] not in HEADED and t[j] not in ("function", "super") or kind[j] in "sn" or t[j] == "]")
            if not named or kind[j] == "w" and (t[j - 1 : j] in (["."], ["?."], ["new"], ["function"]) or t[j - 2 : j] == ["function", "*"]):
                continue
            end = body_end(t, match, i)
            if end:
                out.append((i, end, t[j] if kind[j] == "w" else "", "method"))
    return sorted(out, key=lambda c: (c[0], -c[1]))


def body_end(t: list[str], match: list[int], i: int) -> int:
    """Where the block behind parameters that begin at ``i`` ends; 0 without one.  A result type may stand between."""
    if i >= len(t) or t[i] != "(" or match[i] <= i:
        return 0
    j = match[i] + 1
    if t[j : j + 1] == [":"]:
        j += 1
        while j < len(t) and (t[j] not in ("{", ";", ",", "=>", "=", ":", "?", "(") and t[j] not in CLOSE or t[j] == "{" and t[j - 1] in (":", "|", "&")):
            j = match[j] + 1 if t[j] in OPEN and match[j] > j else j + 1
    return match[j] + 1 if t[j : j + 1] == ["{"] and match[j] > j else 0


def decisions(t: list[str], kind: list[str], match: list[int], end: list[int], conditional: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Intervals of decisions that nest, and the places of those that do not."""
    spans, plain, trailing = list(conditional), [], set()
    for i, x in enumerate(t):
        if kind[i] == "w" and t[i - 1 : i] not in (["."], ["?."]):
            after = t[i + 1 : i + 2]
            if x in ("if", "while", "for") and (after == ["("] or x == "for" and after == ["await"]) and i not in trailing:
                spans.append((i, end[i]))
            elif x == "do" and after != [":"]:
                spans.append((i, end[i]))
                trailing.add(end[i + 1])
            elif x == "catch" and after in (["("], ["{"]):
                spans.append((i, catch_end(t, match, i)))
            elif x == "switch" and after == ["("] and t[match[i + 1] + 1 : match[i + 1] + 2] == ["{"]:
                brace = match[i + 1] + 1
                close, starts, j = match[brace], [], brace + 1
                while j < close:
                    if kind[j] == "w" and (t[j] == "case" or t[j] == "default" and t[j + 1] == ":") and t[j - 1] != ".":
                        starts.append(j)
                    j = match[j] + 1 if t[j] in OPEN and match[j] > j else j + 1
                spans += zip(starts, [*starts[1:], close])
        elif x in ("&&", "||", "??") and kind[i] == "p":
            plain.append(i)
    return spans, plain


class Read:
    """What one file holds: tokens with line ends, brackets, callables, decisions."""

    def __init__(self, source: str, jsx: bool = True, more: bool = False):
        """``more``: a line that begins a declaration follows; ``closed`` then tells whether a statement ends in front of it."""
        self.tokens = Tokens(source, jsx)
        if more:
            self.tokens._add("w", "export", len(source), True)
        self.t, self.kind, self.real, self.headers = with_line_ends(self.tokens)
        if more:
            for x in (self.t, self.kind, self.real, self.tokens.kind, self.tokens.text, self.tokens.at, self.tokens.broken):
                x.pop()
        self.match, sound = matched([x if k == "p" else "" for x, k in zip(self.t, self.kind)])
        self.parsed = self.tokens.whole and sound
        self.closed = more and self.parsed and self.t[-1:] in ([], [";"])
        tags, self.t = self.t, [x if k != "x" else "" for x, k in zip(self.t, self.kind)]
        self.elements = [tags[i + 1] for i, (x, k) in enumerate(zip(tags, self.kind)) if k == "x" and x == "<" and i + 1 < len(tags)]
        conditional, arrows = expressions(self.t, self.match, self.headers)
        self.callables = callables_in(self.t, self.kind, self.match, arrows)
        self.nesting, self.logic = decisions(self.t, self.kind, self.match, statement_ends(self.t, self.match), conditional)


def structure(file: Read) -> list[tuple]:
    """Name, line, tokens, complexity and nesting of each callable."""
    found, real, tokens = file.callables, file.real, file.tokens
    events = sorted([(a, 1, b) for a, b in file.nesting] + [(i, 2, i) for i in file.logic], key=lambda e: (e[0], e[1], -e[2]))
    complexity, nesting, ends = [1] * len(found), [0] * len(found), [[] for _ in found]
    inside, k = [], 0  # callables that the event lies in, and the next to begin
    for at, what, stop in events:
        while k < len(found) and found[k][0] <= at:
            while inside and found[inside[-1]][1] <= found[k][0]:
                inside.pop()
            inside.append(k)
            k += 1
        while inside and found[inside[-1]][1] <= at:
            inside.pop()
        if not inside:
            continue
        own = inside[-1]
        complexity[own] += 1
        if what == 1:
            stack = ends[own]
            while stack and stack[-1] <= at:
                stack.pop()
            stack.append(stop)
            nesting[own] = max(nesting[own], len(stack))
    lines = [m.start() for m in re.finditer("\n", tokens.source)]
    return [(c[2], bisect_right(lines, tokens.at[real[c[0]]]) + 1, max(1, real[c[1]] - real[c[0]]), d, e) for c, d, e in zip(found, complexity, nesting)]


_CUT = re.compile(r"(?m)^(?:[ \t]*//[^\n]*\n)*(?=(?:export|import|function|class|const|let|var)\b)")
KEPT_PIECES, KEPT_LENGTH = 32_768, 2_000  # pieces that a worker keeps, and characters of the longest of them
_HEAD = re.compile(r"((?:export +)?(?:async +)?function +)([^\W\d]\w*)(?=[ (])")
NAMELESS = "\u01c3"  # a letter in place of a declared function's name
WORDS = UNFINISHED | HEADED | BEFORE_VALUE | frozenset("catch finally while function require super in instanceof of as satisfies".split())


def piecewise(source: str, path: str, read):
    """What ``read(piece, jsx, more)`` tells of the pieces of a file, each with how many lines stand in front of it and the name that NAMELESS stands for.

    ``read`` gives a value and whether the piece ends all that it begins.
    """
    jsx, kept = not path.endswith((".ts", ".mts", ".cts")), read.__wrapped__
    at = line = 0
    cuts = _CUT.finditer(source)
    while at <= len(source):
        cut = next(cuts, None)
        if cut is None or cut.end() > at:  # an empty piece says nothing
            stop, after = (cut.start(), cut.end()) if cut else (len(source), len(source) + 1)
            piece, name = source[at:stop], NAMELESS
            head = _HEAD.match(piece)
            if head and head[2] not in WORDS and NAMELESS not in piece:
                name, piece = head[2], f"{head[1]}{NAMELESS}{piece[head.end() :]}"
            value, closed = (read if len(piece) <= KEPT_LENGTH else kept)(piece, jsx, cut is not None)
            if cut and not closed:
                value, name, after = kept(source[at:], jsx, False)[0], NAMELESS, len(source) + 1
            yield line, name, value
            line += source.count("\n", at, after)
            at = after


@lru_cache(KEPT_PIECES)
def structured(piece: str, jsx: bool, more: bool) -> tuple[tuple, bool]:
    file = Read(piece, jsx, more)
    return (structure(file), file.parsed), file.closed


def callables_of(source: str, path: str = "") -> list[tuple]:
    """Rows of SCHEMA for one file."""
    pieces = list(piecewise(source, path, structured))
    parsed = all(sound for *_, (_, sound) in pieces)
    return [(own if name == NAMELESS else name, line + at, *sizes, parsed) for line, own, (rows, _) in pieces for name, at, *sizes in rows]


def callables(files: DataFrame, keys: list[str], text: str = "text", path: str = "path") -> DataFrame:
    """One row a callable of each file: the keys, its place, and SCHEMA."""
    return rows_of(files, keys, [text, path], callables_of, SCHEMA, "place")


# Packages by the family that an import of them shows; a name with a slash at its end stands for all below it.
FAMILIES = {
    "ui": "react react-dom vue svelte @angular/core solid-js preact".split(),
    "full-stack": "next nuxt @sveltejs/kit".split(),
    "server": "express @nestjs/ fastify hono koa elysia @apollo/server graphql-yoga".split(),
    "data": "prisma @prisma/client drizzle-orm typeorm sequelize mongoose knex kysely pg mysql2 better-sqlite3".split(),
    "integration": "axios stripe twilio @sendgrid/mail firebase firebase-admin amqplib kafkajs socket.io graphql-request @grpc/grpc-js @aws-sdk/ @azure/".split(),
    "security": "passport next-auth @auth/core jose jsonwebtoken bcrypt bcryptjs argon2 helmet".split(),
    "validation": "zod yup joi ajv valibot class-validator".split(),
    "background": "bullmq bull agenda node-cron bree".split(),
    "test-unit": "vitest jest mocha jasmine ava".split(),
    "test-e2e": "@playwright/test cypress puppeteer webdriverio".split(),
    "test-integration": "supertest testcontainers @pact-foundation/pact".split(),
    "test-component": "@testing-library/react @testing-library/vue @testing-library/svelte".split(),
    "test-accessibility": "jest-axe @axe-core/playwright".split(),
}
# What a call of a name counts for, always, with a receiver of the chain, or beside an import of a family.
HTTP = frozenset("get post put patch delete options head all Get Post Put Patch Delete Options Head All".split())
ROUTERS = frozenset("app router server fastify hono route api".split())
STORES = frozenset("db prisma repository model query".split())
CLIENTS = frozenset("axios stripe twilio firebase kafka socket".split())
QUERIES = frozenset("findMany findUnique findFirst insert select transaction aggregate upsert".split())
CALLS = {
    "state_usages": "useState useReducer useContext createStore configureStore createSlice signal ref reactive".split(),
    "effect_usages": "useEffect useLayoutEffect watch watchEffect onMount".split(),
    "form_usages": "useForm createForm".split(),
    "integration_calls": ["fetch"],
    "security_usages": "authenticate authorize signIn signOut hashPassword verifyToken useGuards".split(),
    "validation_usages": "safeParse validateOrReject validateSync".split(),
    "background_usages": "schedule cron processJob enqueue".split(),
    "test_cases": "test it".split(),
    "test_suites": "describe suite".split(),
    "assertions": "expect assert assertThat".split(),
    "mock_usages": "mock spyOn stub vi jest".split(),
}
FAMILY_CALLS = {
    "data_calls": ("data", "connect createConnection".split()),
    "integration_calls": ("integration", "send request publish consume upload download create".split()),
    "security_usages": ("security", "sign verify hash compare use".split()),
    "validation_usages": ("validation", "parse validate check".split()),
    "background_usages": ("background", "add process repeat run start".split()),
    "component_tests": ("test-component", "render renderHook mount shallow".split()),
    "end_to_end_tests": ("test-e2e", "goto visit locator".split()),
}
DECORATORS = {
    "controllers": "Controller Resolver".split(),
    "endpoints": sorted(HTTP),
    "graphql_operations": "Query Mutation Subscription ResolveField".split(),
    "data_calls": "Entity Column Schema Prop".split(),
    "security_usages": "UseGuards Roles Public Permissions".split(),
    "validation_usages": "IsString IsNumber IsEmail ValidateNested Min Max".split(),
    "background_usages": "Processor Process Cron Interval Timeout".split(),
}
MEASURES = tuple(
    "imports dynamic_imports exports functions methods async_units classes interfaces type_aliases enums branch_points calls decorators jsx_elements "
    "endpoints controllers graphql_operations state_usages effect_usages form_usages data_calls integration_calls security_usages validation_usages background_usages "
    "test_cases test_suites assertions mock_usages component_tests end_to_end_tests".split()
)
_ALWAYS = {n: m for m, names in CALLS.items() for n in names}
_DECORATED = {n: m for m, names in DECORATORS.items() for n in names}
_FAMILY = {n: [(m, f) for m, (f, names) in FAMILY_CALLS.items() if n in names] for _, names in FAMILY_CALLS.values() for n in names}


def family(package: str) -> str | None:
    """The family of a package by its name, in any case."""
    name = package.lower()
    return next((f for f, names in FAMILIES.items() for n in names if name == n or n.endswith("/") and name.startswith(n)), None)


def chain(t: list[str], i: int, most: int = 6) -> list[str]:
    """Names in front of the member at ``i``: of ``a.b.c`` at c, b and a."""
    out = []
    while len(out) < most and i > 1 and t[i - 1] in (".", "?."):
        i -= 2
        if not t[i][:1].isidentifier() and t[i][:1] != "$":
            break
        out.append(t[i])
    return out


@lru_cache(KEPT_PIECES)
def measured(piece: str, jsx: bool, more: bool) -> tuple[tuple, bool]:
    """Of a piece: values of MEASURES, families, calls that count beside some families as (name, of a store, of a client) with their number, and soundness."""
    file = Read(piece, jsx, more)
    t, kind, tokens = file.t, file.kind, file.tokens
    got = dict.fromkeys(MEASURES, 0)
    got["functions"] = len(file.callables)
    got["methods"] = sum(c[3] == "method" for c in file.callables)
    got["branch_points"], got["jsx_elements"] = len(file.nesting), len(file.elements)
    got["form_usages"] = file.elements.count("form")
    parameters = {c[0] for c in file.callables if c[3] == "method"}
    got["async_units"] = sum(t[c[0]] == "async" for c in file.callables if c[3] != "method")
    families, member = set(), lambda i: t[i - 1 : i] in (["."], ["?."])
    called: list[int] = []
    for i, x in enumerate(t):
        after = t[i + 1] if i + 1 < len(t) else ""
        if kind[i] == "w" and not member(i):
            if x == "import" and after != ".":
                got["dynamic_imports" if after == "(" else "imports"] += 1
                families |= imported(file, i + 1)
            elif x == "export" and after != ":":
                got["exports"] += 1
            elif x in ("class", "interface", "enum", "type") and kind[i + 1 : i + 2] == ["w"] and (x == "class" or after not in ("extends", "in", "of")):
                if x != "type" or t[i - 1 : i] not in (["import"], ["export"]) or t[i + 2 : i + 3] in (["="], ["<"]):
                    got[{"class": "classes", "interface": "interfaces", "enum": "enums", "type": "type_aliases"}[x]] += 1
            elif x == "class" and after == "{":
                got["classes"] += 1
        elif x == "@" and kind[i] == "p" and kind[i + 1 : i + 2] == ["w"]:
            got["decorators"] += 1
            if after in _DECORATED:
                got[_DECORATED[after]] += 1
        elif x == "(" and kind[i] == "p" and i:
            j = i - 1
            if i in parameters:
                k = next((k for k in range(j - 1, max(-1, j - 3), -1) if t[k] != "*"), -1)
                got["async_units"] += k >= 0 and t[k] == "async" and kind[j] == "w"
            elif kind[j] == "w" and (member(j) or t[j] not in NO_CALL) or t[j] in (")", "]", "?.", "`end") and j not in file.headers:
                if t[j - 1 : j] not in (["new"], ["function"]) and t[j - 2 : j] != ["function", "*"]:
                    got["calls"] += 1
                    called.append(j)
                    if t[j] == "require" and not member(j):
                        got["imports"] += 1
                        families |= imported(file, i + 1)
    open_calls: Counter = Counter()
    for j in called:
        name, before = t[j], set(chain(t, j))
        if name in _ALWAYS:
            got[_ALWAYS[name]] += 1
        if (name in HTTP or name in ("route", "register")) and ROUTERS & before:
            got["endpoints"] += 1
        if name in QUERIES or name in _FAMILY or CLIENTS & before:
            open_calls[name, bool(STORES & before), bool(CLIENTS & before)] += 1
    return (tuple(got.values()), families, open_calls, file.parsed), file.closed


def measures_of(source: str, path: str = "") -> list[tuple]:
    """The values of MEASURES, the families of imported packages, and the confidence of one file."""
    values, kinds, calls, sound = zip(*[value for *_, value in piecewise(source, path, measured)])
    got = dict(zip(MEASURES, map(sum, zip(*values))))
    families = set().union(*kinds)
    for one in calls:
        for (name, store, client), n in one.items():
            if name in QUERIES and ("data" in families or store):
                got["data_calls"] += n
            counted = [m for m, f in _FAMILY.get(name, ()) if f in families]
            if "integration" in families and client and "integration_calls" not in counted:
                counted.append("integration_calls")
            for m in counted:
                if _ALWAYS.get(name) != m:
                    got[m] += n
    return [(*got.values(), sorted(families), "high" if all(sound) else "low")]


def imported(file: Read, i: int) -> set[str]:
    """The family of the package that the next text of a statement from ``i`` names."""
    while i < len(file.t) and file.t[i] not in (";", "import", "require"):
        if file.kind[i] == "s":
            found = family(file.tokens.text[file.real[i]][1:-1])
            return {found} if found else set()
        i += 1
    return set()


def analyzed(files: DataFrame, keys: list[str], text: str = "text", path: str = "path") -> DataFrame:
    """The keys of each file with its MEASURES, families of packages and confidence."""
    return rows_of(files, keys, [text, path], measures_of, ", ".join(f"{m} int" for m in MEASURES) + ", families array<string>, confidence string")
