"""Secret scan: patterns, plus character Markov models of random and ordinary strings.

Base spans come from three patterns (assignments, access keys, long hex runs).  Further
spans are tokens that a first-order character model of random strings explains better than
one of ordinary identifiers, by log-likelihood ratio.  Both models are fitted from labelled
strings: what the base patterns capture is random, every other token is ordinary.  They are
fitted on a bounded sample of documents (``SAMPLE_DOCS`` for captures, ``ORDINARY_DOCS`` of
these for ordinary tokens, both chosen by id hash); the scan itself covers every whole text.
The fitted table has one number a pair of character classes, so what reaches the
driver and goes into the plan is of fixed size.

A token is a run of 12 identifier characters or more with a letter among them (digits alone are
numbers); the ratio decides, and what it must reach is higher for short runs.

All of it is built-in functions; there is no shuffle in the scan, and its work is in proportion
to the text, however long a token is or however many matches there are.  Null texts count as
empty, have no spans and stay null in ``redact``; an empty table gives no rows; null ids and
repeated rows are scanned each by itself; ``scan`` replaces input columns named ``base`` or
``found``, ``redact`` keeps all columns as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sample_ids

# Fixed values of the contract: the base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Candidates of the Markov models: whole runs of identifier characters of this length.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
WORDS = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE_DOCS = 8_000
ORDINARY_DOCS = 800
#: A candidate is a secret if its ratio per transition, in nats, is at least this.
THRESHOLD = 0.5

#: Added to the ratio that a token must reach, over its length: short runs need more evidence.
THRESHOLD_SHORT = 10.0
#: Elements of a block in running sums over arrays.
SCAN = 512

SPAN = "array<struct<start:bigint,kind:int,end:bigint,byte_start:bigint,byte_end:bigint>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, zero: Column, add) -> Column:
    """For each element the sum of those before it, by any associative ``add``.

    An array built element by element is copied each time, so sums run within blocks of SCAN
    elements and over the blocks: the work is in proportion to the array.
    """

    def within(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, F.lit(0)).alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(add(acc.at, x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")))

    def over(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / SCAN).cast("int")
        return bound(
            F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: within(F.slice(xs, (b - 1) * SCAN + 1, SCAN))),
            lambda inner: F.flatten(F.zip_with(inner, within(F.transform(inner, lambda x: x.at)).out, lambda i, before: F.transform(i.out, lambda v: add(before, v)))),
        )

    return bound(values, over)


def _spans(text: Column, pattern: str, kind: int, least=None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans in code points and bytes.

    The texts between the matches give the offsets: ``split`` cuts where
    ``regexp_extract_all`` finds.  ``least``: predicate on the matched text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    sizes = lambda x: F.struct(F.char_length(x).cast("bigint").alias("chars"), F.octet_length(x).cast("bigint").alias("bytes"))
    plus = lambda a, b: F.struct((a.chars + b.chars).alias("chars"), (a.bytes + b.bytes).alias("bytes"))
    steps = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(found)),
        found,
        lambda a, b: F.struct(sizes(a).alias("gap"), sizes(b).alias("own"), (F.lit(True) if least is None else least(b)).alias("kept")),
    )

    def spans(steps: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).cast("bigint").alias("bytes"))
        before = running(F.transform(steps, lambda x: plus(x.gap, x.own)), zero, plus)
        made = F.zip_with(
            steps,
            before,
            lambda x, at: F.struct(
                (at.chars + x.gap.chars).alias("start"),
                F.lit(kind).alias("kind"),
                (at.chars + x.gap.chars + x.own.chars).alias("end"),
                (at.bytes + x.gap.bytes).alias("byte_start"),
                (at.bytes + x.gap.bytes + x.own.bytes).alias("byte_end"),
                x.kept.alias("kept"),
            ),
        )
        return F.transform(F.filter(made, lambda x: x.kept), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "kind", "end", "byte_start", "byte_end"))))

    return F.when(F.size(found) > 0, bound(steps, spans)).otherwise(_none())


def base_spans(text: Column) -> list[Column]:
    return [
        _spans(text, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        _spans(text, ACCESS, 1, lambda m: F.char_length(m) >= ACCESS_LEAST),
        _spans(text, HEX, 2),
    ]


def char_classes(token: Column) -> Column:
    """Each character's place in ALPHABET, -1 elsewhere."""
    return F.transform(F.split(token, "", -1), lambda c: F.when(c == "", F.lit(-1)).otherwise(F.instr(F.lit(ALPHABET), c) - 1))


def pair_counts(strings: DataFrame, col: str) -> DataFrame:
    """Counts of adjacent characters of ALPHABET, as code a * size + b, over a column of strings."""
    n = len(ALPHABET)
    classes = strings.select(char_classes(F.col(col)).alias("c"))
    pairs = F.zip_with(F.col("c"), F.slice("c", 2, F.size("c")), lambda a, b: F.when((a >= 0) & (b >= 0), a * n + b))
    return classes.select(F.explode(pairs).alias("pair")).where("pair is not null").groupBy("pair").count()


def fit_ratio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log P(b|a) under random minus under ordinary, for each pair (a, b) of ALPHABET."""
    ids = sample_ids(docs, id_col, SAMPLE_DOCS)
    some = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), id_col, "left_semi")
    captured = F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), 2),
        F.regexp_extract_all("text", F.lit(ACCESS), 0),
        F.regexp_extract_all("text", F.lit(HEX), 0),
    )
    few = sample_ids(docs, id_col, ORDINARY_DOCS)
    random = some.select(F.explode(captured).alias("s")).where(F.length("s") >= ASSIGN_LEAST)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = some.join(F.broadcast(few), id_col, "left_semi").select(F.explode(F.regexp_extract_all(plain, F.lit(WORDS), 0)).alias("s"))
    both = pair_counts(random, "s").withColumn("random", F.lit(True)).unionByName(pair_counts(ordinary, "s").withColumn("random", F.lit(False)))
    n = len(ALPHABET)
    # Random strings have a flat prior over letters and digits, so a small sample keeps its shape.
    table = {True: [[0.2] * n for _ in range(n)], False: [[0.2] * n for _ in range(n)]}
    for pair, count, kind in both.collect():  # at most two rows a pair of the alphabet
        table[kind][pair // n][pair % n] += count
    total = {k: [sum(r) for r in t] for k, t in table.items()}
    return [
        math.log(table[True][a][b] / total[True][a]) - math.log(table[False][a][b] / total[False][a])
        for a in range(n)
        for b in range(n)
    ]


def log_ratio(token: Column, ratio: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a token over ALPHABET."""
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # one literal
    n = len(ALPHABET)

    def mean(classes: Column) -> Column:
        steps = F.zip_with(F.slice(classes, 1, F.length(token) - 1), F.slice(classes, 2, F.length(token) - 1), lambda a, b: a * n + b)
        return F.aggregate(steps, F.lit(0.0), lambda acc, at: acc + F.get(table, at)) / (F.length(token) - 1)

    return bound(char_classes(token), mean)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ratio: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of spans, by start, then kind."""
    ratio = fit_ratio(docs, id_col, text_col) if ratio is None else ratio
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign, access, hexes = base_spans(text)
    least = lambda m: m.rlike("[A-Za-z]") & (log_ratio(m, ratio) >= threshold + THRESHOLD_SHORT / F.length(m))
    out = docs.withColumns({"_assign": assign, "_access": access, "_hex": hexes, "_more": _spans(text, TOKEN, 3, least)})
    out = out.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex"))).drop("_assign", "_access", "_hex")
    # a token is clear if no base span begins within it and the last one begun before it has ended:
    # the running largest end over both kinds in order of their starts tells, with no pair listed
    both = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s.start.alias("start"), F.lit(0).alias("more"), s.alias("span"))), F.transform("_more", lambda s: F.struct(s.start.alias("start"), F.lit(1).alias("more"), s.alias("span")))))

    def clear(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x.more == 0, x.span.end).otherwise(F.lit(0).cast("bigint")))
        before = running(ends, F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x.more == 0, x.span.start).otherwise(F.lit(2**62)))), F.lit(2**62), lambda a, b: F.least(a, b)))
        kept = F.zip_with(F.zip_with(both, before, lambda x, a: F.struct(x.alias("x"), a.alias("before"))), starts, lambda y, b: F.struct(y.x.alias("x"), y.before.alias("before"), b.alias("next")))
        kept = F.filter(kept, lambda y: (y.x.more == 0) | ((y.before <= y.x.span.start) & (y.next >= y.x.span.end)))
        return F.transform(kept, lambda y: y.x.span)

    found = F.when((F.size("_more") == 0) | (F.size("base") == 0), F.concat("base", "_more")).otherwise(bound(both, clear))
    return out.withColumn("found", found).drop("_more")


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping spans (by start) replaced by ``mark``.

    What stays is cut from the text's bytes, so a piece costs its own length only.
    """

    def pieces(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: s.byte_end), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
        # of a run only the first span has a gap before it, or touches the one before
        cut = F.filter(F.zip_with(spans, before, lambda s, at: F.struct(at.alias("at"), s.byte_start.alias("to"))), lambda x: x.to >= x["at"])
        last = F.array_max(F.transform(spans, lambda s: s.byte_end))
        return F.concat(cut, F.array(F.struct(last.alias("at"), F.lit(2**31 - 1).cast("bigint").alias("to"))))

    def joined(raw: Column) -> Column:
        piece = lambda x: F.decode(F.substring(raw, (x["at"] + 1).cast("int"), (x.to - x["at"]).cast("int")), "UTF-8")
        return F.array_join(F.transform(bound(spans, pieces), piece), mark)

    return bound(text.cast("binary"), joined)


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]", ratio: list[float] | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; all columns stay, whatever their names."""
    ratio = fit_ratio(docs, id_col, text_col) if ratio is None else ratio
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col).alias("_text"))
    found = scan(packed, "_text", "_row", ratio)
    text = F.when(F.size("found") == 0, F.col("_text")).otherwise(masked(F.col("_text"), F.col("found"), mark))
    kept = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    return found.select(*kept)
