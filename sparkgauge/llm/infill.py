"""Fill-in-middle transformation by lookaround splitting.

A unit grammar is given as classes of neighbouring characters and becomes a zero-width boundary
pattern: a unit ends wherever a character of the one class stands before a character of the other.
Spark's ``split`` at such a pattern takes nothing away, so the pieces, joined, are the text; the
empty text, which ``split`` gives as one empty piece, has no units and is handled by itself.

Two hashes of the id pick the two cuts among the unit boundaries, a third whether the document is
transformed at all, a fourth the form: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
middle).  All is column expressions: no Python worker, no shuffle.

Null texts count as empty; empty texts, and texts that hold one of the marks, stay ``plain``.  A
null id counts as the empty text in the hashes.  Repeated rows give equal rows; an empty table gives
none.  ``transform`` keeps all columns, so its outcome is one struct column, whose name the caller
may choose; an input column of that name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
ANY = r"\x{0}-\x{10FFFF}"
#: (class of the last character of a unit, class of the first character of the next one)
UNITS = {
    "word": (f"^{SPACE}", SPACE),  # white space goes with the word behind it; at the end it is a unit of its own
    "line": (r"\n", ANY),
    "sentence": (r".!?", SPACE),
    "character": (ANY, ANY),
}
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
RATE = 50  # of a hundred documents, those transformed
SPM = 80  # of a hundred transformed ones, those with the suffix first
SEED = 42


def boundary(unit: str) -> str:
    """The zero-width pattern between two units."""
    last, first = UNITS[unit]
    return f"(?<=[{last}])(?=[{first}])"


def pieces(text: Column, unit: str = "word") -> Column:
    """The units of a text, in order; none for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit)))


def hashes(key: Column, n: int, seed: int = SEED) -> list[Column]:
    """The first n 32-bit numbers of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: marks never occur in a transformed text, nor across its pieces."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "word", rate: int = RATE, spm: int = SPM, seed: int = SEED, into: str = "infill"
) -> DataFrame:
    """Add the struct ``into``: n (units), form, prefix, middle, suffix (null if plain), output."""
    h1, h2, h3, h4 = hashes(F.col(id_col), 4, seed)
    kept = [F.col(c) for c in docs.columns if c != into]
    rows = docs.select(
        F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4")).alias("h"),
    )
    rows = rows.select("*", pieces(F.col("text"), unit).alias("units"))
    rows = rows.select("*", F.size("units").cast("long").alias("n"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h.h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h.h4") % 100 < spm, "spm").otherwise("psm")
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("h.h1", "h.h2"))
    rows = rows.select("row", "text", "units", "n", form.alias("form"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    rows = rows.select(
        "row", "text", "n", "form",
        part(F.lit(1), F.col("a")).alias("prefix"),
        part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        part(F.col("b") + 1, F.greatest(F.col("n").cast("int") - F.col("b"), F.lit(0))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    made = F.struct("n", "form", "prefix", "middle", "suffix", output.alias("output"))
    return rows.select("row.*", made.alias(into))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its form, the lengths of its parts, and digests of the output and of the restored text."""
    made = transform(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", into="_made")
    return made.select(
        "doc_id",
        "_made.n",
        "_made.form",
        F.length("_made.prefix").cast("long").alias("prefix_chars"),
        F.length("_made.middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("_made.output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("_made.output"), F.col("_made.form")), 256).alias("restored_sha256"),
    )
