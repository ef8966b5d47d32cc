"""Exact n-gram Jaccard join by PartEnum signatures.

Two sets of sizes |A| <= |B| with Jaccard similarity of at least 0.8 differ in at most
k = |A| / 4 elements.  Sizes fall into bands (powers of two).  A band partitions the feature
domain in two levels: into groups, and each group into ``SECOND`` parts.  A group is bad if the
sets differ in two of its parts or more, so at most k / 2 groups are bad.  In any other group they agree
on all parts but one at most: for each part a signature is the content of the group's other
parts, and one of these subsets of parts is common to both sets.  Groups have one order in a band,
and a set signs its groups in that order until n // 8 + 1 of them have two filled parts or more:
one of those is not bad, both sets have come that far when the first such group is reached, and
what they agree on there is not empty.  Bands below ``SUBSETS`` features have one part a group and no subsets to choose
from: there a set signs its first n // 4 + 1 non-empty parts.  Sets near the lower edge of a band
also sign in the band below.  Thus no link is lost, whatever the partition, as long as a set fills
so many groups; features are hashed, so it does by ten standard deviations and more.

The partition only decides the work.  Features that a bounded sample shows to be common
(boilerplate, passages, large groups of near copies) go to parts of their own at the end of
the order, so ordinary sets never sign them.

Equal sets are one class with one representative.  Signatures meet in rounds, by remainder, so
that a part of them is shuffled at once; only buckets of several classes are kept.  Sharing a signature with the smallest set
of its bucket is tested first; then pairs that are in one bucket but not yet in one component.
A parity bitmap of each set bounds the difference from below and is tested inside the join, and of
large sets a wider one, in proportion to the set, beside it;
pairs that remain are compared on the whole sets.  Only representatives are paired; the result is
one row a document with its component.  Hot buckets are never listed in pairs within one
component, and skewed joins can be split.

Texts are lower-cased (A-Z) and cut at ASCII white space; a set holds the distinct runs of
``n`` words; fewer words make one run of all.  Null texts and texts without words have an empty
set, which is linked with nothing.  Rows that share an id count as one node; rows without an
id count as nodes of no component but the null one.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Recent, discard, release, sample_ids, text_slices, worker_state, written

WORDS = 5
PERCENT = 80
SAMPLE_DOCS = 16_384
#: A feature is common if so many documents of the sample hold it; at most so many are kept.
COMMON_LEAST = 4
COMMON_MOST = 1_000_000
BITMAP_LONGS = 16
FILTER_BITS = 1 << 24
CACHE_WORDS = 100_000
#: Signatures meet in a round for each so many documents, and in so many rounds at most.
ROUND_DOCS = 32_768
ROUNDS = 8
#: Whole rows pass the bit table so many at a time.
PASS_ROWS = 256
#: Bands of smaller sets have one part a feature.
SMALL = 32
#: Bands from this size on enumerate subsets of SECOND parts.
SUBSETS = 512
SECOND = 3

# Odd multipliers that mix bits: a Weyl sequence of the golden ratio's fraction.
GOLDEN = 0x9E3779B97F4A7C15
MIX = [np.uint64((GOLDEN * (2 * i + 1)) & (2**64 - 1)) for i in range(64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX[3]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit features of each text."""
    split = [t.lower().split() for t in texts]  # on bytes: A-Z and ASCII white space only
    hashes = worker_state("shingles", lambda: Recent(CACHE_WORDS))
    hashes.update((w, xxhash.xxh3_64_intdigest(w)) for w in hashes.missing(set().union(*split)))
    get, out = hashes.__getitem__, []
    for words in split:
        h = _mix(np.fromiter(map(get, words), np.uint64, len(words)))
        width = min(n, len(h))
        grams = np.full(len(h) - width + 1 if width else 0, np.uint64(width))
        for k in range(width):
            grams += h[k : len(h) - width + 1 + k] * MIX[4 + k % 32]
        out.append(np.unique(_mix(grams)))
    hashes.turn()
    return out


def bitmap(features: np.ndarray, longs: int = BITMAP_LONGS) -> np.ndarray:
    """Parity of the features at each of 64 * longs places."""
    at = (features >> np.uint64(7)).astype(np.int64) & (64 * longs - 1)
    odd = np.bincount(at, minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, longs: int = BITMAP_LONGS) -> np.ndarray:
    """The narrower bitmap of the same set; both sizes are powers of two."""
    return np.bitwise_xor.reduce(bits.reshape(-1, longs), 0)


def wide_bitmap(features: np.ndarray) -> np.ndarray:
    """A bitmap of one to two places a feature, BITMAP_LONGS at least: a narrow one tells no large sets apart."""
    return bitmap(features, max(BITMAP_LONGS, 1 << max(0, len(features).bit_length() - 6)))


def parts(band: int) -> int:
    """Parts of a band's domain.

    A set of the band (sizes low to 2 * low - 1) must fill more parts than it may differ in,
    at most low / 2.  In small bands every feature is its own part; in others the expected
    number of filled parts exceeds that by ten standard deviations and more.
    """
    low = 1 << band
    return 3 * low // 5 + 2 * math.isqrt(low) + 4 if low >= SMALL else 1 << 61


def groups(band: int) -> int:
    """Groups of a band that enumerates subsets; about three quarters of them get two filled parts."""
    return 3 * (1 << band) // 10


def of_parts(part: np.ndarray, content: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of single parts, and whether each lies in a common part."""
    part, content = part[: n // 4 + 1], content[: n // 4 + 1]
    return content ^ (part * MIX[41]), part >> np.uint64(62) != 0


def of_subsets(part: np.ndarray, content: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each group's subsets of parts that leave one part out, and whether each is common."""
    late, place = part >> np.uint64(62), part & np.uint64((1 << 62) - 1)
    group = place // np.uint64(SECOND) | late << np.uint64(62)
    begins = np.concatenate([[True], group[1:] != group[:-1]])
    at, group = begins.cumsum() - 1, group[begins]
    filled = np.bincount(at, minlength=len(group))
    enough = np.flatnonzero((filled >= 2).cumsum() == n // 8 + 1)
    held = np.zeros((len(group), SECOND), np.uint64)
    there = np.zeros((len(group), SECOND), bool)
    column = (place % np.uint64(SECOND)).astype(np.int64)
    held[at, column] = _mix(content ^ (part * MIX[41]))
    there[at, column] = True
    signs = (held.sum(1, dtype=np.uint64)[:, None] - held) ^ (group[:, None] * MIX[39]) ^ (np.arange(SECOND, dtype=np.uint64) * MIX[38])
    valid = filled[:, None] > there  # some other part is filled
    if len(enough):
        valid[enough[0] + 1 :] = False
    return signs[valid], np.broadcast_to(group[:, None] >> np.uint64(62) != 0, valid.shape)[valid]


def signatures(features: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, whether each lies in a common part) of one set."""
    n = len(features)
    band = n.bit_length() - 1
    out, late = [], []
    at = np.searchsorted(common, features)
    is_common = np.zeros(n, bool)
    inside = at < len(common)
    is_common[inside] = common[at[inside]] == features[inside]
    for b in [band] + [band - 1] * (band > 0 and n * PERCENT <= 100 * ((1 << band) - 1)):
        subsets = 1 << b >= SUBSETS
        part = ((features >> np.uint64(1)) % np.uint64(SECOND * groups(b) if subsets else parts(b))) | (is_common.astype(np.uint64) << np.uint64(62))
        order = part.argsort(kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(_mix(features[order]) * MIX[40], first)
        part = part[first]
        signs, is_late = (of_subsets if subsets else of_parts)(part, content, n)
        out.append(_mix(signs ^ MIX[42 + b % 20]))
        late.append(is_late)
    return np.concatenate(out).view(np.int64), np.concatenate(late)


def common_features(source: DataFrame, n: int) -> np.ndarray:
    """Features that several documents of a bounded sample share, sorted; of bounded number."""
    some = source.join(F.broadcast(sample_ids(source, "doc_id", SAMPLE_DOCS)), "doc_id", "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                found = shingle_sets(list(set(texts)), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["f"])

    counts = some.mapInArrow(run, "f long").groupBy("f").count().where(F.col("count") >= COMMON_LEAST)
    top = counts.orderBy(F.desc("count"), "f").limit(COMMON_MOST).select("f").toPandas()["f"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def signed(source: DataFrame, n: int, common: np.ndarray, rounds: int) -> DataFrame:
    """One row a document: n_shingles, a digest of its set, the class that begins it, and its bitmaps and signatures.

    ``cold0`` and on hold the signatures of each round; ``wide`` is empty where ``bits`` are as wide.
    """
    shared = source.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                sets = shingle_sets(texts, n)
                signs = [signatures(s, shared.value) if len(s) else (np.zeros(0, np.int64), np.zeros(0, bool)) for s in sets]
                sign, late = (np.concatenate(x) for x in zip(*signs))
                row = np.repeat(np.arange(len(sets)), [len(x) for x, _ in signs])
                turn = np.where(late, rounds, (sign.view(np.uint64) % np.uint64(rounds)).astype(np.int64))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                wide = [wide_bitmap(s) for s in sets]
                made = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(np.frombuffer(b"".join(digests), np.int64)[::2]),
                    lists(np.concatenate([folded(w) for w in wide]), np.full(len(sets), BITMAP_LONGS)),
                    pa.array([w.tobytes() if len(w) > BITMAP_LONGS else b"" for w in wide], pa.binary()),
                    *[lists(sign[turn == r], np.bincount(row[turn == r], minlength=len(sets))) for r in (rounds, *range(rounds))],
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *made], names)

    kinds = {"doc_id": source.schema["doc_id"].dataType.simpleString(), "n_shingles": "long", "digest": "binary", "class": "long", "bits": "array<long>", "wide": "binary", "hot": "array<long>"}
    kinds |= {f"cold{r}": "array<long>" for r in range(rounds)}
    names = list(kinds)
    return source.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """The values in turn as lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32()), pa.array(values, pa.int64()))


def _place(id_col: str):
    return F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS))


def bit_table(ids: DataFrame) -> np.ndarray:
    """A table of fixed size with a bit at the place of each id in the only column."""
    table = (
        ids.select(_place(ids.columns[0]).alias("at"))
        .groupBy(F.expr("at div 64").alias("row"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        .toPandas()
    )  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[table["row"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _hits(table: np.ndarray, places: pa.Array) -> np.ndarray:
    """Whether the table has a bit at each place; none at null."""
    at = places.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1) & (at >= 0)


def compared(source: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough.

    Only texts of ids in pairs are cut into sets: a bit table of fixed size lets them through.
    """
    shared = source.sparkSession.sparkContext.broadcast(bit_table(pairs.select(F.explode(F.array("a", "b")))))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_hits(shared.value, batch.column(2))))
            for start, texts in text_slices(batch.column(1)):
                sets = pa.array([s.tobytes() for s in shingle_sets(texts, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), sets], ["doc_id", "features"])

    kind = source.schema["doc_id"].dataType.simpleString()
    sets = source.where("doc_id is not null").select("doc_id", "text", _place("doc_id").alias("at")).mapInArrow(run, f"doc_id {kind}, features binary")
    sets = written(sets, "sets")

    def similar(frames):
        for pdf in frames:
            keep = []
            for x, y in zip(pdf["fa"], pdf["fb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    alike = written(
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("features").alias("fa")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("features").alias("fb")), "b")
        .mapInPandas(similar, f"a {kind}, b {kind}"),
        "alike",
    )
    discard(sets)
    return alike


def _plausible():
    """Sizes and bitmaps allow the similarity asked for."""
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    apart = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return (least * 100 >= most * PERCENT) & (apart * 4 <= least)


def bucketed(rows: DataFrame, reps: DataFrame, rounds: int) -> DataFrame:
    """Rows (sig, rep) of the signatures that several classes have, and of all hot ones."""
    met = [rows.select(F.explode("hot").alias("sig"), "class").distinct()]
    of_sig = Window.partitionBy("sig")
    for r in range(rounds):
        cold = rows.select(F.explode(f"cold{r}").alias("sig"), "class")
        mixed = cold.withColumns({"low": F.min("class").over(of_sig), "high": F.max("class").over(of_sig)}).where("low <> high")
        met.append(written(mixed.select("sig", "class").distinct(), "met"))
        release(rows.sparkSession)
    every = functools.reduce(DataFrame.unionByName, met)
    out = written(every.join(reps.select("class", F.col("doc_id").alias("rep")), "class").select("sig", "rep"), "buckets")
    for t in met[1:]:
        discard(t)
    return out


def close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose wide bitmaps, folded to the narrower of both, allow the similarity asked for."""
    of = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n" + x), F.col("wide").alias("w" + x))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            keep = []
            for na, x, nb, y in zip(pdf["na"], pdf["wa"], pdf["nb"], pdf["wb"]):
                longs = min(len(x), len(y)) // 8
                x, y = (folded(np.frombuffer(w, np.int64), longs) if longs else np.zeros(0, np.int64) for w in (x, y))
                keep.append(4 * int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= min(na, nb))
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(run, f"a {kind}, b {kind}")


def links(source: DataFrame, buckets: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """Pairs of representatives that are similar enough; pairs already joined through others may be left out."""
    spark = source.sparkSession
    about = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits")

    of = lambda x: about.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("b" + x))
    centre = buckets.groupBy("sig").agg(F.min("rep").alias("a"))  # combined before the shuffle
    star = buckets.join(centre, "sig").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    near = written(close(star.join(of("a"), "a").join(of("b"), "b").where(_plausible()).select("a", "b"), reps), "near")
    release(spark)
    found = compared(source, near, n)
    discard(near)
    release(spark)

    # sizes and bitmaps go with the rows of mixed buckets only
    known = components(found)
    rows = buckets.join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    rows = written(rows.join(mixed, "sig", "left_semi").join(about, "rep"), "mixed")
    left = rows.select("sig", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = rows.select("sig", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    on = (left.sig == right.sig) & (F.col("ca") < F.col("cb")) & _plausible()
    rest = written(close(left.join(right, on).select("a", "b").distinct(), reps), "rest")
    release(spark)
    more = compared(source, rest, n)
    for t in (buckets, rows, rest):
        discard(t)
    return found.unionByName(more)


def join(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rounds = min(ROUNDS, 1 + source.count() // ROUND_DOCS)
    rows = written(signed(source, n, common_features(source, n), rounds), "signed")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    columns = ["doc_id", "n_shingles", "class", "bits", "wide"]
    reps = written(filled.groupBy("digest").agg(F.min(F.struct(*columns)).alias("r")).select("digest", "r.*"), "reps")
    members = written(rows.select("doc_id", "n_shingles", "digest"), "members")
    release(docs.sparkSession)
    buckets = bucketed(filled, reps, rounds)
    discard(rows)
    release(docs.sparkSession)
    of = components(links(source, buckets, reps, n))
    classes = reps.select("digest", F.col("doc_id").alias("rep")).join(of.withColumnRenamed("id", "rep"), "rep", "left")
    classes = written(classes.select("digest", F.coalesce("component", "rep").alias("component")), "classes")
    discard(reps)
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return members.join(classes, "digest", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    Of rows that share an id the one stays whose text has the smallest digest, then the smallest
    of the rows as JSON; rows without an id all stay.  Only rows of repeated ids are sorted.  A bit table of fixed size
    lets all rows pass whose ids neither go nor repeat; whole texts of the others travel only where Spark has to
    shuffle for the anti-join.
    """
    gone = written(join(docs, n, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    repeated = written(docs.groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col(id_col).isNotNull() & (F.col("_n") > 1)).select(id_col), "repeated")
    release(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(gone.union(repeated)))
    placed = docs.select("*", _place(id_col).alias("_at")).withColumn("_at", F.when(F.col(id_col).isNotNull(), F.col("_at")))

    def passed(hit: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                last = batch.num_columns - 1
                for at in range(0, len(batch), PASS_ROWS):  # a small copy at a time, here and in the JVM
                    some = batch.slice(at, PASS_ROWS)
                    yield some.select(list(range(last))).filter(pa.array(_hits(shared.value, some.column(last)) == hit))

        return placed.mapInArrow(run, docs.schema)

    kept = passed(True).join(gone, id_col, "left_anti")
    order = Window.partitionBy(id_col).orderBy(F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    several = kept.join(repeated, id_col, "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return passed(False).unionByName(kept.join(repeated, id_col, "left_anti").select(docs.columns)).unionByName(several.select(docs.columns))
