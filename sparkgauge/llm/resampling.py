"""Importance resampling towards a target distribution, on hashed word n-grams.

Texts become word ids, some at a time, and the ids a suffix array of the slice, sorted as deep as the
longest n-gram.  Neighbours in it that share their first k words (by the LCP array) form a run: a run
is one distinct k-gram with all of its occurrences.  Each k-gram is hashed once a run, and its bucket
scattered back to the occurrences.  A first pass adds up the buckets of all documents and of all
target texts; a bucket's gain is the log-ratio of its smoothed shares.  A second pass, by suffix
arrays again, gives each document the mean gain of its n-grams; noise from a hash of the id turns the
highest scores into a draw without replacement.

What the driver and a broadcast hold is one number a bucket.  Ranks come from a range partitioning
by (score, id) and prefix sums of the partitions' totals, so no task ranks the whole table.

Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased.  Null and empty texts have
no words: weight 0, never drawn.  A long text goes through in pieces that overlap by a word less than
the longest n-gram.  Null ids count as the empty text in the hash and sort first among equal scores;
repeated rows count, score and are drawn each by itself; without target texts all shares of the
target are equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .infill import hashes
from .shared import discard, partitions, text_slices, written

NGRAM = 2
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25  # of a hundred documents with LEAST_WORDS words
SEED = 7
SLICE_CHARS = 4_000_000
_FOLD = bytes(x if x >= 128 or chr(x).isdigit() or chr(x).islower() else x + 32 if chr(x).isupper() else 32 for x in range(256))


class _Places(dict):
    """Word -> number; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` words at least, and each one's LCP with the one before, up to ``depth``.

    ``left`` is how many words of its own text a position has left, itself included: no n-gram
    goes beyond its text, and a shorter suffix comes first.
    """
    n, rank, reach = len(ids), ids.astype(np.int64) + 1, 1
    order = rank.argsort(kind="stable")
    while reach < depth:
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > reach)
        after[inside] = rank[inside + reach]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = key.argsort(kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        reach *= 2
    lcp, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    a, b = order[:-1], order[1:]
    for k in range(depth):
        same &= (left[a] > k) & (left[b] > k)
        at = np.flatnonzero(same)
        same[at] = ids[a[at] + k] == ids[b[at] + k]
        lcp[1:] += same
    return order, lcp


def gram_buckets(ids: np.ndarray, left: np.ndarray, words: list[bytes], n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to n: (positions where a k-gram begins, their buckets), hashed once a run of the suffix array."""
    order, lcp = suffix_array(ids, left, n)
    hashed = np.zeros(len(ids), np.int64)  # of the (k-1)-gram that begins at a position
    for k in range(1, n + 1):
        long_enough = left[order] >= k
        at = order[long_enough]
        run = np.cumsum(lcp[long_enough] < k) - 1
        heads = at[np.flatnonzero(np.diff(run, prepend=-1))]
        last = map(words.__getitem__, ids[heads + k - 1].tolist())
        made = [zlib.crc32(w) for w in last] if k == 1 else [zlib.crc32(b" " + w, h) for w, h in zip(last, hashed[heads].tolist())]
        hashed[at] = np.array(made, np.int64)[run] if len(at) else 0
        yield at, hashed[at] % buckets


def word_runs(texts: list[bytes], overlap: int, size: int = SLICE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """Pieces of a slice of texts: (ids, words left, text of each position, words, whether a k-gram may begin there).

    A text over ``size`` bytes comes in pieces; the last ``overlap`` words of one piece come again in
    the next, and only there do n-grams begin at them.
    """
    place, ids, left, owner, starts = _Places(), [], [], [], []

    def piece():
        return np.concatenate(ids), np.concatenate(left), np.concatenate(owner), list(place), np.concatenate(starts)

    held = 0
    for i, t in enumerate(texts):
        t, at, carry = t.translate(_FOLD), 0, []
        while at < len(t):
            stop = len(t) if len(t) - at <= size else t.find(b" ", at + size)
            stop = len(t) if stop < 0 else stop
            ws = carry + t[at:stop].split()
            at = stop
            final = at >= len(t)
            carry = [] if final else ws[max(0, len(ws) - overlap) :] if overlap else []
            if ws:
                ids.append(np.fromiter(map(place.__getitem__, ws), np.int64, len(ws)))
                left.append(np.arange(len(ws), 0, -1))
                owner.append(np.full(len(ws), i))
                starts.append(np.arange(len(ws)) < len(ws) - len(carry))
                held += len(ws)
            if not final or held > size // 4:
                if held:
                    yield piece()
                place, ids, left, owner, starts, held = _Places(), [], [], [], [], 0
    if held:
        yield piece()


def bucket_counts(texts: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts (the only column) lie in each bucket: one number a bucket, added up by Spark."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in text_slices(batch.column(0), SLICE_CHARS):
                for ids, left, _, words, starts in word_runs(some, n - 1):
                    for at, bucket in gram_buckets(ids, left, words, n, buckets):
                        counts += np.bincount(bucket[starts[at]], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], ["bucket", "n"])

    parts = texts.select(F.col(texts.columns[0]).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, total in parts.groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket at most
        out[bucket] = total
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-ratio of each bucket's share in the target to that in the source, add-one smoothed, in thousandths."""
    n = len(source)
    all_source, all_target = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches):
        gain = shared.value
        for batch in batches:
            for start, some in text_slices(batch.column(1), SLICE_CHARS):
                n_words, features, total = (np.zeros(len(some), np.int64) for _ in range(3))
                for ids, left, owner, words, starts in word_runs(some, n - 1):
                    n_words += np.bincount(owner[starts], minlength=len(some))
                    by_position, grams = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                    for at, bucket in gram_buckets(ids, left, words, n, len(gain)):
                        by_position[at] += gain[bucket]
                        grams[at] += 1
                    by_position[~starts] = grams[~starts] = 0
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    total[owner[first]] += np.add.reduceat(by_position, first)
                    features[owner[first]] += np.add.reduceat(grams, first)
                ids = batch.column(0).slice(start, len(some))
                columns = [ids, pa.array(n_words), pa.array(features), pa.array(total // np.maximum(features, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a hash of the id, in thousandths."""
    (h,) = hashes(key, 1, seed)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, eligible: Column, score: str, id_col: str, share: int = 100) -> DataFrame:
    """Add ``rank``: 1, 2, ... by score downwards and id upwards for the first ``share`` in a hundred eligible rows, null for the others.

    The rows are dealt by ranges of that order and written; a partition's ranks then begin behind
    the totals of those before it.  Equal rows are told apart by a number given when they are written,
    so that no range grows with a repeated id.
    """
    spark = rows.sparkSession
    order = [F.col("_out"), F.col("_down"), F.col(id_col), F.col("_n")]
    numbered = written(rows.select("*", (~eligible).alias("_out"), (-F.col(score)).alias("_down"), F.monotonically_increasing_id().alias("_n")), "scores")
    dealt = written(numbered.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    discard(numbered)
    drawn = share * dealt.where(~F.col("_out")).count() // 100
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = dealt.join(F.broadcast(before), "_part").withColumn("_place", F.col("_before") + place)  # one row a partition
    return placed.select(*rows.columns, F.when(F.col("_place") <= drawn, F.col("_place")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_features, weight, score, rank (null unless drawn)."""
    gains = bucket_gains(bucket_counts(docs.select(text_col)), bucket_counts(target.select(target_col)))
    scored = weights(docs, gains, id_col, text_col)
    scored = scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    placed = ranked(scored, F.col("n_words") >= LEAST_WORDS, "score", "doc_id", share)
    return placed.select("doc_id", "n_features", "weight", "score", "rank")
