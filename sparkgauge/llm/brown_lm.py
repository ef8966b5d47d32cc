"""Class-based bigram language model with Brown clusters.

Every word of the training corpus gets its class by exchange: it goes to the class that raises
the class-bigram likelihood most, given the counts of its neighbours over all training rows.

One pass over the texts counts, for every word, its neighbours among the ``CORE_WORDS`` most
frequent words and the end token; counts of all slices are added up by word.  The core is
clustered first: its ``SEED_WORDS`` most frequent words word by word (at most their number squared
of counts, on the driver), the others then join the classes of these, and ``ROUNDS`` exchange
rounds move a part of the core at a time; a round that lowers the likelihood is undone and from
then on fewer words move at once.  Each of the other words, however rare, is then exchanged once
into the classes of the core.  The two sizes bound what the driver and a broadcast hold, not what
is counted.  Words that never stand next to a core word, and words never seen in training, take
the class that their ending has most often among the core.

Word counts (one row a distinct word, never broadcast whole) and class transitions (classes
squared) are of the whole training corpus.  A text's log10 probability is the sum over its
tokens of transition and emission, both with add-one smoothing; an unseen word takes its
class's share for unseen words.

Counts and classes of the ``HOT_WORDS`` most frequent words, a bounded table, are looked up
where the text is read; the rest of a document's distinct words, and the transitions from and
to them, go through a join.

Tokens are words, A-Z lower-cased, cut at ASCII white space, then one end token a document.
Null and empty texts are one end token.  Null ids count as the empty text for the fold;
repeated rows count and are scored each by itself; without training rows all counts are 0 and
the vocabulary is empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cuts, discard, id_hash, partitions, text_slices, written

CLASSES = 64
CORE_WORDS = 4_096
SEED_WORDS = 1_024
SEED_ROUNDS = 4
ROUNDS = 8
HOT_WORDS = 200_000
SLICE_TOKENS = 1_500_000
SLICE_ENTRIES = 20_000
SIDE = CLASSES + 1
END = CLASSES  # class of the end token, which has no other member
END_WORD = b"\n"  # no word holds white space
#: Codes of neighbours: a core word or the end token behind a word, or, BEFORE added, in front of it.
BITS = 14
BEFORE = 1 << (BITS - 1)
MOST_TIMES = (1 << (31 - BITS)) - 1  # a larger count is split


def held_out(id_col: str = "doc_id"):
    return id_hash(F.col(id_col)) % 7 == 2


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes: A-Z and ASCII white space only


def xlogx(x):
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(big: np.ndarray) -> float:
    """Log-likelihood of class bigrams, without the words' own term, which classes leave alone."""
    return float(xlogx(big).sum() - xlogx(big.sum(1)).sum() - xlogx(big.sum(0)).sum())


def exchange(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int, classes: int = CLASSES, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """Exchange clustering of words 0 to n-1, one after the other, by bigrams (a, b) seen c times."""
    if not n:
        return np.zeros(0, np.int64)
    of = np.arange(n) % classes
    big = np.bincount(of[a] * classes + of[b], c, classes * classes).reshape(classes, classes)
    by_a, by_b = a.argsort(kind="stable"), b.argsort(kind="stable")
    at_a, at_b = np.searchsorted(a[by_a], np.arange(n + 1)), np.searchsorted(b[by_b], np.arange(n + 1))
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            after, before = by_a[at_a[w] : at_a[w + 1]], by_b[at_b[w] : at_b[w + 1]]
            if not len(after) and not len(before):
                continue
            self_pair = c[after[b[after] == w]].sum()
            right = np.bincount(of[b[after]], c[after], classes)
            left = np.bincount(of[a[before]], c[before], classes)
            old = of[w]
            right[old] -= self_pair
            left[old] -= self_pair
            big[old] -= right
            big[:, old] -= left
            big[old, old] -= self_pair
            # likelihood gained by joining each class: rows, columns, the corner, and the margins
            rows = xlogx(big + right) - xlogx(big)
            cols = xlogx(big + left[:, None]) - xlogx(big)
            d = np.arange(classes)
            corner = xlogx(big[d, d] + right + left + self_pair) - xlogx(big[d, d]) - rows[d, d] - cols[d, d]
            sums_r, sums_c = big.sum(1) + left, big.sum(0) + right  # its own moves stay counted, whatever its class
            add_r, add_c = right.sum() + self_pair, left.sum() + self_pair
            margins = xlogx(sums_r + add_r) - xlogx(sums_r) + xlogx(sums_c + add_c) - xlogx(sums_c)
            new = int((rows.sum(1) + cols.sum(0) + corner - margins).argmax())
            big[new] += right
            big[:, new] += left
            big[new, new] += self_pair
            moved += new != old
            of[w] = new
        if moved < n // 200:
            break
    return of


def gains(old: np.ndarray | None, owner: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, big: np.ndarray) -> np.ndarray:
    """Likelihood that each word, taken out of its class, gains in each class (a row a word).

    ``owner`` (ascending), ``slot`` and ``n`` are the words' counts by class after (below SIDE)
    and class before; ``own`` are the words' bigrams with themselves.  Without ``old`` the words
    have no class yet and ``big`` does not hold them.
    """
    words, free = len(own), np.arange(CLASSES)
    near = np.zeros((2, words, SIDE))
    way, d = slot // SIDE, slot % SIDE
    near[way, owner, d] = n
    lines = np.stack([big.T, big])[:, :, :CLASSES]  # [way, class of the neighbour, class of the word]
    logs = xlogx(lines)
    codes, at = np.unique(slot * (int(n.max(initial=0)) + 1) + n, return_inverse=True)
    first = np.zeros(len(codes), np.int64)
    first[at] = np.arange(len(n))
    base = lines[way[first], d[first]]
    value = (xlogx(base + n[first, None]) - logs[way[first], d[first]])[at]
    if old is not None:  # where the word's own bigrams lay: neighbours of its old class, and its old class itself
        e = np.flatnonzero(d == old[owner])
        base = lines[way[e], d[e]] - near[1 - way[e], owner[e], :CLASSES]
        value[e] = xlogx(base + n[e, None]) - xlogx(base)
        e, was = np.arange(len(n)), old[owner]
        base = lines[way, d, was] - n - np.where(d == was, near[1 - way, owner, was] + own[owner], 0)
        value[e, was] = xlogx(base + n) - xlogx(base)
    total = np.zeros((words, CLASSES))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(starts):
        total[owner[starts]] = np.add.reduceat(value, starts, axis=0)
    after, before = near[0, :, :CLASSES], near[1, :, :CLASSES]
    i = np.arange(words)
    base = np.repeat(big[free, free][None], words, 0)
    if old is not None:
        base[i, old] -= after[i, old] + before[i, old] + own
    total += xlogx(base + after + before + own[:, None]) - xlogx(base + after) - xlogx(base + before) + xlogx(base)
    for sums, moved, stays in ((big.sum(1), near[0].sum(1) + own, before), (big.sum(0), near[1].sum(1) + own, after)):
        base = np.repeat(sums[None, :CLASSES], words, 0)
        if old is None:
            base = base + stays  # its bigrams count for its neighbours, whatever its class
        else:
            base[i, old] -= moved
        total -= xlogx(base + moved[:, None]) - xlogx(base)
    return total


class Endings:
    """Class of a word that has no neighbours to go by: the one its ending has most often in the core."""

    def __init__(self, words: list[bytes], of: np.ndarray):
        votes: dict[bytes, Counter] = {}
        for w, k in zip(words, of.tolist()):
            for size in (0, 1, 2, 3, 4):
                if len(w) >= size:
                    votes.setdefault(w[len(w) - size :], Counter())[k] += 1
        self.of = {e: max(v.items(), key=lambda x: (x[1], -x[0]))[0] for e, v in votes.items()}

    def __call__(self, word: bytes) -> int:
        for size in (4, 3, 2, 1, 0):
            got = self.of.get(word[max(0, len(word) - size) :] if size else b"")
            if got is not None:
                return got
        return 0


def word_counts(train: DataFrame) -> DataFrame:
    """Written table of all training words and the end token: (word, n)."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                for t in texts:
                    counts.update(tokens(t))
                counts[END_WORD] += len(texts)
                if len(counts) > 250_000:
                    yield out()
        if counts:
            yield out()

    rows = train.select("text").mapInArrow(run, "word binary, n long")
    return written(rows.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def count_level():
    """Sixteen levels of counts to a power of two."""
    return F.floor(F.log2("n") * 16)


def hot_level(words: DataFrame) -> int:
    """The lowest level such that at most HOT_WORDS words lie on it or above.

    Found from a histogram of levels (some hundred rows), so no task or driver sorts the vocabulary.
    """
    held, least = 0, 1 << 30
    for level, n in sorted(words.groupBy(count_level()).count().collect(), reverse=True):
        held += n
        if held > HOT_WORDS:
            break
        least = level
    return least


class _Places(dict):
    """Word -> number; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def neighbours(train: DataFrame, core: list[bytes]) -> DataFrame:
    """Written table of all words but the end token: (word, n, core, code, times).

    ``core`` is a core word's number; ``code`` and ``times`` count the word's core neighbours.
    """
    shared = train.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate([*core, END_WORD])})

    def run(batches):
        known = shared.value
        end = known[END_WORD]
        place, parts, held = _Places(known), [np.full(1, end)], 0

        def out():
            k = np.concatenate(parts)
            a, b = k[:-1], k[1:]
            right, left = (b <= end) & (a != end), (a <= end) & (b != end)
            keys, times = np.unique(np.concatenate([a[right] << BITS | b[right], b[left] << BITS | BEFORE | a[left]]), return_counts=True)
            while (times > MOST_TIMES).any():  # rare: one more entry with the rest
                over = times > MOST_TIMES
                keys, times = np.concatenate([keys, keys[over]]), np.concatenate([np.minimum(times, MOST_TIMES), times[over] - MOST_TIMES])
                order = keys.argsort(kind="stable")
                keys, times = keys[order], times[order]
            entries = (times << BITS | keys & ((1 << BITS) - 1)).astype("<i4")
            offsets = np.searchsorted(keys, np.arange(len(place) + 1) << BITS)
            n = np.bincount(k, minlength=len(place))
            n[end] = 0
            names = pa.array(list(place), pa.binary())
            lists = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((4 * offsets).astype("<i4").tobytes()), pa.py_buffer(entries.tobytes())])
            made = pa.RecordBatch.from_arrays([names, pa.array(n), lists], ["word", "n", "entries"]).filter(pa.array(n > 0))
            for at in range(0, len(made), 20_000):
                yield made.slice(at, 20_000)

        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                for t in texts:
                    ws = tokens(t)
                    ws.append(END_WORD)
                    parts.append(np.fromiter(map(place.__getitem__, ws), np.int64, len(ws)))
                    held += len(ws)
                if held > SLICE_TOKENS:
                    yield from out()
                    place, parts, held = _Places(known), [np.full(1, end)], 0
        if held:
            yield from out()

    def added(batches):
        """Sorted by word: the entries of one word added up; the last word waits for the next batch."""
        known, wait = shared.value, []

        def out(word, n, code, times, sizes):
            core = pa.array([known.get(w, -1) for w in word], pa.int32())
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], sizes.cumsum()]).astype(np.int32), x) for x in (pa.array(code, pa.int32()), pa.array(times, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(n, pa.int64()), core, *lists], ["word", "n", "core", "code", "times"])

        for batch in batches:
            if not len(batch):
                continue
            words = batch.column(0).to_pylist()
            n = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            entries = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").astype(np.int64)
            code, times = entries & ((1 << BITS) - 1), entries >> BITS
            if wait:
                words, n, sizes = [wait[0], *words], np.concatenate([[wait[1]], n]), np.concatenate([[len(wait[2])], sizes])
                code, times = np.concatenate([wait[2], code]), np.concatenate([wait[3], times])
            first = np.array([True, *(x != y for x, y in zip(words, words[1:]))])
            group = first.cumsum() - 1
            keys, at = np.unique(np.repeat(group, sizes) << BITS | code, return_inverse=True)
            times = np.bincount(at, times, len(keys)).astype(np.int64)
            owner, code = keys >> BITS, keys & ((1 << BITS) - 1)
            names = [words[i] for i in np.flatnonzero(first)]
            total = np.bincount(group, n).astype(np.int64)
            last = np.searchsorted(owner, len(names) - 1)
            wait = [names[-1], total[-1], code[last:], times[last:]]
            if len(names) > 1:
                yield out(names[:-1], total[:-1], code[:last], times[:last], np.bincount(owner[:last], minlength=len(names) - 1))
        if wait:
            yield out([wait[0]], [wait[1]], wait[2], wait[3], np.array([len(wait[2])]))

    rows = train.select("text").mapInArrow(run, "word binary, n long, entries binary")
    rows = rows.repartition(partitions(train.sparkSession), "word").sortWithinPartitions("word")
    return written(rows.mapInArrow(added, "word binary, n long, core int, code array<int>, times array<long>"), "neighbours")


def _flat(batch: pa.RecordBatch):
    """Owner, code and times of all entries of a batch of neighbour rows, and their number by row."""
    code, times = batch.column("code"), batch.column("times")
    sizes = pc.list_value_length(code).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(batch)), sizes), code.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64), sizes


def _slots(owner, code, times, of):
    """Entries by class of the neighbour, added up: those whose neighbour has no class are left out."""
    near = of[code & (BEFORE - 1)]
    known = near >= 0
    keys, at = np.unique(owner[known] * (2 * SIDE) + np.where(code[known] & BEFORE, SIDE, 0) + near[known], return_inverse=True)
    return keys // (2 * SIDE), keys % (2 * SIDE), np.bincount(at, times[known], len(keys)).astype(np.int64)


def best_class(rows: DataFrame, of: np.ndarray, big: np.ndarray, endings: Endings | None, turn: int | None = None, parts: int = 1) -> DataFrame:
    """(word, n, core, class) of neighbour rows.

    ``of``: class by core number and of the end token, -1 for none yet.  Words with a class keep it,
    but in a ``turn`` a part of them is exchanged; all others join the class that gains most.
    """
    shared = rows.sparkSession.sparkContext.broadcast((of, big, endings))

    def run(batches):
        of, big, endings = shared.value
        for batch in batches:
            if not len(batch):
                continue
            core = batch.column("core").to_numpy(zero_copy_only=False)
            old = np.where(core >= 0, of[core], -1)
            new = old.copy()
            owner, code, times, sizes = _flat(batch)
            ends = sizes.cumsum()
            words = batch.column("word")
            for start, stop in cuts(sizes, SLICE_ENTRIES):
                part = slice(int(ends[start - 1]) if start else 0, int(ends[stop - 1]))
                o, c, t = owner[part] - start, code[part], times[part]
                itself = (c & (BEFORE - 1)) == core[start:stop][o]
                own = np.bincount(o[itself & (c < BEFORE)], t[itself & (c < BEFORE)], stop - start)
                o, s, t = _slots(o[~itself], c[~itself], t[~itself], of)
                for fresh in (True, False):
                    move = (old[start:stop] < 0) if fresh else (old[start:stop] >= 0) & (core[start:stop] % parts == (turn or 0) % parts) & (turn is not None)
                    if not move.any():
                        continue
                    index = np.cumsum(move) - 1
                    keep = move[o]
                    gain = gains(None if fresh else old[start:stop][move], index[o[keep]], s[keep], t[keep], own[move], big)
                    new[start:stop][move] = gain.argmax(1)
                    if fresh and endings is not None:
                        alone = np.flatnonzero(move & (np.bincount(o, minlength=stop - start) == 0))
                        for i in alone.tolist():
                            new[start + i] = endings(words[start + i].as_py())
            yield pa.RecordBatch.from_arrays([words, batch.column("n"), batch.column("core"), pa.array(new, pa.int32())], ["word", "n", "core", "class"])

    return rows.mapInArrow(run, "word binary, n long, core int, class int")


def core_moves(core_rows: DataFrame, of: np.ndarray) -> np.ndarray:
    """The matrix of class transitions among the core words with a class and the end token."""
    shared = core_rows.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        of, big = shared.value, np.zeros((SIDE, SIDE), np.int64)
        for batch in batches:
            if len(batch):
                owner, code, times, _ = _flat(batch)
                k = of[batch.column("core").to_numpy(zero_copy_only=False)]
                owner, slot, times = _slots(owner, code, times, of)
                after = (k[owner] >= 0) & ((slot < SIDE) | (slot == SIDE + END))  # bigrams (end, word) have no row of their own
                a, b = np.where(slot < SIDE, k[owner], END), np.where(slot < SIDE, slot, k[owner])
                np.add.at(big, (a[after], b[after]), times[after])
        at = np.flatnonzero(big)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(big.ravel()[at])], ["at", "n"])

    return _matrix(core_rows.mapInArrow(run, "at long, n long"))


def _matrix(rows: DataFrame) -> np.ndarray:
    big = np.zeros(SIDE * SIDE)
    for at, n in rows.groupBy("at").agg(F.sum("n")).collect():  # at most classes squared
        big[at] = n
    return big.reshape(SIDE, SIDE)


def seeds(core_rows: DataFrame, n: int) -> np.ndarray:
    """Classes of the n most frequent core words by exchange, word by word, on at most n squared bigrams."""
    pairs = core_rows.where(F.col("core") < n).select("core", F.explode(F.arrays_zip("code", "times")).alias("x"))
    pairs = pairs.where(F.col("x.code") < n).select("core", F.col("x.code").alias("near"), F.col("x.times").alias("n")).toPandas().sort_values(["core", "near"])
    return exchange(pairs["core"].to_numpy(np.int64), pairs["near"].to_numpy(np.int64), pairs["n"].to_numpy(np.float64), n)


def core_classes(core_rows: DataFrame, core: list[bytes], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class by core number (the end token last), and the core's matrix of class transitions."""
    of = np.full(len(core) + 1, -1)
    of[-1] = END
    n = min(SEED_WORDS, len(core))
    of[:n] = seeds(core_rows, n)

    def exchanged(big, turn, parts):
        new = of.copy()
        for r in best_class(core_rows, of, big, None, turn, parts).select("core", "class").collect():  # one row a core word
            new[r[0]] = r[1]
        return new

    if n < len(core):
        of = exchanged(core_moves(core_rows, of), None, 1)
    big, parts = core_moves(core_rows, of), 4
    for turn in range(rounds):
        new = exchanged(big, turn, parts)
        new_big = core_moves(core_rows, new)
        if likelihood(new_big) < likelihood(big):
            parts *= 2
        else:
            of, big = new, new_big
    return of, big


@dataclass
class Classes:
    words: DataFrame  # (word, n, class, hot), written; the end token among them
    endings: Endings


def clustered(train: DataFrame, rounds: int = ROUNDS) -> Classes:
    """Classes and counts of all training words."""
    vocabulary = word_counts(train)
    level = hot_level(vocabulary)
    names = vocabulary.where(F.col("word") != F.lit(bytearray(END_WORD)))
    core = [bytes(r[0]) for r in names.orderBy(F.desc("n"), "word").limit(CORE_WORDS).select("word").collect()]
    rows = neighbours(train, core)
    core_rows = written(rows.where("core >= 0").coalesce(8), "core")
    of, big = core_classes(core_rows, core, rounds)
    endings = Endings(core, of[:-1])
    words = best_class(rows, of, big, endings).withColumn("hot", (F.col("core") >= 0) | (count_level() >= level)).drop("core")
    ends = vocabulary.where(F.col("word") == F.lit(bytearray(END_WORD))).select("word", "n", F.lit(END).alias("class"), F.lit(True).alias("hot"))
    words = written(words.unionByName(ends), "words")
    for t in (vocabulary, rows, core_rows):
        discard(t)
    return Classes(words, endings)


class _Hot(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _sum_codes(rows: DataFrame) -> DataFrame:
    """Transitions of all rows by code: (at, n)."""

    def run(batches):
        big = np.zeros(SIDE * SIDE, np.int64)
        for batch in batches:
            if len(batch):
                big += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), SIDE * SIDE).astype(np.int64)
        at = np.flatnonzero(big)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(big[at])], ["at", "n"])

    return rows.where("not held_out").select("codes", "counts").mapInArrow(run, "at long, n long")


def _values(rows: DataFrame, weight, name: str, keep: list[str]) -> DataFrame:
    """``keep`` and the sum of the weights of each row's transitions."""
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        for batch in batches:
            codes, counts = batch.column("codes"), batch.column("counts")
            sizes = pc.list_value_length(codes).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), sizes)
            value = np.bincount(owner, weight.value[codes.flatten().to_numpy()] * counts.flatten().to_numpy(), len(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(value)], [*keep, name])

    return rows.select(*keep, "codes", "counts").mapInArrow(run, ", ".join([*kinds, f"{name} double"]))


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.unique(a * SIDE + b, return_counts=True)
    return codes.astype(np.int32), counts.astype(np.int32)


INTS = pa.list_(pa.int32())


def read_texts(source: DataFrame, model: Classes) -> DataFrame:
    """Written table, a row a document: what hot words tell, and the transitions that wait for the others."""
    hot = model.words.where("hot").select("word", "class", "n").toPandas()  # at most HOT_WORDS and the core
    table = {bytes(w): i for i, w in enumerate(hot["word"])}
    shared = source.sparkSession.sparkContext.broadcast((table, hot["class"].to_numpy(np.int64), np.log10(hot["n"].to_numpy() + 1.0), model.endings))

    def run(batches):
        known, hot_class, hot_logs, endings = shared.value
        known = _Hot(known)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                out = []
                for t in texts:
                    ws = tokens(t)
                    at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                    seen = at >= 0
                    k = np.full(len(ws) + 2, END)
                    k[1:-1] = np.where(seen, hot_class[at] if len(hot_class) else -1, -1)
                    rare, times = {}, []
                    if not seen.all():
                        some = [ws[i] for i in np.flatnonzero(~seen)]
                        places = np.fromiter((rare.setdefault(w, len(rare)) for w in some), np.int64, len(some))
                        k[1:-1][~seen] = -1 - places
                        times = np.bincount(places).astype(np.int32)
                    a, b = k[:-1], k[1:]
                    sure = (a >= 0) & (b >= 0)
                    out.append((row, len(ws) + 1, int(seen.sum()), float(hot_logs[at[seen]].sum()), *_counted(a[sure], b[sure]), list(rare), [endings(w) for w in rare], times, a[~sure].astype(np.int32), b[~sure].astype(np.int32)))
                    row += 1
                made = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
                ids = [batch.column(i).slice(start, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *made], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), INTS, INTS, pa.list_(pa.binary()), INTS, INTS, INTS, INTS]
    names = ["doc_id", "held_out", "row", "n_tokens", "n_hot", "hot_logs", "codes", "counts", "rare", "guess", "times", "before", "after"]
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_hot long, hot_logs double, codes array<int>, counts array<int>, rare array<binary>, guess array<int>, times array<int>, before array<int>, after array<int>"
    return written(source.select("doc_id", "held_out", "text").mapInArrow(run, schema), "read")


def rare_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Written table, a row a document with words outside the hot table: their counts and transitions."""
    asked = rows.select("row", F.posexplode("rare").alias("at", "word"))
    found = asked.join(words.where("not hot").select("word", "class", "n"), "word").groupBy("row").agg(F.collect_list(F.struct("at", "class", "n")).alias("found"))
    rest = rows.where("size(rare) > 0").select("row", "held_out", "guess", "times", "before", "after").join(found, "row", "left")
    rest = rest.select("row", "held_out", "guess", "times", "before", "after", *(F.col(f"found.{c}").alias(f"f_{c}") for c in ("at", "class", "n")))

    def run(batches):
        for batch in batches:
            out = []
            for guess, times, before, after, at, of, n in zip(*(batch.column(c).to_pylist() for c in ("guess", "times", "before", "after", "f_at", "f_class", "f_n"))):
                k, times, seen = np.array(guess), np.array(times), np.zeros(len(guess))
                if at is not None:
                    k[at], seen[at] = of, n
                a, b = (np.where(x < 0, k[np.where(x < 0, -1 - x, 0)], x) for x in (np.array(before, np.int64), np.array(after, np.int64)))
                out.append((int(times[seen > 0].sum()), float((times * np.log10(seen + 1)).sum()), *_counted(a, b)))
            if out:
                made = [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.float64(), INTS, INTS))]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), *made], ["row", "held_out", "n_rare", "rare_logs", "codes", "counts"])

    return written(rest.mapInArrow(run, "row long, held_out boolean, n_rare long, rare_logs double, codes array<int>, counts array<int>"), "rare")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train=None) -> DataFrame:
    """One row a document: held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``train``: condition of the rows to learn from; by default those not held out.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *([] if train is None else [train.alias("_train")]))
    source = source.withColumn("held_out", held_out() if train is None else ~F.coalesce("_train", F.lit(False)))
    model = clustered(source.where(~F.col("held_out")))
    by_class = np.zeros((2, SIDE))
    for k, types, n in model.words.groupBy("class").agg(F.count("*"), F.sum("n")).collect():  # one row a class
        by_class[:, k] = types, n
    types, total, ends = int(by_class[0].sum()), int(by_class[1].sum()), int(by_class[1][END])
    rows = read_texts(source, model)
    rare = rare_words(rows, model.words)
    moves = _matrix(_sum_codes(rows).unionByName(_sum_codes(rare)))
    # P(class | class before), add-one; P(word | class), add-one with one share for unseen words; the end token is certain in its class
    log_move = np.log10((moves + 1) / (moves.sum(1, keepdims=True) + SIDE))
    log_class = np.log10(by_class[1] + by_class[0] + 1)
    log_class[END] = 0
    weight = docs.sparkSession.sparkContext.broadcast((log_move - log_class).ravel())
    base_total = total + types + 1
    wide = _values(rows, weight, "value", ["row", "doc_id", "held_out", "n_tokens", "n_hot", "hot_logs"])
    more = _values(rare, weight, "rare_value", ["row", "n_rare", "rare_logs"])
    logs = F.col("hot_logs") + F.coalesce("rare_logs", F.lit(0.0))
    return wide.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(base_total))).alias("base_score"),
        (F.col("value") + F.coalesce("rare_value", F.lit(0.0)) + logs).alias("score"),
    )
