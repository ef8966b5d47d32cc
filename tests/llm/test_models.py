"""Toxicity and language models: held-out accuracy, brute force, awkward inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkgauge.llm import brown_lm, queries, toxicity

from ..conftest import SMALL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_marginals(em, trans):
    """Forward-backward of one chain by summing over all label sequences."""
    n, total, mass = len(em), 0.0, np.zeros(len(em))
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        w = math.exp(sum(em[i] * y[i] + trans[(y[i - 1] if i else 0), y[i]] for i in range(n)))
        total += w
        mass += w * np.array(y)
    return mass / total


def test_forward_backward():
    rng = np.random.default_rng(0)
    em, trans = rng.normal(size=11), rng.normal(size=(2, 2))
    sizes = np.array([4, 0, 7])
    rows, mask, place = toxicity.blocks(em, sizes)
    got, expected = toxicity.forward_backward(rows, mask, place, trans, pairs=True)
    want = np.concatenate([brute_marginals(em[:4], trans), brute_marginals(em[4:], trans)])
    assert np.allclose(got[mask], want) and math.isclose(expected.sum(), 11)


def test_chain_gradient():
    """Marginals and expected transitions are the gradient of the log-partition function."""
    rng = np.random.default_rng(1)
    em, trans = rng.normal(size=5), rng.normal(size=(2, 2))

    def log_z(e, t):
        return math.log(sum(math.exp(sum(e[i] * (b >> i & 1) + t[(b >> (i - 1) & 1) if i else 0, b >> i & 1] for i in range(5))) for b in range(32)))

    rows, mask, place = toxicity.blocks(em, np.array([5]))
    p, expected = toxicity.forward_backward(rows, mask, place, trans, pairs=True)
    for i in range(5):
        d = np.zeros(5)
        d[i] = 1e-5
        assert math.isclose((log_z(em + d, trans) - log_z(em - d, trans)) / 2e-5, p[mask][i], abs_tol=1e-6)
    d = np.zeros((2, 2))
    d[0, 1] = 1e-5
    assert math.isclose((log_z(em, trans + d) - log_z(em, trans - d)) / 2e-5, expected[0, 1], abs_tol=1e-6)


def test_documents_of_many_blocks(monkeypatch):
    """Messages pass over block edges: marginals and transitions are those of one whole chain."""
    rng = np.random.default_rng(4)
    em, trans, sizes = rng.normal(size=26), rng.normal(size=(2, 2)), np.array([11, 0, 1, 12, 2])
    rows, mask, place = toxicity.blocks(em, sizes)
    whole, total = toxicity.forward_backward(rows, mask, place, trans, pairs=True)
    whole = whole[mask]
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    monkeypatch.setattr(toxicity, "BLOCKS", 2)
    rows, mask, place = toxicity.blocks(em, sizes)
    got, expected = toxicity.forward_backward(rows, mask, place, trans, pairs=True)
    assert rows.shape == (10, 3) and np.allclose(got[mask], whole) and np.allclose(expected, total)
    assert np.allclose(got[mask][:11], brute_marginals(em[:11], trans))


def test_long_rows_are_learnt_from(spark, monkeypatch):
    """Texts of any length enter the sample; the rest of it is bounded."""
    long = "fine words " * 40_000
    docs = spark.createDataFrame([(i, long + f"dreadful {i}") for i in range(30)] + [(100 + i, f"fine words {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2_000_000)
    rows = toxicity.sample(docs, labels)
    assert rows[rows.toxic == 1].text.map(len).sum() > 2_000_000 > rows[rows.toxic == 1].text.map(len).sum() - len(long) - 20
    assert len(rows[rows.toxic == 0]) == sum(zlib.crc32(str(100 + i).encode()) % 3 != 1 for i in range(60))


def test_held_out_accuracy(spark):
    from ..conftest import SMALL as small

    big = small.replace("sf0.001", "sf0.01")
    got = queries.op5_toxicity(spark, big).toPandas()
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = labels[labels.held_out]
    hit = held[held.toxic == 1].predicted.mean()
    false = held[held.toxic == 0].predicted.mean()
    assert hit >= 0.7 and false <= 0.02


def test_toxic_spans_and_awkward_documents(spark, docs, empty):
    rows = [(i, f"hello kind world number {i} of many", 0) for i in range(200)] + [(1000 + i, f"hello you dreadful person number {i} of many", 1) for i in range(100)]
    train = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(5000, None), (None, 1), (1000, 0)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    probe = spark.createDataFrame([(1, "So, dreadful weather"), (2, "kind weather")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(probe, model, spans=True).collect()}
    assert got[1].score >= 0.7 > got[2].score
    assert [(s.start, s.end) for s in got[1].spans] == [(4, 12)] and got[2].spans == []
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels).score(np.array([[1.0, 1, 1, 1]]))[0] < 1e-9


def brute_base(rows):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t, h in zip(toks, held)]


def test_language_model_base(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in brown_lm.score(docs).collect()))
    want = sorted((str(i), h, n, k, t, round(b, 6)) for (i, _), (h, n, k, t, b) in zip(rows, brute_base(rows)))
    assert got == want
    assert brown_lm.score(empty).count() == 0


def test_rare_words_go_through_the_join(docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): r for r in brown_lm.score(docs).collect()}
    monkeypatch.setattr(brown_lm, "HOT_WORDS", 3)
    for r in brown_lm.score(docs).collect():
        w = whole[r.doc_id, r.n_tokens]
        assert r.n_known == w.n_known and math.isclose(r.score, w.score, rel_tol=1e-9) and math.isclose(r.base_score, w.base_score, rel_tol=1e-9)


def test_language_model_is_a_distribution(spark):
    """Over all one-word continuations, known and unseen, the shares of a class sum to one."""
    got = queries.op7_brown_lm(spark, SMALL).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()  # classes help on texts not learnt from
    assert (got.score < 0).all()


def test_exchange_raises_likelihood():
    bigrams = np.array([(0, 2, 40), (2, 0, 20), (0, 3, 20), (1, 2, 40), (2, 1, 20), (1, 3, 20)])  # a and b stand before x and y
    of = brown_lm.exchange(*bigrams.T, 4, classes=2)
    assert of[0] == of[1] != of[2] == of[3]
    assert len(brown_lm.exchange(*np.zeros((3, 0), np.int64), 0, 2)) == 0


def test_gains_are_differences_of_likelihood():
    """Of words moved to each class, with bigrams with themselves and with the end token."""
    rng = np.random.default_rng(2)
    words, side = 40, brown_lm.SIDE
    pairs = rng.poisson(0.7, (words + 1, words + 1)).astype(float)  # the last is the end token
    of = np.append(rng.integers(0, 5, words), brown_lm.END)

    def matrix(of):
        big = np.zeros((side, side))
        np.add.at(big, (of[:, None], of[None]), pairs)
        return big

    owner, slot, n = [], [], []
    for w in range(words):
        for shift, line in ((0, pairs[w]), (side, pairs[:, w])):
            counts = np.bincount(of, np.where(np.arange(words + 1) == w, 0, line), side)
            for d in np.flatnonzero(counts):
                owner, slot, n = [*owner, w], [*slot, shift + d], [*n, int(counts[d])]
    got = brown_lm.gains(of[:words], np.array(owner), np.array(slot), np.array(n), np.diag(pairs)[:words], matrix(of))
    for w in range(0, words, 7):
        want = []
        for k in range(8):
            new = of.copy()
            new[w] = k
            want.append(brown_lm.likelihood(matrix(new)))
        assert np.allclose(got[w, :8] - got[w, 0], np.array(want) - want[0], atol=1e-6)


def test_gains_of_joining():
    """Words without a class yet: the likelihood of the matrix with them, for each class."""
    rng = np.random.default_rng(5)
    words, side = 12, brown_lm.SIDE
    of = np.append(rng.integers(0, 5, words), brown_lm.END)
    pairs = rng.poisson(0.9, (words + 1, words + 1)).astype(float)
    big = np.zeros((side, side))
    np.add.at(big, (of[:, None], of[None]), pairs)
    right, left = rng.poisson(0.8, words + 1), rng.poisson(0.8, words + 1)
    counts = np.concatenate([np.bincount(of, right, side), np.bincount(of, left, side)]).astype(np.int64)
    slot = np.flatnonzero(counts)
    got = brown_lm.gains(None, np.zeros(len(slot), np.int64), slot, counts[slot], np.array([3]), big)
    want = []
    for k in range(brown_lm.CLASSES):
        new = big.copy()
        new[k] += counts[:side]
        new[:, k] += counts[side:]
        new[k, k] += 3
        want.append(brown_lm.likelihood(new))
    assert np.allclose(got[0] - got[0, 0], np.array(want) - want[0], atol=1e-6)


def brute_neighbours(texts, core):
    """Each word's n and its counts of core neighbours."""
    place = {w: i for i, w in enumerate([*core, "\n"])}
    out = {}
    for t in texts:
        ws = ["\n", *t.split(), "\n"]
        for i in range(1, len(ws) - 1):
            n, near = out.setdefault(ws[i], [0, Counter()])
            out[ws[i]][0] += 1
            for other, shift in ((ws[i + 1], 0), (ws[i - 1], brown_lm.BEFORE)):
                if other in place:
                    near[place[other] + shift] += 1
    return out


def test_neighbour_counts(spark, monkeypatch):
    """Slices, batches and split counts add up to the counts of the whole corpus."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], rng.integers(0, 60))) for _ in range(200)] + ["x " * 900, ""]
    monkeypatch.setattr(brown_lm, "SLICE_TOKENS", 300)
    monkeypatch.setattr(brown_lm, "MOST_TIMES", 7)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text"))
    core = ["w1", "w2", "x"]
    got = {bytes(r.word).decode(): (r.n, dict(zip(r.code, r.times)), r.core) for r in brown_lm.neighbours(docs, [w.encode() for w in core]).collect()}
    assert got == {w: (n, dict(near), core.index(w) if w in core else -1) for w, (n, near) in brute_neighbours(texts, core).items()}


def test_every_word_is_clustered(spark, monkeypatch):
    """Words beyond the core, in long texts, get their class by exchange and not by their ending."""
    rng = np.random.default_rng(3)
    nouns, verbs = ([f"{x}{i}" for i in range(300)] for x in "nv")
    line = lambda: " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(6000))
    rows = [(i, line()) for i in range(4)] + [(i, "a b") for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    monkeypatch.setattr(brown_lm, "CORE_WORDS", 120)
    monkeypatch.setattr(brown_lm, "SEED_WORDS", 60)
    model = brown_lm.clustered(docs)
    of = {bytes(r.word).decode(): r["class"] for r in model.words.collect()}
    counts = {bytes(r.word).decode(): r.n for r in model.words.collect()}
    tokens = Counter(w for _, t in rows for w in [*t.split(), "\n"])
    assert counts == tokens and of["\n"] == brown_lm.END
    mixed = sum(of[v] == of[w] for v in nouns for w in verbs) / 300**2
    alike = sum(of[v] == of[w] for v in nouns for w in nouns) / 300**2
    assert mixed < 0.02 < alike


def brute_score(rows, classes):
    """log10 probabilities from the definition, given classes and counts of the training words."""
    words = {bytes(r.word): (r["class"], r.n) for r in classes.words.collect()}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    moves, end = np.zeros((brown_lm.SIDE, brown_lm.SIDE)), brown_lm.END
    seqs = []
    for (_, t), h in zip(rows, held):
        ws = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))]
        ks = [end, *(words[w][0] if w in words else classes.endings(w) for w in ws), end]
        seqs.append((ws, ks))
        if not h:
            for a, b in zip(ks, ks[1:]):
                moves[a, b] += 1
    types, total = np.zeros(brown_lm.SIDE), np.zeros(brown_lm.SIDE)
    for k, n in words.values():
        types[k] += 1
        total[k] += n
    out = []
    for ws, ks in seqs:
        x = sum(math.log10((moves[a, b] + 1) / (moves[a].sum() + brown_lm.SIDE)) for a, b in zip(ks, ks[1:]))
        x += sum(math.log10((words.get(w, (0, 0))[1] + 1) / (total[k] + types[k] + 1)) for w, k in zip(ws, ks[1:]))
        out.append(x)
    return out


def test_score_is_brute_force(docs, monkeypatch):
    monkeypatch.setattr(brown_lm, "HOT_WORDS", 5)
    monkeypatch.setattr(brown_lm, "CORE_WORDS", 8)
    made = []
    clustered = brown_lm.clustered
    monkeypatch.setattr(brown_lm, "clustered", lambda *a: made.append(clustered(*a)) or made[-1])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in brown_lm.score(docs).collect())
    assert got == sorted((str(i), round(x, 6)) for (i, _), x in zip(rows, brute_score(rows, made[0])))
