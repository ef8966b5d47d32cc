"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Document labels become token labels first: a word or word beginning that toxic documents use
far more than clean ones (likelihood-ratio test) marks its tokens in toxic documents as toxic;
all other tokens are clean.  A two-state chain is trained on these tokens.  Forward-backward
marginals give each token's probability; a document's score is a logistic function of its
largest marginal, its expected number of toxic tokens and that number's share.

A document is one chain, however long.  The work is cut into blocks of ``BLOCK`` tokens: each
block's transfer matrix carries the forward and backward messages over it, so that all blocks of
a batch run side by side and give the marginals of the whole chains.

The model is fitted on a bounded sample of labelled rows: the first by id hash, at most
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` rows, of each kind as many as begin within the first
``SAMPLE_CHARS`` characters; texts of any length are among them, whole.  Scoring covers every
whole text.  Labels, language, source and ids are no inputs of a score.

Null and empty texts get the score of a document without toxic tokens.  Labels that are null
or neither 0 nor 1 are ignored; a document labelled both ways counts as toxic, and of texts that
share a labelled id the smallest is learnt from; without labels of both kinds every score is 0.
Repeated rows are scored each by itself; an empty table gives no rows; ``keep_clean`` passes all
columns on as they are, ``score`` ignores the others.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Recent, cuts, id_hash, text_slices, worker_state

SAMPLE_TOXIC = 2_000
SAMPLE_CLEAN = 3_000
SAMPLE_CHARS = 8_000_000
BLOCK = 64
BLOCKS = 8_192  # blocks worked on at a time
PREFIXES = (4, 5, 6, 7)
CACHE_WORDS = 150_000
REJECT = 0.7
EDGES = string.punctuation + string.digits
ROUNDS = 40


def features(word: str) -> list[int]:
    """Hashes of the word and its beginnings, of a raw white-space-free token."""
    w = word.strip(EDGES).lower()
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in ("=" + w, *(w[:n] for n in PREFIXES if len(w) >= n))] if w else []


def held_out(id_col: str = "doc_id"):
    return id_hash(F.col(id_col)) % 3 == 1


def blocks(emission: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A run of documents' emissions as rows of BLOCK tokens: (rows, mask, each row's place in its document)."""
    per_doc = -(-sizes // BLOCK)
    doc_of = np.repeat(np.arange(len(sizes)), per_doc)
    place = np.arange(len(doc_of)) - np.repeat(per_doc.cumsum() - per_doc, per_doc)
    ends = sizes.cumsum()
    at = ((ends - sizes)[doc_of] + place * BLOCK)[:, None] + np.arange(BLOCK)
    mask = at < ends[doc_of][:, None]
    rows = np.zeros(at.shape)
    rows[mask] = emission  # row-major order is the order of the tokens
    return rows, mask, place


def transfer(rows: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each block's product of transition matrices, scaled: state before it to state at its end."""
    t = np.exp(trans)
    m = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, len(rows))).copy()
    for k in range(rows.shape[1]):
        psi = np.exp(np.clip(rows[:, k], -30, 30))
        new = np.stack([m[:, 0] * t[0, 0] + m[:, 1] * t[1, 0], (m[:, 0] * t[0, 1] + m[:, 1] * t[1, 1]) * psi], 1)
        m = np.where(mask[:, k], new / new.sum((0, 1)), m)
    return m


def messages(rows: np.ndarray, mask: np.ndarray, place: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward message into each block and backward message from behind it, over whole documents.

    State 0 starts every document.
    """
    n = len(rows)
    ahead, behind = np.zeros((2, n)), np.ones((2, n))
    ahead[0] = 1
    if n and place.max() > 0:
        m = np.concatenate([transfer(rows[at : at + BLOCKS], mask[at : at + BLOCKS], trans) for at in range(0, n, BLOCKS)], 2)
        order = place.argsort(kind="stable")
        bounds = np.searchsorted(place[order], np.arange(1, place.max() + 2))
        groups = [order[a:b] for a, b in zip(bounds, bounds[1:])]  # the second blocks, the third, ...
        for at in groups:
            x = (ahead[:, None, at - 1] * m[:, :, at - 1]).sum(0)
            ahead[:, at] = x / x.sum(0)
        for at in groups[::-1]:
            x = (m[:, :, at] * behind[None, :, at]).sum(1)
            behind[:, at - 1] = x / x.sum(0)
    return ahead, behind


def forward_backward(rows: np.ndarray, mask: np.ndarray, place: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of the toxic state; with ``pairs`` also expected transitions; some blocks at a time."""
    ahead, behind = messages(rows, mask, place, trans)
    out, expected = np.empty(rows.shape), np.zeros((2, 2))
    for at in range(0, len(rows), BLOCKS):
        some = slice(at, at + BLOCKS)
        out[some], part = _within(rows[some], mask[some], ahead[:, some], behind[:, some], trans, pairs)
        expected += part
    return (out, expected) if pairs else out


def _within(rows, mask, ahead, behind, trans, pairs: bool):
    n, length = rows.shape
    t = np.exp(trans)  # t[i, j]
    psi = np.exp(np.clip(rows, -30, 30))
    a0, a1 = np.empty((length, n)), np.empty((length, n))
    p0, p1 = ahead
    for k in range(length):
        on = mask[:, k]
        q0 = p0 * t[0, 0] + p1 * t[1, 0]
        q1 = (p0 * t[0, 1] + p1 * t[1, 1]) * psi[:, k]
        z = q0 + q1
        p0, p1 = np.where(on, q0 / z, p0), np.where(on, q1 / z, p1)
        a0[k], a1[k] = p0, p1
    out = np.empty((length, n))
    b0, b1 = behind
    expected = np.zeros((2, 2))
    for k in range(length - 1, -1, -1):
        g0, g1 = a0[k] * b0, a1[k] * b1
        out[k] = g1 / (g0 + g1)
        c1 = b1 * psi[:, k]
        d0, d1 = t[0, 0] * b0 + t[0, 1] * c1, t[1, 0] * b0 + t[1, 1] * c1
        if pairs:
            f0, f1 = (a0[k - 1], a1[k - 1]) if k else ahead
            z = f0 * d0 + f1 * d1
            on = mask[:, k] / z
            expected += [[(f0 * t[0, 0] * b0 * on).sum(), (f0 * t[0, 1] * c1 * on).sum()], [(f1 * t[1, 0] * b0 * on).sum(), (f1 * t[1, 1] * c1 * on).sum()]]
        z = d0 + d1
        b0, b1 = np.where(mask[:, k], 2 * d0 / z, b0), np.where(mask[:, k], 2 * d1 / z, b1)
    return out.T, expected


@dataclass
class Model:
    bias: float = -8.0
    weights: dict[int, float] = field(default_factory=dict)
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    level: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def document(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Inputs of the document score, from the marginals of a run of documents."""
        out = np.zeros((len(sizes), 4))
        out[:, 0] = 1
        full = sizes > 0
        if full.any():
            starts = (sizes.cumsum() - sizes)[full]
            total = np.add.reduceat(p, starts)
            out[full, 1] = np.maximum.reduceat(p, starts)
            out[full, 2] = np.log1p(total)
            out[full, 3] = np.sqrt(total / sizes[full])
        return out

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.level, -30, 30)))


class Scorer:
    """Scores texts on one worker; remembers a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.known = Recent(CACHE_WORDS)

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        known = self.known
        known.update((w, self.model.emission(w)) for w in known.missing({w for s in split for w in s}))
        get = known.__getitem__
        flat = np.fromiter((x for s in split for x in map(get, s)), np.float64, int(sizes.sum()))
        known.turn()
        rows, mask, place = blocks(flat, sizes)
        return forward_backward(rows, mask, place, self.model.trans)[mask], sizes

    def read(self, texts: list[str], least: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and offending offsets: (start, end, probability) of tokens at least that likely toxic."""
        p, sizes = self.marginals(texts)
        spans, at = [], 0
        for t, n in zip(texts, sizes):
            own = p[at : at + n]
            at += n
            if n and own.max() >= least:
                spans.append([{"start": m.start(), "end": m.end(), "probability": float(x)} for m, x in zip(re.finditer(r"\S+", t), own) if x >= least])
            else:
                spans.append([])
        return self.model.score(self.model.document(p, sizes)), spans

    def score(self, texts: list[str]) -> np.ndarray:
        p, sizes = self.marginals(texts)
        return self.model.score(self.model.document(p, sizes))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """The bounded sample of training rows: text, toxic."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    pick = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(n)
    some = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN))
    sizes = texts.select("_id", F.length("text").alias("n")).join(F.broadcast(some), "_id").groupBy("_id", "toxic").agg(F.max("n").alias("n"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)  # over the sample's rows
    within = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < SAMPLE_CHARS)
    chosen = texts.join(F.broadcast(within.select("_id", "toxic")), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    return chosen.toPandas().sort_values("_id")


def marks(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features toxic documents hold far more often than clean ones, from counts of documents."""
    a, b, n1, n0 = in_toxic.astype(float), in_clean.astype(float), n_toxic, n_clean
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    gain = a * np.log(np.maximum(a, 1) / np.maximum(e1, 1e-12)) + b * np.log(np.maximum(b, 1) / np.maximum(e0, 1e-12))
    return (a >= 3) & (gain >= 9) & (a / n1 >= 8 * (b + 0.5) / n0)


def holders(flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, of_feature: np.ndarray, per_word: np.ndarray, n: int) -> np.ndarray:
    """Documents of either kind (clean, toxic) that hold each of n features, some documents at a time."""
    out, begin, ends = np.zeros((2, n), np.int64), per_word.cumsum() - per_word, sizes.cumsum()
    for start, stop in cuts(sizes, 100_000):
        words = flat[int(ends[start - 1]) if start else 0 : int(ends[stop - 1])]
        held = np.unique(np.repeat(np.arange(stop - start), sizes[start:stop]) * len(per_word) + words)  # (document, word)
        doc, word = held // len(per_word), held % len(per_word)
        many = per_word[word]
        at = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many) + np.repeat(begin[word], many)
        held = np.unique(np.repeat(doc, many) * n + of_feature[at])  # (document, feature)
        np.add.at(out, (toxic[start + held // n], held % n), 1)
    return out


def numbered(texts) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Distinct words by number, the texts' words as numbers, and each text's length in words."""
    words: dict[str, int] = {}
    flat, sizes = array("q"), array("q")
    for t in texts:
        s = t.split()
        sizes.append(len(s))
        flat.extend(words.setdefault(w, len(words)) for w in s)
    return words, np.array(flat, np.int64), np.array(sizes, np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = sample(docs, labels, id_col, text_col)
    toxic = rows["toxic"].to_numpy(np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model()
    words, flat, sizes = numbered(rows["text"])
    del rows
    names = list(words)
    # (word, feature) pairs by number
    of_feature, per_word = array("q"), array("q")
    for w in names:
        fs = features(w)
        per_word.append(len(fs))
        of_feature.extend(fs)
    every, of_feature = np.unique(np.array(of_feature, np.int64), return_inverse=True)
    per_word = np.array(per_word, np.int64)
    of_word = np.repeat(np.arange(len(names)), per_word)
    held = holders(flat, sizes, toxic, of_feature, per_word, len(every))
    strong = marks(held[1], held[0], int(toxic.sum()), int((1 - toxic).sum()))
    strong_word = np.bincount(of_word, strong[of_feature], len(names)) > 0
    y = (strong_word[flat] & np.repeat(toxic == 1, sizes)).astype(float)

    # Only features of a token of either kind near a mark can differ from the bias: keep those seen twice.
    keep = (np.bincount(of_feature, minlength=len(every)) >= 2) | strong
    kept = every[keep]
    of_word, of_feature = of_word[keep[of_feature]], (keep.cumsum() - 1)[of_feature[keep[of_feature]]]
    del every

    rows_at, mask, place = blocks(np.zeros(len(flat)), sizes)
    before = np.concatenate([[0.0], y[:-1]])[: len(y)]
    before[(sizes.cumsum() - sizes)[sizes > 0]] = 0  # every document starts clean
    seen = np.array([[((1 - before) * (1 - y)).sum(), ((1 - before) * y).sum()], [(before * (1 - y)).sum(), (before * y).sum()]])
    scale = 1 / max(1.0, y.sum())
    bias, w, trans = -4.0, np.zeros(len(kept)), np.zeros((2, 2))
    m = [np.zeros(len(kept) + 5), np.zeros(len(kept) + 5)]
    for k in range(1, ROUNDS + 1):
        by_word = bias + np.bincount(of_word, w[of_feature], len(names))
        rows_at[mask] = by_word[flat]
        p, expected = forward_backward(rows_at, mask, place, trans, pairs=True)
        wrong = np.bincount(flat, p[mask] - y, len(names))
        grad = np.concatenate([np.bincount(of_feature, wrong[of_word], len(kept)), [wrong.sum()], (expected - seen).ravel()]) * scale
        grad[: len(kept)] += 1e-4 * w
        grad[len(kept) + 1 :] += 1e-2 * trans.ravel()
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        step = 0.3 * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
        w, bias, trans = w - step[: len(kept)], bias - step[len(kept)], trans - step[len(kept) + 1 :].reshape(2, 2)

    model = Model(float(bias), {f: x for f, x in zip(kept.tolist(), w.tolist()) if abs(x) > 0.01}, trans)
    by_word = np.array([model.emission(x) for x in names])
    rows_at[mask] = by_word[flat]
    inputs = model.document(forward_backward(rows_at, mask, place, trans)[mask], sizes)
    level, ridge = np.zeros(4), np.diag([1e-6, 1e-2, 1e-2, 1e-2])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(inputs @ level, -30, 30)))
        hess = (inputs * (q * (1 - q))[:, None]).T @ inputs + ridge
        level = level - np.linalg.solve(hess, inputs.T @ (q - toxic) + ridge @ level)
    model.level = level
    return model


def _scorer(model: Model) -> Scorer:
    """A worker's scorer, kept between tasks while the model is the same."""
    return worker_state(("toxicity", id(model)), lambda: Scorer(model))


SPANS = "array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row a document: doc_id, score, and with ``spans`` its toxic spans (code points, end exclusive)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: one weight a feature of the sample
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts))
                if spans:
                    scores, found = scorer.read(texts)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(scores), pa.array(found, span_type)], ["doc_id", "score", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(scorer.score(texts))], ["doc_id", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double" + f", spans {SPANS}" * spans)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that score under ``reject``, with all their columns; only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(shared.value)
        for column in columns:
            parts = [scorer.score(texts) for _, texts in text_slices(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(scored(F.col(text_col)) < reject)
