"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph; the graph is cut into equal parts with
few edges between them; a small classifier learns each vector's part.  Where the parts would be
larger than ``PART_ROWS`` rows, each is cut again the same way, by a graph and a classifier of a bounded
sample of its own, fitted side by side in tasks; so the parts grow in number with the rows, to
``PARTS`` squared.  All vectors go to their most probable part, queries to their several most
probable ones, where candidates are scored exactly.  How many parts a query visits is chosen on
the sample, so that the visited parts hold ``RECALL`` of the sample's true neighbours, and so that
they hold k rows at least.

A row travels once.  Only parts larger than that (a common vector, say) are dealt into blocks
of bounded size, and their rows travel once for each ``BLOCK_QUERIES`` queries that visit them.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id.  Rows that share an id are one item with several vectors, found once with its best
score; equal scores go to the smaller id; fewer than k candidates are all returned; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import as_bytes, finite, of_batch, one_a_group, search
from .shared import sample_ids

SAMPLE_ROWS = 4_096  # of all rows, and again of each part that is cut further
PARTS = 32
PART_ROWS = 8_192
GRAPH_DEGREE = 12
BALANCE = 1.1
RECALL = 0.93
BLOCK_ROWS = 2_048
BLOCK_QUERIES = 4_096
LEARN_ROUNDS = 300


@dataclass
class Router:
    """Weights of the classifier of parts, and of each part's own classifier of its parts."""

    weights: np.ndarray  # (dimensions + 1) x parts
    inner: dict[int, np.ndarray] = field(default_factory=dict)
    visits: int = 1

    @property
    def parts(self) -> int:
        return sum(self.inner[p].shape[1] if p in self.inner else 1 for p in range(self.weights.shape[1]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of each part for each row; a part that is cut gives way to its parts."""
        if not len(x):
            return np.zeros((0, self.parts))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        outer = log_shares(unit, self.weights)
        return np.hstack([outer[:, [p]] + (log_shares(unit, self.inner[p]) if p in self.inner else 0) for p in range(outer.shape[1])])


def log_shares(unit: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = unit @ weights[:-1] + weights[-1]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others by inner product, in blocks of rows."""
    out = []
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisected(x: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by repeated halving along the direction of most variance: the start of the cut."""
    of = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            g = g[(y @ axis).argsort(kind="stable")]
            halves += [g[: len(g) // 2], g[len(g) // 2 :]]
        groups = halves
    for p, g in enumerate(groups):
        of[g] = p
    return of


def balanced_cut(near: np.ndarray, of: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Refine a partition of the neighbour graph: move rows to the part of most neighbours while sizes allow."""
    n = len(of)
    cap, floor = int(BALANCE * n / parts) + 1, int(n / parts / BALANCE)
    a = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    b = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(a * parts + of[b], minlength=n * parts).reshape(n, parts)
        gain = votes - votes[np.arange(n), of][:, None]
        size = np.bincount(of, minlength=parts)
        moved = 0
        best = gain.argmax(1)
        for i in (-gain[np.arange(n), best]).argsort(kind="stable"):
            p = best[i]
            if gain[i, p] <= 0:
                break
            if size[p] < cap and size[of[i]] > floor:
                size[p] += 1
                size[of[i]] -= 1
                of[i] = p
                moved += 1
        if not moved:
            break
    return of


def classifier(x: np.ndarray, most: int) -> np.ndarray:
    """Graph of the rows, its balanced cut into at most ``most`` parts, and a softmax classifier of these."""
    parts = 1
    while parts * 2 <= most and len(x) >= 64 * parts:
        parts *= 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, x.shape[1] if x.ndim > 1 else 0))
    if parts == 1:
        return np.zeros((unit.shape[1] + 1, 1))
    of = balanced_cut(neighbours(x, min(GRAPH_DEGREE, len(x) - 1)), bisected(unit, parts), parts)
    inputs = np.hstack([unit, np.ones((len(unit), 1))])
    w, m1, m2 = (np.zeros((inputs.shape[1], parts)) for _ in range(3))
    target = np.eye(parts)[of]
    for t in range(1, LEARN_ROUNDS + 1):
        p = np.exp(log_shares(unit, w))
        g = inputs.T @ (p - target) / len(x) + 1e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    return w


def route(rows: DataFrame, router: Router, most: int) -> DataFrame:
    """(id, v as bytes, parts): each row's ``most`` most probable parts, the likeliest first."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 2_048):
                part = batch.slice(start, 2_048)
                x = of_batch(part.column(1))
                ranked = (-shared.value.logits(x)).argsort(1, kind="stable")[:, :most].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * ranked.shape[1]), pa.array(ranked.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), as_bytes(x), lists], ["id", "v", "parts"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v binary, parts array<int>")


def sampled(rows: DataFrame, bound: int) -> np.ndarray:
    some = rows.join(F.broadcast(sample_ids(rows, "id", bound)), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").toPandas()
    return np.stack(some["v"].to_numpy()) if len(some) else np.zeros((0, 0))


def fit(rows: DataFrame, k: int) -> Router:
    """Graph, cut and classifiers from bounded samples of (id, v)."""
    x = sampled(rows, SAMPLE_ROWS)
    router = Router(classifier(x, PARTS))
    parts = router.weights.shape[1]
    if parts == 1:
        return router
    routed = route(rows, router, 1).withColumn("part", F.get("parts", 0))
    counts = dict(routed.groupBy("part").count().collect())  # one row a part
    large = {p: n for p, n in counts.items() if n > PART_ROWS}
    if large:
        share = F.create_map(*[F.lit(v) for p, n in large.items() for v in (p, min(2**63 - 1, int(min(1.0, SAMPLE_ROWS / n) * 2**63)))])
        some = routed.where(F.col("part").isin(list(large)) & (F.shiftrightunsigned(F.xxhash64("id", F.lit(2)), 1) <= F.element_at(share, F.col("part"))))

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            part = int(pdf["part"].iloc[0])
            own = np.stack([np.frombuffer(v, "<f8") for v in pdf.sort_values("id")["v"]])[: 2 * SAMPLE_ROWS]
            w = classifier(own, min(PARTS, -(-large[part] * 2 // PART_ROWS)))
            return pd.DataFrame({"part": [part], "width": [w.shape[1]], "weights": [w.astype("<f8").tobytes()]})

        for part, width, weights in some.select("part", "id", "v").groupBy("part").applyInPandas(cut, "part int, width int, weights binary").collect():  # one row a part
            router.inner[part] = np.frombuffer(weights, "<f8").reshape(-1, width)
        parts = router.parts
    logits = router.logits(x)
    own = logits.argmax(1)
    rank_of = np.empty_like(logits, dtype=np.int64)
    np.put_along_axis(rank_of, (-logits).argsort(1, kind="stable"), np.arange(parts)[None, :], axis=1)
    asked = np.arange(0, len(x), max(1, len(x) // 1024))
    near = neighbours(x, min(k, len(x) - 1))[asked]
    needed = np.take_along_axis(rank_of[asked], own[near], axis=1)  # visits that reach each true neighbour
    router.visits = int(np.searchsorted(np.bincount(needed.ravel(), minlength=parts).cumsum() / needed.size, RECALL)) + 1
    return router


def best_of_block(query_ids, queries, ids, rows, k):
    """Exact scores; sums are repeated in one order for all rows near the edge, so equal vectors tie."""
    ids, rows, starts = one_a_group(ids, rows)
    several = len(starts) < len(ids)
    out_q, out_i, out_s = [], [], []
    for at in range(0, len(queries), 256):
        scores = queries[at : at + 256] @ rows.T
        for qid, q, s in zip(query_ids[at : at + 256], queries[at : at + 256], scores):
            s[ids == qid] = -np.inf
            best = np.maximum.reduceat(s, starts) if several else s
            n = min(k, len(best))
            edge = np.partition(best, len(best) - n)[len(best) - n]
            keep = np.flatnonzero((s >= edge - 1e-9 * (1 + abs(edge))) & (s > -np.inf)) if edge > -np.inf else np.flatnonzero(s > -np.inf)
            exact = (rows[keep] * q).sum(1)
            top = np.lexsort((ids[keep], -exact))
            if several:
                top = top[np.sort(np.unique(ids[keep][top], return_index=True)[1])]
            top = top[:k]
            out_q.append(np.full(len(top), qid))
            out_i.append(ids[keep][top])
            out_s.append(exact[top])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """Each query's k nearest found: query_id, rank, vec_id, score.

    is_query: condition on ``id`` that states the query set.  ``report`` gets the number of parts,
    the parts a query visits, and the share of the rows that are scored for a query.
    """
    rows = finite(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    router = fit(rows, k)
    parts = router.parts
    routed = route(rows, router, 1).select("id", "v", F.get("parts", 0).alias("part"))
    counts = dict(routed.groupBy("part").count().collect())  # one row a part
    sizes = np.sort([counts.get(p, 0) for p in range(parts)]).cumsum()
    visits = min(parts, max(router.visits, int(np.searchsorted(sizes, k + 1)) + 1))  # even the smallest parts hold k others
    asked = route(rows.where(is_query), router, visits).select(F.col("id").alias("query_id"), "v", F.explode("parts").alias("part"))
    visitors = dict(asked.groupBy("part").count().collect())
    if report is not None:
        pairs = sum(n * counts.get(p, 0) for p, n in visitors.items())
        report |= {"parts": parts, "visits": visits, "scored": pairs / max(1, sum(counts.values()) * sum(visitors.values()) / visits)}
    column = lambda f: F.array(*[F.lit(int(f(p))) for p in range(parts)])
    pieces = column(lambda p: max(1, -(-counts.get(p, 0) // BLOCK_ROWS)))
    blocks = column(lambda p: max(1, -(-visitors.get(p, 0) // BLOCK_QUERIES)))
    of = lambda c: F.get(c, F.col("part"))
    shard = lambda piece: (F.col("part") * F.lit(1 << 32) + piece).alias("shard")
    candidates = routed.select(shard(F.pmod(F.xxhash64("id"), of(pieces))), F.explode(F.sequence(F.lit(0), of(blocks) - 1)).alias("block"), "id", "v")
    queries = asked.select(
        "part", "query_id", "v", F.pmod(F.xxhash64("query_id", F.lit(1)), of(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), of(pieces) - 1)).alias("piece")
    ).select(shard(F.col("piece")), "block", "query_id", "v")
    return search(candidates, queries, best_of_block, k, "double")
