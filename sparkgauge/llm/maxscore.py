"""Exact top-k inner-product search by MaxScore.

Every dimension is a term with a posting for each row.  In a shard, a query's terms are ordered
by the most they can add to a score (above the least they can); the tail whose bounds together cannot lift a row
over the threshold is non-essential.  Essential postings are traversed; the others are
probed only for rows that are still competitive, a few terms at a time, while the threshold
rises.  Shards are merged at the end.  Pruning is strict, so ties are kept and the result is exact.

Shards and blocks of queries are about as large as a task can hold, so the rows travel once for each
``BLOCK_QUERIES`` queries and the queries once for each ``SHARD_ROWS`` rows, as 16-bit integers
where all components fit: an exact search cannot do with fewer meetings than it has such pairs.

Rows whose vector is null or holds null or non-finite components take no part, nor do rows without
an id.  Rows that share an id are one item with several vectors: it is no candidate for itself,
and is found once, with its best score.  Fewer than k candidates are all returned; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import as_bytes, finite, of_batch, one_a_group, search

SHARD_ROWS = 4_096
BLOCK_QUERIES = 4_096
PROBE_TERMS = 8


def best_of_shard(query_ids, queries, ids, rows, k):
    """MaxScore within a shard; all numbers are integers held exactly in doubles."""
    ids, rows, starts = one_a_group(ids, rows)
    several = len(starts) < len(ids)
    postings = np.ascontiguousarray(rows.T)  # one posting list a term, by id
    low, high = postings.min(1), postings.max(1)
    out_q, out_i, out_s = [], [], []
    for qid, q in zip(query_ids, queries):
        least, most = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
        bound = most - least
        terms = bound.argsort(kind="stable")[::-1]
        rest = np.concatenate([bound[terms][::-1].cumsum()[::-1], [0.0]])  # what terms from here on can add
        own = ids == qid
        few = np.flatnonzero(~own)[: 8 * k]
        if not len(few):
            continue
        if several:  # of each item one vector, so that k bounds are those of k items
            few = few[np.isin(few, starts)]
        seed = q @ postings[:, few]
        base = least.sum()
        at_least = (np.partition(seed, len(seed) - k)[-k] if len(seed) >= k else -np.inf) - base
        essential = max(1, int((rest >= at_least).sum()))
        essential = min(essential, len(terms))
        chosen = terms[:essential]
        partial = q[chosen] @ postings[chosen] - least[chosen].sum()
        alive = np.flatnonzero((partial + rest[essential] >= at_least) & ~own)
        partial = partial[alive]
        at = essential
        while at < len(terms) and len(alive):
            if len(partial) > k and not several:
                at_least = max(at_least, np.partition(partial, len(partial) - k)[-k])
                keep = partial + rest[at] >= at_least
                alive, partial = alive[keep], partial[keep]
            chosen = terms[at : at + PROBE_TERMS]
            partial = partial + q[chosen] @ postings[np.ix_(chosen, alive)] - least[chosen].sum()
            at += PROBE_TERMS
        top = np.lexsort((ids[alive], -partial))
        if several:
            top = top[np.sort(np.unique(ids[alive][top], return_index=True)[1])]
        top = top[:k]
        out_q.append(np.full(len(top), qid))
        out_i.append(ids[alive[top]])
        out_s.append(partial[top] + base)
    if not out_q:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_i), np.rint(np.concatenate(out_s)).astype(np.int64)


def topk(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k best rows by integer inner product of floor(scale * component).

    is_query: condition on ``id`` that states the query set.
    """
    rows = finite(vectors, id_col, vector_col)
    n, n_queries, most = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.array_max(F.transform("v", F.abs)))).first()
    kind = "<i2" if (most or 0) * scale + 1 < 2**15 else "<f8"
    least = vectors.sparkSession.sparkContext.defaultParallelism  # a shard a core at least
    shards, blocks = max(least, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))

    def scaled(batches):
        for batch in batches:
            v = np.floor(of_batch(batch.column(1)) * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_bytes(v, kind)], ["id", "v"])

    rows = rows.mapInArrow(scaled, f"id {rows.schema['id'].dataType.simpleString()}, v binary")
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = (
        rows.where(is_query)
        .withColumnRenamed("id", "query_id")
        .withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    )
    return search(candidates, queries, best_of_shard, k, "long", kind)
