"""Search of a stated query set against all rows, in blocks of bounded size.

Candidates are dealt into shards and queries into blocks; a task sees one shard and one block
at a time, so its memory is bounded whatever the number of rows, and copies of one vector are
spread like any other rows.  Each pair of shard and block gives its own best, which are merged
by (score, id).  Vectors travel as bytes of one fixed type.

Rows that share an id are one item with several vectors: an item is found once, with its best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector and components are all there and finite, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)


def matrix(column: pd.Series, kind: str = "<f8") -> np.ndarray:
    """Rows of bytes as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def of_batch(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def as_bytes(x: np.ndarray, kind: str = "<f8") -> pa.Array:
    """Each row of a matrix as bytes."""
    data = x.astype(kind)
    offsets = (np.arange(len(x) + 1) * data.strides[0] if len(x) else np.zeros(1)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def one_a_group(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their ids, and where each id's run begins."""
    order = ids.argsort(kind="stable")
    ids, rows = ids[order], rows[order]
    return ids, rows, np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else np.zeros(0, np.int64)


def search(candidates: DataFrame, queries: DataFrame, best, k: int, score_type: str, kind: str = "<f8") -> DataFrame:
    """Top ``k`` per query: query_id, rank, vec_id, score.

    candidates: (shard, block, id, v); queries: (shard, block, query_id, v); v as bytes of ``kind``.
    best(query ids, query matrix, ids, candidate matrix, k) -> arrays of query_id, vec_id, score.
    """
    schema = f"query_id long, vec_id long, score {score_type}"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, i, s = best(left["query_id"].to_numpy(), matrix(left["v"], kind), right["id"].to_numpy(), matrix(right["v"], kind), k)
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    found = queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # both steps by one shuffle
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
