"""Helpers shared by the operators: session settings, written tables, samples."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a fresh local one is set in local mode, as in tests; on a
    cluster that is an error, since executors do not see each other's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkgauge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished queries go, which Spark keeps until the driver's garbage is collected."""
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def id_hash(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def sample_ids(ids: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct ids, the smallest by hash, so the choice is repeatable.

    Of a large table only ids with hashes in a low range are sorted, eight times as many
    as asked for in expectation, so the merge of the tasks' best does not grow with the table.
    """
    some = ids.select(id_col).where(F.col(id_col).isNotNull())
    share = min(1.0, 8 * bound / max(1, some.count()))
    top = min(2**63 - 1, int(share * 2**64) - 2**63)
    return some.where(F.xxhash64(id_col) <= F.lit(top)).distinct().orderBy(F.xxhash64(id_col), id_col).limit(bound)


_state: list = [None, None]


def worker_state(key, make):
    """What a Python worker keeps between tasks: one state at a time.

    Workers outlive operators, so a state of another key is dropped before a new one grows.
    """
    if _state[0] != key:
        _state[:] = [None, None]
        _state[:] = [key, make()]
    return _state[1]


class Recent(dict):
    """A cache of two generations: entries not asked for during a whole generation go."""

    def __init__(self, size: int):
        self.size, self.old = size, {}

    def missing(self, keys) -> list:
        """The keys that neither generation holds; those of the old one are taken over."""
        out, old = [], self.old
        for k in keys:
            if k not in self:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    self[k] = v
        return out

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


def cuts(lengths: np.ndarray, size: int):
    """(start, stop) of runs whose lengths sum to at most ``size``; a longer one is a run of its own."""
    ends, start = lengths.cumsum(), 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield start, stop
        start = stop


def text_slices(column: pa.Array, size: int = 1_500_000):
    """(start, list) slices of an Arrow column of texts, null ones as empty, of bounded total length."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    for start, stop in cuts(lengths, size):
        yield start, [t or empty for t in column.slice(start, stop - start).to_pylist()]


ARROW_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def arrow_type(column: str) -> pa.DataType:
    """Arrow's type of a column given as ``name type``."""
    return ARROW_TYPES[column.split()[1]]


def slices(texts, size: int = 4_000_000):
    """(start, list) slices of a column of texts with bounded total length each; a longer text alone."""
    some, total, start = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if some and total + n > size:
            yield start, some
            some, total, start = [], 0, i
        some.append(t)
        total += n
    if some:
        yield start, some
