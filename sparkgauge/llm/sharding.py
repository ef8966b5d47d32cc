"""Contiguous balanced shards from global byte-size prefix sums.

The rows are ordered by a digest of their text and then by id, so copies of one text lie
next to each other.  Range partitions of that order are written once; the prefix sums then
need no more than each partition's total (one row a partition) and a running sum within
each partition.  A row belongs to the shard in whose equal share of all bytes it starts:
shards are contiguous and their sizes differ by less than one row's size.

A text that a third of all rows share is spread over range partitions by id, so no task
holds it whole.  Null texts count as empty (size 1, crc 0); null ids sort first; repeated
rows each get a slot of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written


def with_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document: id, size, crc of the text, and the order's key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("key"),
    )


def balanced_shards(rows: DataFrame, n_shards: int = 16) -> DataFrame:
    """Add shard and slot to rows that have size, key and doc_id."""
    spark = rows.sparkSession
    ranged = (
        written(rows, "sizes")
        .repartitionByRange(partitions(spark), "key", "doc_id")
        .withColumn("part", F.spark_partition_id())
    )
    ranged = written(ranged, "ranges")

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(order), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(order), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(whole).alias("total"),
    )
    run = Window.partitionBy("part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumns({"_sum": F.sum("size").over(run), "_row": F.count("*").over(run)})
        .join(F.broadcast(before), "part")  # one row a partition
        .withColumn("_start", F.col("size_before") + F.col("_sum") - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"(_start * {n_shards}) div total"), F.lit(n_shards - 1)).cast("int"))
        .withColumn("_row", F.col("rows_before") + F.col("_row") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return (
        placed.join(F.broadcast(firsts), "shard")  # one row a shard
        .withColumn("slot", F.col("_row") - F.col("_first"))
        .select(*rows.columns, "shard", "slot")
    )
