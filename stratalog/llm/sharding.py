"""Contiguous shards of balanced byte size, cut from global prefix sums.

Rows are put in one total order by range partitioning; every partition's byte and row totals (one small row
each) are summed in order, which gives each partition its offset; a running sum inside the partition completes
the global prefix.  Only built-in functions are used, and texts stay behind: what is shuffled is a row of a few
numbers.

Behaviour: a null text has no bytes and, like any other, one unit of its own, no crc32 of its own (that of the
empty string); a null id sorts last among equal texts; equal texts are neighbours in the order, so they share a
shard but for the few groups that a cut passes through; repeated rows are rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.llm.common import Scratch, partitions


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard for every row.

    A row goes to the shard in whose equal share of all bytes its middle lies; slots number a shard's rows
    from 0 in the order of the prefix sums.
    """
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    ordered = rows.repartitionByRange(partitions(spark), F.col("text_key"), F.col("doc_id").asc_nulls_last())
    ordered = scratch.save(ordered.withColumn("part", F.spark_partition_id()), "ordered")

    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    everything = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("bytes_all"),
    )
    inside = W.partitionBy("part").orderBy("text_key", F.col("doc_id").asc_nulls_last())
    placed = (
        ordered.join(F.broadcast(offsets), "part")
        .withColumn("at", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("at") + F.col("size") / 2) * shards / F.col("bytes_all"))).cast("int"))
    )
    placed = scratch.save(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    scratch.drop("ordered")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
