"""Work in the order of a group's rows that doesn't need the group in one task: running sums, positions, greedy packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.operators.graph import keep


def running(df: DataFrame, group: str, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds for each new column in ``sums`` the sum of an expression over the earlier rows of the row's group.

    Rows are dealt by ranges of group and order, so a large group is many ranges; each range sums inside itself and is
    told what the group's earlier ranges hold, one small row for each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(df.repartitionByRange(n, group, order).withColumn("range_", F.spark_partition_id()))
    totals = ranged.groupBy(group, "range_").agg(*[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])
    earlier = W.partitionBy(group).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(group, "range_", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])
    inside = W.partitionBy(group, "range_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)).alias(c) for c, e in sums.items()])
    joined = own.join(offsets, [group, "range_"])
    return joined.select(*df.columns, *[(F.col(c) + F.col(f"{c}_before")).cast("long").alias(c) for c in sums])


def pack(docs: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Adds batch: rows of a group in order fill batches of at most ``most`` greedily; a larger row has its own.

    The row at which the next batch begins, if one begins here, is found from running sums: it holds the byte that
    lies ``most`` after this row's first, and is met on the page of ``most`` bytes that this byte is on.  From a group's
    first row on these links are followed by steps that double, so rounds grow with the logarithm of a group's rows.
    """
    rows = running(docs.select("*", F.col(group).alias("g_"), F.col(order).alias("o_"), F.col(size).cast("long").alias("n_")), "g_", "o_", {"start_": "n_", "row_": "1"})
    rows = keep(rows)
    probe, page = F.col("start_") + most, lambda c: F.floor(c / most)
    pages = F.explode(F.sequence(page(F.col("start_")), page(F.col("start_") + F.col("n_") - 1)))
    held = rows.where("n_ > 0").select("g_", pages.alias("page_"), F.col("start_").alias("at_"), F.lit(0).alias("asks_"), F.struct("start_", "row_").alias("held_"), F.lit(None).cast("long").alias("of_"))
    asks = rows.select("g_", page(probe).alias("page_"), probe.alias("at_"), F.lit(1).alias("asks_"), F.lit(None).cast(held.schema["held_"].dataType).alias("held_"), F.col("row_").alias("of_"))
    # on a page the last row that starts no later than a byte holds it, or none does; pages have no more bytes than a batch
    last = F.last("held_", ignorenulls=True).over(W.partitionBy("g_", "page_").orderBy("at_", "asks_", "of_").rowsBetween(W.unboundedPreceding, 0))
    met = held.unionByName(asks).withColumn("met_", last).where("asks_ = 1").select("g_", "of_", F.col("at_") - most, "met_").toDF("g_", "row_", "from_", "met_")
    after = F.when(F.col("met_.start_") == F.col("from_"), F.col("met_.row_") + 1).otherwise(F.col("met_.row_"))
    sizes = rows.groupBy("g_").agg(F.count("*").alias("rows_"), F.sum("n_").alias("all_"))
    jump = keep(met.join(sizes, "g_").where((F.col("from_") + most < F.col("all_")) & (after < F.col("rows_"))).select("g_", "row_", after.alias("next_")))
    begins = keep(sizes.select("g_", F.lit(0).cast("long").alias("row_"), F.lit(0).cast("long").alias("batch")))
    step = 1
    while True:
        fresh = keep(begins.join(jump, ["g_", "row_"]).select("g_", F.col("next_").alias("row_"), (F.col("batch") + step).alias("batch")))
        if fresh.isEmpty():
            break
        begins = keep(begins.unionByName(fresh))
        jump = keep(jump.join(jump.select("g_", F.col("row_").alias("next_"), F.col("next_").alias("then_")), ["g_", "next_"]).select("g_", "row_", F.col("then_").alias("next_")))
        step *= 2
    marked = rows.join(begins.select("g_", "row_", F.lit(1).alias("opens_")), ["g_", "row_"], "left").withColumn("opens_", F.coalesce("opens_", F.lit(0)))
    batches = running(marked, "g_", "o_", {"batch": "opens_"})
    return batches.select(*docs.columns, (F.col("batch") + F.col("opens_") - 1).alias("batch"))


LEVELS = 6


def locators(lines: DataFrame) -> DataFrame:
    """Adds locator to (document_id, ordinal, level): like §2.1 for headings of ``level`` 1 to 6, §2.1 ¶3 for what has none.

    A level's number counts its headings since the last one of a higher rank; skipped levels count as 1.  Every number is
    a running count less what it was at its last reset, and both are running aggregates.
    """
    upto = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    level = F.coalesce("level", F.lit(0))
    seen = lines.select("*", *[F.sum((level == k).cast("int")).over(upto).alias(f"seen{k}") for k in range(1, LEVELS + 1)], F.sum((level == 0).cast("int")).over(upto).alias("plain"))
    reset = lambda c, when: F.coalesce(F.max(F.when(when, F.col(c))).over(upto), F.lit(0))
    numbers = [F.col(f"seen{k}") - reset(f"seen{k}", level.between(1, k - 1)) for k in range(1, LEVELS + 1)]
    depth = F.coalesce(F.last(F.when(level > 0, level), ignorenulls=True).over(upto), F.lit(0))
    counted = seen.select(*lines.columns, level.alias("level_"), depth.alias("depth"), F.array(*numbers).alias("numbers"), (F.col("plain") - reset("plain", level > 0)).alias("paragraph"))
    head = F.concat(F.lit("§"), F.array_join(F.transform(F.slice("numbers", 1, F.col("depth")), lambda x: F.greatest(x, F.lit(1)).cast("string")), "."))
    own = F.concat(F.lit("¶"), F.col("paragraph").cast("string"))
    locator = F.when(F.col("level_") > 0, head).when(F.col("depth") > 0, F.concat(head, F.lit(" "), own)).otherwise(own)
    return counted.select(*lines.columns, locator.alias("locator"))
