"""Reading and settling apart: what was proposed is stored batch by batch, and settled when it has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.consolidate import consolidate
from stratalog.streaming import feeds


def store(root: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a batch of claims under its number: one that comes again replaces what it had left."""

    def apply(claims: DataFrame, number: int) -> None:
        claims.write.mode("overwrite").parquet(f"{root}/batch={number}")
        if after:
            after(number)

    return apply


def read_in(claims: DataFrame, root: str, checkpoint: str, after: Callable[[int], None] | None = None) -> None:
    """A stream of claims into the store; ``after`` runs once a batch is written."""
    feeds.each_batch(claims, checkpoint, store(root, after), mode="append")


def stored(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The claims that hold: of each document those of the last batch that read it."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", root).parquet(root)
    last = rows.groupBy("document").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["document", "batch"], "left_semi").select(*[c for c in rows.columns if c != "batch"])


def settle(spark: SparkSession, root: str, schema: str, settled_at: int = -1) -> tuple[DataFrame | None, int]:
    """The groups of all stored claims and their number, or none where it is what it was when they were last settled."""
    claims = stored(spark, root, schema)
    n = claims.count()
    return (consolidate(claims) if n and n != settled_at else None), n
