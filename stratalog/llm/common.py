"""What the operators share: reading, scratch tables in the shared folder, joins that survive hot keys,
streaming over sorted groups and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of the rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.01

#: Rows handed to Python code at once, so that a batch of long texts stays small beside the executor.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that all executors share, so that a lost executor costs no lineage.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is unset (tests) a temporary
    folder is taken.
    """

    def __init__(self, spark: SparkSession, tag: str):
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.spark = spark
        self.root = f"{(shared or tempfile.mkdtemp()).rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``left`` to one row per ``key`` in ``groups``, whose column ``size`` counts the rows of
    ``left`` under that key, ``total`` in all.

    Keys with at least HOT_SHARE of the rows, at most 1 / HOT_SHARE of them, are broadcast; the others are
    shuffled, so no task gets more than an even share and one hot key's worth.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= least)
    cold = groups.where(F.col(size) < least)
    by_hot = left.join(F.broadcast(hot), key)
    by_cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return by_hot.unionByName(by_cold)


def map_texts(df: DataFrame, schema: str, start: Callable[[], Callable[[dict], dict]], rows: int = SLICE_ROWS) -> DataFrame:
    """``start()`` runs once per task and gives a function from columns (lists) to columns (lists) of ``schema``,
    a DDL list of plain names and types."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
    }
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def grouped(batches: Iterator, keys: list[str]) -> Iterator:
    """The pandas frame of each run of equal ``keys`` in batches sorted by them."""
    import pandas as pd

    held: list = []
    now = None
    for pdf in batches:
        if not len(pdf):
            continue
        same = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy()
        same[0] = True
        starts = [*same.nonzero()[0], len(pdf)]
        for a, b in zip(starts, starts[1:], strict=False):
            part = pdf.iloc[a:b]
            k = tuple(part[keys].iloc[0])
            if held and k != now:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            now = k
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def held_out(doc_id: Column) -> Column:
    """The rows that no classifier may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that links reach.

    Alternating large and small stars: every round links each node's larger neighbours to the smallest one,
    then the same among the smaller, until nothing changes; rounds grow with the logarithm of a component's
    size.  A round's edges are written to the shared folder.  Hubs go through ``join_hot``.
    """
    ids = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen, turn = scratch.save(ids, "cc0"), None, 0
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, "u", "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"cc{turn}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        total = large.count()
        small = join_hot(large, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"cc{turn + 1}")
        scratch.drop(f"cc{turn}")
        scratch.drop(f"cc{turn}l")
        turn += 1
