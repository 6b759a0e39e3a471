"""Structured Streaming forms of the engine's watching, queueing and running usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures of the transport in a row that open the breaker, and seconds that it stays open.
BREAK_AFTER, OPEN_SECONDS = 5, 60


def events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def watched_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream, without their content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def use_by_app(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Running reads and objects by application and window; events later than the watermark are dropped by it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), (F.col("user_id") % 7).alias("app")).agg(
        F.count("*").alias("reads"), F.approx_count_distinct(F.get_json_object("props", "$.k")).alias("objects")
    ).select(F.col("w.start").alias("start"), "app", "reads", "objects")


def once_per_window(stream: DataFrame, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """The first request of a kind in each tumbling window, as a queue with an idempotency key takes it."""
    window = F.window("ts", f"{hours} hours")
    keyed = stream.withColumn("key", F.concat_ws(":", "event_type", F.unix_timestamp(window["start"]).cast("string")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def quiet_sessions(stream: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of changes by source, each closed by a quiet gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "source").agg(F.count("*").alias("changes")).select(
        "source", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "changes"
    )


def breaker(stream: DataFrame) -> DataFrame:
    """(engine, ts, ok) to (engine, ts, state): open for a while after several failures in a row, else closed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, opened = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            now = int(ts.timestamp())
            if opened and now < opened + OPEN_SECONDS:
                out.append((key[0], ts, "open"))
                continue
            failed, opened = (0, 0) if ok else (failed + 1, 0)
            if failed >= BREAK_AFTER:
                failed, opened = 0, now
            out.append((key[0], ts, "open" if opened else "closed"))
        state.update((failed, opened))
        yield pd.DataFrame(out, columns=["engine", "ts", "state"])

    return stream.groupBy("engine").applyInPandasWithState(step, "engine string, ts timestamp, state string", "failed int, opened long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, written as parquet; a second call continues where this one stopped."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """``apply`` to every micro-batch; a batch that comes again has the number it had."""
    stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
