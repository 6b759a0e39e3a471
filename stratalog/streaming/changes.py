"""The change feed: a notice for each revision that clients haven't been told of, looked at in fixed intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds between two looks.
INTERVAL = 4
NOTICES = "source string, at timestamp, revision string"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watcher(StatefulProcessor):
    """Holds what was told last and compares it with the last revision of each interval, which come once they are over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "revision string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one row an interval; those of later batches are later
        looks = pd.concat(list(rows)).sort_values("at")
        told = self.told.get()[0] if self.told.exists() else None
        before = looks["revision"].shift(1)
        before.iloc[0] = told
        fresh = (looks["revision"] != before) & ~(looks["revision"].isna() & before.isna())
        self.told.update((looks["revision"].iloc[-1],))
        yield looks.loc[fresh, ["source", "at", "revision"]]

    def close(self) -> None:
        pass


def notices(stream: DataFrame, interval: int = INTERVAL, late: str = "0 seconds") -> DataFrame:
    """(source, at, revision) of a stream (source, ts, place, revision), ``place`` deciding between equal times.

    A source's rows of an interval become its last revision before anything is kept or handed to Python; that is told when the
    watermark has passed the interval.
    """
    # an interval holds its end and not its beginning
    rows = stream.withColumn("in_", F.col("ts") - F.make_dt_interval(secs=F.lit(0.001))).withWatermark("in_", late)
    order = F.struct(F.unix_millis("ts"), F.col("place").cast("long"))
    looks = rows.groupBy("source", F.window("in_", f"{interval} seconds")).agg(F.max_by("revision", order).alias("revision"))
    looks = looks.select("source", F.col("window.end").alias("at"), "revision")
    return looks.groupBy("source").transformWithStateInPandas(Watcher(), NOTICES, "Append", "None")


def with_rocks(spark: SparkSession, run) -> None:
    """``run()`` with the state store that holds several states and timers; the session's own is put back."""
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        run()
    finally:
        if before is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], before)
