"""Incremental delivery of a stream of record files, exactly once by key, with state in versioned tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow.operators import state

SEEN = "h long, last_day int"


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the state's finished versions; each is a folder of its own with a success mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        if (m := re.fullmatch(r"v=(\d+)", status.getPath().getName())) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v={m[1]}/_SUCCESS")):
            found.append(int(m[1]))
    return sorted(found)


def read_state(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The seen-set of the last finished version, or of the last one before a batch; empty where there is none."""
    versions = [v for v in _versions(spark, base) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], SEEN)
    return spark.read.schema(SEEN).parquet(f"{base}/v={versions[-1]}")


def deliver_unseen(stream: DataFrame, key: str, day: Callable[[], int], state_dir: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Deliver each key of a stream once and remember it.

    A batch reads the state version before its own number and writes the next
    one, so a batch run again after a failure sees the same state and delivers
    the same rows; ``sink`` gets the batch number to be idempotent too. Late
    records with old dates are delivered, as only keys decide.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = read_state(spark, state_dir, before=number)
        sink(state.unseen(batch, seen, key), number)
        state.next_seen(batch, seen, key, day()).write.mode("overwrite").parquet(f"{state_dir}/v={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, group: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts a window and group; windows close when the watermark has passed them, later rows are dropped."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")
