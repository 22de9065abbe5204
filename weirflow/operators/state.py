"""State of incremental delivery as tables: boundary-day trackers and sets of seen keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cursor_key(options: dict) -> str:
    """A name for a set of filters; the order and case of its values make no other one, output options none at all."""
    kept = {k: sorted(str(x).lower() for x in v) if isinstance(v, list | tuple | set) else str(v).lower() for k, v in options.items() if not k.startswith("output") and v not in (None, [], "")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:20]


def filter_identity(values: Column) -> Column:
    """A name for a set of filter values; order, case, repeats and blanks around them make no other one."""
    tidy = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.lower(F.trim(v)))))
    return F.sha2(F.array_join(tidy, ","), 256)


def key_hash(key: Column) -> Column:
    """The first 52 bits of a SHA-1, exact as a long."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 13), 16, 10).cast("long")


def undelivered(rows: DataFrame, known: DataFrame, key: str, day: str, last_day: str | None, complete: bool = True) -> DataFrame:
    """Rows that a tracker hasn't delivered: not among the known keys and, after a complete run, not before its last day."""
    fresh = rows.join(known.select(key).distinct(), key, "left_anti")
    if complete and last_day is not None:
        fresh = fresh.where(F.col(day).isNull() | (F.col(day) >= F.lit(last_day).cast("date")))
    return fresh


def next_tracker(delivered: DataFrame, known: DataFrame, key: str, day: str, last_day: str | None, truncated: bool, was_complete: bool = True) -> tuple[str | None, DataFrame]:
    """(last day, known keys) after a run.

    A truncated run doesn't move the boundary and adds what it delivered. A
    complete one moves it to the newest day and keeps the keys of that day,
    plus those that are still needed: of the same boundary, or of a run cut short.
    """
    if truncated:
        return last_day, known.select(key).unionByName(delivered.select(key)).distinct()
    newest = delivered.agg(F.max(day).cast("string")).first()[0]
    newest = max(filter(None, (newest, last_day)), default=None)
    keys = delivered.where(F.col(day) == F.lit(newest).cast("date")).select(key)
    if newest == last_day or not was_complete:
        keys = keys.unionByName(known.select(key))
    return newest, keys.distinct()


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The first row of each key that the seen-set (h, last_day) lacks, however old its date."""
    return rows.dropDuplicates([key]).withColumn("h", key_hash(F.col(key))).join(seen.select("h"), "h", "left_anti").drop("h")


def next_seen(rows: DataFrame, seen: DataFrame, key: str, day: int, truncated: bool = False, keep_days: int = 14) -> DataFrame:
    """(h, last_day) after a run on ``day``; only a complete run drops what wasn't seen for more than ``keep_days``."""
    now = rows.select(key_hash(F.col(key)).alias("h"), F.lit(day).alias("last_day"))
    merged = seen.select("h", "last_day").unionByName(now).groupBy("h").agg(F.max("last_day").alias("last_day"))
    return merged if truncated else merged.where(F.col("last_day") >= day - keep_days)


def carried(fresh: DataFrame, previous: DataFrame, partition: str, at: str, oldest: object) -> DataFrame:
    """Fresh partitions, and those of the build before that weren't read again and aren't older than ``oldest``."""
    kept = previous.join(fresh.select(partition).distinct(), partition, "left_anti").where(F.col(at) >= F.lit(oldest))
    return fresh.unionByName(kept)
