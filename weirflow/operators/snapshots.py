"""Changes between consecutive full snapshots, by content-defined chunks of key-sorted rows.

Each snapshot is hashed into buckets of keys and sorted by key within them. A
row whose key hash falls on a boundary starts a chunk, so an added or removed
row moves no other chunk. Chunks with equal digests in both snapshots are
discarded; only rows of the other chunks are joined and classified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.session import materialize

CHUNK_ROWS = 16
BUCKET_ROWS = 50_000
RUN_DAYS, DAY_SALTS = 10_000, 64


def comparable(name: str) -> Column:
    """Text without surrounding blanks, null as ''."""
    return F.coalesce(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""), F.lit(""))


def comparable_array(name: str) -> Column:
    """Elements without surrounding blanks, in sorted order, without empty ones; null as empty."""
    trimmed = F.transform(F.col(name), lambda x: F.coalesce(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit("")))
    return F.coalesce(F.array_sort(F.filter(trimmed, lambda x: x != "")), F.array().cast("array<string>"))


def reads_of_runs(reads: DataFrame, runs: DataFrame, at: str, start: str, end: str, run: str) -> DataFrame:
    """Reads with the run in whose interval [start, end] they lie; reads of no run are left out.

    An equi-join on the day: each run is spread over the days it touches. Up to
    ``RUN_DAYS`` rows of these are broadcast, as counted; beyond that the reads
    of a day, which may be a whole snapshot, are split by a salt of the moment
    that the few rows of runs are repeated for.
    """
    days = runs.where(F.col(start) <= F.col(end)).select(
        F.col(run).alias("__run"), F.col(start).alias("__start"), F.col(end).alias("__end"),
        F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("__day"),
    )
    within = (F.col(at) >= F.col("__start")) & (F.col(at) <= F.col("__end"))
    keyed = reads.withColumn("__day", F.to_date(at))
    if days.limit(RUN_DAYS + 1).count() <= RUN_DAYS:
        joined = keyed.join(F.broadcast(days), "__day")
    else:
        salted = days.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(DAY_SALTS - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64(at), F.lit(DAY_SALTS)).cast("int")).join(salted, ["__day", "__salt"]).drop("__salt")
    return joined.where(within).drop("__day", "__start", "__end")


def latest_states(reads: DataFrame, run: str, key: str, at: str, content: list[Column]) -> DataFrame:
    """(run, key, h1, h2): the two content digests of the last read of each key in each run.

    Null keys are left out. Reads at the same moment with different contents
    resolve to the greater digest, so the result doesn't depend on row order.
    """
    digest = F.struct(
        F.col(at).alias("at"), F.xxhash64(*content).alias("h1"), F.xxhash64(F.lit(17), *reversed(content)).alias("h2")
    )
    rows = reads.where(F.col(key).isNotNull()).select(F.col(run).alias("run"), F.col(key).alias("key"), digest.alias("s"))
    return rows.groupBy("run", "key").agg(F.max("s").alias("s")).select("run", "key", "s.h1", "s.h2")


def chunked(states: DataFrame, buckets: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``states`` with bucket and chunk: the last key at or before the row's whose hash is a boundary ('' before any)."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    boundary = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(chunk_rows)) == 0
    order = Window.partitionBy("run", "bucket").orderBy("key")
    last = F.last(F.when(boundary, F.col("key")), ignorenulls=True).over(order)
    return states.withColumn("bucket", bucket).withColumn("chunk", F.coalesce(last, F.lit("")))


def snapshot_changes(states: DataFrame, pairs: DataFrame, rows_estimate: int | None = None) -> DataFrame:
    """(run, key, change) for each (earlier, later) in ``pairs``: `added`, `removed` or `changed` in run ``later``.

    An empty snapshot on one side makes all rows of the other added or removed.
    """
    total = states.count() if rows_estimate is None else rows_estimate
    rows = materialize(chunked(states, max(1, total // BUCKET_ROWS)), "chunks")
    digest = rows.groupBy("run", "bucket", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("key", "h1", "h2")).alias("x"),
        F.sum(F.xxhash64("h2", "h1", "key").cast("decimal(20,0)")).alias("t"),
    )
    sides = F.explode(F.array(F.lit("earlier"), F.lit("later")))
    member = pairs.select("earlier", "later", sides.alias("side")).select(
        F.when(F.col("side") == "earlier", F.col("earlier")).otherwise(F.col("later")).alias("run"), F.col("later").alias("pair"), "side"
    )
    # A chunk of a pair is unchanged when both sides have it with one and the same digest.
    chunk = digest.join(member, "run")
    same = chunk.groupBy("pair", "bucket", "chunk").agg(
        F.count(F.lit(1)).alias("sides"),
        (F.min(F.struct("n", "x", "t")) == F.max(F.struct("n", "x", "t"))).alias("equal"),
    )
    open_chunks = same.where(~((F.col("sides") == 2) & F.col("equal"))).select("pair", "bucket", "chunk")
    kept = rows.join(member, "run").join(open_chunks, ["pair", "bucket", "chunk"], "left_semi")
    was, now = F.col("side") == "earlier", F.col("side") == "later"
    # Both sides in one shuffle on the key: a conditional aggregate is the full outer join of unique keys.
    both = kept.groupBy("pair", "key").agg(
        F.max(F.when(was, F.col("h1"))).alias("a1"), F.max(F.when(was, F.col("h2"))).alias("a2"),
        F.max(F.when(now, F.col("h1"))).alias("b1"), F.max(F.when(now, F.col("h2"))).alias("b2"),
    )
    change = (
        F.when(F.col("a1").isNull(), "added")
        .when(F.col("b1").isNull(), "removed")
        .when((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")), "changed")
    )
    return both.select(F.col("pair").alias("run"), "key", change.alias("change")).where(F.col("change").isNotNull())


def consecutive_runs(runs: DataFrame, run: str, start: str) -> DataFrame:
    """(earlier, later) of runs next to one another by start; the table of runs has few rows."""
    order = Window.orderBy(F.col(start), F.col(run))
    return runs.select(F.lag(run).over(order).alias("earlier"), F.col(run).alias("later")).where(F.col("earlier").isNotNull())
