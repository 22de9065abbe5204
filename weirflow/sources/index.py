"""A posting index as a partitioned table: written in bands of age, described by a manifest, swapped in whole."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.dates import age_band


def write_index(df: DataFrame, base: str, source: str, at: str, key: str, now: Column, rows_per_file: int = 1_000_000) -> str:
    """Write a build below ``base`` and return its name.

    Rows are spread by source, band and a salt drawn from the key, so that a
    source holding a third of all rows is written by many tasks; within a file
    they are sorted for compression and for skipping by statistics.
    """
    build = f"build={uuid.uuid4().hex}"
    banded = df.withColumn("band", age_band(F.col(at), now))
    salt = F.pmod(F.xxhash64(key), F.lit(16))
    spread = banded.repartition(source, "band", salt).sortWithinPartitions(source, "band", F.col(at).desc_nulls_last(), key)
    spread.write.partitionBy(source, "band").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(f"{base}/{build}")
    return build


def publish(spark: SparkSession, base: str, build: str) -> None:
    """Make ``build`` the one that readers see, by appending to the log of builds last; earlier builds stay until removed."""
    spark.range(1).select(F.lit(build).alias("build"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{base}/builds")


def current_build(spark: SparkSession, base: str) -> str:
    """The build published last; a base without one is an error rather than an empty index."""
    last = spark.read.parquet(f"{base}/builds").orderBy(F.col("at").desc()).first()
    if last is None:
        raise FileNotFoundError(f"no build published below {base}")
    return last.build


def read_index(spark: SparkSession, base: str, source: str, sources: Sequence[str] = (), bands: Sequence[int] = ()) -> DataFrame:
    """The published build, its partitions pruned to the wanted sources and bands."""
    df = spark.read.parquet(f"{base}/{current_build(spark, base)}")
    if sources:
        df = df.where(F.col(source).isin(list(sources)))
    return df.where(F.col("band").isin(list(bands))) if bands else df


def manifest(index: DataFrame, source: str, at: str, key: str) -> DataFrame:
    """Per partition: rows, different keys, and the range of moments."""
    return index.groupBy(source, "band").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
