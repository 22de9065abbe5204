"""Normalisation of mixed time texts by a dictionary of distinct values.

Distinct (source, text, zone) triples are parsed once, kept in a dictionary
table that later runs extend, and the instants are joined back to the rows.
"""

from __future__ import annotations

import hashlib
import inspect
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import instants as parser
from weirflow.functions.instants import COMPLETE, parse_instant
from weirflow.session import materialize, path_exists, shared_dir

DICTIONARY = "source string, raw string, tz string, utc_us long"
KEY = ["source", "raw", "tz"]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws, zones = batch.column("raw").to_pylist(), batch.column("tz").to_pylist()
        instants = pa.array([parse_instant(r, z or None) for r, z in zip(raws, zones)], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), instants], [*KEY, "utc_us"])


def dictionary_path(spark: SparkSession) -> str:
    """Where the shared folder keeps the dictionary that this version of the parser has filled."""
    version = hashlib.sha256(inspect.getsource(parser).encode()).hexdigest()[:16]
    return os.path.join(shared_dir(spark), f"weirflow-instants-{version}")


def instant_dictionary(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dictionary rows of the distinct triples in ``values`` (source, raw, tz) that ``known`` lacks.

    Null raws are left out; null sources and zones are kept as '' so that they
    join. Texts that denote nothing stay in the dictionary with a null instant,
    so they aren't parsed again.
    """
    own = [F.coalesce(k, F.lit("")).alias(k) for k in KEY]
    found = values.where(F.col("raw").isNotNull()).select(*own).distinct()
    if known is not None:
        found = found.join(known, KEY, "left_anti")
    return found.mapInArrow(_parse, DICTIONARY)


def extend_dictionary(values: DataFrame, path: str) -> DataFrame:
    """Parse what the dictionary at ``path`` lacks, append it there and return the whole dictionary.

    Runs at the same time may append a value twice; it is read once.
    """
    spark = values.sparkSession
    known = spark.read.schema(DICTIONARY).parquet(path) if path_exists(spark, path) else None
    instant_dictionary(values, known).write.mode("append").parquet(path)
    return spark.read.schema(DICTIONARY).parquet(path).dropDuplicates(KEY)


def normalise_instants(
    df: DataFrame, raw: str, tz: str | Column, out: str = "utc_us", path: str | None = None, source: Column | None = None
) -> DataFrame:
    """``df`` with the instant of column ``raw`` in ``out``; null where the text is null or denotes nothing.

    All other columns and repeated rows stay. The join is on the distinct
    triple, so the row side may be split by adaptive skew handling while the
    dictionary side has one row a key; rows with a null text take no part in
    it. With ``path`` the dictionary there is used and extended.
    """
    zone = F.coalesce(F.col(tz) if isinstance(tz, str) else tz, F.lit(""))
    named = F.coalesce(source, F.lit("")) if source is not None else F.lit("")
    keyed = df.where(F.col(raw).isNotNull()).withColumns({"__raw": F.col(raw), "__tz": zone, "__source": named})
    values = keyed.select(F.col("__source").alias("source"), F.col("__raw").alias("raw"), F.col("__tz").alias("tz"))
    dictionary = extend_dictionary(values, path) if path else materialize(instant_dictionary(values), "instants")
    entry = dictionary.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("utc_us").alias("__us"))
    joined = keyed.join(entry, [f"__{k}" for k in KEY], "left").withColumn(out, F.col("__us")).drop("__us", *[f"__{k}" for k in KEY])
    without = df.where(F.col(raw).isNull()).withColumn(out, F.lit(None).cast("long"))
    return joined.unionByName(without)


def is_complete(raw: Column) -> Column:
    """Whether the text is already a complete form: epoch milliseconds, or ISO with seconds and a zone."""
    return raw.rlike(rf"\A(?:{COMPLETE.pattern})\z")
