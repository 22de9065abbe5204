"""Projections of delivered rows, delivery with its summary, guarded assets and retention."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.documents import SchemaChange


def pick(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that there are, in the table's own order; none wanted means all."""
    return df.select(*[c for c in df.columns if not wanted or c in wanted])


def text_status(text: Column, asked: bool, failed: Column) -> Column:
    """Why a row has its text or not: not_asked, failed (its source could not be read), none (there is none) or given."""
    if not asked:
        return F.lit("not_asked")
    return F.when(F.coalesce(text, F.lit("")) != "", "given").when(F.coalesce(failed, F.lit(False)), "failed").otherwise("none")


def board_url(platform: Column, board: Column, patterns: dict[str, str]) -> Column:
    """The board's address by the platform's pattern, in which {} stands for the board; null for other platforms."""
    found = F.lit(None).cast("string")
    for name, pattern in sorted(patterns.items()):
        found = F.when(platform == name, F.replace(F.lit(pattern), F.lit("{}"), board)).otherwise(found)
    return found


def retained(published: Column, still_open: Column, now: Column, days: int, open_days: int = 730, ahead: int = 2) -> Column:
    """Published within ``days``, or still open and within ``open_days``; what lies more than ``ahead`` days in the future is out. Never null."""
    age = F.date_diff(now, published)
    fresh = (age >= -ahead) & ((age <= days) | (F.coalesce(still_open, F.lit(False)) & (age <= open_days)))
    return F.coalesce(fresh, F.lit(False))


def complete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows in which every required field holds something but blanks."""
    for name in required:
        df = df.where(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "")
    return df


def deliver(df: DataFrame, path: str, counters: dict[str, Column]) -> dict:
    """Append the rows to the table at ``path`` and return the run's counters, taken while writing."""
    seen = Observation("delivery")
    df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.mode("append").parquet(path)
    return seen.get


def write_asset(df: DataFrame, path: str, form: str, at: str) -> None:
    """Rows as lines of JSON below ``rows``, and a footer that says what form they have, how many they are and of what moment."""
    seen = Observation("asset")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{path}/rows")
    footer = json.dumps({"form": form, "rows": seen.get["rows"], "at": at})
    df.sparkSession.createDataFrame([(footer,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/footer")


def read_asset(spark: SparkSession, path: str, form: str, schema: str, not_before: str | None = None, least: int = 0) -> DataFrame:
    """The rows of an asset; another form, fewer rows than its footer says or than ``least``, or an older moment is an error."""
    footer = json.loads("".join(r.value for r in spark.read.text(f"{path}/footer").limit(1).collect()))
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")
    if footer.get("form") != form:
        raise SchemaChange(f"an asset of form {footer.get('form')}, not {form}")
    if not_before is not None and footer["at"] < not_before:
        raise ValueError(f"an asset of {footer['at']}, before {not_before}")
    if (n := rows.count()) != footer["rows"] or n < least:
        raise ValueError(f"an asset of {n} rows where its footer says {footer['rows']}")
    return rows
