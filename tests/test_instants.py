from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.functions.instants import parse_instant
from weirflow.operators.instants import is_complete, normalise_instants


def at(text: str) -> int:
    return (datetime.fromisoformat(text) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


@pytest.mark.parametrize(
    ("raw", "tz", "utc"),
    [
        ("2025-03-30 02:41:00", "Europe/Warsaw", "2025-03-30T01:41:00"),  # skipped: forward by the hour skipped
        ("26/10/2025 02:48", "Europe/Paris", "2025-10-26T00:48:00"),  # repeated: the earlier one
        ("Oct 25, 2026 2:22 AM CET", "Europe/Warsaw", "2026-10-25T01:22:00"),
        ("Oct 25, 2026 2:22 AM CEST", "Europe/Warsaw", "2026-10-25T00:22:00"),
        ("20260706", "UTC", "2026-07-06T00:00:00"),
        ("2026-06-27+01:00", "Europe/London", "2026-06-26T23:00:00"),
        ("2024-05-17T24:00-03:00", "America/Sao_Paulo", "2024-05-18T03:00:00"),
        ("1.725786372402E12", None, "2024-09-08T09:06:12.402"),
        ("1733817899.259", None, "2024-12-10T08:04:59.259"),
        ("27 avril 2026 à 10h15", "Europe/Athens", "2026-04-27T07:15:00"),
        ("11. September 2026, 15:17 Uhr", None, "2026-09-11T15:17:00"),
        ("01/02/2024 10:02 AM", "America/Sao_Paulo", "2024-01-02T13:02:00"),
        ("01/02/2024 10:02", "Europe/London", "2024-02-01T10:02:00"),
        ("\t25.07.2026 00:59 Uhr\n", None, "2026-07-25T00:59:00"),
        ("2024-12-04T13:52:59,641+05:30", None, "2024-12-04T08:22:59.641"),
        ("2025-11-01T12:02:37.893+01:00[Europe/Paris]", None, "2025-11-01T11:02:37.893"),
        ("Mar 2, 2026 7:35 PM CST", "America/Chicago", "2026-03-03T01:35:00"),
        ("2024-09-06t09:17:58z", "Asia/Tokyo", "2024-09-06T09:17:58"),
        ("12/31/2025 12:00 AM", "America/Chicago", "2025-12-31T06:00:00"),
    ],
)
def test_forms(raw, tz, utc):
    assert parse_instant(raw, tz) == at(utc)


@pytest.mark.parametrize("raw", [None, "", " ", "asap", "2025-02-30", "31.02.2026 10:00", "25:61", "0", "0000-00-00 00:00:00", "2026-13-05T10:00:00Z", "1994-12-31", "x" * 100_000, "24:30", "2025-01-01 24:30", "2025-01-01 13:00 PM"])
def test_nothing(raw):
    assert parse_instant(raw, "Europe/Berlin") is None


def test_join_keeps_rows_and_columns(spark, tmp_path):
    rows = [(1, "2025-01-01", None, "a"), (2, None, "UTC", "b"), (3, "bad", "UTC", "c"), (4, "2025-01-01", None, "d"), (4, "2025-01-01", None, "d")]
    df = spark.createDataFrame(rows, "utc_key int, raw string, tz string, dictionary string")
    path = str(tmp_path / "dictionary")
    for _ in range(2):  # the second run parses nothing anew
        got = normalise_instants(df, "raw", "tz", path=path)
        assert sorted((r.utc_key, r.utc_us) for r in got.collect() if r.utc_us) == [(1, at("2025-01-01"))] + [(4, at("2025-01-01"))] * 2
        assert got.count() == 5
    assert spark.read.parquet(path).count() == 2
    assert normalise_instants(df.limit(0), "raw", "tz").count() == 0


def test_unknown_zone_denotes_nothing():
    assert parse_instant("2026-01-02 03:04:05", "Mars/Base") is None and parse_instant("2026-01-02T03:04:05Z", "Mars/Base") == at("2026-01-02T03:04:05")
    assert parse_instant("2026-01-02 03:04:05[Mars/Base]", None) is None


def test_source_is_part_of_the_key(spark, tmp_path):
    df = spark.createDataFrame([("a", "2025-01-01", None), ("b", "2025-01-01", None), (None, None, None)], "tab string, raw string, tz string")
    path = str(tmp_path / "dictionary")
    got = normalise_instants(df, "raw", "tz", path=path, source=F.col("tab"))
    assert sorted((r.tab or "", r.utc_us or 0) for r in got.collect()) == [("", 0), ("a", at("2025-01-01")), ("b", at("2025-01-01"))]
    spark.read.parquet(path).write.mode("append").parquet(path)  # as two runs at once leave it
    assert normalise_instants(df, "raw", "tz", path=path, source=F.col("tab")).count() == 3


def test_complete(spark):
    forms = ["1716362355000", "2026-03-08T08:30:27Z", "2026-03-08T08:30:27.5+01:00", "2026-03-08T08:30:27", " 1716362355000", "2026-03-08T08:30:27Z\n", "171636235500"]
    df = spark.createDataFrame([(f,) for f in forms], "raw string").select(is_complete(F.col("raw")).alias("c"))
    assert [r.c for r in df.collect()] == [True, True, True, False, False, False, False]
