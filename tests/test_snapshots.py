import random
from datetime import datetime

from pyspark.sql import functions as F

from weirflow.operators import snapshots

RUNS = "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz"


def changes(spark, reads, runs, **kw):
    r = spark.createDataFrame(reads, "key string, at timestamp_ntz, title string, places array<string>, run string")
    u = spark.createDataFrame(runs, RUNS)
    placed = snapshots.reads_of_runs(r, u, "at", "started_at", "finished_at", "run_id")
    states = snapshots.latest_states(placed, "__run", "key", "at", [snapshots.comparable("title"), snapshots.comparable_array("places")])
    out = snapshots.snapshot_changes(states, snapshots.consecutive_runs(u, "run_id", "started_at"), **kw)
    return sorted(map(tuple, out.collect()))


def day(d, h=0):
    return datetime(2026, 1, d, h)


def test_classifies(spark):
    runs = [(1, day(1), day(1, 5)), (2, day(2), day(2, 5))]
    reads = [
        ("same", day(1, 1), " A ", ["x", "y"], "clash"), ("same", day(2, 1), "A", ["y ", "x", None], None),
        ("gone", day(1, 5), "A", None, None), ("new", day(2, 0), None, [], None),
        ("case", day(1, 1), "a", None, None), ("case", day(2, 1), "A", None, None),
        ("late", day(1, 1), "A", None, None), ("late", day(2, 1), "B", None, None), ("late", day(2, 2), "A", None, None),
        ("outside", day(1, 6), "A", None, None), (None, day(1, 1), "A", None, None),
        ("empty", day(1, 1), None, None, None), ("empty", day(2, 1), "  ", [], None),
    ]
    assert changes(spark, reads + reads, runs) == [(2, "case", "changed"), (2, "gone", "removed"), (2, "new", "added")]
    assert changes(spark, [], runs) == [] and changes(spark, reads, runs[:1]) == []


def test_many_chunks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 100)
    rng = random.Random(5)
    runs = [(i, day(i), day(i, 5)) for i in (1, 2, 3)]
    held, reads, expected = {}, [], set()
    for run in (1, 2, 3):
        before = dict(held)
        for i in range(600):
            k = f"k{i:04}"
            x = rng.random()
            if x < 0.05:
                held.pop(k, None)
            elif x < 0.1 or run == 1:
                held[k] = f"t{rng.randrange(3)}"
        reads += [(k, day(run, 1), t, None, None) for k, t in held.items()]
        if run > 1:
            expected |= {(run, k, "added") for k in held.keys() - before.keys()} | {(run, k, "removed") for k in before.keys() - held.keys()}
            expected |= {(run, k, "changed") for k in held.keys() & before.keys() if held[k] != before[k]}
    assert changes(spark, reads, runs) == sorted(expected)


def test_equal_chunks_are_discarded(spark):
    rows = spark.range(2000).select(F.lit(1).alias("run"), F.col("id").cast("string").alias("key"), F.lit(1).alias("h1"), F.lit(2).alias("h2"))
    both = snapshots.chunked(rows, 3)
    again = snapshots.chunked(rows.where("key <> '77'"), 3)
    a = {(r.bucket, r.chunk, r.n) for r in both.groupBy("bucket", "chunk").agg(F.count("*").alias("n")).collect()}
    b = {(r.bucket, r.chunk, r.n) for r in again.groupBy("bucket", "chunk").agg(F.count("*").alias("n")).collect()}
    assert len(a) > 60 and len(a ^ b) <= 4
