import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm import repeated_lines
from weirflow.llm.repeated_lines import RepeatedLines, without_lines


def key(line):
    return re.sub(r" +", " ", re.sub(r"[^\w#]+|_+", " ", re.sub(r"[0-9]+", "#", line.lower()))).strip()


def expected(rows, least=5, share=0.2):
    ids, held = defaultdict(set), defaultdict(set)
    for source, i, text in rows:
        if source is None or i is None:
            continue
        ids[source].add(i)
        for line in re.split(r"\r?\n", text or ""):
            if key(line):
                held[source, key(line)].add(i)
    return {k for k, v in held.items() if len(v) >= least and len(v) >= share * len(ids[k[0]])}


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "source_name string, id string, text string").withColumn("key", F.lit("clash"))
    return df, RepeatedLines(df, F.col("source_name"), F.col("id"), F.col("text"), **kw)


@pytest.mark.parametrize(("capacity", "held"), [(4096, 400_000), (8, 400_000), (4096, 50)])
def test_against_brute_force(spark, monkeypatch, capacity, held):
    """With a small capacity the summaries lose count and all lines of a source are counted instead; early reports add up."""
    monkeypatch.setattr(repeated_lines, "HELD_AT_ONCE", held)
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        lines = [f"Unique {rng.random()} line {rng.choice('abcdefgh') * rng.randrange(1, 9)}" for _ in range(4)]
        lines += [f"Apply by {i} NOW!" for _ in range(rng.random() < 0.3)] + ["© Legal — notice" for _ in range(rng.random() < 0.22)] + ["", "---"]
        rng.shuffle(lines)
        rows.append((source, str(i), rng.choice(["\n", "\r\n"]).join(lines)))
    rows += rows[:40] + [("hot", "n1", None), ("hot", "n2", ""), (None, "x", "© Legal — notice"), ("hot", None, "© Legal — notice"), ("few", "1", "a\na\na\na\na\na")]
    _, lines = found(spark, rows, capacity=capacity)
    assert {(r.source, r.key) for r in lines.found().collect()} == expected(rows)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_removal(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rows = [("s", str(i), f"Own {'x' * i}\r\nShare this!\nEnd") for i in range(6)] + [("s", "null", None), (None, "0", "Share this!"), ("t", "0", "Share this!")]
    df, lines = found(spark, rows)
    clean = {(r.source_name, r.id): (r.text_clean, r.lines_removed, r.key) for r in without_lines(df, "source_name", "text", lines.found()).collect()}
    assert clean["s", "2"] == ("Own xx\r", 2, "clash") and clean["s", "null"][0] is None and clean[None, "0"][:2] == ("Share this!", 0) and clean["t", "0"][:2] == ("Share this!", 0)
    assert len(clean) == 9
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_state_of_a_task_is_bounded():
    kept = repeated_lines._Summaries(0.05, 16)
    rng = random.Random(2)
    for i in range(20_000):
        kept.add(f"s{i % 3}", [rng.randrange(10**9) for _ in range(3)])
        assert kept.held == sum(map(len, kept.counts.values())) <= 3 * 36
    batch = kept.report()
    assert batch.num_rows <= 3 * 37 and kept.held == 0 and not kept.texts


def test_clean_texts_against_brute_force(spark):
    """p5_clean over its whole table: no confirmed line is left, all others stand in order."""
    from weirflow.llm import queries

    sf = "/root/testdata/sf0.001"
    jobs = spark.read.parquet(f"{sf}/boards_jobs.parquet").select("job_id", "company_board", "description_text").collect()
    gone = expected([(r.company_board, r.job_id, r.description_text) for r in jobs])
    want = []
    for r in jobs:
        lines = r.description_text.split("\n") if r.description_text is not None else None
        kept = [x for x in lines if (r.company_board, key(x)) not in gone] if lines is not None else None
        want.append((r.job_id, r.company_board, "\n".join(kept) if kept is not None else None, len(lines) - len(kept) if kept is not None else 0))
    got = [tuple(r) for r in queries.p5_clean(spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(n for *_, n in want)


def test_empty(spark):
    df, lines = found(spark, [])
    assert lines.found().count() == 0 and without_lines(df, "source_name", "text", lines.found()).count() == 0
