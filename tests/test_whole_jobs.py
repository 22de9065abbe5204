"""Nothing is left out where a query or operator could stop short."""

import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weirflow.functions import geo, pay
from weirflow.functions.instants import COMPLETE, parse_instant
from weirflow import session
from weirflow.operators import relevance, resolve
from weirflow.plans import catalogue_more, data_queries

LONG = "plain words of the daily work " * 60  # 1,800 characters


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_keywords_behind_1500_characters(spark, tmp_path):
    rows = [("1", "Clerk", None, None, LONG + "nurses")]
    schema = "job_id string, title string, department string, team string, description_text string"
    df = spark.createDataFrame(rows, schema)
    got = relevance.ranked(df, ["nurse"], F.col("title"), [F.col("department")], F.col("description_text")).collect()
    assert [(r.match_score, r.matched_in) for r in got] == [(30, "description")]
    sf = saved(spark, tmp_path, "boards_jobs", [(*r, "b") for r in rows], f"{schema}, company_board string")
    assert [r.kw for r in catalogue_more.keyword_fields(spark, sf).collect()] == ["plain words daily work nurses"]


def test_luhn_of_wrapped_and_single_results(spark, tmp_path):
    bodies = [json.dumps({"results": [{"siren": "732829320"}, None]}), json.dumps(json.dumps({"results": [{"siren": "732829321"}]})), json.dumps({"results": {"siren": "552100554"}}), json.dumps({"results": None}), '{"results": [{', "", None]
    sf = saved(spark, tmp_path, "search_airbus", [(b,) for b in bodies], "body string")
    assert {(r.siren, r.valid) for r in catalogue_more.luhn_checks(spark, sf).collect()} == {("732829320", True), ("732829321", False), ("552100554", True)}


def test_late_and_long_instants():
    assert parse_instant("9999-12-31", None) == 253402214400000000
    assert parse_instant("9999-12-31T23:59:59-05:00", None) == 253402318799000000
    assert parse_instant("9999-12-31T24:00", None) is None and parse_instant("word " * 100, None) is None
    assert parse_instant("2026-01-02" + " " * 300 + "03:04:05", None) == parse_instant("2026-01-02 03:04:05", None) is not None


def test_windows_are_split_down_to_seconds(spark, tmp_path):
    moments = [datetime(2026, 1, 1, 9, 0, 0)] * 330 + [datetime(2026, 1, 1, 9, 0, 1)] * 2 + [datetime(2026, 1, 1, 9, 1)] * 5 + [datetime(2026, 1, 1, 10)] * 7 + [datetime(2026, 1, 2)] * 320
    sf = saved(spark, tmp_path, "events", [(t,) for t in moments], "ts timestamp_ntz")
    got = sorted((str(r.start)[8:], r.n, r.width) for r in catalogue_more.split_windows(spark, sf).collect())
    assert got == [("01 09:00:00", 330, "second"), ("01 09:00:01", 2, "second"), ("01 09:01:00", 5, "minute"), ("01 10:00:00", 7, "hour"), ("02 00:00:00", 320, "day")]


def test_components_that_do_not_converge(spark):
    nodes = spark.range(64).select(F.col("id").alias("n"))
    edges = nodes.where("n > 0").select(F.col("n").alias("a"), (F.col("n") - 1).alias("b"))
    assert resolve.connected_components(nodes, edges).where("component = 0").count() == 64
    with pytest.raises(RuntimeError):
        resolve.connected_components(nodes, edges, most_rounds=1)


def test_shared_folder(spark):
    held = session.materialize(spark.range(3), "t")
    folder = session.run_dir(spark)
    assert held.count() == 3 and session.path_exists(spark, folder)
    session.release(spark)
    assert not session.path_exists(spark, folder) and session.run_dir(spark) != folder
    session.require_one_machine("local[8]")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,4,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            session.require_one_machine(master)


def test_overlaps_against_all_pairs(spark):
    """An item that all nodes hold, null items and repeated rows; equal to comparing all pairs of a block."""
    rng = random.Random(6)
    rows = [(b, n, i) for b in ("x", "y") for n in range(25) for i in {*(rng.randrange(30) for _ in range(rng.randrange(1, 12))), 99}]
    df = spark.createDataFrame([*rows, *rows[:20], ("x", 1, None), (None, 5, 3)], "a string, b int, item int")
    for least, share in ((4, 0.5), (10**9, 0.3), (1, 0.9)):
        sets = {}
        for b, n, i in rows:
            sets.setdefault((b, n), set()).add(i)
        want = {(n, m) for (b, n), s in sets.items() for (c, m), t in sets.items() if b == c and n < m and (len(s & t) >= least or len(s & t) >= share * min(len(s), len(t)))}
        assert {tuple(r) for r in resolve.overlap_edges(df, "a", "b", "item", least, share).collect()} == want


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_instants_of_whole_tables_against_brute_force(spark):
    """p1_found and p1_all_instants, every value parsed by itself without dictionary or join."""
    values = []
    for tab, rec, fld in (("lever_postings", "id", "createdat"), ("ashby_jobs", "id", "publishedat"), ("search_response", "publication_number", "publication_date"), ("search_response", "publication_number", "deadline_receipt_request")):
        for r in spark.read.parquet(f"{SF}/{tab}.parquet").select(rec, fld, "tz").collect():
            held = r[fld] if isinstance(r[fld], list) else [r[fld]]
            values += [(tab, r[rec], fld, pos, raw, parse_instant(raw, r.tz)) for pos, raw in enumerate(held or []) if raw is not None]
    want = {(*v[:4], v[5]) for v in values if v[5] is not None and not COMPLETE.fullmatch(v[4])}
    assert {tuple(r) for r in data_queries.p1_found(spark, SF).collect()} == want and want
    for r in data_queries.p1_all_instants(spark, SF).collect():
        own = [v for v in values if (v[0], v[2]) == (r.tab, r.fld)]
        known = [v[5] for v in own if v[5] is not None]
        assert (r.texts, r.instants, r.first_us, r.last_us) == (len(own), len(known), min(known), max(known))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pay_of_whole_tables_against_brute_force(spark):
    """p3_found, every row by plain arithmetic on the two unit tables, without graph or joins."""
    rates = {r.currency: r.obs_value for r in spark.read.parquet(f"{SF}/ecb_rates.parquet").collect()} | {"EUR": 1.0}
    years = {r.period: r.per_year for r in spark.read.parquet(f"{SF}/pay_periods.parquet").collect()}
    want = set()

    def add(tab, rec, lo, hi, code, period):
        for bound, amount in (("min", lo), ("max", hi)):
            if amount is not None and amount > 0 and code in rates and period in years:
                want.add((tab, rec, bound, int(amount * years[period] / rates[code] + 0.5)))

    for r in spark.read.parquet(f"{SF}/lever_postings.parquet").where("salaryrange IS NOT NULL").collect():
        code, scale = pay.currency_of(r.salaryrange.currency)
        add("lever_postings", r.id, *[x * scale if x is not None else None for x in (r.salaryrange.min, r.salaryrange.max)], code, pay.period_of(r.salaryrange.interval))
    for r in spark.read.parquet(f"{SF}/pinpoint_postings.parquet").collect():
        lo, hi = (x if x is not None and x == x else None for x in (r.compensation_minimum, r.compensation_maximum))
        (code, scale), said = pay.currency_of(r.compensation_currency), pay.read_pay(r.compensation)
        if lo is None and hi is None:
            lo, hi, scale = said.low, said.high, 1.0
        lo, hi = (x * scale if x is not None else None for x in (lo, hi))
        add("pinpoint_postings", r.id, lo, hi, code or said.currency, pay.period_of(r.compensation_frequency) or said.period)
    got = {tuple(r) for r in data_queries.p3_found(spark, SF).collect()}
    near = {(t, i, b) for t, i, b, _ in got ^ want}
    assert all(abs(x[3] - y[3]) <= 1 for x in got for y in want if x[:3] == y[:3] and x[:3] in near) and len(got) == len(want) > 50 and len(got ^ want) <= 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_country_codes_of_whole_tables(spark):
    rows = spark.read.parquet(f"{SF}/boards_jobs.parquet").select("job_id", "locations").collect()
    want = {(r.job_id, tuple(r.locations) if r.locations is not None else None): ",".join(geo.location_codes(r.locations)) for r in rows}
    got = catalogue_more.country_codes(spark, SF).collect()
    assert sorted((r.job_id, r.codes) for r in got) == sorted((k[0], v) for k, v in want.items())
