import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from weirflow.functions import classify, dates, text, web
from weirflow.functions.geo import location_codes
from weirflow.operators import aggregates, dedupe, filters, joins, relevance, resolve, rules, state, terms
from weirflow.plans.options import SearchOptions, search


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, bool | int | list) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_text_keys(spark):
    assert one(spark, text.search_text(F.col("s")), s="Café C++/C# Ürün") == "cafe c++ c# urun"
    assert one(spark, text.company_key(F.col("s")), s="Müller & Co. GmbH") == "muller and"
    assert one(spark, text.match_key(F.col("s")), s=None) == ""
    assert one(spark, text.shorten(F.col("s"), 10), s="aaaa bbbb cccc") == "aaaa bbbb…"
    assert one(spark, text.budget_join(F.col("a"), 5), a=["ab", "cd", "e"]) == "ab cd"
    assert one(spark, text.html_to_text(F.col("s")), s="<ul><li>a &amp; b</li><li>c</li></ul><!-- x --><script>1</script>") == "• a & b\n• c"
    assert one(spark, text.html_to_text(F.col("s")), s="&lt;p&gt;Hi&lt;/p&gt;") == "Hi"
    assert one(spark, text.snippet(F.col("s")), s="  ") is None


@pytest.mark.parametrize(
    ("title", "level"),
    [("Senior Data Engineer", "senior"), ("Working Student Sales", "intern"), ("Head of Finance", "director"), ("Product Manager", None), ("Sales Manager", "manager"), ("Chief Financial Officer", "executive"), ("Engineer II", "mid"), ("Junior Nurse", "entry"), ("Team Lead Ops", "lead"), ("", None), (None, None)],
)
def test_levels(spark, title, level):
    assert one(spark, classify.seniority(F.col("t")), t=title) == level


@pytest.mark.parametrize(
    ("said", "years"),
    [("3+ years of experience with SQL", 3), ("We have 20 years of experience", None), ("5-7 years working in sales", 5), ("up to 5 years of experience", None), ("at least two years of background in law", 2), ("18 years old", None), (None, None)],
)
def test_years(spark, said, years):
    assert one(spark, classify.years_asked(F.col("s")), s=said) == years


def test_years_below_wishes(spark):
    text_ = "Nice to have:\n5 years of experience with Go\nRequirements:\n3 years of experience with SQL"
    assert one(spark, classify.years_asked(F.col("s")), s=text_) == 3
    assert one(spark, classify.years_asked(F.col("s")), s="Bonus\n5 years of experience") is None


@pytest.mark.parametrize(("said", "offered"), [("Visa sponsorship available.", True), ("We are unable to sponsor visas.", False), ("Sponsorship may be considered.", None), ("A visa card", None), (None, None)])
def test_visa(spark, said, offered):
    assert one(spark, classify.visa_offered(F.col("s")), s=said) is offered


def test_references_and_contacts(spark):
    assert one(spark, text.decode_entities(F.col("s")), s="&amp;lt; &eacute;&#8364;&#x1F389; &nothing; &#0;") == "&lt; é€🎉 &nothing; &#0;"
    assert one(spark, text.html_to_text(F.col("s")), s="<p>a&nbsp;&nbsp;b<br/>c < d</p>\n\n\n<table><tr><td>x</td></tr></table>") == "a b\nc < d\n\nx"
    said = "Mail a.b+c@x-y.co.uk or jo (at) firm (dot) de; +44 (0)20 7946 0958, 212-555-0147, Tel: 030/123456, Contact: Eva Maria Sanz. Order 12345678 in 2026-11-02."
    assert one(spark, text.redact_contacts(F.col("s")), s=said) == "Mail [email redacted] or [email redacted]; [phone redacted], [phone redacted], Tel: [phone redacted], Contact: [name redacted]. Order 12345678 in 2026-11-02."
    assert one(spark, text.redact_contacts(F.col("s")), s=None) is None


def test_filters_never_null(spark):
    df = spark.createDataFrame([("remote", None), (None, True), (None, None), ("onsite", False)], "w string, r boolean")
    remote = filters.is_remote(F.col("w"), F.col("r"))
    assert [r.x for r in df.select((~remote).alias("x")).collect()] == [False, False, True, True]
    assert one(spark, filters.code_prefix_any(F.col("a"), ["79"]), a=["4500", "7912"]) is True
    assert one(spark, filters.whole_words_any(F.col("s"), ["São Paulo"]), s="Sao Paulo, BR") is True
    assert one(spark, filters.company_is(F.col("s"), F.lit("b"), "Acme"), s="ACME GmbH") is True


def test_ranking(spark):
    rows = [("1", "Data Engineer", None, None, None), ("2", "Nurse", "Data", None, None), ("3", "Clerk", None, "needs engineers for data", None), ("4", "Cook", None, None, None), ("5", "Maintenance", None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, title string, department string, description_text string, posted_at timestamp_ntz")
    got = relevance.ranked(df, ["data engineer"], F.col("title"), [F.col("department")], F.col("description_text"))
    assert [(r.job_id, r.match_score, r.matched_in) for r in got.orderBy(*relevance.rank_order()).collect()] == [("1", 100, "title"), ("3", 30, "description")]
    any_ = relevance.ranked(df, ["data", "ai"], F.col("title"), [F.col("department")], F.col("description_text"))
    assert [(r.job_id, r.match_score) for r in any_.orderBy(*relevance.rank_order()).collect()] == [("1", 65), ("2", 45), ("3", 25)]
    assert relevance.ranked(df, [], F.col("title"), []).where("match_score is null").count() == 5
    page = relevance.after_key(any_, 65, None, "1")
    assert [r.job_id for r in page.orderBy("job_id").collect()] == ["2", "3"]


def test_search_options(spark):
    rows = [("a:1", "a", "Senior Engineer", "X Ltd", "x", "remote", None, "full_time", None, None, datetime(2026, 1, 2), ["Berlin"], ["DE"], "d"), ("b:2", "b", "Engineer", "Y", "y", None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, ats string, title string, company_name string, company_board string, workplace_type string, remote boolean, employment_type string, department string, team string, posted_at timestamp_ntz, locations array<string>, country_codes array<string>, description_text string")
    now = F.lit("2026-01-03 00:00:00").cast("timestamp_ntz")
    ids = lambda **o: [r.job_id for r in search(df, SearchOptions(**o), now).collect()]
    assert ids() == ["a:1", "b:2"] and ids(remote="onsite_only") == ["b:2"] and ids(levels=["senior"]) == ["a:1"]
    assert ids(keywords=["engineer"], most_per_company=1) == ["a:1", "b:2"] and ids(posted_within_days=2) == ["a:1"] and ids(places=["berlin"]) == ["a:1"] and ids(not_companies=["X"]) == ["b:2"]
    for bad in ({"remote": "x"}, {"levels": ["boss"]}, {"limit": 0}, {"keywords": "x"}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)


def test_dedupe(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 2, "c"), ("k", 2, "a"), ("k", 2, "a"), (None, 1, "z")], "k string, score int, id string")
    got = dedupe.survivors(df, [F.col("k")], [F.col("score")], "id").collect()
    assert sorted((r.k or "", r.id, r.duplicate_sources) for r in got) == [("", "z", []), ("k", "a", ["b", "c"])]
    x = spark.createDataFrame([("t", "ted", 1), ("t", "sam", 2), ("t", "ted", 3), (None, "sam", 4)], "k string, source string, id int")
    assert sorted(r.id for r in dedupe.cross_source(x, ["k"], "source", [F.col("source").desc(), F.col("id")]).collect()) == [1, 3, 4]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, seen int, v string")
    new = spark.createDataFrame([("a", 5, "z")], "id string, seen int, v string")
    assert sorted(map(tuple, dedupe.upsert(old, new, "id", "seen").collect())) == [("a", 1, "z"), ("b", 2, "y")]


def test_openings(spark):
    rows = [("c", "o", "b1", "1"), ("c", "o", "b1", "2"), ("c", "o", "b2", "3"), ("c", "o", "b2", "4"), ("c", "o", "b2", "5"), ("c", "p", "b2", "6")]
    df = spark.createDataFrame(rows, "company string, opening string, board string, id string")
    assert aggregates.cross_board_openings(df, "company", "opening", "board").first().openings == 4
    assert sorted(r.id for r in aggregates.counted_openings(df, "company", "opening", "board", "id").collect()) == ["1", "2", "5", "6"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    nodes = spark.range(0, 103)
    got = {r.node: r.component for r in resolve.connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 101, 102)} == {100} and got[0] == 0 and got[50] == 50
    assert resolve.connected_components(nodes, edges.limit(0)).where("node <> component").count() == 0


def test_names(spark):
    q = spark.createDataFrame([(1, "Ivan PETROV"), (2, "Ltd"), (3, None)], "q int, name string")
    c = spark.createDataFrame([(1, "PETROV, Ivan Ivanovich"), (2, "Petrov Ivan"), (3, "Anna Smith"), (4, "ivan petrov")], "c int, name string")
    assert sorted((r.q, r.c, r.score) for r in resolve.screen_names(q, c, 0.8).collect()) == [(1, 1, 0.867), (1, 2, 1.0), (1, 4, 1.0)]


def test_names_of_many_ids(spark):
    """Names are compared once each, not once for every two ids that have them, and what pairs of ids there are is no longer shuffled or counted."""
    names = ("large ring", "Ring, large", "old ring", "ring of the large", "hot bolt", None, "ltd")
    q = spark.createDataFrame([(i, names[i % 7]) for i in range(70)] + [(None, "old ring"), (14, "hot bolt"), (3, "ring of the large")], "q int, name string")
    c = spark.createDataFrame([(i, names[i % 7]) for i in range(700)] + [(None, "large ring"), (4, "hot bolt")], "c int, name string")
    alike = resolve.alike_names(q.groupBy("q", resolve.name_norm(F.col("name")).alias("qn")).agg(F.count("*").alias("mq")), c.groupBy("c", resolve.name_norm(F.col("name")).alias("cn")).agg(F.count("*").alias("mc")), 0.7)
    assert alike.where("mq = 1 and mc = 1").count() == 11
    found = resolve.screen_names(q, c, 0.7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")] and "Aggregate" not in plan[: plan.index("SortMergeJoin")]
    whole = found.where("(q <> 3 or q is null) and (c <> 4 or c is null)")
    same = {0: (0, 1, 3), 1: (0, 1, 3), 2: (2,), 3: (0, 1, 3), 4: (4,)}
    expected = [(a, b, 1.0) for a in [*range(70), None] for b in [*range(700), None] if a != 3 and b != 4 and (2 if a is None else a % 7) in same and (0 if b is None else b % 7) in same[2 if a is None else a % 7]]
    expected += [(14, b, 1.0) for b in range(700) if b % 7 == 4 and b != 4]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    assert sorted(map(tuple, whole.collect()), key=key) == sorted(expected, key=key)
    spread = resolve.SPELLED_AT_ONCE
    try:
        resolve.SPELLED_AT_ONCE = 100
        assert sorted(map(tuple, resolve.screen_names(q, c, 0.7).collect()), key=key) == sorted(map(tuple, found.collect()), key=key)
    finally:
        resolve.SPELLED_AT_ONCE = spread


def test_state(spark):
    rows = spark.createDataFrame([("a", date(2026, 1, 1)), ("b", date(2026, 1, 2)), ("c", date(2026, 1, 2)), ("d", None)], "id string, day date")
    known = rows.where("id = 'b'")
    assert sorted(r.id for r in state.undelivered(rows, known, "id", "day", "2026-01-02").collect()) == ["c", "d"]
    assert sorted(r.id for r in state.undelivered(rows, known, "id", "day", "2026-01-02", complete=False).collect()) == ["a", "c", "d"]
    last, keys = state.next_tracker(rows, known, "id", "day", "2026-01-01", truncated=False)
    assert last == "2026-01-02" and sorted(r.id for r in keys.collect()) == ["b", "c"]
    last, keys = state.next_tracker(rows, known, "id", "day", "2026-01-01", truncated=True)
    assert last == "2026-01-01" and keys.count() == 4
    seen = spark.createDataFrame([("x", 1), ("a", 10)], "id string, last_day int").select(state.key_hash(F.col("id")).alias("h"), "last_day")
    assert sorted(r.id for r in state.unseen(rows, seen, "id").collect()) == ["b", "c", "d"]
    assert state.next_seen(rows, seen, "id", 16).count() == 4 and state.next_seen(rows, seen, "id", 15).count() == 5 and state.next_seen(rows, seen, "id", 99, truncated=True).count() == 5
    assert state.cursor_key({"a": ["X", "y"], "output": 1}) == state.cursor_key({"a": ["Y", "x"], "b": None})


def test_joins(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "src string, dst string")
    assert {r.start: r.goal for r in joins.follow_chain(links).collect()} == {"a": "c", "b": "c", "x": "x"}
    rates = spark.createDataFrame([("d", "USD", 2.0), ("d", "GBP", 0.5), ("e", "GBP", 1.0)], "day string, currency string, rate double")
    assert sorted(map(tuple, joins.cross_rates(rates, "USD").collect())) == [("d", "EUR", 0.5), ("d", "GBP", 0.25)]
    df = spark.createDataFrame([("1", None), ("2", "kept"), ("3", None)], "id string, v string")
    det = spark.createDataFrame([("1", "filled", None), ("2", "other", False), ("3", "x", True)], "id string, v string, gone boolean")
    assert sorted(map(tuple, joins.fill_missing(df, det, "id", "gone").collect())) == [("1", "filled"), ("2", "kept")]


def test_rules(spark):
    table = [rules.Rule("wp", "wp-content", "wp", 60, implies=("php",)), rules.Rule("wp", "wordpress", "", 60), rules.Rule("php", "nope", implies=("sql",)), rules.Rule("joomla", "joomla", excludes=("wp",))]
    df = spark.createDataFrame([(1, "WP-content wp-content wordpress"), (2, "wordpress joomla"), (3, None)], "id int, t string")
    assert sorted(map(tuple, rules.detect(df, "id", "t", table).collect())) == [(1, "php", 100), (1, "sql", 100), (1, "wp", 100), (2, "joomla", 100)]


def test_dates_and_web(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp_ntz")
    bands = spark.createDataFrame([(datetime(2026, 1, 11),), (datetime(2026, 1, 8),), (None,), (datetime(2020, 1, 1),)], "t timestamp_ntz").select(dates.age_band(F.col("t"), now).alias("b"))
    assert [r.b for r in bands.collect()] == [0, 1, 8, 8]
    assert one(spark, dates.relative_day(F.col("s"), now), s="Posted 30+ Days Ago") == date(2025, 12, 11)
    assert one(spark, web.url_key(F.col("s")), s="HTTPS://www.X.com/a/b/?q=1&gh_jid=7#z") == "x.com/a/b?gh_jid=7"
    assert one(spark, web.url_key(F.col("s")), s="ftp://x") is None
    assert one(spark, web.site_of(F.col("s")), s="jobs.acme.co.uk") == "acme.co.uk"
    assert one(spark, web.luhn_valid(F.col("s")), s="732829320") is True
    robots = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern")) for a, p in ((False, "/"), (True, "/jobs/*"), (False, "/jobs/x$"))])
    assert [one(spark, web.robots_allowed(robots, F.col("s")), s=p) for p in ("/a", "/jobs/1", "/jobs/x", "/jobs/xy")] == [False, True, False, True]
    assert location_codes(["Berlin, Germany", "Remote (United States of America)", "London UK", None]) == ["DE", "GB", "US"]


def test_aggregates(spark):
    runs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False)], "g string, t int, f boolean")
    assert sorted(map(tuple, aggregates.streaks(runs, "g", [F.col("t").desc()], F.col("f")).collect())) == [("a", 4, 3, 2), ("b", 1, 0, 0)]
    items = F.array(*[F.struct(F.lit(float(a)).alias("amount"), F.lit(c).alias("currency")) for a, c in ((0, "USD"), (5, "EUR"), (7, "EUR"))])
    assert spark.range(1).select(aggregates.one_currency_total(items).alias("x")).first().x == 12.0


def test_terms(spark):
    found = [terms.Term("go", ("Go", "Golang"), exact=True, weak=True), terms.Term("c++", ("c++",)), terms.Term("c", ("C",), exact=True, weak=True), terms.Term("react", ("react",), implies=("js",)), terms.Term("js", ("javascript",), implies=("web",)), terms.Term("excel", ("Excel",), exact=True, excludes=("go",))]
    rows = [(1, "We go far in Go."), (2, "Go and C++ 20; excel at it"), (3, "REACT, react.native"), (4, "Excel, Go"), (5, None), (6, ""), (7, "İstanbul C++"), (2, "Go and C++ 20; excel at it")]
    df = spark.createDataFrame(rows, "key int, name string").withColumn("text", F.lit("c++"))
    got = {(r.key, r.name, r.worded, r.implied) for r in terms.detect_terms(df, F.col("key"), F.col("name"), found).collect()}
    assert got == {(2, "go", "Go", False), (2, "c++", "C++", False), (3, "react", "REACT", False), (3, "js", None, True), (3, "web", None, True), (4, "excel", "Excel", False), (7, "c++", "C++", False)}
    assert terms.detect_terms(df, F.col("key"), F.col("name"), []).count() == 0 == terms.detect_terms(df.limit(0), F.col("key"), F.col("name"), found).count()
    assert terms.suggest_terms("go", found) == ["go"] and terms.suggest_terms("c", found) == ["c", "c++", "excel", "js", "react"][:5] and terms.suggest_terms(" ", found) == []


def test_many_terms_cost_no_more_a_text():
    """Six hundred names: a text is read once by one automaton."""
    many = [terms.Term(f"name{i}", (f"Name{i}", f"tool-{i}x")) for i in range(600)]
    built = terms.automaton_of(many)
    text_ = "plain words of the daily work, Name17 and tool-598x; name5990 " * 80
    began = time.perf_counter()
    for _ in range(50):
        assert set(terms.find_terms(text_, built, many)) == {17, 598}
    assert (time.perf_counter() - began) / 50 < 0.05
