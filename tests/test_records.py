"""Functions over single records, payloads of platforms, outputs and assets."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from weirflow.functions import records, web
from weirflow.operators import outputs, relevance, state
from weirflow.sources import platforms, releases
from weirflow.sources.documents import SchemaChange, json_ld, read_csv_by_header


def values(spark, column, rows, schema):
    return [r.x for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_policies(spark):
    spf = records.spf_policy(F.col("s"))
    got = values(spark, spf, [("v=spf1 a mx include:x.y ~all",), ("v=spf1 redirect=z.example ip4:1.2.3.4",), ("V=SPF1 -ALL",), ("text",), ("",), (None,)], "s string")
    assert [tuple(g) for g in got] == [(True, 3, "~all"), (True, 1, None), (True, 0, "-all"), (False, 0, None), (False, 0, None), (False, 0, None)]
    tags = records.tag_list(F.col("s"))
    assert [m.get("p") for m in values(spark, tags, [("v=DMARC1; p = none ;pct=5",), ("",), (None,)], "s string")] == ["none", None, None]


def test_ratings_and_grades(spark):
    assert values(spark, records.rated(F.col("n"), 1, 3), [(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "n double") == ["good", "needs work", "needs work", "poor", None]
    assert values(spark, records.graded(F.col("n"), [(5, "A"), (3, "B")], "C"), [(9,), (5,), (4,), (0,), (None,)], "n int") == ["A", "A", "B", "C", "C"]


def test_versions(spark):
    rows = [(["1.9", "1.10", "1.2.3"],), (["2", "2.0"],), ([],), (None,)]
    assert values(spark, records.best_version(F.col("v")), rows, "v array<string>") == ["1.10", "2.0", None, None]


def test_names(spark):
    rows = [("Аcme Group (ACM) (ex Foo)",), ("Москва",), ("",), (None,)]
    got = values(spark, records.name_variants(records.repaired_name(F.col("s"))), rows, "s string")
    assert got == [["Acme Group", "ACM", "ex Foo"], ["Москва"], [], []]
    near = records.near_name("acme grup", F.col("t"))
    assert values(spark, near, [(["acme", "group"],), (["acme"],), ([],), (None,)], "t array<string>") == [False, False, False, None]
    assert values(spark, records.near_name("brellowey", F.col("t")), [(["brelloway", "x"],), (["brello"],)], "t array<string>") == [True, False]


def test_titles_terms_codes_and_fields(spark):
    pages = [("<title>\n A  b </title>",), ("<meta property='og:title' content=' Shared '><title>x</title>",), ("<meta content=\"S\" name='og:title'>",), ("<p>none</p>",), (None,)]
    assert values(spark, records.page_title(F.col("s")), pages, "s string") == ["A b", "Shared", "S", None, None]
    assert values(spark, records.terms_within(F.col("s"), ["b", "a"]), [("A big",), ("",), (None,)], "s string") == [["b", "a"], [], []]
    assert values(spark, records.plain_codes(F.col("a")), [(["45-1", "451", None, "x", "123456789"],), (None,)], "a array<string>") == [["451", "12345678"], []]
    got = values(spark, records.multimap(F.col("a")), [(["A: 1", "a:2:3", ": none", "no", "B:"],), ([],)], "a array<string>")
    assert got == [{"a": ["1", "2:3"], "b": [""]}, {}]
    assert records.share_of(85) == records.share_of(0.85) == 0.85 and records.share_of(-1) == 0 and records.share_of(250) == 1
    assert records.region_codes(" DACH", {"dach": ("DE", "AT")}) == ["AT", "DE"] and records.region_codes("de", {"dach": ("DE",)}) == ["DE"] and records.region_codes("xx", {}) == []


def test_points(spark):
    assert values(spark, relevance.word_points(F.col("s"), ["road", "C++"], 3), [("roads and road",), ("broads",), (None,)], "s string") == [3, 0, 0]
    assert values(spark, relevance.additive([(F.col("s") == "a", 2), (F.col("s").isNull(), -1)]), [("a",), ("b",), (None,)], "s string") == [2, 0, -1]


def test_robots(spark):
    rules = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern")) for a, p in ((False, "/a"), (True, "/a/b"), (False, "/*.pdf$"), (True, ""), (False, "/c"), (True, "/c"))])
    paths = [("/a/x",), ("/a/b/c",), ("/z.pdf",), ("/z.pdf?x",), ("/c",), ("/other",)]
    assert values(spark, web.robots_allowed(rules, F.col("p")), paths, "p string") == [False, True, False, True, True, True]


PAYLOADS = {
    "greenhouse": json.dumps({"jobs": [{"id": 7, "title": "A", "absolute_url": "u", "location": {"name": "L"}, "departments": [{"name": "D"}], "updated_at": "t", "extra": 1}, {"id": None, "title": "x"}, None]}),
    "workable": json.dumps({"jobs": [{"shortcode": "S", "title": "A", "city": "C", "country": "X", "url": "u", "application_url": "v"}]}),
    "recruitee": json.dumps({"offers": [{"id": 1, "title": "A", "status": "published"}, {"id": 2, "title": "B", "status": "draft"}, {"id": 3, "title": "C"}]}),
    "workday": json.dumps({"jobPostings": [{"title": "A", "externalPath": "/job/Place/A_R-12", "postedOn": "Posted Today"}]}),
    "personio": "<workzag-jobs><position><id>5</id><name>A</name><office>O</office></position><position><id>6</id><name></name></position></workzag-jobs>",
    "teamtailor": "<rss><channel><item><guid>g</guid><title>A &amp; B</title><link>u</link></item></channel></rss>",
    "jazzhr": "<h4><a href='https://x/apply/Z9/'>A <b>b</b></a></h4><ul><li><i></i> L</li><li>D</li></ul><h4><a href=''> </a></h4>",
}


@pytest.mark.parametrize("platform", sorted(PAYLOADS))
def test_platforms(spark, platform):
    df = spark.createDataFrame([(PAYLOADS[platform], "b1", "clash"), (None, "b2", ""), ("", "b3", ""), ("{broken", "b4", "")], "payload string, board string, p string")
    got = platforms.payload_rows(df.drop("p"), platform, "payload").collect()
    assert [(r.board, r.id) for r in got] == [("b1", {"greenhouse": "7", "workable": "S", "recruitee": "1", "workday": "A_R-12", "personio": "5", "teamtailor": "g", "jazzhr": "Z9"}[platform])]
    assert got[0].title == {"teamtailor": "A & B", "jazzhr": "A b"}.get(platform, "A")
    assert got[0].location == {"greenhouse": "L", "workable": "C, X", "personio": "O", "jazzhr": "L"}.get(platform)
    assert platforms.payload_rows(df.drop("p").limit(0), platform, "payload").count() == 0


def test_json_ld_and_csv(spark, tmp_path):
    html = '<script type="application/ld+json">{"@graph": [{"a": 1}, {"a": 2}]}</script><script type=\'application/ld+json\'>{bad</script><script type="application/ld+json">{"a":\t"x\ny"}</script>'
    got = json_ld(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), "h").select("id", F.to_json("block").alias("b")).collect()
    assert sorted((r.id, r.b) for r in got) == [(1, '{"a":"x y"}'), (1, '{"a":1}'), (1, '{"a":2}')]
    path = tmp_path / "x.csv"
    path.write_bytes('id,name\n1,"a ""q"" é\nb"\n2,\n'.encode("iso-8859-1"))
    rows = read_csv_by_header(spark, str(path), ["name"], "iso-8859-1").collect()
    assert [(r.id, r.name) for r in rows] == [("1", 'a "q" é\nb'), ("2", None)]
    with pytest.raises(SchemaChange):
        read_csv_by_header(spark, str(path), ["missing"])


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", False, "lever", date(2026, 1, 1), True), (2, " ", True, "x", date(2026, 6, 1), False), (3, None, None, None, None, None), (4, "", True, "lever", date(2027, 1, 1), True)], "id int, t string, failed boolean, ats string, at date, open boolean")
    assert values(spark, outputs.text_status(F.col("t"), True, F.col("failed")), [("a", None), ("", True), (None, None)], "t string, failed boolean") == ["given", "failed", "none"]
    assert outputs.pick(df, ["t", "id", "nothing"]).columns == ["id", "t"] and outputs.pick(df, []).columns == df.columns
    assert [r.x for r in df.select(outputs.board_url(F.col("ats"), F.col("id").cast("string"), {"lever": "https://l/{}"}).alias("x")).collect()] == ["https://l/1", None, None, "https://l/4"]
    kept = outputs.retained(F.col("at"), F.col("open"), F.lit("2026-06-20").cast("date"), 30)
    assert [r.x for r in df.select(kept.alias("x")).collect()] == [True, True, False, False]
    assert [r.id for r in outputs.complete_rows(df, ["t", "at"]).collect()] == [1]
    path = str(tmp_path / "out")
    for n in (1, 2):
        assert outputs.deliver(df, path, {"rows": F.count(F.lit(1)), "open": F.count_if("open")}) == {"rows": 4, "open": 2}
        assert spark.read.parquet(path).count() == 4 * n


def test_assets(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string"), str(tmp_path / "asset")
    outputs.write_asset(df, path, "f/1", "2026-01-01")
    read = lambda **kw: outputs.read_asset(spark, path, kw.pop("form", "f/1"), "id int, t string", **kw)
    assert sorted(map(tuple, read().collect())) == [(1, "a"), (2, None)]
    with pytest.raises(SchemaChange):
        read(form="f/2")
    for wrong in ({"not_before": "2026-02-01"}, {"least": 3}):
        with pytest.raises(ValueError):
            read(**wrong)
    spark.createDataFrame([("{\"id\": 3}",)], "value string").write.mode("append").text(f"{path}/rows")
    with pytest.raises(ValueError):
        read()


def test_releases(spark):
    body = {
        "ocid": "o1", "tag": ["tender", "award"], "buyer": {"id": "b"}, "parties": [{"id": "b", "name": "Buyer", "roles": ["buyer"]}, {"id": "s", "name": "Seller"}],
        "tender": {"title": "T", "value": {"amount": 9, "currency": "USD"}, "items": [{"classification": {"id": "45-1"}}, {}, {"classification": {"id": "451"}}]},
        "awards": [{"status": "active", "value": {"amount": 2, "currency": "EUR"}, "suppliers": [{"id": "s"}, {"id": "none"}, {"id": "x", "name": "Own"}]}, {"status": "cancelled", "value": {"amount": 5, "currency": "EUR"}, "suppliers": [{"id": "b"}]}],
    }
    mixed = {"ocid": "o2", "awards": [{"value": {"amount": 1, "currency": "EUR"}}, {"value": {"amount": 1, "currency": "GBP"}}], "tender": {"value": {"amount": 7, "currency": "SEK"}, "procuringEntity": {"id": "q", "name": "Q"}}}
    rows = [("k", json.dumps(body)), ("m", json.dumps(mixed)), ("n", json.dumps({"ocid": "o3"})), ("x", "{}"), ("y", "{broken"), ("z", None)]
    got = {r.kind_: r for r in releases.release_rows(spark.createDataFrame(rows, "kind_ string, body string"), "body").collect()}
    assert got.keys() == {"k", "m", "n"}
    assert (got["k"].kind, got["k"].buyer, got["k"].suppliers, got["k"].codes, got["k"].amount, got["k"].currency) == ("award", "Buyer", ["Own", "Seller"], ["451"], 2.0, "EUR")
    assert (got["m"].kind, got["m"].buyer, got["m"].amount, got["m"].currency) == ("other", "Q", 7.0, "SEK") and got["n"].suppliers == [] and got["n"].amount is None
    assert releases.release_rows(spark.createDataFrame([], "body string"), "body").count() == 0


def test_name_lists(spark):
    un = "<e><DATAID>1</DATAID><FIRST_NAME>A</FIRST_NAME><SECOND_NAME>B</SECOND_NAME><INDIVIDUAL_ALIAS><ALIAS_NAME> C </ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><ALIAS_NAME>A B</ALIAS_NAME></INDIVIDUAL_ALIAS></e>"
    df = spark.createDataFrame([("x", un), ("y", "<e><DATAID>2</DATAID></e>"), ("z", None)], "uid_ string, e string")
    assert [(r.uid, r.name, r.aliases) for r in releases.list_rows(df, "un", "e").collect()] == [("1", "A B", ["C"])]
    names, aliases = spark.createDataFrame([(1, "N"), (2, "M")], "k int, n string"), spark.createDataFrame([(1, "b"), (1, " a"), (1, ""), (1, "b"), (3, "c"), (2, None)], "k int, a string")
    assert sorted((r.k, r.aliases) for r in releases.with_aliases(names, aliases, "k", "a").collect()) == [(1, ["a", "b"]), (2, [])]


def test_filter_identity(spark):
    same = values(spark, state.filter_identity(F.col("a")), [(["B ", "a"],), (["A", "b", "b"],), (["a"],), ([],)], "a array<string>")
    assert same[0] == same[1] != same[2] != same[3]


def test_board_and_posting_refs(spark):
    boards = [("https://boards.greenhouse.io/Acme/jobs/12",), ("https://jobs.lever.co/acme.x/1",), ("https://www.recruitee.com/x",), ("https://acme.wd5.myworkdayjobs.com/en-US/Ext",), ("https://acme.jobs.personio.de/job/1",), ("ftp://x",), ("",), (None,)]
    got = values(spark, web.board_ref(F.col("u")), boards, "u string")
    assert [tuple(g) if g else None for g in got] == [("greenhouse", "acme"), ("lever", "acme.x"), None, ("workday", "acme"), ("personio", "acme"), None, None, None]
    posts = [("https://x/jobs/12/apply?y=1",), ("https://x/p?gh_jid=77",), ("https://x/a/00b40b8c-7cc0-48b1-a610-7a90247ae1ca/",), ("https://x/job/Berlin/Nurse_JR-104",), ("https://x/about",), (None,)]
    assert values(spark, web.posting_ref(F.col("u")), posts, "u string") == ["12", "77", "00b40b8c-7cc0-48b1-a610-7a90247ae1ca", "JR-104", None, None]
