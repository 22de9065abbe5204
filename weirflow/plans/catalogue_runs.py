"""Further queries of the catalogue: whole searches, state over several runs, streams, releases and lists of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weirflow.functions import classify, web
from weirflow.operators import state
from weirflow.plans.catalogue import NOW, now, query, sql_company_key, sql_match_key, sql_search_text
from weirflow.plans.options import SearchOptions, search
from weirflow.session import materialize, run_dir, table
from weirflow.sources import documents, releases
from weirflow.streaming import incremental


@query(f"""
WITH j AS (SELECT DISTINCT job_id, title, department, team, company_name, company_board, posted_at, description_text FROM boards_jobs WHERE ats IN ('lever', 'greenhouse', 'workday') AND NOT (coalesce(workplace_type = 'remote', false) OR coalesce(remote, false))
  AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at) <= 300 * 86400000000 AND coalesce({classify.rules_sql(sql_match_key('title'), classify.LEVEL_RULES)} IN ('senior', 'lead', 'entry'), false) AND NOT contains(lower(coalesce(title, '')), 'nurse')
  AND NOT (lower(company_board) = 'merulbin' OR {sql_company_key('company_name')} = 'merulbin' OR contains(' ' || {sql_company_key('company_name')} || ' ', ' merulbin '))),
a AS (SELECT *, {sql_search_text('title')} AS t, {sql_search_text("concat_ws(' ', department, team)")} AS u, ' ' || {sql_search_text("concat_ws(' ', department, team, description_text)")} || ' ' AS d FROM j),
p AS (SELECT *, CASE WHEN contains(' ' || t, ' analyst') THEN 3 WHEN contains(' ' || u, ' analyst') OR regexp_matches(u, '(^| )analyst(s|es)?( |$)') THEN 2 WHEN regexp_matches(' ' || t || ' ', ' analyst(s|es)? ') OR regexp_matches(d, ' analyst(s|es)? ') THEN 1 ELSE 0 END AS p1,
  CASE WHEN contains(' ' || t, ' planner') THEN 3 WHEN contains(' ' || u, ' planner') OR regexp_matches(u, '(^| )planner(s|es)?( |$)') THEN 2 WHEN regexp_matches(' ' || t || ' ', ' planner(s|es)? ') OR regexp_matches(d, ' planner(s|es)? ') THEN 1 ELSE 0 END AS p2 FROM a),
s AS (SELECT *, (CASE WHEN p1 = 3 AND p2 = 3 THEN 90 WHEN p1 = 3 OR p2 = 3 THEN 60 WHEN p1 = 2 OR p2 = 2 THEN 40 ELSE 20 END) + CASE WHEN p1 > 0 AND p2 > 0 THEN 10 ELSE 5 END AS match_score FROM p WHERE p1 > 0 OR p2 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY company_board ORDER BY match_score DESC, posted_at DESC NULLS LAST, job_id) AS n FROM s)
SELECT job_id, company_board, match_score FROM r WHERE n <= 3 ORDER BY match_score DESC, posted_at DESC NULLS LAST, job_id LIMIT 50""")
def search_options(spark, sf):
    """F1 to F11 and W1, O5, O10 in one search: keywords, sources, place of work, levels, age, companies left out, three a board."""
    asked = SearchOptions(
        keywords=["Analyst", "planner"], sources=["lever", "greenhouse", "workday"], remote="onsite_only", levels=["senior", "lead", "entry"], posted_within_days=300, not_companies=["Merulbin"],
        not_in_title=["nurse"], most_per_company=3, limit=50,
    )
    columns = ["job_id", "title", "department", "team", "company_name", "company_board", "posted_at", "ats", "workplace_type", "remote", "description_text"]
    df = table(spark, sf, "boards_jobs").select(*columns).dropDuplicates(["job_id", "title", "company_board", "posted_at", "department", "team", "description_text"])
    return search(df, asked, now()).select("job_id", "company_board", "match_score")


@query("""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), r1 AS (SELECT * FROM e WHERE day <= DATE '2024-01-10'), w1 AS (SELECT max(day) AS d FROM r1), k1 AS (SELECT event_id FROM r1, w1 WHERE day = d),
r2 AS (SELECT e.* FROM e, w1 WHERE day <= DATE '2024-01-12' AND day >= d AND event_id NOT IN (SELECT event_id FROM k1) AND event_id % 3 = 0), k2 AS (SELECT event_id FROM k1 UNION SELECT event_id FROM r2),
r3 AS (SELECT e.* FROM e, w1 WHERE day <= DATE '2024-01-12' AND event_id NOT IN (SELECT event_id FROM k2) AND day >= d), w3 AS (SELECT greatest(max(day), (SELECT d FROM w1)) AS d FROM r3),
k3 AS (SELECT event_id FROM r3, w3 WHERE day = d UNION SELECT event_id FROM k2)
SELECT (SELECT count(*) FROM r1) AS first_run, (SELECT count(*) FROM r2) AS cut_run, (SELECT count(*) FROM r3) AS third_run, (SELECT CAST(d AS VARCHAR) FROM w3) AS last_day, (SELECT count(*) FROM k3) AS known""")
def tracker_runs(spark, sf):
    """Three runs of one search, the second cut short, each with what the last one left to it."""
    rows = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    upto = lambda day: rows.where(F.col("day") <= F.lit(day).cast("date"))
    none = spark.createDataFrame([], "event_id long")
    first = materialize(state.undelivered(upto("2024-01-10"), none, "event_id", "day", None), "run")
    day, known = state.next_tracker(first, none, "event_id", "day", None, truncated=False)
    cut = materialize(state.undelivered(upto("2024-01-12"), known, "event_id", "day", day).where(F.col("event_id") % 3 == 0), "run")
    day, known = state.next_tracker(cut, known, "event_id", "day", day, truncated=True)
    third = materialize(state.undelivered(upto("2024-01-12"), known, "event_id", "day", day), "run")
    day, known = state.next_tracker(third, known, "event_id", "day", day, truncated=False, was_complete=False)
    return spark.createDataFrame([(first.count(), cut.count(), third.count(), day, known.count())], "first_run long, cut_run long, third_run long, last_day string, known long")


@query("""
SELECT company_board, sha256(array_to_string(list_sort(list_distinct(list(lower(trim(department))))), ',')) AS cursor FROM boards_jobs WHERE department IS NOT NULL GROUP BY company_board""")
def filter_identities(spark, sf):
    """One name for each set of filters, whatever the order, case and number of its values."""
    sets = table(spark, sf, "boards_jobs").where(F.col("department").isNotNull()).groupBy("company_board").agg(F.collect_set("department").alias("values"))
    return sets.select("company_board", state.filter_identity(F.col("values")).alias("cursor"))


def _events_stream(spark, sf):
    """The events as a stream of files; the pattern takes a file and a folder alike."""
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type FROM events), c AS (SELECT start, event_type, count(*) AS n FROM w GROUP BY start, event_type)
SELECT start, event_type, n FROM c WHERE start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def streamed_windows(spark, sf):
    """Windowed counts of a stream, of the windows that the watermark has closed."""
    base = f"{run_dir(spark)}/windows-{abs(hash(sf))}"
    counts = incremental.windowed_counts(_events_stream(spark, sf), "ts", "event_type")
    run = counts.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(DISTINCT user_id) AS users, sum(DISTINCT user_id) AS total FROM events")
def streamed_delivery(spark, sf):
    """Each key of a stream delivered once, with the seen-set kept in versions; a second run delivers nothing."""
    base = f"{run_dir(spark)}/delivery-{abs(hash(sf))}"

    def sink(rows, number):
        rows.select("user_id").write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    for _ in range(2):
        keyed = _events_stream(spark, sf).withColumn("user", F.col("user_id").cast("string"))
        incremental.deliver_unseen(keyed, "user", lambda: 20_000, f"{base}/seen", sink, f"{base}/checkpoint").awaitTermination()
    out = spark.read.schema("user_id long, batch int").parquet(f"{base}/out")
    return out.agg(F.count(F.lit(1)).alias("users"), F.sum("user_id").alias("total"))


@query("""
WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT s_name)) AS suppliers, list_sort(list(DISTINCT lpad(CAST(l_partkey AS VARCHAR), 8, '0'))) AS codes, sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'O') AS awards,
  list_sort(list(DISTINCT s_name) FILTER (WHERE l_linestatus = 'O')) AS awarded FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey)
SELECT 'ocds-' || o_orderkey AS ocid, CASE o_orderstatus WHEN 'F' THEN 'tender' WHEN 'O' THEN 'award' ELSE 'planning' END AS kind, c_name AS buyer, coalesce(array_to_string(l.awarded, ','), '') AS suppliers, array_to_string(l.codes, ',') AS codes,
  round(CASE WHEN l.awards > 0 THEN l.open ELSE o_totalprice END, 2) AS amount, CASE WHEN l.awards > 0 THEN 'EUR' ELSE 'USD' END AS currency FROM orders JOIN l ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey""")
def release_records(spark, sf):
    """Nested releases, with buyers and suppliers by reference to their parties, as flat rows; cancelled awards don't count."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice", "l_linestatus")
    named = lines.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    ref = F.concat(F.lit("S-"), F.col("l_suppkey").cast("string"))
    party = F.struct(ref.alias("id"), F.col("s_name").alias("name"), F.array(F.lit("supplier")).alias("roles"))
    value = lambda amount, code: F.struct(amount.alias("amount"), F.lit(code).alias("currency"))
    award = F.struct(F.when(F.col("l_linestatus") == "O", "active").otherwise("cancelled").alias("status"), value(F.col("l_extendedprice"), "EUR").alias("value"), F.array(F.struct(ref.alias("id"), F.lit(" ").alias("name"))).alias("suppliers"))
    item = F.struct(F.struct(F.lit("CPV").alias("scheme"), F.concat(F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit("-")).alias("id")).alias("classification"))
    # An order has seven lines at most.
    grouped = named.groupBy("l_orderkey").agg(F.collect_set(party).alias("parties"), F.collect_list(award).alias("awards"), F.collect_list(item).alias("items"))
    buyer = F.concat(F.lit("B-"), F.col("o_custkey").cast("string"))
    tag = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("planning"), F.lit("tender"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("tender"), F.lit("award"))).otherwise(F.array(F.lit("planning")))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"))
    body = F.to_json(F.struct(
        F.concat(F.lit("ocds-"), F.col("o_orderkey").cast("string")).alias("ocid"), tag.alias("tag"), F.struct(buyer.alias("id")).alias("buyer"),
        F.concat("parties", F.array(F.struct(buyer.alias("id"), F.col("c_name").alias("name"), F.array(F.lit("buyer")).alias("roles")))).alias("parties"),
        F.struct(F.lit("t").alias("title"), value(F.col("o_totalprice"), "USD").alias("value"), F.col("items")).alias("tender"), "awards",
    ))
    rows = releases.release_rows(orders.select(body.alias("body")), "body")
    return rows.select("ocid", "kind", "buyer", F.array_join("suppliers", ",").alias("suppliers"), F.array_join("codes", ",").alias("codes"), F.round("amount", 2).alias("amount"), "currency")


@query("""
WITH s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier)
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'eu' WHEN 1 THEN 'uk' WHEN 2 THEN 'un' ELSE 'us' END AS list, CAST(s_suppkey AS VARCHAR) AS uid, s_name AS name, 'aka ' || s_nationkey || CASE WHEN s_suppkey % 4 = 3 THEN ',x ' || s_name ELSE '' END AS aliases FROM s""")
def name_lists(spark, sf):
    """Four lists of names as their publishers write them, three in XML and one in two tables, as rows of one schema."""
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("aka "), F.col("s_nationkey").cast("string")).alias("alias"))
    key = F.col("s_suppkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name, alias = F.col("s_name"), F.col("alias")
    entries = {
        "eu": text('<e logicalId="', key, '"><nameAlias wholeName="', name, '" strong="true"/><nameAlias wholeName=" ', alias, '"/><nameAlias wholeName="', name, '"/></e>'),
        "uk": text("<e><UniqueID>", key, "</UniqueID><Names><Name><Name6>", alias, "</Name6><NameType>Alias</NameType></Name><Name><Name6>", name, "</Name6><NameType>Primary Name</NameType></Name></Names></e>"),
        "un": text("<e><DATAID>", key, "</DATAID><FIRST_NAME>", name, "</FIRST_NAME><INDIVIDUAL_ALIAS><ALIAS_NAME>", alias, "</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><ALIAS_NAME/></INDIVIDUAL_ALIAS></e>"),
    }
    parts = [releases.list_rows(df.where(F.col("s_suppkey") % 4 == n).select(F.lit(source).alias("list"), entry.alias("entry")), source, "entry") for n, (source, entry) in enumerate(entries.items())]
    third = df.where(F.col("s_suppkey") % 4 == 3)
    names = third.select(F.lit("us").alias("list"), key.alias("uid"), name.alias("name"))
    aliases = third.select(key.alias("uid"), F.explode(F.array(alias, text(" x ", name), F.lit(""), alias)).alias("alias"))
    parts.append(releases.with_aliases(names, aliases, "uid", "alias").select("list", "uid", "name", "aliases"))
    return reduce(lambda a, b: a.unionByName(b), parts).select("list", "uid", "name", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT c_custkey AS id, c_name || ', \"' || coalesce(c_mktsegment, '') || '\"' AS label, c_nationkey AS nation FROM customer")
def csv_with_header(spark, sf):
    """Quoted CSV read by the names of its header, in another encoding; a missing column is an error."""
    path = f"{run_dir(spark)}/csv-{abs(hash(sf))}"
    label = F.concat(F.col("c_name"), F.lit(', "'), F.coalesce("c_mktsegment", F.lit("")), F.lit('"'))
    df = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), label.alias("label"), F.col("c_custkey").alias("id"))
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    read = documents.read_csv_by_header(spark, path, ["id", "label", "nation"], "ISO-8859-1")
    return read.select(F.col("id").cast("long").alias("id"), "label", F.col("nation").cast("long").alias("nation"))


@query("""
SELECT DISTINCT job_id, title, coalesce(department, 'none') AS unit FROM boards_jobs WHERE title IS NOT NULL UNION ALL SELECT DISTINCT job_id, 'Organization', 'graph' FROM boards_jobs WHERE title IS NOT NULL""")
def json_ld_blocks(spark, sf):
    """Blocks of linked data in pages, members of a graph one by one, broken blocks left out."""
    posting = F.to_json(F.struct(F.col("title"), F.coalesce("department", F.lit("none")).alias("unit")))
    page = F.concat(F.lit('<script type="application/ld+json">{"@graph": ['), posting, F.lit(', {"title":\t"Organization", "unit": "graph"}]}</script><p>x</p><script type="application/ld+json">{"broken": </script>'))
    df = table(spark, sf, "boards_jobs").where(F.col("title").isNotNull()).select("job_id", page.alias("page")).distinct()
    part = lambda name: F.try_variant_get("block", f"$.{name}", "string").alias(name)
    return documents.json_ld(df, "page").select("job_id", part("title"), part("unit")).distinct()


@query("""
SELECT DISTINCT job_id, CASE WHEN ats IN ('greenhouse', 'lever', 'ashby', 'workable', 'recruitee', 'workday', 'personio', 'teamtailor', 'jazzhr', 'pinpoint') THEN ats END AS platform,
  CASE WHEN ats IN ('greenhouse', 'lever', 'ashby', 'workable', 'recruitee', 'workday', 'personio', 'teamtailor', 'jazzhr', 'pinpoint') THEN lower(company_board) END AS board, list_last(string_split(job_id, ':')) AS posting FROM boards_jobs""")
def board_refs(spark, sf):
    """L1, L3: platform, board and posting read from addresses as ten platforms write them."""
    b, n = F.col("company_board"), F.element_at(F.split("job_id", ":"), -1)
    at = {"greenhouse": ("https://boards.greenhouse.io/", b, "/jobs/"), "lever": ("https://jobs.eu.lever.co/", b, "/"), "ashby": ("https://jobs.ashbyhq.com/", b, "/"), "workable": ("https://apply.workable.com/", b, "/j/")}
    hosts = {"recruitee": ".recruitee.com/o/", "workday": ".wd3.myworkdayjobs.com/en-US/Ext/job/Town/Title_", "personio": ".jobs.personio.de/job/", "teamtailor": ".teamtailor.com/jobs/", "jazzhr": ".applytojob.com/apply/", "pinpoint": ".pinpointhq.com/en/postings/"}
    url = F.concat(F.lit("https://none.sample.invalid/"), b, F.lit("/"), n)
    for name, (head, board, tail) in at.items():
        url = F.when(F.col("ats") == name, F.concat(F.lit(head), board, F.lit(tail), n, F.lit("?src=x"))).otherwise(url)
    for name, tail in hosts.items():
        url = F.when(F.col("ats") == name, F.concat(F.lit("HTTPS://"), b, F.lit(tail), n, F.lit("/apply"))).otherwise(url)
    df = table(spark, sf, "boards_jobs").select("job_id", url.alias("url")).distinct()
    ref = web.board_ref(F.col("url"))
    return df.select("job_id", ref["platform"].alias("platform"), ref["board"].alias("board"), web.posting_ref(F.col("url")).alias("posting"))
