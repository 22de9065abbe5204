"""Further queries of the catalogue: platform payloads, outputs, retention, matching of names, policies, versions and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirflow.functions import records, text, web
from weirflow.operators import nested, outputs, relevance
from weirflow.plans.catalogue import NOW, jobs, now, query, sql_match_key
from weirflow.session import materialize, run_dir, table
from weirflow.sources import platforms

# ---------------------------------------------------------------- sources and sinks


def _slim(spark, sf):
    return jobs(spark, sf, "job_id", "ats", "company_board", "title", "posted_at")


@query("""
SELECT ats, count(*) AS n, count(DISTINCT company_board) AS boards, CAST(max(posted_at) AS VARCHAR) AS newest FROM (SELECT DISTINCT job_id, ats, company_board, title, posted_at FROM boards_jobs) GROUP BY ats""")
def shard_lines(spark, sf):
    """Compressed shards of JSON lines, written by platform and read as one table; a broken line is an error."""
    path = f"{run_dir(spark)}/shards-{abs(hash(sf))}"
    _slim(spark, sf).write.mode("overwrite").partitionBy("ats").option("compression", "gzip").json(path)
    read = spark.read.schema("job_id string, company_board string, title string, posted_at timestamp_ntz, ats string").option("mode", "FAILFAST").json(path)
    return read.groupBy("ats").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company_board").alias("boards"), F.date_format(F.max("posted_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("SELECT ats, count(DISTINCT company_board) AS boards FROM boards_jobs GROUP BY ats")
def asset_boards(spark, sf):
    """A list of boards written with a footer of its form, size and moment, and read only if these hold."""
    path = f"{run_dir(spark)}/boards-{abs(hash(sf))}"
    outputs.write_asset(table(spark, sf, "boards_jobs").select("ats", "company_board").distinct(), path, "boards/1", NOW)
    read = outputs.read_asset(spark, path, "boards/1", "ats string, company_board string", not_before="2026-11-01")
    return read.groupBy("ats").agg(F.count(F.lit(1)).alias("boards"))


@query("SELECT count(*) AS delivered, count(*) FILTER (WHERE remote) AS remote_jobs, count(*) FILTER (WHERE posted_at IS NULL) AS undated FROM (SELECT DISTINCT job_id, remote, posted_at FROM boards_jobs)")
def delivery_summary(spark, sf):
    """Rows appended to a delivery, with counters taken while they are written."""
    counters = {"delivered": F.count(F.lit(1)), "remote_jobs": F.count_if(F.coalesce("remote", F.lit(False))), "undated": F.count_if(F.col("posted_at").isNull())}
    seen = outputs.deliver(jobs(spark, sf, "job_id", "remote", "posted_at"), f"{run_dir(spark)}/delivery-{abs(hash(sf))}", counters)
    return spark.createDataFrame([tuple(seen[c] for c in counters)], ", ".join(f"{c} long" for c in counters))


@query("SELECT job_id, company_board FROM (SELECT DISTINCT job_id, company_board, job_url FROM boards_jobs) WHERE starts_with(job_url, 'https://lever.sample.invalid/b')")
def prefix_scan(spark, sf):
    """An index sorted by address, of which a search for a prefix reads only the row groups whose bounds hold it."""
    path = f"{run_dir(spark)}/by-url-{abs(hash(sf))}"
    df = jobs(spark, sf, "job_url", "job_id", "company_board").where(F.col("job_url").isNotNull())
    df.repartitionByRange("job_url").sortWithinPartitions("job_url").write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path).where(F.col("job_url").startswith("https://lever.sample.invalid/b")).select("job_id", "company_board")


@query("""
SELECT resp_id, 'https://api.sample.invalid/search?q=' || replace(url_encode('"' || trim(query_text) || '"'), '%20', '+') || '&from=' || strftime(fetched_at, '%Y-%m-%d') || '&size=50' AS url FROM (SELECT DISTINCT resp_id, query_text, fetched_at FROM fts_response) WHERE query_text IS NOT NULL""")
def source_query_urls(spark, sf):
    """Filters compiled into the addresses that a source is asked at."""
    asked = F.concat(F.lit("https://api.sample.invalid/search?q="), F.url_encode(F.concat(F.lit('"'), F.trim("query_text"), F.lit('"'))), F.lit("&from="), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("&size=50"))
    df = table(spark, sf, "fts_response").select("resp_id", "query_text", "fetched_at").distinct().where(F.col("query_text").isNotNull())
    return df.select("resp_id", asked.alias("url"))


@query("""
WITH j AS (SELECT DISTINCT job_id, ats, title, department, locations[1] AS place, employment_type, job_url, remote FROM boards_jobs WHERE ats IN ('greenhouse', 'workable', 'recruitee', 'workday', 'personio', 'teamtailor', 'jazzhr'))
SELECT ats, job_id AS id, title, CASE WHEN ats NOT IN ('workday', 'teamtailor') THEN department END AS department, CASE WHEN ats <> 'teamtailor' THEN place END AS location,
  CASE WHEN ats IN ('workable', 'recruitee', 'personio') THEN employment_type END AS employment_type, CASE WHEN ats <> 'personio' THEN job_url END AS url
FROM j WHERE coalesce(title, '') <> '' AND NOT (ats = 'recruitee' AND coalesce(remote, false))""")
def platform_rows(spark, sf):
    """S9, S9a to S9j, S10: payloads of seven platforms, in JSON, XML and HTML, as rows of one schema; unpublished offers are left out."""
    df = jobs(spark, sf, "job_id", "ats", "title", "department", F.get("locations", 0).alias("place"), "employment_type", "job_url", "remote")
    named = lambda **cols: F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
    keyed = df.withColumn("board", F.col("job_id"))  # numbers stand in for the platforms' own ids, the job's id rides along
    number = F.abs(F.xxhash64("job_id"))
    payloads = {
        "greenhouse": F.to_json(named(jobs=F.array(named(id=number, title="title", absolute_url="job_url", location=named(name="place"), departments=F.array(named(name="department")))))),
        "workable": F.to_json(named(jobs=F.array(named(shortcode="job_id", title="title", url="job_url", city="place", department="department", employment_type="employment_type")))),
        "recruitee": F.to_json(named(offers=F.array(named(id=number, title="title", status=F.when(F.coalesce("remote", F.lit(False)), "internal").otherwise("published"), careers_url="job_url", location="place", department="department", employment_type_code="employment_type")))),
        "workday": F.to_json(named(jobPostings=F.array(named(title="title", externalPath="job_url", locationsText="place", bulletFields=F.array("job_id"))))),
        "personio": F.to_xml(named(position=F.array(named(id="job_id", name="title", department="department", office="place", employmentType="employment_type"))), {"rowTag": "workzag-jobs"}),
        "teamtailor": F.to_xml(named(channel=named(item=F.array(named(guid="job_id", title="title", link="job_url")))), {"rowTag": "rss"}),
        "jazzhr": F.concat(
            F.lit('<ul><li class="group"><h4 class="heading"> <a href="'), F.col("job_url"), F.lit('">'), F.col("title"), F.lit("</a></h4><ul><li><i></i> "), F.coalesce("place", F.lit("")), F.lit("</li><li>"),
            F.coalesce("department", F.lit("")), F.lit("</li></ul></li></ul>"),
        ),
    }
    found = None
    for name, payload in payloads.items():
        rows = platforms.payload_rows(keyed.where(F.col("ats") == name).select("ats", "board", payload.alias("payload")), name, "payload")
        rows = rows.select("ats", F.col("board").alias("id"), "title", "department", "location", "employment_type", "url")
        found = rows if found is None else found.unionByName(rows)
    return found


# ---------------------------------------------------------------- outputs and filters


@query("""
SELECT job_id, title, array_to_string(coalesce(locations, []), ' | ') AS locations, coalesce(apply_url, job_url || '/apply') AS apply_url,
  CASE ats WHEN 'lever' THEN 'https://jobs.lever.sample.invalid/' || company_board WHEN 'ashby' THEN 'https://jobs.ashby.sample.invalid/' || company_board END AS board_url,
  CASE WHEN coalesce(description_text, '') <> '' THEN 'given' WHEN ats = 'workday' THEN 'failed' ELSE 'none' END AS description_status FROM (SELECT DISTINCT * FROM boards_jobs)""")
def posting_output(spark, sf):
    """The delivered columns with defaults, derived addresses and why a text is missing; derivable and internal columns are dropped."""
    df = table(spark, sf, "boards_jobs").distinct()
    patterns = {"lever": "https://jobs.lever.sample.invalid/{}", "ashby": "https://jobs.ashby.sample.invalid/{}"}
    status = outputs.text_status(F.col("description_text"), True, F.col("ats") == "workday")
    whole = df.withColumns({
        "locations": F.coalesce("locations", F.array().cast("array<string>")), "apply_url": F.coalesce("apply_url", F.concat("job_url", F.lit("/apply"))),
        "board_url": outputs.board_url(F.col("ats"), F.col("company_board"), patterns), "description_status": status,
    })
    picked = outputs.pick(whole, ["description_status", "board_url", "job_id", "title", "locations", "apply_url"])
    return picked.withColumn("locations", F.array_join("locations", " | "))


@query(f"""
WITH n AS (SELECT DISTINCT publication_number, TRY_CAST(regexp_extract(publication_date, '^\\s*(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) AS published, list_max(list_transform(deadline_receipt_request, lambda d: TRY_CAST(regexp_extract(d, '^\\s*(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE))) AS deadline,
  coalesce(notice_title['eng'], notice_title['deu'], notice_title['fra']) AS title FROM search_response)
SELECT publication_number, CAST(published AS VARCHAR) AS published, coalesce(deadline >= DATE '{NOW[:10]}', false) AS still_open FROM n WHERE trim(coalesce(title, '')) <> '' AND trim(coalesce(publication_number, '')) <> '' AND published IS NOT NULL
  AND date_diff('day', published, DATE '{NOW[:10]}') >= -2 AND (date_diff('day', published, DATE '{NOW[:10]}') <= 60 OR (coalesce(deadline >= DATE '{NOW[:10]}', false) AND date_diff('day', published, DATE '{NOW[:10]}') <= 730))""")
def retained_notices(spark, sf):
    """whole notices of the last sixty days, and older ones that are still open."""
    day = lambda c: F.regexp_extract(c, r"^\s*(\d{4}-\d\d-\d\d)", 1).try_cast("date")
    title = F.coalesce(*[F.try_element_at("notice_title", F.lit(c)) for c in ("eng", "deu", "fra")])
    latest = F.array_max(F.transform("deadline_receipt_request", day))
    df = table(spark, sf, "search_response").select("publication_number", day(F.col("publication_date")).alias("published"), latest.alias("deadline"), title.alias("title")).distinct()
    today = F.to_date(now())
    df = outputs.complete_rows(df, ["publication_number", "title", "published"]).withColumn("still_open", F.coalesce(F.col("deadline") >= today, F.lit(False)))
    return df.where(outputs.retained(F.col("published"), F.col("still_open"), today, 60)).select("publication_number", F.col("published").cast("string").alias("published"), "still_open")


ROBOTS = ((True, "/"), (False, "/*/10*5$"), (False, "/merulbin"), (True, "/merulbin*/1*/apply"), (False, "/*?q="))


@query("""
WITH u AS (SELECT DISTINCT job_id, regexp_extract(apply_url, '^https?://[^/]+(/.*)$', 1) AS path FROM boards_jobs WHERE apply_url IS NOT NULL),
r AS (SELECT * FROM (VALUES (true, '^/.*', 1), (false, '^/[^/]*.*/10.*5$', 8), (false, '^/merulbin.*', 9), (true, '^/merulbin.*/1.*/apply.*', 19), (false, '^/.*[?]q=.*', 5)) t(allow, rx, len)),
b AS (SELECT job_id, path, arg_max(allow, len) AS allowed FROM u JOIN r ON regexp_matches(path, rx) GROUP BY ALL) SELECT u.job_id, u.path, coalesce(b.allowed, true) AS allowed FROM u LEFT JOIN b USING (job_id, path)""")
def robots_paths(spark, sf):
    """F16: paths that may be fetched, by the longest rule that fits."""
    rules = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern")) for a, p in ROBOTS])
    path = F.regexp_extract("apply_url", "^https?://[^/]+(/.*)$", 1)
    df = jobs(spark, sf, "job_id", "apply_url").where(F.col("apply_url").isNotNull()).select("job_id", path.alias("path")).distinct()
    return df.select("job_id", "path", web.robots_allowed(rules, F.col("path")).alias("allowed"))


ASKED = ("merulbin", "brelloway grup", "solho", "ltd vilruru")


@query("WITH c AS (SELECT DISTINCT company_name, string_split(" + sql_match_key("company_name") + ", ' ') AS t FROM boards_jobs WHERE company_name IS NOT NULL), a AS (SELECT unnest(['" + "', '".join(ASKED) + """']) AS asked)
SELECT asked, company_name FROM a JOIN c ON len(list_filter(string_split(asked, ' '), lambda w: len(list_filter(t, lambda x: starts_with(x, w) OR (length(w) >= 5 AND levenshtein(x, w) <= 1))) = 0)) = 0""")
def name_matches(spark, sf):
    """companies each word of whose asked name begins one of their words or is one edit away."""
    names = table(spark, sf, "boards_jobs").select("company_name").where(F.col("company_name").isNotNull()).distinct()
    held = names.select("company_name", F.split(text.match_key(F.col("company_name")), " ").alias("t"))
    hits = F.filter(F.array(*[F.when(records.near_name(a, F.col("t")), F.lit(a)) for a in ASKED]), lambda x: x.isNotNull())
    return held.select(F.explode(hits).alias("asked"), "company_name")


THIRD_PARTIES = ("lever.sample.invalid", "workday.sample.invalid", "ashby.sample.invalid")


@query("""
SELECT DISTINCT company_board, host FROM (SELECT company_board, regexp_replace(lower(regexp_extract(job_url, '^https?://([^/?#:]+)', 1)), '^www[.]', '') AS host FROM boards_jobs WHERE job_url IS NOT NULL) WHERE host <> ''
AND NOT (host IN ('lever.sample.invalid', 'workday.sample.invalid', 'ashby.sample.invalid') OR ends_with(host, '.lever.sample.invalid') OR ends_with(host, '.workday.sample.invalid') OR ends_with(host, '.ashby.sample.invalid'))""")
def own_hosts(spark, sf):
    """hosts of postings that belong to none of the listed third parties, by their suffixes."""
    host = web.url_host(F.col("job_url"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = table(spark, sf, "boards_jobs").select("company_board", host.alias("host")).where(F.col("host").isNotNull()).distinct()
    listed = F.array(*map(F.lit, THIRD_PARTIES))  # as many as the code names
    return hosts.where(~F.arrays_overlap(suffixes, listed))


REGIONS = {"dach": ("DE", "AT", "CH"), "iberia": ("ES", "PT"), "nordics": ("SE", "NO", "DK", "FI", "IS"), "anz": ("AU", "NZ"), "utc+1": ("DE", "AT", "CH", "FR", "ES", "IT", "SE", "NO", "DK", "PL")}


@query("""
SELECT job_id, array_to_string(country_codes, ',') AS codes FROM (SELECT DISTINCT job_id, country_codes FROM boards_jobs) WHERE coalesce(list_has_any(country_codes, ['AT', 'CH', 'DE', 'AU', 'NZ', 'FR']), false)""")
def region_filter(spark, sf):
    """Postings in regions given by name, and in a country given by its code."""
    wanted = sorted({c for asked in ("DACH", "anz", "fr") for c in records.region_codes(asked, REGIONS)})
    df = jobs(spark, sf, "job_id", "country_codes")
    within = F.coalesce(F.arrays_overlap("country_codes", F.array(*map(F.lit, wanted))), F.lit(False))
    return df.where(within).select("job_id", F.array_join("country_codes", ",").alias("codes"))


# ---------------------------------------------------------------- joins, windows, orders, scores


@query("""
WITH b AS (SELECT CASE WHEN json_type(j) = 'OBJECT' THEN j WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') AND json_type(CAST(j ->> '$' AS JSON)) = 'OBJECT' THEN CAST(j ->> '$' AS JSON) END AS o FROM (SELECT CAST(body AS JSON) AS j FROM search_airbus WHERE json_valid(body))),
r AS (SELECT unnest(CASE WHEN json_type(o, '$.results') = 'ARRAY' THEN CAST(json_extract(o, '$.results') AS JSON[]) WHEN json_type(o, '$.results') = 'OBJECT' THEN [json_extract(o, '$.results')] ELSE [] END) AS r FROM b WHERE o IS NOT NULL),
e AS (SELECT r ->> '$.siren' AS siren, r ->> '$.siege.code_postal' AS code, unnest(CASE WHEN json_type(r, '$.matching_etablissements') = 'ARRAY' THEN CAST(json_extract(r, '$.matching_etablissements') AS JSON[]) WHEN json_type(r, '$.matching_etablissements') = 'OBJECT' THEN [json_extract(r, '$.matching_etablissements')] ELSE [] END) AS e FROM r)
SELECT DISTINCT siren, e ->> '$.siret' AS siret FROM e WHERE siren IS NOT NULL AND e ->> '$.siret' IS NOT NULL AND starts_with(e ->> '$.siret', siren) AND json_type(e) = 'OBJECT'""")
def parties_of_records(spark, sf):
    """Within each record, the entries of its list that belong to the record's own id."""
    record = nested.json_object(F.col("body"))
    results = table(spark, sf, "search_airbus").select(F.explode(nested.elements(F.try_variant_get(record, "$.results", "variant"))).alias("r"))
    siren, own = nested.field("r", "siren"), nested.elements(F.try_variant_get("r", "$.matching_etablissements", "variant"))
    held = results.select(siren.alias("siren"), F.explode(own).alias("e")).select("siren", nested.field("e", "siret").alias("siret"))
    return held.where(F.col("siret").startswith(F.col("siren"))).distinct()


@query(f"""
WITH c AS (SELECT job_url AS url, min(title) AS title, min(fetched_at) AS seen FROM boards_jobs_snapshots WHERE job_url IS NOT NULL GROUP BY job_url),
n AS (SELECT * FROM c WHERE url NOT IN (SELECT job_url FROM boards_jobs_snapshots WHERE fetched_at < TIMESTAMP '2026-10-15' AND job_url IS NOT NULL)),
s AS (SELECT url, CASE WHEN regexp_matches(lower(coalesce(title, '')), '\\b(data|software|engineer)\\b') THEN 10 ELSE 4 END AS points, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen)) / 3600000000.0 AS hours FROM n)
SELECT url, round(points / (1 + greatest(hours, 0) / 24), 6) AS score FROM s ORDER BY round(points / (1 + greatest(hours, 0) / 24), 6) DESC, url LIMIT 100""")
def fresh_mentions(spark, sf):
    """Addresses not seen before a day, by points for their words that decay with age."""
    reads = table(spark, sf, "boards_jobs_snapshots").select("job_url", "title", "fetched_at").where(F.col("job_url").isNotNull())
    known = reads.where(F.col("fetched_at") < F.lit("2026-10-15").cast("timestamp_ntz")).select("job_url").distinct()
    fresh = reads.groupBy("job_url").agg(F.min("title").alias("title"), F.min("fetched_at").alias("seen")).join(known, "job_url", "left_anti")
    points = F.when(F.lower(F.coalesce("title", F.lit(""))).rlike(r"\b(data|software|engineer)\b"), 10).otherwise(4)
    hours = (F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))) / F.lit(3_600_000_000.0)
    score = F.round(points / (1 + F.greatest(hours, F.lit(0.0)) / 24), 6)
    return relevance.top_k(fresh.select(F.col("job_url").alias("url"), score.alias("score")), [F.col("score").desc(), F.col("url")], 100)


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey AS n, s_suppkey % 4 AS k FROM supplier)
SELECT s_suppkey, k <> 3 AS valid, CASE WHEN k = 3 THEN 0 ELSE k + 2 END AS lookups, CASE k WHEN 0 THEN '-all' WHEN 1 THEN '~all' WHEN 2 THEN NULL END AS last, CASE n % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'none' END AS dmarc,
 CASE WHEN (CASE WHEN k <> 3 THEN 2 ELSE 0 END) + (CASE WHEN k < 2 THEN 1 ELSE 0 END) + (CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) >= 5 THEN 'A' WHEN (CASE WHEN k <> 3 THEN 2 ELSE 0 END) + (CASE WHEN k < 2 THEN 1 ELSE 0 END) + (CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) >= 3 THEN 'B' ELSE 'C' END AS grade FROM s""")
def mail_policies(spark, sf):
    """Sender policies of hosts and what they are worth together."""
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey") % 3
    includes = F.array_join(F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: F.concat(F.lit(" include:_spf"), i.cast("string"), F.lit(".sample.invalid"))), "")
    spf = F.when(k == 3, "site-verification=x").otherwise(F.concat(F.lit("V=spf1  mx"), includes, F.when(k == 0, " ip4:192.0.2.0/24 -all").when(k == 1, " ~all").otherwise("")))
    dmarc = F.when(n == 0, "v=DMARC1; p = reject ; pct=100").when(n == 1, "v=DMARC1;p=none")
    read = table(spark, sf, "supplier").select("s_suppkey", records.spf_policy(spf).alias("s"), F.try_element_at(records.tag_list(dmarc), F.lit("p")).alias("dmarc"))
    points = F.when(F.col("s.valid"), 2).otherwise(0) + F.when(F.col("s.last").isNotNull(), 1).otherwise(0) + F.when(F.col("dmarc") == "reject", 2).when(F.col("dmarc") == "none", 1).otherwise(0)
    grade = records.graded(points, [(5, "A"), (3, "B")], "C")
    return read.select("s_suppkey", "s.valid", F.col("s.lookups").alias("lookups"), "s.last", "dmarc", grade.alias("grade"))


@query("""
WITH r AS (SELECT l_orderkey, l_partkey, CASE WHEN l_quantity <= 20 THEN 'good' WHEN l_quantity > 40 THEN 'poor' ELSE 'needs work' END AS rating, l_extendedprice * l_discount AS saving FROM lineitem),
p AS (SELECT l_orderkey, bool_and(rating = 'good') AS passed, count(*) FILTER (WHERE rating = 'poor') AS poor FROM r GROUP BY 1),
t AS (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY n) AS most FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY saving DESC, l_partkey) AS n FROM r) WHERE n <= 3 GROUP BY 1)
SELECT l_orderkey, passed, poor, most FROM p JOIN t USING (l_orderkey)""")
def audit_ratings(spark, sf):
    """Values rated by two bounds, groups that pass if all are good, and where most could be saved."""
    saving = F.col("l_extendedprice") * F.col("l_discount")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", records.rated(F.col("l_quantity"), 20, 40).alias("rating"), saving.alias("saving"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("saving").desc(), "l_partkey"))
    top = F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "l_partkey"))))  # three a group
    out = df.withColumn("n", place).groupBy("l_orderkey").agg(F.bool_and(F.col("rating") == "good").alias("passed"), F.count_if(F.col("rating") == "poor").alias("poor"), top.alias("t"))
    return out.select("l_orderkey", "passed", "poor", F.array_join(F.transform("t", lambda x: x["l_partkey"].cast("string")), ",").alias("most"))


@query("""
WITH c AS (SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n FROM boards_jobs_snapshots GROUP BY 1), s AS (SELECT day, n, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT CAST(day AS VARCHAR) AS day, n, CAST(before AS BIGINT) AS before FROM s WHERE before < (SELECT count(*) / 4 FROM boards_jobs_snapshots)""")
def newest_bands(spark, sf):
    """Days of reads, newest first, until a quarter of all reads is filled; days are counted before they are ordered."""
    days = materialize(table(spark, sf, "boards_jobs_snapshots").groupBy(F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("n")), "days")
    wanted = days.agg(F.sum("n") / 4).first()[0] or 0
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return days.withColumn("before", before).where(F.col("before") < wanted).withColumn("day", F.col("day").cast("string"))


@query("""
WITH b AS (SELECT ats, company_board, count(DISTINCT job_id) AS open_jobs, count(DISTINCT job_id) FILTER (WHERE posted_at >= TIMESTAMP '2026-10-04') AS recent, max(posted_at) AS newest FROM boards_jobs GROUP BY ALL),
r AS (SELECT *, round(recent / open_jobs, 2) AS velocity FROM b),
m AS (SELECT 'jobs' AS mode, *, row_number() OVER (ORDER BY open_jobs DESC, newest DESC NULLS LAST, ats, company_board) AS place FROM r UNION ALL SELECT 'velocity', *, row_number() OVER (ORDER BY velocity DESC, open_jobs DESC, ats, company_board) FROM r
UNION ALL SELECT 'newest', *, row_number() OVER (ORDER BY newest DESC NULLS LAST, open_jobs DESC, ats, company_board) FROM r) SELECT mode, ats, company_board, open_jobs, velocity, place FROM m WHERE place <= 20""")
def company_orders(spark, sf):
    """The first twenty boards in three orders, each total."""
    recent = F.count_distinct(F.when(F.col("posted_at") >= F.lit("2026-10-04").cast("timestamp_ntz"), F.col("job_id")))
    df = table(spark, sf, "boards_jobs").groupBy("ats", "company_board").agg(F.count_distinct("job_id").alias("open_jobs"), recent.alias("recent"), F.max("posted_at").alias("newest"))
    df = materialize(df.withColumn("velocity", F.round(F.col("recent") / F.col("open_jobs"), 2)), "boards")
    jobs_, newest, ties = F.col("open_jobs").desc(), F.col("newest").desc_nulls_last(), [F.col("ats"), F.col("company_board")]
    found = None
    for mode, order in (("jobs", [jobs_, newest, *ties]), ("velocity", [F.col("velocity").desc(), jobs_, *ties]), ("newest", [newest, jobs_, *ties])):
        top = relevance.top_k(df, order, 20).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
        part = top.select(F.lit(mode).alias("mode"), "ats", "company_board", "open_jobs", "velocity", "place")
        found = part if found is None else found.unionByName(part)
    return found


@query("""
WITH n AS (SELECT DISTINCT publication_number, lower(concat_ws(' | ', notice_title['eng'], notice_title['deu'], notice_title['fra'], notice_title['spa'])) AS t, lower(coalesce(buyer_name['eng'][1], buyer_name['deu'][1], buyer_name['fra'][1], buyer_name['spa'][1], '')) AS b FROM search_response),
s AS (SELECT publication_number, CASE WHEN regexp_matches(t, '\\b(road|roads)\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '\\b(water meter|water meters)\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(b, '\\b(road|roads)\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(b, '\\b(water|waters)\\b') THEN 1 ELSE 0 END AS score FROM n)
SELECT publication_number, score FROM s WHERE score > 0 ORDER BY score DESC, publication_number LIMIT 200""")
def notice_scores(spark, sf):
    """Notices by whole words or their plurals, three points in the title, one in the buyer's name."""
    langs = ("eng", "deu", "fra", "spa")
    title = F.lower(F.concat_ws(" | ", *[F.try_element_at("notice_title", F.lit(c)) for c in langs]))
    buyer = F.lower(F.coalesce(*[F.get(F.try_element_at("buyer_name", F.lit(c)), 0) for c in langs], F.lit("")))
    df = table(spark, sf, "search_response").select("publication_number", title.alias("t"), buyer.alias("b")).distinct()
    score = relevance.word_points(F.col("t"), ["road", "water meter"], 3) + relevance.word_points(F.col("b"), ["road", "water"], 1)
    scored = df.select("publication_number", score.alias("score")).where("score > 0")
    return relevance.top_k(scored, [F.col("score").desc(), F.col("publication_number")], 200)


@query(r"""
WITH l AS (SELECT DISTINCT company_board, link FROM (SELECT company_board, job_url AS link FROM boards_jobs UNION ALL SELECT company_board, apply_url FROM boards_jobs) WHERE link IS NOT NULL),
s AS (SELECT *, CASE WHEN contains(link, '/apply') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(link, '[0-9]{4}') THEN 2 ELSE 0 END + CASE WHEN starts_with(link, 'https://lever') THEN 1 ELSE 0 END - CASE WHEN contains(link, '?') THEN 2 ELSE 0 END AS score FROM l)
SELECT company_board, link, score FROM (SELECT *, row_number() OVER (PARTITION BY company_board ORDER BY score DESC, link) AS n FROM s WHERE score > 0) WHERE n <= 2""")
def career_links(spark, sf):
    """The two links of each board that score best by the parts of their address."""
    urls = table(spark, sf, "boards_jobs").select("company_board", F.explode(F.array("job_url", "apply_url")).alias("link")).where(F.col("link").isNotNull()).distinct()
    points = [(F.col("link").contains("/apply"), 3), (F.col("link").rlike("[0-9]{4}"), 2), (F.col("link").startswith("https://lever"), 1), (F.col("link").contains("?"), -2)]
    scored = urls.withColumn("score", relevance.additive(points)).where("score > 0")
    return relevance.capped(scored, "company_board", [F.col("score").desc(), F.col("link")], 2)


# ---------------------------------------------------------------- texts and records


@query(r"""
WITH n AS (SELECT DISTINCT title || ' (' || coalesce(department, '') || ') (' || coalesce(team, 'x y') || ')' AS name FROM boards_jobs WHERE title IS NOT NULL)
SELECT name, unnest(list_distinct(list_filter(list_concat([trim(regexp_replace(regexp_replace(name, '\([^()]*\)', ' ', 'g'), '\s+', ' ', 'g'))], list_transform(regexp_extract_all(name, '\(([^()]*)\)', 1), lambda x: trim(x))), lambda x: x <> ''))) AS variant FROM n""")
def name_variants(spark, sf):
    """Names without their parentheses, and what stands in these."""
    name = F.concat("title", F.lit(" ("), F.coalesce("department", F.lit("")), F.lit(") ("), F.coalesce("team", F.lit("x y")), F.lit(")"))
    df = table(spark, sf, "boards_jobs").where(F.col("title").isNotNull()).select(name.alias("name")).distinct()
    return df.select("name", F.explode(records.name_variants(records.repaired_name(F.col("name")))).alias("variant"))


@query("""
SELECT DISTINCT job_id, CASE WHEN department IS NULL THEN nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') ELSE nullif(trim(regexp_replace(department, '\\s+', ' ', 'g')), '') END AS page_title FROM boards_jobs WHERE title IS NOT NULL""")
def page_titles(spark, sf):
    """Titles of pages, the one for sharing first."""
    shared = F.coalesce(F.concat(F.lit("<META content='"), F.col("department"), F.lit("' property=\"og:title\" />")), F.lit("<meta name='description' content='none'>"))
    page = F.concat(F.lit("<html><head>"), shared, F.lit("<title lang='x'>\n "), F.col("title"), F.lit(" </title></head><body></body></html>"))
    return table(spark, sf, "boards_jobs").where(F.col("title").isNotNull()).select("job_id", records.page_title(page).alias("page_title")).distinct()


RISKS = ("fraud", "failed", "penalt", "outage", "timeout", "audit")


@query("SELECT doc_id, array_to_string(list_filter(['" + "', '".join(RISKS) + "'], lambda t: contains(lower(coalesce(text, '')), t)), ',') AS risks FROM documents")
def risk_terms(spark, sf):
    """Which of the listed terms occur in each document."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(records.terms_within(F.col("text"), RISKS), ",").alias("risks"))


@query("""
WITH k AS (SELECT DISTINCT l_returnflag, l_linenumber, l_quantity, l_suppkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber DESC, CAST(l_quantity AS INTEGER) DESC, l_suppkey DESC) AS n, count(*) OVER (PARTITION BY l_returnflag) AS versions FROM k)
SELECT l_returnflag, l_linenumber || '.' || CAST(l_quantity AS INTEGER) || '.' || l_suppkey AS newest, versions FROM r WHERE n = 1""")
def best_versions(spark, sf):
    """The newest of the dotted numbers of each group, by their parts and not by their letters."""
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string"))
    df = table(spark, sf, "lineitem").select("l_returnflag", version.alias("version")).distinct()
    newest = F.max(F.struct(records.version_key(F.col("version")).alias("key"), "version"))["version"]
    return df.groupBy("l_returnflag").agg(newest.alias("newest"), F.count(F.lit(1)).alias("versions"))


@query("""
WITH f AS (SELECT DISTINCT resp_id, query_text, fetched_at, CASE WHEN json_type(j) = 'OBJECT' THEN j WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') AND json_type(CAST(j ->> '$' AS JSON)) = 'OBJECT' THEN CAST(j ->> '$' AS JSON) END AS o FROM (SELECT *, CAST(body AS JSON) AS j FROM fts_response WHERE json_valid(body))),
h AS (SELECT query_text, unnest(CAST(json_extract(o, '$.hits.hits') AS JSON[])) ->> '$._id' AS hit FROM f WHERE json_type(o, '$.hits.hits') = 'ARRAY'), t AS (SELECT query_text, count(*) AS pages, arg_min(TRY_CAST(o ->> '$.took' AS BIGINT), resp_id) FILTER (TRY_CAST(o ->> '$.took' AS BIGINT) IS NOT NULL) AS took FROM f WHERE o IS NOT NULL GROUP BY ALL),
a AS (SELECT query_text, count(hit) AS hits, count(DISTINCT hit) AS different FROM h GROUP BY ALL) SELECT t.query_text, t.pages, t.took, coalesce(a.hits, 0) AS hits, coalesce(a.different, 0) AS different FROM t LEFT JOIN a ON a.query_text IS NOT DISTINCT FROM t.query_text""")
def merged_pages(spark, sf):
    """The pages of each search as one answer: lists together, single values from the first page that has them."""
    record = nested.json_object(F.col("body"))
    pages = table(spark, sf, "fts_response").select("resp_id", "query_text", "fetched_at", "body").distinct().select("resp_id", "query_text", record.alias("o")).where(F.col("o").isNotNull())
    hits = F.try_variant_get("o", "$.hits.hits", "array<variant>")
    took = F.try_variant_get("o", "$.took", "string").try_cast("long")
    pages = pages.select("resp_id", "query_text", took.alias("took"), F.transform(hits, lambda h: F.try_variant_get(h, "$._id", "string")).alias("ids"))
    single = pages.groupBy("query_text").agg(F.count(F.lit(1)).alias("pages"), F.min_by("took", F.when(F.col("took").isNotNull(), F.col("resp_id"))).alias("took"))
    lists = pages.select("query_text", F.explode("ids").alias("hit")).groupBy("query_text").agg(F.count("hit").alias("hits"), F.count_distinct("hit").alias("different"))
    joined = single.alias("s").join(lists.alias("l"), F.col("s.query_text").eqNullSafe(F.col("l.query_text")), "left")
    return joined.select("s.query_text", "pages", "took", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("different", F.lit(0)).alias("different"))


@query("""
WITH n AS (SELECT row_number() OVER () AS r, publication_number, classification_cpv FROM (SELECT DISTINCT publication_number, classification_cpv FROM search_response)),
c AS (SELECT r, unnest(range(len(classification_cpv))) AS nr, substr(regexp_replace(coalesce(unnest(classification_cpv), ''), '[^0-9]', '', 'g'), 1, 8) AS code FROM n), f AS (SELECT r, code, min(nr) AS nr FROM c WHERE length(code) >= 2 GROUP BY ALL),
g AS (SELECT r, string_agg(code, ',' ORDER BY nr) AS codes FROM f GROUP BY r) SELECT publication_number, coalesce(codes, '') AS codes FROM n LEFT JOIN g USING (r)""")
def code_lists(spark, sf):
    """Codes of notices in plain form, each once, in their order."""
    df = table(spark, sf, "search_response").select("publication_number", "classification_cpv").distinct()
    return df.select("publication_number", F.array_join(records.plain_codes(F.col("classification_cpv")), ",").alias("codes"))


@query("""
SELECT DISTINCT id, categories.department AS department, array_to_string(list_filter([categories.team, categories.location], lambda x: x IS NOT NULL), ' | ') AS groups FROM lever_postings WHERE categories IS NOT NULL""")
def header_fields(spark, sf):
    """Lines of fields as a map from lower-case names to all of their values in order."""
    c = lambda n: F.col(f"categories.{n}")
    lines = F.filter(F.array(F.concat(F.lit("X-Group:  "), c("team")), F.concat(F.lit("Department: "), c("department")), F.lit("no field"), F.concat(F.lit("x-group:"), c("location"))), lambda x: x.isNotNull())
    df = table(spark, sf, "lever_postings").where(F.col("categories").isNotNull()).select("id", records.multimap(lines).alias("m"))
    joined = F.coalesce(F.array_join(F.try_element_at("m", F.lit("x-group")), " | "), F.lit(""))
    return df.select("id", F.get(F.try_element_at("m", F.lit("department")), 0).alias("department"), joined.alias("groups")).distinct()


@query("SELECT strftime(fetched_at, '%Y-%m-%d') AS day, count(*) AS n FROM boards_jobs_snapshots WHERE fetched_at >= TIMESTAMP '2026-10-20' GROUP BY 1")
def early_stop(spark, sf):
    """Rows kept by day, of which a search since a day reads only the folders from it on."""
    path = f"{run_dir(spark)}/by-day-{abs(hash(sf))}"
    reads = table(spark, sf, "boards_jobs_snapshots").select("job_id", "fetched_at", F.to_date("fetched_at").alias("day"))
    reads.repartition("day").sortWithinPartitions(F.col("fetched_at").desc()).write.mode("overwrite").partitionBy("day").parquet(path)
    kept = spark.read.schema(reads.schema).parquet(path).where(F.col("day") >= F.lit("2026-10-20").cast("date"))
    return kept.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))

