"""Further queries of the catalogue: joins, state, text, rules, sources and indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirflow.functions import classify, dates, text, web
from weirflow.functions.geo import location_codes_udf
from weirflow.operators import aggregates, joins, relevance, resolve, rules, state, terms, units
from weirflow.plans.catalogue import _STOP, NOW, jobs, now, query, sql_company_key, sql_match_key, sql_search_text
from weirflow.session import materialize, run_dir, table
from weirflow.sources import documents as doc_sources
from weirflow.sources import index as index_sources

# ---------------------------------------------------------------- entity resolution and joins


@query("""
WITH RECURSIVE m AS (SELECT DISTINCT s_nationkey AS block, l_suppkey AS node, l_partkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
z AS (SELECT block, node, count(*) AS n FROM m GROUP BY ALL),
e AS (SELECT x.node AS a, y.node AS b FROM m x JOIN m y ON x.block = y.block AND x.item = y.item AND x.node < y.node JOIN z p ON p.node = x.node JOIN z q ON q.node = y.node GROUP BY x.node, y.node, p.n, q.n HAVING count(*) >= 140 OR count(*) >= least(p.n, q.n) * 0.28),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def cluster_boards(spark, sf):
    """Suppliers of one nation joined by the number or the share of parts they have in common, as components."""
    supplier = table(spark, sf, "supplier")
    members = table(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_suppkey", "l_partkey")
    edges = resolve.overlap_edges(members, "s_nationkey", "l_suppkey", "l_partkey", 140, 0.28)
    return resolve.connected_components(supplier.select("s_suppkey"), edges)


_NAME = "trim(regexp_replace(regexp_replace(upper(strip_accents(coalesce({}, ''))), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_NAME_STOP = ", ".join(f"'{w}'" for w in resolve.NAME_STOP)


@query(f"""
WITH n AS (SELECT p_partkey AS id, {_NAME.format('p_name')} AS nm, list_distinct(list_filter(string_split({_NAME.format('p_name')}, ' '), lambda t: t <> '' AND NOT list_contains([{_NAME_STOP}], t))) AS ts FROM part),
t AS (SELECT id, nm, len(ts) AS k, unnest(ts) AS t FROM n),
p AS (SELECT a.id AS q, b.id AS c, a.nm AS qn, b.nm AS cn, a.k AS nq, b.k AS nc, count(*) AS n FROM t a JOIN t b USING (t) WHERE a.id % 100 = 0 GROUP BY ALL)
SELECT q, c, score FROM (SELECT q, c, CASE WHEN qn = cn THEN 1.0 ELSE round(0.6 * n / least(nq, nc) + 0.4 * n / (nq + nc - n), 3) END AS score FROM p) WHERE score >= 0.7""")
def screen_names(spark, sf):
    """Every hundredth part name against all, by the tokens they share."""
    part = table(spark, sf, "part")
    queries = part.where(F.col("p_partkey") % 100 == 0).select(F.col("p_partkey").alias("q"), F.col("p_name").alias("name"))
    return resolve.screen_names(queries, part.select(F.col("p_partkey").alias("c"), F.col("p_name").alias("name")), 0.7)


@query("""
WITH r AS (SELECT CAST(ts AS DATE) AS day, event_type AS currency, avg(value) AS rate FROM events WHERE value > 0 GROUP BY ALL),
b AS (SELECT day, rate AS base FROM r WHERE currency = 'click')
SELECT CAST(day AS VARCHAR) AS day, currency, round(rate / base, 6) AS rate FROM (SELECT * FROM r WHERE currency <> 'click' UNION ALL SELECT day, 'EUR', 1.0 FROM b) JOIN b USING (day)""")
def fx_triangulate(spark, sf):
    """Rates against another base by way of the common unit."""
    rates = table(spark, sf, "events").where(F.col("value") > 0).groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("currency")).agg(F.avg("value").alias("rate"))
    return joins.cross_rates(rates, "click").withColumns({"rate": F.round("rate", 6), "day": F.col("day").cast("string")})


@query("""
WITH i AS (SELECT DISTINCT job_id AS id, company_board AS board FROM boards_jobs_snapshots), d AS (SELECT DISTINCT job_id AS id, company_board AS held_by FROM boards_jobs),
x AS (SELECT DISTINCT replace(job_id, split_part(job_id, ':', 1), 'lever') AS id, company_board AS held_by FROM boards_jobs),
h AS (SELECT id, 1 AS p, held_by FROM d UNION ALL SELECT id, 2, held_by FROM x), m AS (SELECT id, min({'p': p, 'held_by': held_by}) AS hit FROM h GROUP BY id)
SELECT i.id, i.board, CASE WHEN hit.p = 1 THEN 'in_index' WHEN hit.p = 2 THEN 'duplicate_in_index' WHEN b.board IS NOT NULL THEN 'not_on_board' ELSE 'unknown' END AS reason, hit.held_by AS held_by
FROM i LEFT JOIN m USING (id) LEFT JOIN (SELECT DISTINCT company_board AS board FROM boards_jobs WHERE company_board <> 'brelloway') b ON b.board = i.board""")
def status_check(spark, sf):
    """Ids looked up directly, then as duplicates, then by whether their board was read."""
    held = jobs(spark, sf, "job_id", "company_board")
    inputs = table(spark, sf, "boards_jobs_snapshots").select(F.col("job_id").alias("id"), F.col("company_board").alias("board")).distinct()
    direct = held.select(F.col("job_id").alias("id"), F.col("company_board").alias("held_by"))
    duplicates = held.select(F.regexp_replace("job_id", "^[^:]*", "lever").alias("id"), F.col("company_board").alias("held_by")).distinct()
    known = held.where(F.col("company_board") != "brelloway").select(F.col("company_board").alias("board"))
    return joins.status_by_key(inputs, direct, duplicates, known)


@query("""
WITH d AS (SELECT ats || CASE WHEN company_board < 'm' THEN ':eu:' ELSE ':' END || company_board AS k, max(company_name) AS company_name FROM boards_jobs GROUP BY k
  UNION ALL SELECT ats || ':' || company_board, 'plain' FROM boards_jobs WHERE company_board < 'd' GROUP BY ALL)
SELECT s.ats, count(*) AS n, count(coalesce(a.company_name, b.company_name)) AS named, count(*) FILTER (WHERE coalesce(a.company_name, b.company_name) = 'plain') AS plain FROM (SELECT DISTINCT job_id, ats, company_board FROM boards_jobs_snapshots) s
LEFT JOIN d a ON a.k = s.ats || ':eu:' || s.company_board LEFT JOIN d b ON b.k = s.ats || ':' || s.company_board GROUP BY s.ats""")
def fallback_join(spark, sf):
    """Names from the regional key, else the plain one."""
    board = F.col("company_board")
    key = F.concat("ats", F.when(board < "m", ":eu:").otherwise(":"), board)  # some boards are known by their regional key, some of these by the plain one too
    dim = table(spark, sf, "boards_jobs").groupBy(key.alias("k")).agg(F.max("company_name").alias("company_name"))
    dim = dim.unionByName(table(spark, sf, "boards_jobs").where(board < "d").select(F.concat_ws(":", "ats", board).alias("k"), F.lit("plain").alias("company_name")).distinct())
    reads = table(spark, sf, "boards_jobs_snapshots").select("job_id", "ats", "company_board").distinct()
    keys = [F.concat(F.col("ats"), F.lit(":eu:"), F.col("company_board")), F.concat(F.col("ats"), F.lit(":"), F.col("company_board"))]
    return joins.fallback_join(reads, dim, keys, "k", ["company_name"]).groupBy("ats").agg(F.count(F.lit(1)).alias("n"), F.count("company_name").alias("named"), F.count_if(F.col("company_name") == "plain").alias("plain"))


@query("""
SELECT r.r_name, l.nations, coalesce(l.n, 0) AS n FROM region r LEFT JOIN (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations, count(*) AS n FROM nation GROUP BY n_regionkey) l ON l.n_regionkey = r.r_regionkey""")
def alias_lists(spark, sf):
    """Names with the list of those that belong to them."""
    lists = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"), F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select("r_name", "nations", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH d AS (SELECT job_id, max(department) AS department, max(team) AS team, max(fetched_at) < TIMESTAMP '2026-11-02 00:00:00' AS gone FROM boards_jobs_snapshots GROUP BY job_id)
SELECT j.job_id, coalesce(j.department, d.department) AS department, coalesce(j.team, d.team) AS team FROM (SELECT DISTINCT job_id, department, team FROM boards_jobs) j LEFT JOIN d USING (job_id) WHERE NOT coalesce(d.gone, false)""")
def fill_missing(spark, sf):
    """Nulls filled from details, records that are gone dropped; stated values win."""
    gone = F.max("fetched_at") < F.lit("2026-11-02 00:00:00").cast("timestamp_ntz")
    details = table(spark, sf, "boards_jobs_snapshots").groupBy("job_id").agg(F.max("department").alias("department"), F.max("team").alias("team"), gone.alias("gone"))
    return joins.fill_missing(jobs(spark, sf, "job_id", "department", "team"), details, "job_id", "gone")


@query("""
WITH t AS (SELECT job_id, posted_at FROM (SELECT DISTINCT job_id, posted_at FROM boards_jobs) ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 30), w AS (SELECT job_id, max(description_text) AS description_text FROM boards_jobs GROUP BY job_id)
SELECT job_id, posted_at, length(description_text) AS chars FROM t JOIN w USING (job_id)""")
def late_text(spark, sf):
    """Texts joined back for the few rows chosen without them."""
    top = relevance.top_k(jobs(spark, sf, "job_id", "posted_at"), relevance.newest_order(), 30)
    wide = table(spark, sf, "boards_jobs").groupBy("job_id").agg(F.max("description_text").alias("description_text"))
    return joins.late_text(top, wide, "job_id", ["description_text"]).select("job_id", "posted_at", F.length("description_text").alias("chars"))


@query("""
WITH RECURSIVE l AS (SELECT p_partkey AS src, CAST(p_size AS BIGINT) AS dst FROM part WHERE p_partkey <> p_size),
c(start, goal, hops) AS (SELECT src, dst, 1 FROM l UNION ALL SELECT c.start, l.dst, c.hops + 1 FROM c JOIN l ON l.src = c.goal WHERE c.hops < 5)
SELECT start, max_by(goal, hops) AS goal, max(hops) AS hops FROM c GROUP BY start""")
def redirect_chain(spark, sf):
    """Chains of at most five links."""
    links = table(spark, sf, "part").where(F.col("p_partkey") != F.col("p_size")).select(F.col("p_partkey").alias("src"), F.col("p_size").cast("long").alias("dst"))
    return joins.follow_chain(links)


# ---------------------------------------------------------------- state


@query("""
WITH k AS (SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND event_id % 2 = 0)
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15' AND event_id NOT IN (SELECT event_id FROM k)""")
def since_watermark(spark, sf):
    """What a complete run before has not delivered, its last day read again."""
    rows = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    known = rows.where((F.col("day") == F.lit("2024-01-15").cast("date")) & (F.col("event_id") % 2 == 0))
    return state.undelivered(rows, known, "event_id", "day", "2024-01-15").withColumn("day", F.col("day").cast("string"))


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events), s AS (SELECT DISTINCT user_id FROM e WHERE ts < TIMESTAMP '2024-01-03')
SELECT count(*) AS users, min(user_id) AS first_user, max(user_id) AS last_user FROM (SELECT DISTINCT user_id FROM e WHERE ts >= TIMESTAMP '2024-01-03' AND user_id NOT IN (SELECT user_id FROM s))""")
def seen_set_anti(spark, sf):
    """Keys never seen before, whatever their date, each once."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user"), "ts", "user_id")
    cut = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    seen = rows.where(F.col("ts") < cut).select(state.key_hash(F.col("user")).alias("h"), F.lit(1).alias("last_day")).distinct()
    fresh = state.unseen(rows.where(F.col("ts") >= cut), seen, "user")
    return fresh.agg(F.count(F.lit(1)).alias("users"), F.min("user_id").alias("first_user"), F.max("user_id").alias("last_user"))


@query("""
WITH u AS (SELECT user_id, max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS d FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id),
n AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-28'), m AS (SELECT coalesce(n.user_id, u.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN 27 ELSE d END AS last_day FROM u FULL JOIN n USING (user_id))
SELECT last_day, count(*) AS users FROM m WHERE last_day >= 13 GROUP BY last_day""")
def seen_set_merge(spark, sf):
    """The set of seen keys after a complete run, without those unseen for more than fourteen days."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d"))
    seen = rows.where("d < 19").groupBy(state.key_hash(F.col("user")).alias("h")).agg(F.max("d").alias("last_day"))
    after = state.next_seen(rows.where("d = 27"), seen, "user", 27)
    return after.groupBy("last_day").agg(F.count(F.lit(1)).alias("users"))


@query("""
WITH f AS (SELECT company_board, job_id, fetched_at FROM boards_jobs_snapshots WHERE fetched_at >= TIMESTAMP '2026-11-02 22:00:00' AND ats <> 'workday'), p AS (SELECT company_board, job_id, fetched_at FROM boards_jobs_snapshots WHERE fetched_at < TIMESTAMP '2026-10-28' AND fetched_at >= TIMESTAMP '2026-10-26 22:00:00')
SELECT company_board, count(*) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM p WHERE company_board NOT IN (SELECT company_board FROM f)) GROUP BY company_board""")
def carried_boards(spark, sf):
    """Boards read anew, and those of the run before that weren't."""
    reads = table(spark, sf, "boards_jobs_snapshots").select("company_board", "job_id", "fetched_at", "ats")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    fresh = reads.where((F.col("fetched_at") >= at("2026-11-02 22:00:00")) & (F.col("ats") != "workday")).drop("ats")
    previous = reads.where(F.col("fetched_at") < at("2026-10-28 00:00:00")).drop("ats")
    kept = state.carried(fresh, previous, "company_board", "fetched_at", at("2026-10-26 22:00:00"))
    return kept.groupBy("company_board").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT DISTINCT job_id FROM boards_jobs_snapshots WHERE fetched_at BETWEEN TIMESTAMP '2026-10-26 22:40:00' AND TIMESTAMP '2026-10-27 03:50:00'), b AS (SELECT DISTINCT job_id FROM boards_jobs_snapshots WHERE fetched_at BETWEEN TIMESTAMP '2026-11-02 22:43:00' AND TIMESTAMP '2026-11-03 03:53:00')
SELECT 'lost' AS part, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'kept', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def set_differences(spark, sf):
    """Differences and intersection of two reads."""
    reads = table(spark, sf, "boards_jobs_snapshots")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    a = reads.where(F.col("fetched_at").between(at("2026-10-26 22:40:00"), at("2026-10-27 03:50:00"))).select("job_id")
    b = reads.where(F.col("fetched_at").between(at("2026-11-02 22:43:00"), at("2026-11-03 03:53:00"))).select("job_id")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(a.exceptAll(b).distinct().join(b, "job_id", "left_anti"), "lost").unionByName(count(b.subtract(a), "new")).unionByName(count(a.intersect(b), "kept"))


@query("""
WITH r AS (SELECT query_text, resp_id, row_number() OVER (PARTITION BY lower(trim(query_text)) ORDER BY resp_id, fetched_at) AS rn FROM fts_response WHERE query_text IS NOT NULL)
SELECT lower(trim(query_text)) AS query_key, resp_id FROM r WHERE rn = 1""")
def inputs_in_order(spark, sf):
    """Distinct inputs, each at its first place."""
    order = Window.partitionBy(F.lower(F.trim("query_text"))).orderBy("resp_id", "fetched_at")
    df = table(spark, sf, "fts_response").where(F.col("query_text").isNotNull()).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return df.select(F.lower(F.trim("query_text")).alias("query_key"), "resp_id")


# ---------------------------------------------------------------- text, dates, urls


@query(f"SELECT DISTINCT company_name, {sql_search_text('company_name')} AS search_key, {sql_company_key('company_name')} AS company_key, {sql_match_key('company_name')} AS match_key FROM boards_jobs")
def company_keys(spark, sf):
    """Keys of company names."""
    name = F.col("company_name")
    return table(spark, sf, "boards_jobs").select("company_name", text.search_text(name).alias("search_key"), text.company_key(name).alias("company_key"), text.match_key(name).alias("match_key")).distinct()


@query(r"""
WITH n AS (SELECT DISTINCT publication_number, coalesce(notice_title['eng'], notice_title['deu'], notice_title['fra']) AS title FROM search_response)
SELECT publication_number, substr(trim(regexp_replace(lower(list_extract(string_split(coalesce(title, ''), ' – '), -1)), '[^\p{L}\p{N}]+', ' ', 'g')), 1, 80) AS core FROM n""")
def title_cores(spark, sf):
    """T5: the original part of notice titles."""
    title = F.coalesce(*[F.try_element_at("notice_title", F.lit(c)) for c in ("eng", "deu", "fra")])
    return table(spark, sf, "search_response").select("publication_number", text.title_core(title).alias("core")).distinct()


# The twin cuts at each `<` and reads every piece by the name of its tag, where the operator replaces by expressions.
_BLOCK_SQL = ", ".join(f"'{x}'" for x in "br address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table tr ul".split())
_REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&bull;": "•", "&ndash;": "–", "&mdash;": "—", "&euro;": "€", "&pound;": "£", "&eacute;": "é", "&amp;": "&"}


def _references_sql(x: str) -> str:
    for name, char in _REFERENCES.items():
        x = "replace({}, '{}', '{}')".format(x, name, char.replace("'", "''"))
    return x


_READ_SQL = f"""
d AS (SELECT DISTINCT id, CASE WHEN contains(description, '&lt;') AND NOT regexp_matches(description, '<[/A-Za-z!]') THEN {_references_sql('description')} ELSE description END AS h FROM pinpoint_postings),
c AS (SELECT id, string_split(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script.*?</script *>|<style.*?</style *>|<noscript.*?</noscript *>', ' ', 'g'), '<') AS a FROM d WHERE h IS NOT NULL),
e AS (SELECT id, a[1] || array_to_string(list_transform(a[2:], lambda x: CASE WHEN NOT regexp_matches(x, '^[/A-Za-z!]') OR NOT contains(x, '>') THEN '<' || x
  WHEN lower(regexp_extract(x, '^/?([A-Za-z0-9]*)', 1)) IN ({_BLOCK_SQL}) THEN chr(10) WHEN lower(regexp_extract(x, '^([A-Za-z0-9]*)', 1)) = 'li' THEN chr(10) || '• ' ELSE '' END
  || CASE WHEN regexp_matches(x, '^[/A-Za-z!]') AND contains(x, '>') THEN substr(x, instr(x, '>') + 1) ELSE '' END), '') AS t FROM c),
g AS (SELECT id, array_to_string(list_transform(string_split({_references_sql('t')}, chr(10)), lambda x: trim(regexp_replace(replace(x, chr(160), ' '), '[ \\t\\f\\r]+', ' ', 'g'))), chr(10)) AS t FROM e),
r AS (SELECT id, nullif(trim(regexp_replace(t, '\\n\\n\\n+', chr(10) || chr(10), 'g'), chr(10) || ' '), '') AS t FROM g)"""


@query(f"WITH {_READ_SQL} SELECT d.id, length(r.t) AS chars, md5(r.t) AS digest FROM d LEFT JOIN r USING (id)")
def html_to_text(spark, sf):
    """Readable text of HTML descriptions."""
    plain = text.html_to_text(F.col("description"))
    df = table(spark, sf, "pinpoint_postings").select("id", plain.alias("t")).distinct()
    return df.select("id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


# The twin masks addresses word by word and takes numbers by their digits, all in one list of words.
@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') || ' Write to jobs.' || lower(coalesce(lang, 'xx')) || '@mail.sample.invalid, hr [at] mail [dot] invalid or call +49 30 1234 5678, (212) 555-0147 or Tel. 030 4455667. Contact: Ana Lopez today' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[A-Za-z0-9_.+-]+@([A-Za-z0-9_-]+[.])+[A-Za-z][A-Za-z]+', '[email redacted]', 'g'), 'hr \[at\] mail \[dot\] invalid', '[email redacted]', 'g') AS t FROM d),
b AS (SELECT doc_id, regexp_replace(t, '[+]\d([ ./()-]?[ ./()-]?\d){7,14}', '[phone redacted]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([(]\d\d\d[)] ?|\b\d\d\d[-. ])\d\d\d[-. ]\d\d\d\d\b', '[phone redacted]', 'g'), 'Tel[.] 030 4455667', 'Tel. [phone redacted]', 'g') AS t FROM b)
SELECT doc_id, length(r) AS chars, md5(r) AS digest FROM (SELECT doc_id, replace(t, 'Contact: Ana Lopez', 'Contact: [name redacted]') AS r FROM c)""")
def redact_contacts(spark, sf):
    """Addresses, phone numbers and labelled names masked."""
    said = "@mail.sample.invalid, hr [at] mail [dot] invalid or call +49 30 1234 5678, (212) 555-0147 or Tel. 030 4455667. Contact: Ana Lopez today"
    tail = F.concat(F.lit(" Write to jobs."), F.lower(F.coalesce("lang", F.lit("xx"))), F.lit(said))
    masked = text.redact_contacts(F.concat(F.coalesce("text", F.lit("")), tail))
    return table(spark, sf, "documents").select("doc_id", masked.alias("r")).select("doc_id", F.length("r").alias("chars"), F.md5(F.col("r").cast("binary")).alias("digest"))


@query(r"""
WITH c AS (SELECT job_id, nullif(trim(regexp_replace(description_text, '\s+', ' ', 'g')), '') AS t FROM (SELECT DISTINCT job_id, description_text FROM boards_jobs))
SELECT job_id, CASE WHEN length(t) <= 300 THEN t WHEN 299 - instr(reverse(substr(t, 1, 299)), ' ') > 240 AND instr(reverse(substr(t, 1, 299)), ' ') > 0 THEN substr(t, 1, 299 - instr(reverse(substr(t, 1, 299)), ' ')) || '…' ELSE substr(t, 1, 299) || '…' END AS snippet FROM c""")
def snippets(spark, sf):
    """Beginnings of texts, cut at a word."""
    return jobs(spark, sf, "job_id", "description_text").select("job_id", text.snippet(F.col("description_text")).alias("snippet"))


@query(f"""
WITH j AS (SELECT DISTINCT job_id, company_board, title, department, team, description_text FROM boards_jobs), d AS (SELECT row_number() OVER () AS r, job_id, company_board, string_split({sql_search_text('title')}, ' ') AS t, string_split({sql_search_text("concat_ws(' ', department, team, description_text)")}, ' ') AS a FROM j),
w AS (SELECT r, word, min(nr) AS nr FROM (SELECT r, unnest(a) AS word, unnest(range(len(a))) AS nr, t FROM d) WHERE length(word) > 1 AND NOT list_contains(t, word) AND word NOT IN ({_STOP}) GROUP BY ALL),
h AS (SELECT company_board, word FROM (SELECT DISTINCT d.company_board, d.job_id, w.word FROM w JOIN d USING (r)) JOIN (SELECT company_board, count(DISTINCT job_id) AS n FROM boards_jobs GROUP BY 1) USING (company_board) GROUP BY company_board, word, n HAVING n >= 3 AND count(*) >= n * 0.6),
o AS (SELECT w.* FROM w JOIN d USING (r) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.company_board = d.company_board AND h.word = w.word)), c AS (SELECT r, word, nr, sum(length(word) + 1) OVER (PARTITION BY r ORDER BY nr) - 1 AS used FROM o),
k AS (SELECT r, count(*) AS words, coalesce(string_agg(word, ' ' ORDER BY nr) FILTER (used <= 500), '') AS kw FROM c GROUP BY r)
SELECT d.job_id, CAST(coalesce(k.words, 0) AS INTEGER) AS words, coalesce(k.kw, '') AS kw FROM d LEFT JOIN k USING (r)""")
def keyword_fields(spark, sf):
    """Words of a posting beyond its title and beyond those that its board's postings share, within a budget of characters."""
    tokens = text.keyword_tokens(F.col("title"), [F.col("department"), F.col("team"), F.col("description_text")])
    df = jobs(spark, sf, "job_id", "company_board", "title", "department", "team", "description_text")
    held = materialize(df.select("job_id", "company_board", tokens.alias("tokens")), "tokens")
    shared = aggregates.shared_terms(held, "company_board", "job_id", F.col("tokens"))
    # A term of six tenths of a board's postings: at most their mean number of terms / 0.6 a board.
    by_board = shared.groupBy("company_board").agg(F.collect_set("term").alias("shared"))
    own = F.array_except("tokens", F.coalesce("shared", F.array().cast("array<string>")))
    kept = held.join(by_board, "company_board", "left").select("job_id", own.alias("own"))
    return kept.select("job_id", F.size("own").alias("words"), text.budget_join(F.col("own"), 500).alias("kw"))


@query(f"""
SELECT band, count(*) AS n, min(posted_at) AS first_at, max(posted_at) AS last_at FROM (SELECT posted_at, CASE WHEN posted_at IS NULL THEN 8 ELSE
 CASE {' '.join(f"WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at)) / 86400000000.0 >= {low} THEN {n}" for n, low in reversed(list(enumerate(dates.BAND_DAYS))[1:]))} ELSE 0 END END AS band FROM boards_jobs) GROUP BY band""")
def age_band_rollup(spark, sf):
    """Postings by band of age; undated ones in the last, future ones in the first."""
    df = table(spark, sf, "boards_jobs").select("posted_at", dates.age_band(F.col("posted_at"), now()).alias("band"))
    return df.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("posted_at").alias("first_at"), F.max("posted_at").alias("last_at"))


@query(f"""
SELECT DISTINCT job_id, CAST(CAST(posted_at AS DATE) AS VARCHAR) AS day FROM boards_jobs WHERE posted_at IS NOT NULL AND posted_at <= TIMESTAMP '{NOW}'""")
def relative_days(spark, sf):
    """Days read from texts such as `Posted 12 Days Ago`."""
    df = jobs(spark, sf, "job_id", "posted_at").where(F.col("posted_at").isNotNull() & (F.col("posted_at") <= now()))
    days = F.date_diff(F.to_date(now()), F.to_date("posted_at"))
    said = F.when(days == 0, "Posted Today").when(days == 1, "Posted Yesterday").otherwise(F.concat(F.lit("Posted "), days.cast("string"), F.lit(" Days Ago")))
    return df.select("job_id", dates.relative_day(said, now()).cast("string").alias("day")).distinct()


@query("""
WITH c AS (SELECT unnest(generate_series(TIMESTAMP '2026-10-01', TIMESTAMP '2026-11-05', INTERVAL 1 DAY)) AS d), r AS (SELECT DISTINCT CAST(fetched_at AS DATE) AS day FROM boards_jobs_snapshots)
SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM c WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT day FROM r)""")
def planned_days(spark, sf):
    """Working days of a calendar on which nothing was read."""
    span = spark.range(1).select(F.explode(F.sequence(F.lit("2026-10-01").cast("date"), F.lit("2026-11-05").cast("date"))).alias("day"))
    read = table(spark, sf, "boards_jobs_snapshots").select(F.to_date("fetched_at").alias("day")).distinct()
    return span.where(F.weekday("day") < 5).join(read, "day", "left_anti").select(F.col("day").cast("string").alias("day"))


@query("""
WITH h AS (SELECT date_trunc('day', ts) AS w, count(*) AS n FROM events GROUP BY 1), f AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE date_trunc('day', ts) IN (SELECT w FROM h WHERE n > 320) GROUP BY 1)
SELECT w AS start, n, 'day' AS width FROM h WHERE n <= 320 UNION ALL SELECT start, n, 'hour' FROM f""")
def split_windows(spark, sf):
    """Windows that hold more than a cap are split into finer ones, from days to hours, minutes and seconds at the least."""
    at = lambda width: F.date_trunc(width, "second").cast("timestamp_ntz")
    n = table(spark, sf, "events").groupBy(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    held = lambda width: F.sum("n").over(Window.partitionBy(at(width))) <= 320
    width = F.when(held("day"), "day").when(held("hour"), "hour").when(held("minute"), "minute").otherwise("second")
    start = F.when(F.col("width") == "day", at("day")).when(F.col("width") == "hour", at("hour")).when(F.col("width") == "minute", at("minute")).otherwise(F.col("second"))
    return n.withColumn("width", width).groupBy(start.alias("start"), "width").agg(F.sum("n").alias("n")).select("start", "n", "width")


@query(r"""
SELECT DISTINCT job_url, regexp_replace(lower(regexp_extract(trim(job_url), '^https?://([^/?#:@\s]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(trim(job_url), '^[^:]+://[^/?#]+(/[^?#]*)?', 1), '/+$', '') AS url_key,
 regexp_extract(job_url, '^https?://([a-z]+)\.', 1) AS platform, regexp_extract(job_url, '^https?://[^/]+/([^/?#]+)', 1) AS token, regexp_extract(job_url, '/([^/?#]+)$', 1) AS posting, 'sample.invalid' AS site
FROM boards_jobs WHERE job_url IS NOT NULL""")
def url_parts(spark, sf):
    """L1 to L4: keys and parts of posting URLs."""
    url = F.col("job_url")
    return table(spark, sf, "boards_jobs").where(url.isNotNull()).select(
        "job_url", web.url_key(url).alias("url_key"), F.regexp_extract(url, r"^https?://([a-z]+)\.", 1).alias("platform"), F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)", 1).alias("token"),
        F.regexp_extract(url, r"/([^/?#]+)$", 1).alias("posting"), web.site_of(web.url_host(url)).alias("site"),
    ).distinct()


@query("""
SELECT company_board, count(*) AS links, count(DISTINCT link) AS targets FROM (SELECT company_board, job_url AS link FROM (SELECT DISTINCT company_board, job_url, apply_url FROM boards_jobs) WHERE job_url IS NOT NULL
UNION ALL SELECT company_board, apply_url FROM (SELECT DISTINCT company_board, job_url, apply_url FROM boards_jobs) WHERE apply_url IS NOT NULL) GROUP BY company_board""")
def extract_links(spark, sf):
    """Links of pages, comments left out, resolved against the page."""
    anchors = lambda c: F.coalesce(F.concat(F.lit('<a class="x" href="'), F.col(c), F.lit('">go</a>')), F.lit(""))
    page = F.concat(F.lit("<html><!-- <a href='https://no.sample.invalid/'>x</a> -->"), anchors("job_url"), anchors("apply_url"), F.lit('<a href="mailto:x@y.invalid">m</a></html>'))
    df = jobs(spark, sf, "company_board", "job_url", "apply_url").select("company_board", F.explode(web.html_links(page)).alias("link"))
    whole = df.withColumn("link", web.resolve_url(F.lit("https://base.sample.invalid/"), F.col("link"))).where(F.col("link").isNotNull())
    return whole.groupBy("company_board").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("link").alias("targets"))


@query("SELECT DISTINCT company_board, job_url AS loc, CAST(CAST(fetched_at AS DATE) AS VARCHAR) AS lastmod FROM boards_jobs WHERE job_url IS NOT NULL")
def sitemap_flatten(spark, sf):
    """Entries of sitemaps."""
    entry = F.concat(F.lit("<url>\n <loc> "), F.col("job_url"), F.lit(" </loc><lastmod>"), F.to_date("fetched_at").cast("string"), F.lit("</lastmod></url>"))
    maps = table(spark, sf, "boards_jobs").where(F.col("job_url").isNotNull()).groupBy("company_board").agg(F.concat_ws("", F.lit("<urlset>"), F.concat_ws("", F.collect_set(entry)), F.lit("</urlset>")).alias("xml"))
    return maps.select("company_board", F.explode(web.sitemap_entries(F.col("xml"))).alias("e")).select("company_board", "e.loc", "e.lastmod")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def xml_and_csv_records(spark, sf):
    """Records read from XML with prefixes and from quoted CSV, joined on their id."""
    nation = table(spark, sf, "nation")
    xml = F.concat(F.lit("<x:row><x:id>"), F.col("n_nationkey").cast("string"), F.lit("</x:id><x:name>"), F.col("n_name"), F.lit("</x:name></x:row>"))
    csv = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit(', ""quoted""",'), F.col("n_regionkey").cast("string"))
    a = doc_sources.parse_xml(nation.select(xml.alias("doc")), "doc", "id INT, name STRING")
    b = doc_sources.parse_csv_lines(nation.select(csv.alias("line")), "line", "key INT, label STRING, region INT")
    return a.join(b, a.id == b.key).where(F.col("label").endswith('"quoted"')).select("id", "name", "region")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_projection(spark, sf):
    """Flat rows of JSON payloads; rows without the key are dropped."""
    df = table(spark, sf, "events").select("event_id", "props")
    return doc_sources.project_json(df, "props", "k BIGINT", {"k": "k"}, required=["k"])


@query("""
WITH s AS (SELECT DISTINCT json_extract_string(r, '$.siren') AS siren FROM (SELECT unnest(CAST(json_extract(body, '$.results') AS JSON[])) AS r FROM search_airbus WHERE json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.results') = 'ARRAY')),
d AS (SELECT siren, list_sum(list_transform(generate_series(1, 9), lambda i: CASE WHEN i % 2 = 0 THEN (2 * CAST(siren[i] AS INT)) // 10 + (2 * CAST(siren[i] AS INT)) % 10 ELSE CAST(siren[i] AS INT) END)) AS t FROM s WHERE regexp_full_match(siren, '[0-9]{9}'))
SELECT siren, t % 10 = 0 AS valid FROM d""")
def luhn_checks(spark, sf):
    """check digits of company numbers, also of those in wrapped bodies and single results."""
    from weirflow.operators import nested

    record = nested.json_object(F.col("body"))
    bodies = table(spark, sf, "search_airbus").select(F.try_variant_get(record, "$.results", "variant").alias("rs"))
    siren = nested.field("r", "siren")
    df = bodies.select(F.explode(nested.elements(F.col("rs"))).alias("r")).select(siren.alias("siren")).where(F.col("siren").rlike("^[0-9]{9}$")).distinct()
    return df.select("siren", web.luhn_valid(F.col("siren")).alias("valid"))


@query()
def country_codes(spark, sf):
    """Country codes named in locations."""
    df = jobs(spark, sf, "job_id", F.to_json("locations").alias("places"))
    named = units.parsed_once(df, "places", lambda c: location_codes_udf(F.from_json(c, "array<string>")), "codes")
    return named.select("job_id", F.coalesce(F.array_join("codes", ","), F.lit("")).alias("codes"))


@query(r"""
WITH d AS (SELECT DISTINCT id, descriptionplain FROM lever_postings), l AS (SELECT id, unnest(range(len(a))) AS nr, unnest(a) AS line FROM (SELECT id, string_split(replace(replace(coalesce(descriptionplain, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM d)),
h AS (SELECT *, regexp_matches(line, '^[^\p{L}\d_]*\p{L}[\p{L} /&''’-]{2,40}:?\s*$') AS heading, regexp_matches(line, '(?i)nice to have|preferred|bonus|optional|desirable|wünschenswert|von vorteil|atouts?\b|deseable') AS wish FROM l),
s AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN wish END IGNORE NULLS) OVER (PARTITION BY id ORDER BY nr), false) AS wished,
  regexp_extract(line, '(?i)(?:^|[^\w.])(up to |at most |maximum |under |less than |bis zu |jusqu.à |hasta )?([0-9]{1,2}|one|two|three|four|five|six|seven|eight|nine|ten) ?(?:\+|plus)? ?(?:(?:-|–|to|bis|à) ?[0-9]{1,2} ?\+? ?)?(?:years?|yrs?|jahren?|ans|années|años)\b', ['most', 'n']) AS m FROM h),
n AS (SELECT id, nr, coalesce(TRY_CAST(m.n AS INTEGER), nullif(list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], lower(m.n)), 0)) AS years FROM s WHERE m.most = '' AND NOT wished AND NOT wish
  AND regexp_matches(line, '(?i)experien|expérien|erfahrung|background|worked|working|track record|expertise|practice')
  AND NOT regexp_matches(line, '(?i)years? old|ago\b|founded|our company|our history|we have|warranty|for over [0-9]+ years|since [0-9]{4}')),
y AS (SELECT id, arg_min(years, nr) AS years_min FROM n WHERE years BETWEEN 1 AND 20 GROUP BY id),
v AS (SELECT id, bool_or(regexp_matches(x, '(?i)\b(no|not|never|cannot|unable|without|kein|keine|ohne|pas|aucune?|sin)\b|n[''’]t\b')) AS denied,
  bool_or(regexp_matches(x, '(?i)\b(available|offer\w*|provid\w*|support\w*|sponsor(s|ed)?|help\w*|assist\w*|cover\w*)\b') AND NOT regexp_matches(x, '(?i)\b(may|might|could|possibl[ey]|case[ -]by[ -]case|depend\w*|limited|subject to|consider\w*)\b')) AS offered
  FROM (SELECT id, unnest(regexp_split_to_array(coalesce(descriptionplain, ''), '[.!?;\r\n]+')) AS x FROM d) WHERE regexp_matches(x, '(?i)\bvisas?\b|\bsponsor|work permit|\bh-?1b\b|\bvisum\b|parrainage') GROUP BY id)
SELECT d.id, y.years_min, CASE WHEN v.denied THEN false WHEN v.offered THEN true END AS visa FROM d LEFT JOIN y USING (id) LEFT JOIN v USING (id)""")
def enrich_postings(spark, sf):
    """Years asked for and sponsorship offered, read from texts."""
    df = table(spark, sf, "lever_postings").select("id", "descriptionplain").distinct()
    return df.select("id", classify.years_asked(F.col("descriptionplain")).alias("years_min"), classify.visa_offered(F.col("descriptionplain")).alias("visa"))


# ---------------------------------------------------------------- rules

# A dictionary of the tests' own: languages, stores, tools and standards; a line is name, aliases and marks (= exact case, ~ weak), then what it implies after >.
_DICTIONARY = """
python; scala > jvm; java > jvm; kotlin > jvm; groovy > jvm; clojure > jvm; rust = ; go, golang = ~ ; c++; c#, csharp > dotnet; f# > dotnet; dotnet, .net; php; ruby; perl = ; swift = ; matlab; julia = ~ ; haskell; erlang; elixir = ~ ; typescript > javascript
javascript; node.js, nodejs > javascript; react, react.js > javascript; angular > javascript; vue.js, vue > javascript; svelte > javascript; next.js > react; jquery > javascript; html, html5; css, css3; sass = ; webpack; vite = ~
django > python; flask = > python; fastapi > python; pandas > python; numpy > python; pytorch > python; tensorflow; scikit-learn, sklearn > python; airflow > python; dbt; jupyter; spark, apache spark = > jvm; kafka, apache kafka = > jvm; flink = > jvm; hadoop > jvm; hive = ~ > sql; trino > sql
spring boot > spring; spring = ~ > java; hibernate > java; quarkus > java; rails, ruby on rails > ruby; laravel > php; symfony > php; sql; postgresql, postgres > sql; mysql > sql; mariadb > sql; oracle database > sql; sql server, mssql > sql; sqlite > sql; snowflake = ~ > sql; bigquery > sql
redshift > sql; clickhouse > sql; duckdb > sql; mongodb; cassandra; redis; elasticsearch; opensearch; neo4j; dynamodb > aws; aws, amazon web services; azure; gcp, google cloud; docker; kubernetes, k8s > docker; helm = ~ ; terraform; ansible; puppet = ~ ; jenkins; gitlab > git; github > git; git = ; grafana
prometheus; datadog; splunk; linux; bash; powershell; graphql; grpc; rabbitmq; nginx; tableau; power bi; looker; excel, microsoft excel = ; sap = ; salesforce; jira; confluence; figma = ; photoshop; autocad; cad software, cad; solidworks; selenium; cypress = ~ ; playwright; unity = ~ ; opencv
"""
_SPELLED = {"python": "Python", "rust": "Rust", "go": "Go", "golang": "Golang", "perl": "Perl", "swift": "Swift", "julia": "Julia", "elixir": "Elixir", "sass": "Sass", "vite": "Vite", "flask": "Flask", "spark": "Spark", "apache spark": "Apache Spark", "kafka": "Kafka", "apache kafka": "Apache Kafka", "flink": "Flink", "hive": "Hive", "spring": "Spring", "snowflake": "Snowflake", "helm": "Helm", "puppet": "Puppet", "git": "Git", "excel": "Excel", "microsoft excel": "Microsoft Excel", "sap": "SAP", "figma": "Figma", "cypress": "Cypress", "unity": "Unity"}


def _dictionary() -> list[terms.Term]:
    found = []
    for entry in _DICTIONARY.replace("\n", ";").split(";"):
        names, _, implied = entry.partition(">")
        exact, weak = "=" in names, "~" in names
        aliases = [x.strip() for x in names.replace("=", "").replace("~", "").split(",") if x.strip()]
        if aliases:
            spelled = tuple(_SPELLED.get(x, x) if exact else x for x in aliases)
            excludes = ("go",) if aliases[0] == "excel" else ()
            found.append(terms.Term(aliases[0], spelled, exact, weak, tuple(x.strip() for x in implied.split(",") if x.strip()), excludes))
    return found


TERMS = _dictionary()


def _tech_sql() -> str:
    quoted = lambda x: "".join(f"[{c}]" if c in ".+#" else c for c in x)
    rows = ", ".join(
        "('{}', '(^|[^\\p{{L}}\\p{{N}}_#+.@]){}({})($|[^\\p{{L}}\\p{{N}}_#+.]|[.]($|[^\\p{{L}}\\p{{N}}]))', {})".format(t.name, "" if t.exact else "(?i)", "|".join(map(quoted, t.aliases)), str(t.weak).lower()) for t in TERMS
    )
    implied = ", ".join(f"('{a}', '{b}')" for a, bs in sorted(rules.closure({t.name: set(t.implies) for t in TERMS}).items()) for b in sorted(bs))
    return f"""
j AS (SELECT DISTINCT job_id, description_text FROM boards_jobs), p AS (SELECT * FROM (VALUES {rows}) t(name, pattern, weak)),
h AS (SELECT DISTINCT j.job_id, j.description_text, p.name, p.weak FROM j JOIN p ON regexp_matches(j.description_text, p.pattern)),
d AS (SELECT DISTINCT job_id, name FROM h WHERE (job_id, description_text) IN (SELECT (job_id, description_text) FROM h WHERE NOT weak)),
k AS (SELECT * FROM d WHERE NOT (name = 'go' AND job_id IN (SELECT job_id FROM d WHERE name = 'excel'))),
i AS (SELECT * FROM (VALUES {implied}) t(name, other)), f AS (SELECT job_id, name, bool_and(implied) AS implied FROM (SELECT *, false AS implied FROM k UNION ALL SELECT job_id, other, true FROM k JOIN i USING (name)) GROUP BY ALL)"""


def _tech(spark, sf):
    found = terms.detect_terms(table(spark, sf, "boards_jobs"), F.col("job_id"), F.col("description_text"), TERMS)
    return found.withColumnRenamed("key", "job_id")


@query(f"WITH {_tech_sql()} SELECT job_id, name, implied FROM f")
def tech_mentions(spark, sf):
    """Technologies named in postings, with what they imply and exclude."""
    return _tech(spark, sf).select("job_id", "name", "implied")


@query(f"""
WITH {_tech_sql()}, b AS (SELECT DISTINCT job_id, company_board FROM boards_jobs), n AS (SELECT company_board, count(DISTINCT job_id) AS open_jobs FROM b GROUP BY ALL),
c AS (SELECT company_board, name, count(DISTINCT job_id) AS jobs FROM f JOIN b USING (job_id) GROUP BY ALL), m AS (SELECT company_board FROM c WHERE name IN ('spark', 'kafka') GROUP BY ALL HAVING count(*) = 2),
t AS (SELECT company_board, string_agg(name || ' (' || jobs || ')', '; ' ORDER BY rn) AS techs FROM (SELECT *, row_number() OVER (PARTITION BY company_board ORDER BY jobs DESC, name) AS rn FROM c) WHERE rn <= 5 GROUP BY ALL)
SELECT company_board, open_jobs, techs FROM n JOIN m USING (company_board) JOIN t USING (company_board)""")
def companies_by_technology(spark, sf):
    """Boards whose postings name all wanted technologies, with their top five."""
    boards = jobs(spark, sf, "job_id", "company_board")
    named = materialize(_tech(spark, sf).select("job_id", "name").distinct().join(boards, "job_id"), "named")
    wanted = named.where(F.col("name").isin("spark", "kafka")).groupBy("company_board").agg(F.count_distinct("name").alias("n")).where("n = 2").select("company_board")
    sizes = boards.groupBy("company_board").agg(F.count_distinct("job_id").alias("open_jobs"))
    return sizes.join(wanted, "company_board", "left_semi").join(aggregates.nested_top(named, ["company_board"], "name", 5, "techs"), "company_board")


PROVIDERS = ((r"^lever\.", "Lever"), (r"^(ashby|recruitee)\.", "Young platform"), (r"workday", "Workday"), (r"\.sample\.invalid$", "other"))


@query(f"""
SELECT provider, count(*) AS n FROM (SELECT {classify.rules_sql("regexp_extract(job_url, '^https?://([^/]+)', 1)", PROVIDERS)} AS provider FROM boards_jobs) GROUP BY provider""")
def provider_lookup(spark, sf):
    """The first rule that fits a host names its provider."""
    host = F.regexp_extract("job_url", "^https?://([^/]+)", 1)
    return table(spark, sf, "boards_jobs").select(rules.provider_of(host, PROVIDERS).alias("provider")).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- index


@query(f"""
WITH b AS (SELECT DISTINCT job_id, ats, posted_at, CASE WHEN posted_at IS NULL THEN 8 ELSE CASE {' '.join(f"WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at)) / 86400000000.0 >= {low} THEN {n}" for n, low in reversed(list(enumerate(dates.BAND_DAYS))[1:]))} ELSE 0 END END AS band FROM boards_jobs)
SELECT ats, band, count(*) AS rows, count(DISTINCT job_id) AS keys, min(posted_at) AS first_at, max(posted_at) AS last_at FROM b WHERE ats IN ('lever', 'ashby', 'workday') GROUP BY ats, band""")
def index_manifest(spark, sf):
    """An index written in bands, published, read with pruned partitions and described."""
    base = f"{run_dir(spark)}/index-{abs(hash(sf))}"
    build = index_sources.write_index(jobs(spark, sf, "job_id", "ats", "posted_at"), base, "ats", "posted_at", "job_id", now())
    index_sources.publish(spark, base, build)
    index = index_sources.read_index(spark, base, "ats", ["lever", "ashby", "workday"])
    return index_sources.manifest(index, "ats", "posted_at", "job_id")


@query("""
WITH o AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey), r AS (SELECT c_nationkey, c_custkey, orders, spent, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS place FROM o JOIN customer ON c_custkey = o_custkey)
SELECT n_name, c_custkey, orders, spent, place FROM r JOIN nation ON n_nationkey = c_nationkey WHERE place <= 3""")
def top_customers(spark, sf):
    """The best customers of each nation, aggregated before the join."""
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    joined = spent.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    order = Window.partitionBy("c_nationkey").orderBy(F.col("spent").desc(), "c_custkey")
    top = joined.withColumn("place", F.row_number().over(order)).where("place <= 3").withColumn("place", F.col("place").cast("long"))
    return top.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "orders", "spent", "place")

