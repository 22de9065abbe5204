"""Queries of the reference's operators over the test tables, each with its SQL twin where SQL can say it.

Moments are fixed parameters, as results must not depend on the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import classify, dates, text
from weirflow.operators import aggregates, dedupe, filters, relevance
from weirflow.session import materialize, table

NOW = "2026-11-03 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def jobs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Postings of the last crawl without repeated rows."""
    return table(spark, sf, "boards_jobs").select(*columns).distinct()


# SQL pieces that several twins share.
_FOLD = "lower(strip_accents(coalesce({}, '')))"


def sql_search_text(x: str) -> str:
    return f"trim(regexp_replace({_FOLD.format(x)}, '[^a-z0-9+#]+', ' ', 'g'))"


def sql_match_key(x: str) -> str:
    return f"trim(regexp_replace(replace({_FOLD.format(x)}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def sql_company_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_match_key(x)}, '\\b({text.LEGAL_FORMS})\\b', ' ', 'g'), ' +', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


# ---------------------------------------------------------------- relevance, filters, order

_KEYWORDS = ("engineer", "data platform", "nurse", "energy")


def _ranked_sql() -> str:
    places = []
    for k in _KEYWORDS:
        phrase, tokens = relevance.compile_keyword(k)
        has = lambda v: " AND ".join(f"list_has_any({v}, ['{t}', '{t}s', '{t}es'])" for t in tokens)  # noqa: B023, E731
        places.append(f"CASE WHEN contains(' ' || t, ' {phrase}') THEN 3 WHEN contains(' ' || u, ' {phrase}') OR ({has('uw')}) THEN 2 WHEN {has('vocab')} THEN 1 ELSE 0 END")
    n = len(places)
    return f"""
WITH j AS (SELECT DISTINCT job_id, title, department, team, posted_at, description_text, workplace_type, remote FROM boards_jobs),
a AS (SELECT *, {sql_search_text('title')} t, {sql_search_text("concat_ws(' ', department, team)")} u,
        {sql_search_text("concat_ws(' ', department, team, description_text)")} d FROM j),
b AS (SELECT *, string_split(u, ' ') uw, list_concat(string_split(t, ' '), list_filter(string_split(d, ' '), lambda w: length(w) >= 2 AND NOT list_contains([{_STOP}], w))) vocab FROM a),
c AS (SELECT *, [{', '.join(places)}] p FROM b),
s AS (SELECT *, len(list_filter(p, lambda x: x = 3)) n3, len(list_filter(p, lambda x: x = 2)) n2, len(list_filter(p, lambda x: x > 0)) hits FROM c)
SELECT DISTINCT job_id, title, posted_at,
  CAST((CASE WHEN n3 = {n} THEN 90 WHEN n3 > 0 THEN 60 WHEN n2 > 0 THEN 40 ELSE 20 END) + floor(10.0 * hits / {n} + 0.5) AS INTEGER) AS match_score,
  CASE WHEN n3 > 0 THEN 'title' WHEN n2 > 0 THEN 'department' ELSE 'description' END AS matched_in
FROM s WHERE hits > 0 AND NOT (coalesce(workplace_type = 'onsite', false))
ORDER BY match_score DESC, posted_at DESC NULLS LAST, job_id LIMIT 100"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Scored postings; repeated rows fall together once they are narrow."""
    df = table(spark, sf, "boards_jobs").where(~filters.one_of(F.col("workplace_type"), ["onsite"]))
    scored = relevance.ranked(df, _KEYWORDS, F.col("title"), [F.col("department"), F.col("team")], F.col("description_text"))
    return scored.select("job_id", "title", "posted_at", "match_score", "matched_in").distinct()


@query(_ranked_sql())
def ranked_topk_jobs(spark, sf):
    """The hundred best postings for four keywords, sought in the whole description."""
    return relevance.top_k(_ranked(spark, sf), relevance.rank_order(), 100)


@query(
    f"WITH r AS ({_ranked_sql().replace('LIMIT 100', '')}), f AS (SELECT * FROM r ORDER BY match_score DESC, posted_at DESC NULLS LAST, job_id LIMIT 1 OFFSET 39) "
    "SELECT r.job_id, r.match_score FROM r, f WHERE r.match_score < f.match_score OR (r.match_score = f.match_score AND (r.posted_at < f.posted_at OR (r.posted_at IS NULL AND f.posted_at IS NOT NULL) OR "
    "(r.posted_at IS NOT DISTINCT FROM f.posted_at AND r.job_id > f.job_id))) ORDER BY r.match_score DESC, r.posted_at DESC NULLS LAST, r.job_id LIMIT 40"
)
def keyset_page(spark, sf):
    """The second page of forty, continued from the last row of the first; ranked as in ranked_topk_jobs."""
    ranked = materialize(_ranked(spark, sf).select("job_id", "posted_at", "match_score"), "ranked")
    last = relevance.top_k(ranked, relevance.rank_order(), 40).orderBy(*relevance.rank_order()).tail(1)
    rest = relevance.after_key(ranked, last[0].match_score, last[0].posted_at, last[0].job_id) if last else ranked
    return relevance.top_k(rest, relevance.rank_order(), 40).select("job_id", "match_score")


@query("""
SELECT ats, count(*) FILTER (WHERE coalesce(workplace_type = 'remote', false) OR coalesce(remote, false)) AS remote_only,
  count(*) FILTER (WHERE NOT (coalesce(workplace_type = 'remote', false) OR coalesce(remote, false))) AS onsite_only,
  count(*) FILTER (WHERE coalesce(employment_type IN ('full_time', 'contract'), false)) AS typed
FROM boards_jobs WHERE ats IN ('lever', 'ashby', 'greenhouse', 'workday') GROUP BY ats""")
def filter_remote_semantics(spark, sf):
    """Remote and its true negation, membership with nulls out."""
    df = table(spark, sf, "boards_jobs").where(filters.one_of(F.col("ats"), ["lever", "ashby", "greenhouse", "workday"]))
    remote = filters.is_remote(F.col("workplace_type"), F.col("remote"))
    typed = filters.one_of(F.col("employment_type"), ["full_time", "contract"])
    return df.groupBy("ats").agg(F.count_if(remote).alias("remote_only"), F.count_if(~remote).alias("onsite_only"), F.count_if(typed).alias("typed"))


@query(f"""
SELECT ats, count(*) AS n, max(posted_at) AS newest FROM boards_jobs
WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at) <= 200 * 86400000000 GROUP BY ats""")
def posted_within_days(spark, sf):
    """postings of the last two hundred days; undated ones are out."""
    df = table(spark, sf, "boards_jobs").where(dates.within_days(F.col("posted_at"), now(), 200))
    return df.groupBy("ats").agg(F.count(F.lit(1)).alias("n"), F.max("posted_at").alias("newest"))


@query(f"""
SELECT job_id, company_board FROM (SELECT DISTINCT job_id, company_board, locations, country_codes, department, team, title FROM boards_jobs)
WHERE (coalesce(list_has_any(country_codes, ['DE', 'FR']), false) OR contains(' ' || {sql_match_key("array_to_string(locations, ' | ')")} || ' ', ' tulsa ') OR contains(' ' || {sql_match_key("array_to_string(locations, ' | ')")} || ' ', ' sao paulo '))
AND (contains(lower(coalesce(department, '') || ' | ' || coalesce(team, '')), 'su') OR contains(lower(coalesce(department, '') || ' | ' || coalesce(team, '')), 'data'))
AND NOT contains(lower(coalesce(title, '')), 'lead')""")
def filter_places_departments(spark, sf):
    """Places by code or whole words, departments by parts, words that titles must not have."""
    df = jobs(spark, sf, "job_id", "company_board", "locations", "country_codes", "department", "team", "title")
    unit = F.concat(F.coalesce("department", F.lit("")), F.lit(" | "), F.coalesce("team", F.lit("")))
    places = filters.in_places(F.col("country_codes"), F.col("locations"), ["DE", "FR"], ["Tulsa", "São Paulo"])
    return df.where(places & filters.contains_any(unit, ["su", "data"]) & ~filters.contains_any(F.col("title"), ["lead"])).select("job_id", "company_board")


_HOLDER = f"(SELECT *, {sql_company_key('company_name')} k FROM (SELECT DISTINCT job_id, company_name, company_board FROM boards_jobs))"


@query(f"""
SELECT job_id, company_name FROM {_HOLDER} WHERE (lower(company_board) = 'brelloway' OR k = 'brelloway' OR contains(' ' || k || ' ', ' brelloway ') OR k = 'merulbin' OR contains(' ' || k || ' ', ' merulbin ') OR lower(company_board) = 'merulbin gmbh')
AND NOT (coalesce(contains(lower(job_id), 'workday'), false))""")
def filter_companies(spark, sf):
    """companies by board, key or whole words of it, less an excluded list."""
    df = jobs(spark, sf, "job_id", "company_name", "company_board")
    name, board = F.col("company_name"), F.col("company_board")
    wanted = filters.company_is(name, board, "Brelloway") | filters.company_is(name, board, "Merulbin GmbH")
    barred = spark.createDataFrame([("workday",)], "term string")
    return filters.without_matches(df.where(wanted), barred, F.lower("job_id").contains(F.col("term"))).select("job_id", "company_name")


@query(f"SELECT level, count(*) AS n FROM (SELECT {classify.rules_sql(sql_match_key('title'), classify.LEVEL_RULES)} AS level FROM boards_jobs) GROUP BY level")
def title_levels(spark, sf):
    """Postings by the level their titles state."""
    return table(spark, sf, "boards_jobs").select(classify.seniority(F.col("title")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {sql_match_key('categories.commitment')} <> '' THEN {classify.rules_sql(sql_match_key('categories.commitment'), classify.EMPLOYMENT_RULES, 'other')} END AS kind FROM lever_postings) GROUP BY kind""")
def employment_types(spark, sf):
    """What sources call the kind of employment, in one vocabulary."""
    kind = classify.employment_type(F.col("categories.commitment")).alias("kind")
    return table(spark, sf, "lever_postings").select(kind).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT job_id, company_board, posted_at FROM (SELECT *, row_number() OVER (PARTITION BY company_board ORDER BY posted_at DESC NULLS LAST, job_id) rn
FROM (SELECT DISTINCT job_id, company_board, posted_at FROM boards_jobs)) WHERE rn <= 2""")
def max_per_company(spark, sf):
    """The two newest postings of each board."""
    df = jobs(spark, sf, "job_id", "company_board", "posted_at")
    return relevance.capped(df, "company_board", relevance.newest_order(), 2)


@query("SELECT job_id, posted_at FROM (SELECT DISTINCT job_id, posted_at FROM boards_jobs) ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 200")
def newest_jobs(spark, sf):
    """The newest postings."""
    return relevance.top_k(jobs(spark, sf, "job_id", "posted_at"), relevance.newest_order(), 200)


@query("""
WITH d AS (SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM d)
SELECT doc_id, lang, turn FROM r ORDER BY turn, lang, doc_id LIMIT 60""")
def round_robin_sample(spark, sf):
    """One document of each language in turn."""
    df = table(spark, sf, "documents").select("doc_id", "lang").where(F.col("lang").isNotNull()).distinct()
    return relevance.round_robin(df, "lang", "doc_id", 60).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query("""
WITH b AS (SELECT DISTINCT company_board FROM boards_jobs), n AS (SELECT count(*) AS n FROM b)
SELECT company_board, CAST(((row_number() OVER (ORDER BY company_board) - 1 - 37 % n) % n + n) % n AS BIGINT) AS place FROM b, n""")
def rotated_boards(spark, sf):
    """The boards in an order that begins elsewhere every day."""
    boards = table(spark, sf, "boards_jobs").select("company_board").distinct()
    return relevance.rotated(boards, "company_board", 37).select("company_board", F.col("place").cast("long").alias("place"))


@query(f"""
SELECT publication_number, first_buyer FROM (SELECT DISTINCT publication_number, classification_cpv, coalesce(buyer_name['eng'][1], buyer_name['deu'][1], buyer_name['fra'][1]) AS first_buyer FROM search_response)
WHERE len(list_filter(coalesce(classification_cpv, []), lambda c: starts_with(c, '79') OR starts_with(c, '45'))) > 0 AND contains({_FOLD.format('first_buyer')}, 'a')""")
def notice_filters(spark, sf):
    """Notices by code prefixes and part of the buyer's name, the name by order of languages."""
    name = F.coalesce(*[F.get(F.try_element_at("buyer_name", F.lit(code)), 0) for code in ("eng", "deu", "fra")])
    df = table(spark, sf, "search_response").select("publication_number", "classification_cpv", name.alias("first_buyer")).distinct()
    passed = filters.code_prefix_any(F.col("classification_cpv"), ["79", "45"]) & filters.folded_contains(F.col("first_buyer"), "A")
    return df.where(passed).select("publication_number", "first_buyer")


@query("""
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderstatus = 'X' THEN 'awarded' WHEN o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1998-01-01' THEN 'open' ELSE 'closed' END AS status
FROM orders ORDER BY CASE status WHEN 'open' THEN 0 ELSE 1 END, o_orderdate + INTERVAL 400 DAY, o_orderkey LIMIT 100""")
def status_order(spark, sf):
    """Status as of a moment, ordered by deadline."""
    deadline = F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")
    status = dates.open_status(F.lit("tender"), deadline, F.col("o_orderstatus") == "X", F.col("o_orderstatus") == "P", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", deadline.alias("deadline"), status.alias("status"))
    return relevance.top_k(df, [F.when(F.col("status") == "open", 0).otherwise(1), F.col("deadline"), F.col("o_orderkey")], 100).drop("deadline")


@query("SELECT p_brand, count(*) AS parts, min(p_retailprice) AS least FROM part WHERE starts_with(p_type, 'PROMO') OR starts_with(p_type, 'STANDARD') OR p_retailprice >= 1500 GROUP BY p_brand")
def prefix_or_amount(spark, sf):
    """prefixes or a least amount."""
    df = table(spark, sf, "part").where(filters.any_of([F.col("p_type").startswith("PROMO"), F.col("p_type").startswith("STANDARD"), filters.amount_between(F.col("p_retailprice"), 1500)]))
    return df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.min("p_retailprice").alias("least"))


# ---------------------------------------------------------------- duplicates and merging

_COMPLETE = "(CASE WHEN description_text IS NOT NULL AND description_text <> '' THEN 2 ELSE 0 END + CASE WHEN len(coalesce(country_codes, [])) > 0 THEN 1 ELSE 0 END)"


@query(f"""
WITH j AS (SELECT job_id, {sql_company_key('coalesce(company_name, company_board)')} || '#' || {sql_match_key('title')} || '#' || array_to_string(list_sort(list_transform(coalesce(locations, []), lambda l: {sql_match_key('l')})), '|') AS k,
  {_COMPLETE} AS score, posted_at FROM boards_jobs),
u AS (SELECT k, job_id, max(score) AS score, max(posted_at) AS posted_at FROM j GROUP BY k, job_id),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, posted_at DESC NULLS LAST, job_id) AS rn FROM u)
SELECT w.job_id, w.k AS opening, coalesce(array_to_string(l.ids, ','), '') AS duplicate_ids
FROM r w LEFT JOIN (SELECT k, list(job_id ORDER BY job_id) AS ids FROM r WHERE rn > 1 GROUP BY k) l USING (k) WHERE w.rn = 1""")
def dedupe_survivors(spark, sf):
    """One posting of each opening, the others by their ids."""
    place = F.array_join(F.array_sort(F.transform(F.coalesce("locations", F.array().cast("array<string>")), text.match_key)), "|")
    key = F.concat(text.company_key(F.coalesce("company_name", "company_board")), F.lit("#"), text.match_key(F.col("title")), F.lit("#"), place)
    score = F.when(F.coalesce(F.col("description_text") != "", F.lit(False)), 2).otherwise(0) + F.when(F.size(F.coalesce("country_codes", F.array().cast("array<string>"))) > 0, 1).otherwise(0)
    df = table(spark, sf, "boards_jobs").select("job_id", key.alias("opening"), score.alias("score"), "posted_at")
    best = dedupe.survivors(df, [F.col("opening")], [F.col("score"), F.col("posted_at")], "job_id")
    return best.select("job_id", "opening", F.array_join("duplicate_sources", ",").alias("duplicate_ids"))


@query("""
WITH r AS (SELECT job_id, title, fetched_at, row_number() OVER (PARTITION BY job_id ORDER BY fetched_at DESC, title) AS rn FROM boards_jobs_snapshots),
l AS (SELECT job_id, list_sort(list_distinct(list(x))) AS xs FROM (SELECT job_id, unnest(locations) AS x FROM boards_jobs_snapshots) GROUP BY job_id)
SELECT r.job_id, r.title, r.fetched_at, coalesce(array_to_string(xs, '; '), '') AS places FROM r LEFT JOIN l USING (job_id) WHERE rn = 1""")
def same_id_union(spark, sf):
    """One row an id with the union of its places."""
    df = table(spark, sf, "boards_jobs_snapshots").select("job_id", "title", "fetched_at", "locations")
    merged = dedupe.merge_same_id(df, "job_id", [F.col("fetched_at").desc(), F.col("title").asc_nulls_last()], ["locations"])
    return merged.select("job_id", "title", "fetched_at", F.array_join("locations", "; ").alias("places"))


@query("""
WITH d AS (SELECT DISTINCT doc_id, md5(text) AS h, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND text <> ''),
m AS (SELECT *, first_value(source) OVER (PARTITION BY h, lang ORDER BY CASE WHEN source IS NOT NULL THEN 0 ELSE 1 END, CASE source WHEN 'ted' THEN 0 WHEN 'edgar' THEN 1 ELSE 2 END, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM d)
SELECT doc_id, source FROM m WHERE lang IS NULL OR source IS NOT DISTINCT FROM s""")
def cross_source_dedupe(spark, sf):
    """Copies of a text in several sources stay in one of them."""
    df = table(spark, sf, "documents").where(F.col("text") != "").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "lang", "source", "n_chars").distinct()
    order = [F.when(F.col("source").isNotNull(), 0).otherwise(1), F.when(F.col("source") == "ted", 0).when(F.col("source") == "edgar", 1).otherwise(2), F.col("doc_id")]
    return dedupe.cross_source(df, ["h", "lang"], "source", order).select("doc_id", "source")


_CUT = "TIMESTAMP '2026-10-22 00:00:00'"


@query(f"""
WITH s AS (SELECT job_id, max(fetched_at) AS last_read, min(fetched_at) AS first_read FROM boards_jobs_snapshots GROUP BY job_id)
SELECT job_id, first_read, last_read, last_read >= {_CUT} AS fresh FROM s""")
def first_seen_store(spark, sf):
    """Reads upserted into a store that keeps when each job was first seen."""
    df = table(spark, sf, "boards_jobs_snapshots").select("job_id", "fetched_at", F.col("fetched_at").alias("last_read")).withColumnRenamed("fetched_at", "first_read")
    cut = F.lit("2026-10-22 00:00:00").cast("timestamp_ntz")
    merged = dedupe.upsert(df.where(F.col("last_read") < cut), df.where(F.col("last_read") >= cut), "job_id", "first_read")
    return merged.select("job_id", "first_read", "last_read", (F.col("last_read") >= cut).alias("fresh"))


@query("""
WITH u AS (
 SELECT 'lever:' || id AS job_id, text AS title, categories.department AS department, descriptionplain AS body FROM lever_postings
 UNION ALL SELECT 'ashby:' || id, title, department, descriptionplain FROM ashby_jobs WHERE coalesce(islisted, true)
 UNION ALL SELECT 'pinpoint:' || id, title, job.department.name, description FROM pinpoint_postings)
SELECT split_part(job_id, ':', 1) AS ats, count(*) AS n, count(DISTINCT job_id) AS jobs, count(department) AS with_department, count(body) AS with_body, count(DISTINCT title) AS titles FROM u WHERE job_id IS NOT NULL GROUP BY ats""")
def unified_sources(spark, sf):
    """Three sources' records in one shape, unlisted and keyless ones left out."""
    from weirflow.sources.postings import unified_postings

    df = unified_postings(table(spark, sf, "lever_postings"), table(spark, sf, "ashby_jobs"), table(spark, sf, "pinpoint_postings"))
    return df.groupBy("ats").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("jobs"), F.count("department").alias("with_department"), F.count("body").alias("with_body"), F.count_distinct("title").alias("titles")
    )


# ---------------------------------------------------------------- aggregates

_OPENING = f"{sql_match_key('title')} || '|' || array_to_string(list_sort(coalesce(country_codes, [])), ',')"


def _openings(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.coalesce("country_codes", F.array().cast("array<string>"))
    opening = F.concat(text.match_key(F.col("title")), F.lit("|"), F.array_join(F.array_sort(codes), ","))
    df = table(spark, sf, "boards_jobs").select(
        "job_id", text.company_key(F.coalesce("company_name", "company_board")).alias("company"), opening.alias("opening"), F.concat_ws(":", "ats", "company_board").alias("board"),
        filters.is_remote(F.col("workplace_type"), F.col("remote")).alias("remote"), "department", "posted_at",
    )
    return df.distinct()


_OPENINGS_SQL = f"""(SELECT DISTINCT job_id, {sql_company_key('coalesce(company_name, company_board)')} AS company, {_OPENING} AS opening, concat_ws(':', ats, company_board) AS board,
  coalesce(workplace_type = 'remote', false) OR coalesce(remote, false) AS remote, department, posted_at FROM boards_jobs)"""


@query(f"""
WITH o AS {_OPENINGS_SQL}, b AS (SELECT company, opening, board, count(*) AS c FROM o GROUP BY ALL), m AS (SELECT company, opening, max(c) AS m FROM b GROUP BY ALL)
SELECT company, CAST(sum(m) AS BIGINT) AS openings FROM m GROUP BY company""")
def cross_board_distinct(spark, sf):
    """A2: distinct openings, copies on other boards counted once."""
    return aggregates.cross_board_openings(_openings(spark, sf), "company", "opening", "board")


@query(f"""
WITH o AS {_OPENINGS_SQL}, b AS (SELECT company, opening, board, count(*) AS c FROM o GROUP BY ALL),
h AS (SELECT *, coalesce(max(c) OVER (PARTITION BY company, opening ORDER BY board ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY company, opening, board ORDER BY job_id) AS rn FROM o)
SELECT n.company, count(*) AS counted, count(*) FILTER (WHERE n.remote) AS remote_jobs FROM n JOIN h USING (company, opening, board) WHERE rn > had GROUP BY n.company""")
def counted_jobs(spark, sf):
    """Which postings count, and how many of them are remote."""
    rows = aggregates.counted_openings(_openings(spark, sf), "company", "opening", "board", "job_id")
    return rows.groupBy("company").agg(F.count(F.lit(1)).alias("counted"), F.count_if("remote").alias("remote_jobs"))


@query(f"""
WITH o AS {_OPENINGS_SQL},
d AS (SELECT company, department, count(*) AS c FROM o WHERE department IS NOT NULL GROUP BY ALL),
t AS (SELECT company, string_agg(department || ' (' || c || ')', '; ' ORDER BY rn) AS top_departments FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY c DESC, department) AS rn FROM d) WHERE rn <= 5 GROUP BY company),
a AS (SELECT company, count(*) AS jobs, count(*) FILTER (WHERE remote) AS remote_jobs, max(posted_at) AS newest, count(*) FILTER (WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at) <= 200 * 86400000000) AS recent FROM o GROUP BY company)
SELECT a.*, round(remote_jobs / jobs, 2) AS remote_share, round(recent / jobs, 2) AS velocity, t.top_departments FROM a LEFT JOIN t USING (company)""")
def company_rollup(spark, sf):
    """One row a company with counts, shares and its top departments."""
    rows = materialize(_openings(spark, sf), "openings")
    sums = rows.groupBy("company").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if("remote").alias("remote_jobs"), F.max("posted_at").alias("newest"),
        F.count_if(dates.within_days(F.col("posted_at"), now(), 200)).alias("recent"),
    )
    shares = sums.withColumns({"remote_share": F.round(F.col("remote_jobs") / F.col("jobs"), 2), "velocity": F.round(F.col("recent") / F.col("jobs"), 2)})
    return shares.join(aggregates.nested_top(rows, ["company"], "department", 5, "top_departments"), "company", "left")


@query(f"""
WITH d AS (SELECT DISTINCT job_id, company_board, unnest(list_distinct(list_filter(string_split({sql_search_text("concat_ws(' ', department, team)")}, ' '), lambda w: length(w) >= 2))) AS term FROM boards_jobs),
s AS (SELECT company_board, count(DISTINCT job_id) AS n FROM boards_jobs GROUP BY company_board), c AS (SELECT company_board, term, count(*) AS records FROM d GROUP BY ALL)
SELECT c.* FROM c JOIN s USING (company_board) WHERE n >= 3 AND records >= n * 0.3""")
def shared_terms(spark, sf):
    """Words that most postings of a board share."""
    tokens = F.filter(text.words(text.search_text(F.concat_ws(" ", "department", "team"))), lambda w: F.length(w) >= 2)
    return aggregates.shared_terms(table(spark, sf, "boards_jobs"), "company_board", "job_id", tokens, share=0.3)


@query(r"""
WITH d AS (SELECT DISTINCT company_board, job_id, trim(p) AS paragraph FROM (SELECT company_board, job_id, unnest(string_split(replace(coalesce(description_text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS p FROM boards_jobs) WHERE length(trim(p)) >= 40),
s AS (SELECT company_board, count(DISTINCT job_id) AS n FROM boards_jobs GROUP BY company_board), c AS (SELECT company_board, paragraph, count(*) AS records FROM d GROUP BY ALL)
SELECT c.* FROM c JOIN s USING (company_board) WHERE records >= greatest(3, ceil(n * 0.3))""")
def boilerplate_paragraphs(spark, sf):
    """A10: long paragraphs that recur on a board."""
    return aggregates.boilerplate(table(spark, sf, "boards_jobs"), "company_board", "job_id", "description_text", chars=40, share=0.3)


@query("""
SELECT 'ats' AS dimension, ats AS value, count(*) AS n FROM boards_jobs GROUP BY ats UNION ALL SELECT 'workplace_type', workplace_type, count(*) FROM boards_jobs GROUP BY workplace_type
UNION ALL SELECT 'remote', CAST(remote AS VARCHAR), count(*) FROM boards_jobs GROUP BY remote""")
def manifest_counts(spark, sf):
    """Counts by each of several dimensions."""
    return aggregates.rollups(table(spark, sf, "boards_jobs"), ["ats", "workplace_type", "remote"])


@query("""
WITH g AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id)
SELECT e.user_id, count(*) AS n FROM events e JOIN g USING (user_id) WHERE g.newest >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY e.user_id""")
def stale_group_drop(spark, sf):
    """Groups that have gone silent are dropped."""
    return aggregates.live_groups(table(spark, sf, "events"), "user_id", "ts", 2).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT user_id, event_type = 'error' AS failed, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM events)
SELECT user_id, count(*) AS runs, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failures, CAST(count(*) FILTER (WHERE failed AND ok = 0) AS BIGINT) AS streak FROM e GROUP BY user_id""")
def health_streaks(spark, sf):
    """Failures, and those since the last success."""
    return aggregates.streaks(table(spark, sf, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], F.col("event_type") == "error")


@query("""
WITH w AS (SELECT event_type, date_trunc('week', ts) AS week, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)
SELECT event_type, week, users, lag(users) OVER (PARTITION BY event_type ORDER BY week) AS previous, users - lag(users) OVER (PARTITION BY event_type ORDER BY week) AS delta FROM w""")
def week_over_week(spark, sf):
    """Users a week against the week before."""
    weeks = table(spark, sf, "events").groupBy("event_type", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.count_distinct("user_id").alias("users"))
    return aggregates.against_previous(weeks, "event_type", "week", "users")


@query("""
SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_price, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 4) AS returned_share,
  quantile_disc(l_extendedprice, 0.75) AS p75_price, round(log10(count(*)) * sqrt(avg(l_discount)), 6) AS score FROM lineitem GROUP BY l_suppkey""")
def weighted_scores(spark, sf):
    """Weighted means, shares, a discrete percentile and a damped score."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(p * q) / F.sum(q), 4).alias("weighted_price"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 4).alias("returned_share"),
        F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY l_extendedprice)").alias("p75_price"), F.round(F.log10(F.count(F.lit(1))) * F.sqrt(F.avg("l_discount")), 6).alias("score"),
    )


@query("""
WITH s AS (SELECT department, company_board, sum(CASE WHEN ats IN ('lever', 'ashby') AND remote THEN 1000 ELSE 1 END) AS votes FROM boards_jobs WHERE department IS NOT NULL GROUP BY ALL)
SELECT department, company_board, CAST(votes AS BIGINT) AS votes, place FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY votes DESC, company_board) AS place FROM s) WHERE place <= 3""")
def platform_votes(spark, sf):
    """The boards with most votes in each department; a vote of one kind outweighs a thousand others."""
    df = table(spark, sf, "boards_jobs").where(F.col("department").isNotNull())
    weight = F.when(F.col("ats").isin("lever", "ashby") & F.col("remote"), 1000).otherwise(1).cast("long")
    return aggregates.voted(df, "department", "company_board", weight).withColumn("place", F.col("place").cast("long"))


@query("""
WITH l AS (SELECT 'https://' || ats || '.sample.invalid/' || company_board AS target, job_id AS page, row_number() OVER (ORDER BY job_id, title, posted_at) AS pos, department AS label FROM (SELECT DISTINCT ats, company_board, job_id, title, posted_at, department FROM boards_jobs)),
p AS (SELECT target, list_sort(list_distinct(list(page))) AS ps FROM l GROUP BY target)
SELECT l.target, min_by(page, page) AS first_page, count(DISTINCT page) AS pages, any_value(array_to_string(list_slice(ps, 1, 5), ', ')) AS some_pages FROM l JOIN p USING (target) GROUP BY l.target""")
def link_occurrences(spark, sf):
    """Where each link target is seen."""
    df = jobs(spark, sf, "ats", "company_board", "job_id", "department")
    target = F.concat(F.lit("https://"), F.col("ats"), F.lit(".sample.invalid/"), F.col("company_board"))
    seen = aggregates.occurrences(df.select(target.alias("target"), "job_id", "department"), "target", "job_id", "job_id", "department")
    return seen.select("target", "first_page", "pages", "some_pages")


@query("""
WITH c AS (SELECT id, list_filter(list_transform(coalesce(compensation.summarycomponents, []), lambda x: {'a': coalesce(x.minvalue, 0), 'c': x.currencycode}), lambda x: x.a > 0) AS xs FROM (SELECT DISTINCT id, compensation FROM ashby_jobs WHERE compensation IS NOT NULL))
SELECT id, CASE WHEN len(xs) = 0 THEN NULL WHEN len(list_distinct(list_transform(xs, lambda x: coalesce(x.c, '?')))) = 1 THEN round(list_sum(list_transform(xs, lambda x: x.a)), 2) ELSE round(xs[1].a, 2) END AS total FROM c""")
def one_currency_totals(spark, sf):
    """Sums of amounts where they are in one currency."""
    df = table(spark, sf, "ashby_jobs").where(F.col("compensation").isNotNull()).select("id", "compensation").distinct()
    items = F.transform(
        F.coalesce("compensation.summarycomponents", F.array()), lambda x: F.struct(x["minvalue"].alias("amount"), F.coalesce(x["currencycode"], F.lit("?")).alias("currency"))
    )
    return df.select("id", F.round(aggregates.one_currency_total(items), 2).alias("total"))


def queries() -> dict:
    from weirflow.plans import catalogue_more, catalogue_records, catalogue_runs  # noqa: F401  (register their queries)

    return dict(QUERIES)


def sql() -> dict[str, str]:
    from weirflow.plans import catalogue_more, catalogue_records, catalogue_runs  # noqa: F401

    return dict(SQL)

