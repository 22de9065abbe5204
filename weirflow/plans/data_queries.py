"""Queries p1 to p3 and p6: the core operators for training data over their whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.pay import currency_of, period_of, read_pay
from weirflow.operators import instants, nested, snapshots, units
from weirflow.session import materialize, table


def _time_values(spark: SparkSession, sf: str) -> DataFrame:
    """(tab, rec, fld, pos, raw, tz) of every time text, places in arrays counted from 0."""

    def plain(tab: str, rec: str, fld: str) -> DataFrame:
        return table(spark, sf, tab).select(
            F.lit(tab).alias("tab"), F.col(rec).alias("rec"), F.lit(fld).alias("fld"), F.lit(0).alias("pos"), F.col(fld).alias("raw"), "tz"
        )

    deadlines = table(spark, sf, "search_response").select(
        F.lit("search_response").alias("tab"), F.col("publication_number").alias("rec"), F.lit("deadline_receipt_request").alias("fld"),
        F.posexplode("deadline_receipt_request").alias("pos", "raw"), "tz",
    )
    return (
        plain("lever_postings", "id", "createdat")
        .unionByName(plain("ashby_jobs", "id", "publishedat"))
        .unionByName(plain("search_response", "publication_number", "publication_date"))
        .unionByName(deadlines)
    )


def _normalised(spark: SparkSession, values: DataFrame) -> DataFrame:
    """With ``utc_us`` from the dictionary that all runs in the shared folder extend."""
    return instants.normalise_instants(values, "raw", "tz", path=instants.dictionary_path(spark), source=F.col("tab"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values that denote an instant and aren't complete, with that instant."""
    values = _time_values(spark, sf).where(F.col("raw").isNotNull() & ~instants.is_complete(F.col("raw")))
    out = _normalised(spark, values).where(F.col("utc_us").isNotNull())
    return out.select("tab", "rec", "fld", F.col("pos").cast("int").alias("pos"), "utc_us").distinct()


def p1_all_instants(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each field denote an instant, and from when to when."""
    out = _normalised(spark, _time_values(spark, sf).where(F.col("raw").isNotNull()))
    return out.groupBy("tab", "fld").agg(
        F.count("raw").alias("texts"), F.count("utc_us").alias("instants"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us")
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs added, removed or changed between consecutive complete runs."""
    runs = table(spark, sf, "crawl_runs").where(F.col("status") == "complete").select("run_id", "started_at", "finished_at")
    fields = ["title", "department", "team", "employment_type", "workplace_type"]
    reads = table(spark, sf, "boards_jobs_snapshots").select("job_id", "fetched_at", "locations", *fields)
    placed = snapshots.reads_of_runs(reads, runs, "fetched_at", "started_at", "finished_at", "run_id")
    content = [*map(snapshots.comparable, fields), snapshots.comparable_array("locations")]
    states = snapshots.latest_states(placed, "__run", "job_id", "fetched_at", content)
    states = materialize(states, "states")
    pairs = snapshots.consecutive_runs(runs, "run_id", "started_at")
    out = snapshots.snapshot_changes(states, pairs)
    return out.select(F.col("run").alias("run_id"), F.col("key").alias("job_id"), "change")


def p2_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p2_found(spark, sf).groupBy("run_id", "change").agg(F.count(F.lit(1)).alias("jobs"))


def pay_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Factors from amounts in a currency a period to euros a year, unit `CUR/period`."""
    graph = units.ConversionGraph()
    quotes = units.bounded_rows(table(spark, sf, "ecb_rates"))
    newest: dict[tuple[str, str], object] = {}
    for r in sorted((r for r in quotes if r.currency and r.obs_value), key=lambda r: (r.time_period or "", r.obs_value)):
        newest[r.currency, r.currency_denom or "EUR"] = r  # the newest day of each pair of currencies
    codes = sorted({"EUR", *(c for pair in newest for c in pair)})
    periods = {r.period: r.per_year for r in units.bounded_rows(table(spark, sf, "pay_periods")) if r.period and r.per_year}
    for period, per_year in periods.items():
        for code in codes:
            if period != "year":
                graph.add(f"{code}/{period}", f"{code}/year", per_year)
    for (code, base), r in newest.items():
        if code != base:  # quotes against other currencies than the euro close cycles, which are checked
            graph.add(f"{base}/year", f"{code}/year", str(r.obs_value))
    return graph.factors(spark, "EUR/year")


def _read_text_udf():
    @F.pandas_udf("low double, high double, code string, period string")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_pay(t) for t in texts], columns=["low", "high", "code", "period"])

    return read


def _currency_udf():
    @F.pandas_udf("code string, scale double")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([currency_of(t) for t in texts], columns=["code", "scale"])

    return read


def _period_udf():
    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([period_of(t) for t in texts], dtype=object)

    return read


def _pay_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """(tab, rec, bound, amount, code, period) of each bound of both tables; what isn't stated is null."""
    currency, period, read = _currency_udf(), _period_udf(), _read_text_udf()
    # A missing currency text states none and scales nothing.
    scale = F.coalesce(F.col("c.scale"), F.lit(1.0))
    lever = table(spark, sf, "lever_postings").where(F.col("salaryrange").isNotNull())
    lever = lever.select("id", F.col("salaryrange.min").alias("lo"), F.col("salaryrange.max").alias("hi"), F.col("salaryrange.currency").alias("money"), F.col("salaryrange.interval").alias("every"))
    lever = units.parsed_once(units.parsed_once(lever, "money", currency, "c"), "every", period, "period")
    lever = lever.select(F.lit("lever_postings").alias("tab"), F.col("id").alias("rec"), (F.col("lo") * scale).alias("lo"), (F.col("hi") * scale).alias("hi"), F.col("c.code").alias("code"), "period")
    pin = table(spark, sf, "pinpoint_postings").select("id", "compensation_minimum", "compensation_maximum", "compensation_currency", "compensation_frequency", "compensation")
    for name, parse, out in (("compensation_currency", currency, "c"), ("compensation_frequency", period, "f"), ("compensation", read, "t")):
        pin = units.parsed_once(pin, name, parse, out)
    lo, hi = F.nullif(F.col("compensation_minimum"), F.lit(float("nan"))), F.nullif(F.col("compensation_maximum"), F.lit(float("nan")))
    from_text = lo.isNull() & hi.isNull()
    pin = pin.select(
        F.lit("pinpoint_postings").alias("tab"), F.col("id").alias("rec"),
        F.when(from_text, F.col("t.low")).otherwise(lo * scale).alias("lo"), F.when(from_text, F.col("t.high")).otherwise(hi * scale).alias("hi"),
        F.coalesce(F.col("c.code"), F.col("t.code")).alias("code"), F.coalesce(F.col("f"), F.col("t.period")).alias("period"),
    )
    both = lever.unionByName(pin)
    bounds = F.explode(F.array(F.struct(F.lit("min").alias("bound"), F.col("lo").alias("amount")), F.struct(F.lit("max").alias("bound"), F.col("hi").alias("amount"))))
    return both.select("tab", "rec", "code", "period", bounds.alias("b")).select("tab", "rec", "b.bound", "b.amount", "code", "period")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every stated pay bound in whole euros a year."""
    bounds = _pay_bounds(spark, sf).where(F.col("amount") > 0)
    unit = F.concat(F.col("code"), F.lit("/"), F.col("period"))
    out = units.convert(bounds, F.col("amount"), unit, "EUR/year", pay_factors(spark, sf), "eur")
    return out.where(F.col("eur").isNotNull()).select("tab", "rec", "bound", F.floor(F.col("eur") + 0.5).alias("eur_year")).distinct()


def _record_tables(spark: SparkSession, df: DataFrame, text: str, key: str) -> dict[str, DataFrame]:
    parsed = df.select(F.col(key).cast("string").alias("key"), nested.json_object(F.col(text)).alias("record"))
    parsed = materialize(parsed.where(F.col("record").isNotNull()), "records")
    return nested.flatten_records(parsed, "record", nested.infer_merged_schema(df, text), F.col("key"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows of the nested records with their parents' keys and places."""

    def links(tables: dict[str, DataFrame], path: str, rel: str, parent, child) -> list[DataFrame]:
        if path not in tables:
            return []
        return [tables[path].select(F.lit(rel).alias("rel"), parent.alias("parent_key"), F.col("_pos").cast("int").alias("pos"), child.alias("child_key"))]

    hits = _record_tables(spark, table(spark, sf, "fts_response"), "body", "resp_id")
    firms = _record_tables(spark, table(spark, sf, "search_airbus"), "body", "resp_id")
    jobs = table(spark, sf, "ashby_jobs").where(F.col("secondarylocations").isNotNull())
    held = nested.MergedSchema(nested.schema_of_type(jobs.select("secondarylocations").schema))
    jobs = jobs.select(F.col("id").alias("key"), F.to_variant_object(F.struct("secondarylocations")).alias("record"))
    places = nested.flatten_records(jobs, "record", held, F.col("key"))
    siege = nested.field("_value", "adresse")
    parts = [
        *links(hits, "hits.hits", "hit", F.col("key"), nested.field("_value", "_id")),
        *links(hits, "hits.hits._source.ciks", "cik", nested.field("_parent", "_id"), nested.field("_value")),
        *links(places, "secondarylocations", "secondary", F.col("key"), nested.field("_value", "location")),
        *links(firms, "results.matching_etablissements", "etab", nested.field("_parent", "siren"), nested.field("_value", "siret")),
    ]
    if "results.siege" in firms:
        parts += links(firms, "results.siege", "siege", nested.field("_parent", "siren"), siege)
    elif "results" in firms:
        parts.append(
            firms["results"].select(
                F.lit("siege").alias("rel"), nested.field("_value", "siren").alias("parent_key"), F.lit(0).alias("pos"), nested.field("_value", "siege", "adresse").alias("child_key")
            )
        )
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "rel string, parent_key string, pos int, child_key string")
    return out.where(F.col("parent_key").isNotNull() & F.col("child_key").isNotNull()).distinct()


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_all_instants": p1_all_instants,
        "p2_found": p2_found,
        "p2_change_counts": p2_change_counts,
        "p3_found": p3_found,
        "p6_found": p6_found,
    }


_CHANGES = r"""
u AS (SELECT run_id, started_at, finished_at, lag(run_id) OVER (ORDER BY started_at) AS earlier FROM crawl_runs WHERE status = 'complete'),
s AS (SELECT run_id, job_id, max_by(state, fetched_at) AS state FROM (SELECT u.run_id, b.job_id, b.fetched_at, concat_ws(chr(31), trim(coalesce(title, '')), trim(coalesce(department, '')), trim(coalesce(team, '')), trim(coalesce(employment_type, '')),
  trim(coalesce(workplace_type, '')), array_to_string(list_sort(list_filter(list_transform(coalesce(locations, []), lambda l: trim(coalesce(l, ''))), lambda l: l <> '')), chr(30))) AS state
  FROM boards_jobs_snapshots b JOIN u ON b.fetched_at BETWEEN u.started_at AND u.finished_at) GROUP BY ALL),
w AS (SELECT u.run_id, s.job_id, s.state FROM s JOIN u ON s.run_id = u.earlier), n AS (SELECT s.* FROM s JOIN u USING (run_id) WHERE u.earlier IS NOT NULL),
c AS (SELECT coalesce(n.run_id, w.run_id) AS run_id, coalesce(n.job_id, w.job_id) AS job_id, CASE WHEN w.job_id IS NULL THEN 'added' WHEN n.job_id IS NULL THEN 'removed' WHEN n.state <> w.state THEN 'changed' END AS change
  FROM n FULL JOIN w ON n.run_id = w.run_id AND n.job_id = w.job_id)"""

_BODY = "(SELECT resp_id, CASE WHEN json_type(j) = 'OBJECT' THEN j WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') AND json_type(CAST(j ->> '$' AS JSON)) = 'OBJECT' THEN CAST(j ->> '$' AS JSON) END AS o FROM (SELECT resp_id, CAST(body AS JSON) AS j FROM {} WHERE json_valid(body)))"


def _array_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [{x}] END"


def _unnested(source: str, keep: str, x: str) -> str:
    return f"(SELECT {keep}, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS e FROM (SELECT *, {_array_sql(x)} AS a FROM {source}))"


_NESTED = f"""
WITH f AS {_BODY.format('fts_response')}, b AS {_BODY.format('search_airbus')}, h AS {_unnested('f', 'resp_id', "(o -> '$.hits.hits')")}, r AS {_unnested('b', 'resp_id', "(o -> '$.results')")},
c AS {_unnested("(SELECT e ->> '$._id' AS k, e -> '$._source.ciks' AS v FROM h)", 'k', 'v')}, g AS {_unnested("(SELECT e ->> '$.siren' AS k, e -> '$.siege' AS v FROM r)", 'k', 'v')},
t AS {_unnested("(SELECT e ->> '$.siren' AS k, e -> '$.matching_etablissements' AS v FROM r)", 'k', 'v')}
SELECT DISTINCT * FROM (SELECT 'hit' AS rel, CAST(resp_id AS VARCHAR) AS parent_key, pos, e ->> '$._id' AS child_key FROM h UNION ALL SELECT 'cik', k, pos, e ->> '$' FROM c
UNION ALL SELECT 'siege', k, pos, e ->> '$.adresse' FROM g UNION ALL SELECT 'etab', k, pos, e ->> '$.siret' FROM t
UNION ALL SELECT 'secondary', id, CAST(unnest(range(len(secondarylocations))) AS INTEGER), unnest(secondarylocations).location FROM ashby_jobs) WHERE parent_key IS NOT NULL AND child_key IS NOT NULL"""


def sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_CHANGES} SELECT * FROM c WHERE change IS NOT NULL",
        "p2_change_counts": f"WITH {_CHANGES} SELECT run_id, change, count(*) AS jobs FROM c WHERE change IS NOT NULL GROUP BY ALL",
        "p6_found": _NESTED,
    }
