"""Queries p4, p5, p7 to p9 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import mixture, tokens
from weirflow.llm.near_duplicates import NearDuplicates
from weirflow.llm.repeated_lines import RepeatedLines, without_lines
from weirflow.llm.residue import find_residue
from weirflow.session import materialize, table


def _posting_duplicates(spark: SparkSession, sf: str) -> NearDuplicates:
    jobs = table(spark, sf, "boards_jobs").where(F.col("description_text").isNotNull())
    content = F.concat_ws(" ", "title", "description_text", "locations")
    return NearDuplicates(jobs, F.col("job_id"), content, k=3, threshold=0.45)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different jobs whose contents share at least 0.45 of their three-word runs."""
    found = _posting_duplicates(spark, sf)
    links = materialize(found.links(), "links")
    return found.pairs(links).select(F.col("id_a").alias("job_a"), F.col("id_b").alias("job_b"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each job with its class of equal contents, named by the class's least job, and the number of classes linked to it."""
    found = _posting_duplicates(spark, sf)
    links = materialize(found.links(), "links")
    return found.classes(links).select(F.col("id").alias("job_id"), F.col("first").alias("class_id"), "copies", "links")


def _posting_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, RepeatedLines]:
    jobs = table(spark, sf, "boards_jobs").select("job_id", "company_board", "description_text")
    return jobs, RepeatedLines(jobs, F.col("company_board"), F.col("job_id"), F.col("description_text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in at least 5 and a fifth of the jobs of one board."""
    _, lines = _posting_lines(spark, sf)
    return lines.found().select(F.col("source").alias("company_board"), F.col("key").alias("line_key"))


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Each posting without the lines repeated on its board."""
    jobs, lines = _posting_lines(spark, sf)
    clean = without_lines(jobs, "company_board", "description_text", materialize(lines.found(), "lines"))
    return clean.select("job_id", "company_board", "text_clean", "lines_removed")


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document; empty lists for empty and null texts."""
    return _encoded(spark, sf).select(F.col("key").alias("doc_id"), "ids")


def p7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, characters and different texts as decoded from the ids alone (null as empty); the table isn't read for them."""
    back = tokens.decode_corpus(materialize(_encoded(spark, sf), "encoded"))
    return back.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"), F.count_distinct(F.xxhash64("text")).alias("texts"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, tokens) of every document."""
    docs = table(spark, sf, "documents")
    key = F.struct("doc_id", "source")
    counted = tokens.count_tokens(docs, key, F.col("text"))
    return materialize(counted.select("key.doc_id", "key.source", "tokens"), "sizes")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Each use of a document in the mix, copies counted from 1."""
    sized = _sized(spark, sf)
    rates = mixture.mixing_rates(sized, table(spark, sf, "mix_targets"))
    return mixture.mixed(sized, rates, F.col("doc_id")).select("doc_id", "source", "tokens", "copy")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    sized = _sized(spark, sf)
    rates = mixture.mixing_rates(sized, table(spark, sf, "mix_targets"))
    return mixture.reached_shares(mixture.mixed(sized, rates, F.col("doc_id")), rates)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with template residue or filler, or made of an error message or notice."""
    return find_residue(table(spark, sf, "documents"), F.col("doc_id"), F.col("text")).select(F.col("key").alias("doc_id")).distinct()


def p9_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents are flagged for each reason."""
    found = find_residue(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict:
    return {
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p5_found": p5_found,
        "p5_clean": p5_clean,
        "p7_ids": p7_ids,
        "p7_roundtrip": p7_roundtrip,
        "p8_mix": p8_mix,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_reasons": p9_reasons,
    }


_LINES = r"""
j AS (SELECT DISTINCT company_board, job_id, replace(description_text, chr(13) || chr(10), chr(10)) AS t FROM boards_jobs), n AS (SELECT company_board, count(DISTINCT job_id) AS n FROM j GROUP BY ALL),
l AS (SELECT DISTINCT company_board, job_id, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '#', 'g'), '[^\p{L}\p{Nd}#]+', ' ', 'g')) AS line_key FROM (SELECT company_board, job_id, unnest(string_split(t, chr(10))) AS x FROM j WHERE t IS NOT NULL)),
f AS (SELECT company_board, line_key FROM l JOIN n USING (company_board) WHERE line_key <> '' GROUP BY company_board, line_key, n.n HAVING count(*) >= 5 AND count(*) * 5 >= n.n)"""

# Lines are cut at line feeds and put together again, so a return before a line feed stays with its line.
_CLEAN = r"""
, d AS (SELECT row_number() OVER () AS r, job_id, company_board, description_text FROM boards_jobs),
x AS (SELECT r, company_board, unnest(range(len(a))) AS nr, unnest(a) AS line FROM (SELECT r, company_board, string_split(description_text, chr(10)) AS a FROM d WHERE description_text IS NOT NULL)),
k AS (SELECT x.*, f.line_key IS NOT NULL AS gone FROM x LEFT JOIN f ON f.company_board = x.company_board
  AND f.line_key = trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[^\p{L}\p{Nd}#]+', ' ', 'g'))),
t AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '') AS text_clean, count(*) FILTER (gone) AS lines_removed FROM k GROUP BY r)
SELECT d.job_id, d.company_board, t.text_clean, CAST(coalesce(t.lines_removed, 0) AS INTEGER) AS lines_removed FROM d LEFT JOIN t USING (r)"""

_SHARES = r"""
j AS (SELECT DISTINCT job_id, regexp_extract_all(lower(concat_ws(' ', title, description_text, array_to_string(locations, ' '))), '[\p{{L}}\p{{N}}]+') AS w FROM boards_jobs WHERE description_text IS NOT NULL),
{sets}, n AS (SELECT {id}, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT x.{id} AS a, y.{id} AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.{id} < y.{id} GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n q ON q.{id} = a JOIN n r ON r.{id} = b WHERE c / (q.n + r.n - c) >= 0.45)"""
_RUNS = "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]"
_PAIRS = "WITH " + _SHARES.format(id="job_id", sets=f"s AS (SELECT DISTINCT job_id, {_RUNS} AS g FROM (SELECT job_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM j))") + " SELECT a AS job_a, b AS job_b FROM l"
_CLASSES = "WITH " + _SHARES.format(
    id="class_id",
    sets=f"""o AS (SELECT job_id, list_sort(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: {_RUNS}))) AS v FROM j WHERE len(w) > 2),
e AS (SELECT v, min(job_id) AS class_id, count(DISTINCT job_id) AS copies FROM o GROUP BY v), s AS (SELECT class_id, unnest(v) AS g FROM e)""",
) + """, h AS (SELECT c AS class_id, count(*) AS links FROM (SELECT a AS c FROM l UNION ALL SELECT b FROM l) GROUP BY c)
SELECT DISTINCT o.job_id, e.class_id, e.copies, coalesce(h.links, 0) AS links FROM o JOIN e USING (v) LEFT JOIN h USING (class_id)"""


def sql() -> dict[str, str]:
    """SQL twins over whole tables; the other queries are tested against brute force."""
    return {
        "p4_found": _PAIRS,
        "p4_classes": _CLASSES,
        "p5_found": f"WITH {_LINES} SELECT * FROM f",
        "p5_clean": f"WITH {_LINES}{_CLEAN}",
        "p7_roundtrip": "SELECT count(*) AS documents, sum(length(coalesce(text, ''))) AS characters, count(DISTINCT coalesce(text, '')) AS texts FROM documents",
    }
