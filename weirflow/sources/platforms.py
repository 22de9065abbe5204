"""Payloads of posting platforms as rows of one schema.

Each platform is a description: the type of its payload, the array of jobs in
it, and one expression a canonical field. JSON, XML and HTML payloads pass
through the same projection, so a new platform is a new description.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "title", "department", "location", "employment_type", "posted", "url", "apply_url")


@dataclass(frozen=True)
class Platform:
    """``jobs`` is an expression over the payload `p`; ``fields`` are expressions over one job `j`; ``keep`` says which jobs are open."""

    kind: str
    schema: str
    jobs: str
    fields: dict[str, str]
    keep: str = "true"


PLATFORMS = {
    "greenhouse": Platform(
        "json", "jobs array<struct<id: bigint, title: string, absolute_url: string, first_published: string, updated_at: string, location: struct<name: string>, departments: array<struct<name: string>>>>", "p.jobs",
        {"id": "cast(j.id as string)", "title": "j.title", "department": "try_element_at(j.departments, 1).name", "location": "j.location.name", "posted": "coalesce(j.first_published, j.updated_at)", "url": "j.absolute_url"},
    ),
    "workable": Platform(
        "json", "jobs array<struct<shortcode: string, title: string, url: string, application_url: string, published_on: string, city: string, country: string, department: string, employment_type: string>>", "p.jobs",
        {"id": "j.shortcode", "title": "j.title", "department": "j.department", "location": "nullif(concat_ws(', ', j.city, j.country), '')", "employment_type": "j.employment_type", "posted": "j.published_on", "url": "j.url", "apply_url": "j.application_url"},
    ),
    "recruitee": Platform(
        "json", "offers array<struct<id: bigint, title: string, status: string, careers_url: string, careers_apply_url: string, published_at: string, location: string, department: string, employment_type_code: string>>", "p.offers",
        {"id": "cast(j.id as string)", "title": "j.title", "department": "j.department", "location": "j.location", "employment_type": "j.employment_type_code", "posted": "j.published_at", "url": "j.careers_url", "apply_url": "j.careers_apply_url"},
        keep="j.status = 'published'",
    ),
    "workday": Platform(
        "json", "jobPostings array<struct<title: string, externalPath: string, locationsText: string, postedOn: string, bulletFields: array<string>>>", "p.jobPostings",
        {"id": "coalesce(try_element_at(j.bulletFields, 1), regexp_extract(j.externalPath, '([^/]+)$', 1))", "title": "j.title", "location": "j.locationsText", "posted": "j.postedOn", "url": "j.externalPath"},
    ),
    "personio": Platform(
        "xml", "position array<struct<id: string, name: string, department: string, office: string, employmentType: string, createdAt: string>>", "p.position",
        {"id": "j.id", "title": "j.name", "department": "j.department", "location": "j.office", "employment_type": "j.employmentType", "posted": "j.createdAt"},
    ),
    "teamtailor": Platform(
        "xml", "channel struct<item: array<struct<guid: string, title: string, link: string, pubDate: string>>>", "p.channel.item",
        {"id": "j.guid", "title": "j.title", "posted": "j.pubDate", "url": "j.link"},
    ),
}
# Boards without a feed list their jobs as links in headings, place and unit below.
LISTED = r"(?is)<h[2-4][^>]*>\s*<a[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>\s*</h[2-4]>(.*?)(?=<h[2-4]|\z)"


def payload_rows(df: DataFrame, platform: str, column: str) -> DataFrame:
    """One row a job: the other columns of ``df`` and the canonical fields as text.

    Payloads that aren't of the described shape, jobs without id or title and
    jobs that aren't open give no row; fields that a platform lacks are null.
    """
    keep = [c for c in df.columns if c != column]
    if platform == "jazzhr":
        return _listed(df, column, keep)
    spec = PLATFORMS[platform]
    parse = F.from_json(column, spec.schema) if spec.kind == "json" else F.from_xml(column, spec.schema)
    jobs = df.select(*keep, parse.alias("p")).select(*keep, F.explode(F.expr(spec.jobs)).alias("j")).where(F.coalesce(F.expr(spec.keep), F.lit(False)))
    return _present(jobs.select(*keep, *[F.expr(spec.fields.get(f, "null")).cast("string").alias(f) for f in FIELDS]))


def _listed(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    part = lambda n: F.regexp_extract("block", LISTED, n)
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    blocks = df.select(*keep, F.explode(F.regexp_extract_all(F.col(column), F.lit(LISTED), 0)).alias("block"))
    below = F.regexp_extract_all(part(3), F.lit("(?is)<li[^>]*>(.*?)</li>"), 1)
    made: dict[str, Column] = {"id": F.regexp_extract(part(1), "([^/?#]+)/?(?:[?#].*)?$", 1), "title": bare(part(2)), "location": bare(F.get(below, 0)), "department": bare(F.get(below, 1)), "url": part(1)}
    return _present(blocks.select(*keep, *[made.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS]))


def _present(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
