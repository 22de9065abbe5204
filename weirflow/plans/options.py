"""Validated options of a posting search, compiled into one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.classify import LEVEL_RULES, seniority
from weirflow.functions.dates import within_days
from weirflow.operators import filters, relevance

LEVELS = tuple(label for _, label in LEVEL_RULES)
REMOTE = (None, "remote_only", "onsite_only")


@dataclass(frozen=True)
class SearchOptions:
    """All filters are and-ed, values within one or-ed; empty ones don't filter."""

    keywords: Sequence[str] = ()
    every_keyword: bool = False
    titles_only: bool = False
    sources: Sequence[str] = ()
    remote: str | None = None
    employment_types: Sequence[str] = ()
    levels: Sequence[str] = ()
    posted_within_days: float | None = None
    companies: Sequence[str] = ()
    not_companies: Sequence[str] = ()
    departments: Sequence[str] = ()
    country_codes: Sequence[str] = ()
    places: Sequence[str] = ()
    not_in_title: Sequence[str] = ()
    most_per_company: int | None = None
    limit: int = 100

    def __post_init__(self) -> None:
        if self.remote not in REMOTE:
            raise ValueError(f"remote must be one of {REMOTE}")
        if bad := [x for x in self.levels if x not in LEVELS]:
            raise ValueError(f"unknown levels: {bad}")
        for name in ("limit", "most_per_company", "posted_within_days"):
            if (value := getattr(self, name)) is not None and value <= 0:
                raise ValueError(f"{name} must be positive")
        for f in fields(self):
            if str(f.type).startswith("Sequence") and isinstance(getattr(self, f.name), str):
                raise ValueError(f"{f.name} must be a list")


def predicate(o: SearchOptions, now: Column) -> Column:
    """The filters of the options, cheap ones first, keywords apart."""
    c = F.col
    parts = []
    if o.sources:
        parts.append(filters.one_of(c("ats"), o.sources))
    if o.remote:
        remote = filters.is_remote(c("workplace_type"), c("remote"))
        parts.append(remote if o.remote == "remote_only" else ~remote)
    if o.employment_types:
        parts.append(filters.one_of(c("employment_type"), o.employment_types))
    if o.posted_within_days:
        parts.append(within_days(c("posted_at"), now, o.posted_within_days))
    if o.levels:
        parts.append(filters.one_of(seniority(c("title")), o.levels))
    if o.companies:
        parts.append(filters.any_of(filters.company_is(c("company_name"), c("company_board"), t) for t in o.companies))
    if o.not_companies:
        parts.append(~filters.any_of(filters.company_is(c("company_name"), c("company_board"), t) for t in o.not_companies))
    if o.departments:
        parts.append(filters.contains_any(F.concat(F.coalesce("department", F.lit("")), F.lit(" | "), F.coalesce("team", F.lit(""))), o.departments))
    if o.country_codes or o.places:
        parts.append(filters.in_places(c("country_codes"), c("locations"), o.country_codes, o.places))
    if o.not_in_title:
        parts.append(~filters.contains_any(c("title"), o.not_in_title))
    return filters.all_of(parts)


def search(df: DataFrame, o: SearchOptions, now: Column) -> DataFrame:
    """The best rows in rank order, or the newest without keywords."""
    text = None if o.titles_only else F.col("description_text")
    unit = [] if o.titles_only else [F.col("department"), F.col("team")]
    found = relevance.ranked(df.where(predicate(o, now)), o.keywords, F.col("title"), unit or [F.lit(None).cast("string")], text, o.every_keyword)
    order = relevance.rank_order()
    if o.most_per_company:
        found = relevance.capped(found, "company_board", order, o.most_per_company)
    return relevance.top_k(found, order, o.limit)
