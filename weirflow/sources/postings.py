"""Records of several posting sources in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTING = ("job_id", "ats", "title", "department", "team", "employment_type", "workplace_type", "locations", "body")


def _shape(df: DataFrame, ats: str, **columns: Column) -> DataFrame:
    held = {"ats": F.lit(ats), "job_id": F.concat(F.lit(f"{ats}:"), F.col("id"))} | columns
    return df.select(*[held[name].alias(name) for name in POSTING]).where(F.col("job_id").isNotNull())


def unified_postings(lever: DataFrame, ashby: DataFrame, pinpoint: DataFrame) -> DataFrame:
    """The postings of three sources; rows without an id and unlisted ones are left out."""
    places = F.transform(F.coalesce("secondarylocations", F.array()), lambda x: x["location"])
    return (
        _shape(
            lever, "lever", title=F.col("text"), department=F.col("categories.department"), team=F.col("categories.team"), employment_type=F.col("categories.commitment"),
            workplace_type=F.col("workplacetype"), locations=F.coalesce("categories.alllocations", F.array("categories.location")), body=F.col("descriptionplain"),
        )
        .unionByName(
            _shape(
                ashby.where(F.coalesce("islisted", F.lit(True))), "ashby", title=F.col("title"), department=F.col("department"), team=F.col("team"), employment_type=F.col("employmenttype"),
                workplace_type=F.col("workplacetype"), locations=F.array_compact(F.concat(F.array("location"), places)), body=F.col("descriptionplain"),
            )
        )
        .unionByName(
            _shape(
                pinpoint, "pinpoint", title=F.col("title"), department=F.col("job.department.name"), team=F.lit(None).cast("string"), employment_type=F.col("employment_type"),
                workplace_type=F.col("workplace_type"), locations=F.array_compact(F.array(F.coalesce("location.name", "location.city"))), body=F.col("description"),
            )
        )
    )
