"""Reading of XML, CSV and JSON payloads held in text columns, with failing fast on missing required fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaChange(ValueError):
    """A payload isn't of the documented shape."""


def project_json(df: DataFrame, column: str, schema: str, fields: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Flat columns of a JSON text column; rows that lack a required field are dropped, malformed ones too."""
    parsed = df.withColumn("__r", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    out = parsed.select(*[c for c in df.columns if c != column], *[F.expr(f"__r.{path}").alias(name) for name, path in fields.items()])
    for name in required:
        out = out.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return out


def read_csv_by_header(spark: SparkSession, path: str, required: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Quoted CSV with doubled quotes and line breaks in fields; a missing required column is an error."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", encoding).csv(path)
    if lost := [c for c in required if c not in df.columns]:
        raise SchemaChange(f"columns missing: {', '.join(lost)}")
    return df


def parse_csv_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of CSV lines in a text column."""
    return df.select(*[c for c in df.columns if c != column], F.from_csv(column, schema, {"quote": '"', "escape": '"'}).alias("r")).select("*", "r.*").drop("r")


def parse_xml(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of an XML text column; names without regard to their namespace prefix."""
    bare = F.regexp_replace(column, r"(</?)[A-Za-z][\w.-]*:", "$1")
    return df.select(*[c for c in df.columns if c != column], F.from_xml(bare, schema).alias("r")).select("*", "r.*").drop("r")


def json_ld(df: DataFrame, html: str) -> DataFrame:
    """One row for each JSON-LD block of a page, `@graph` members as rows of their own; broken blocks are left out."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    tidy = F.regexp_replace("__b", r"[\x00-\x1f]+", " ")
    one = df.withColumn("__b", F.explode(blocks)).withColumn("__v", F.try_parse_json(tidy)).where(F.col("__v").isNotNull())
    graph = F.try_variant_get("__v", "$['@graph']", "array<variant>")
    return one.withColumn("block", F.explode(F.coalesce(graph, F.array("__v")))).drop("__b", "__v")
