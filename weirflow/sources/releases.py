"""Nested procurement releases and lists of names with aliases as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = "struct<amount: double, currency: string>"
RELEASE = (
    "ocid string, id string, date string, tag array<string>, buyer struct<id: string, name: string>, parties array<struct<id: string, name: string, roles: array<string>>>, "
    f"tender struct<title: string, status: string, procuringEntity: struct<id: string, name: string>, value: {_VALUE}, tenderPeriod: struct<endDate: string>, items: array<struct<classification: struct<scheme: string, id: string>>>>, "
    f"awards array<struct<status: string, value: {_VALUE}, suppliers: array<struct<id: string, name: string>>>>"
)


def party_name(parties: Column, ref: Column) -> Column:
    """The name that a reference bears, else that of the party it points to."""
    held = F.filter(parties, lambda p: p["id"] == ref["id"])
    return F.coalesce(F.nullif(F.trim(ref["name"]), F.lit("")), F.get(held, 0)["name"])


def release_rows(df: DataFrame, column: str) -> DataFrame:
    """One row a release: the other columns of ``df``, kind, title, buyer, suppliers, codes, amount and currency.

    The kind is that of the last stage reached: award, tender or planning by
    its tags. Amounts are those of the awards if they are in one currency, else
    of the tender. Texts that are no release, or have no id, give no row.
    """
    keep = [c for c in df.columns if c != column]
    r = F.col("__r")
    parsed = df.select(*keep, F.from_json(column, RELEASE).alias("__r")).where(F.coalesce(r["ocid"], F.lit("")) != "")
    tags = F.coalesce(r["tag"], F.array().cast("array<string>"))
    has = lambda *names: F.exists(tags, lambda t: t.isin(*names))
    kind = F.when(has("award", "awardUpdate", "contract"), "award").when(has("tender", "tenderUpdate", "tenderAmendment"), "tender").when(has("planning"), "planning").otherwise("other")
    given = F.filter(F.coalesce(r["awards"], F.array().cast(f"array<struct<status: string, value: {_VALUE}, suppliers: array<struct<id: string, name: string>>>>")), lambda a: F.coalesce(a["status"], F.lit("")) != "cancelled")
    suppliers = F.flatten(F.transform(given, lambda a: F.coalesce(a["suppliers"], F.array().cast("array<struct<id: string, name: string>>"))))
    amounts = F.filter(F.transform(given, lambda a: a["value"]), lambda v: v["amount"] > 0)
    one = F.size(F.array_distinct(F.transform(amounts, lambda v: v["currency"]))) == 1
    codes = F.transform(F.filter(r["tender"]["items"], lambda i: i["classification"]["id"].isNotNull()), lambda i: F.regexp_replace(i["classification"]["id"], "[^0-9]", ""))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(suppliers, lambda s: party_name(r["parties"], s)), lambda n: n.isNotNull())))
    return parsed.select(
        *keep, r["ocid"].alias("ocid"), kind.alias("kind"), r["tender"]["title"].alias("title"), F.coalesce(party_name(r["parties"], r["buyer"]), party_name(r["parties"], r["tender"]["procuringEntity"])).alias("buyer"),
        names.alias("suppliers"), F.array_sort(F.array_distinct(F.coalesce(codes, F.array().cast("array<string>")))).alias("codes"),
        F.when(one, F.aggregate(amounts, F.lit(0.0), lambda acc, v: acc + v["amount"])).otherwise(r["tender"]["value"]["amount"]).alias("amount"),
        F.when(one, F.get(amounts, 0)["currency"]).otherwise(r["tender"]["value"]["currency"]).alias("currency"),
    )


# One entry of each list as its publisher writes it, and where uid, name and aliases stand in it.
LISTS = {
    "eu": ("_logicalId string, nameAlias array<struct<_wholeName: string, _strong: string>>", "__e._logicalId", "transform(__e.nameAlias, n -> n._wholeName)"),
    "uk": ("UniqueID string, Names struct<Name: array<struct<Name6: string, NameType: string>>>", "__e.UniqueID", "transform(array_sort(__e.Names.Name, (a, b) -> case when a.NameType = b.NameType then 0 when a.NameType = 'Primary Name' then -1 when b.NameType = 'Primary Name' then 1 else 0 end), n -> n.Name6)"),
    "un": ("DATAID string, FIRST_NAME string, SECOND_NAME string, INDIVIDUAL_ALIAS array<struct<ALIAS_NAME: string>>", "__e.DATAID", "concat(array(nullif(trim(concat_ws(' ', __e.FIRST_NAME, __e.SECOND_NAME)), '')), coalesce(transform(__e.INDIVIDUAL_ALIAS, a -> a.ALIAS_NAME), array()))"),
}


def list_rows(df: DataFrame, source: str, column: str) -> DataFrame:
    """(other columns, uid, name, aliases) of XML entries of a list; the first name is the main one, repeats are left out."""
    schema, uid, names = LISTS[source]
    keep = [c for c in df.columns if c != column]
    parsed = df.select(*keep, F.from_xml(column, schema).alias("__e"))
    tidy = F.filter(F.transform(F.expr(names), lambda n: F.trim(n)), lambda n: F.coalesce(n, F.lit("")) != "")
    held = parsed.select(*keep, F.expr(uid).cast("string").alias("uid"), F.array_distinct(tidy).alias("n")).where(F.col("uid").isNotNull() & (F.size("n") > 0))
    return held.select(*keep, "uid", F.get("n", 0).alias("name"), F.slice("n", F.lit(2), F.size("n")).alias("aliases"))


def with_aliases(names: DataFrame, aliases: DataFrame, key: str, name: str) -> DataFrame:
    """The main list with the sorted alternative names of the same key, none as an empty list."""
    held = aliases.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "").groupBy(key).agg(F.array_sort(F.collect_set(F.trim(F.col(name)))).alias("aliases"))
    return names.join(held, key, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
