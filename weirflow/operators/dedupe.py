"""Duplicates with survivorship, merging of repeated keys, and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled_fields(names: Sequence[str], schema) -> Column:
    """How many of the named columns hold something; empty arrays don't."""
    total = F.lit(0)
    for name in names:
        held = F.col(name).isNotNull()
        if schema[name].dataType.typeName() == "array":
            held = held & (F.size(name) > 0)
        total = total + held.cast("int")
    return total


def survivors(df: DataFrame, key: Sequence[Column], order: Sequence[Column], id_: str, out: str = "duplicate_sources") -> DataFrame:
    """The best row of each key with the sorted ids of the others.

    Repeated rows of an id are one, combined before the shuffle. The winner is
    an aggregate, which is combined too, so a key that many rows share costs
    one row a task; the list of the other ids is as long as the key has ids,
    as the result asks for. ``order`` holds values to be greatest first; ties
    fall to the smallest id.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*[F.col(c) for c in df.columns])
    keyed = df.select(*[k.alias(f"__k{i}") for i, k in enumerate(key)], rank.alias("__rank"), row.alias("__row"), F.col(id_).alias("__id"))
    keys = [f"__k{i}" for i in range(len(key))]
    per_id = keyed.groupBy(*keys, "__id").agg(F.max_by("__row", "__rank").alias("__row"), F.max("__rank").alias("__rank"))
    # The greatest rank, then the smallest id: ids of the best rank are aggregated beside it.
    best = per_id.groupBy(*keys).agg(F.max("__rank").alias("__best"), F.array_sort(F.collect_list("__id")).alias("__ids"))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("b.__best").eqNullSafe(F.col("p.__rank"))]
    first = per_id.alias("p").join(best.alias("b"), same)
    win = first.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys]).agg(F.min_by("p.__row", "p.__id").alias("__row"), F.min("p.__id").alias("__id"), F.first("b.__ids").alias("__ids"))
    return win.select("__row.*", F.array_remove("__ids", F.col("__id")).alias(out))


def merge_same_id(df: DataFrame, id_: str, order: Sequence[Column], arrays: Sequence[str]) -> DataFrame:
    """One row an id: the first in order, with the sorted union of the named arrays over all of its rows."""
    first = Window.partitionBy(id_).orderBy(*order)
    rest = [c for c in df.columns if c not in arrays]
    head = df.select(*rest, F.row_number().over(first).alias("__n")).where(F.col("__n") == 1).drop("__n")
    unions = df.groupBy(id_).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(a, F.array().cast("array<string>")))))).alias(a) for a in arrays])
    return head.join(unions, id_)


def cross_source(df: DataFrame, key: Sequence[str], source: str, order: Sequence[Column]) -> DataFrame:
    """Rows less copies from other sources: of each key the source of the best row stays, with all of its rows.

    Rows with a null in the key are never merged.
    """
    complete = ~_any_null(key)
    best = Window.partitionBy(*key).orderBy(*order)
    marked = df.where(complete).withColumn("__source", F.first(source).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = marked.where(F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    return kept.unionByName(df.where(~complete))


def _any_null(names: Sequence[str]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | F.col(name).isNull()
    return found


def upsert(store: DataFrame, fresh: DataFrame, id_: str, first_seen: str) -> DataFrame:
    """The store with fresh rows in place of old ones of the same id, keeping the earlier ``first_seen``."""
    order = Window.partitionBy(id_).orderBy(F.col("__new").desc(), F.col(first_seen).desc())
    both = store.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    seen = F.min(first_seen).over(Window.partitionBy(id_))
    return both.withColumns({"__first": seen, "__n": F.row_number().over(order)}).where("__n = 1").withColumn(first_seen, F.col("__first")).drop("__new", "__first", "__n")
