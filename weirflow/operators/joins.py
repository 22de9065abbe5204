"""Joins with precedence, filling of missing values, cross rates and chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fallback_join(df: DataFrame, dim: DataFrame, keys: Sequence[Column], dim_key: str, values: Sequence[str]) -> DataFrame:
    """``df`` with values of the first of several keys that the dimension knows."""
    held = df
    for n, key in enumerate(keys):
        side = dim.select(F.col(dim_key).alias(f"__k{n}"), F.struct(*values).alias(f"__v{n}"))
        held = held.join(side, key == F.col(f"__k{n}"), "left")
    best = F.coalesce(*[F.col(f"__v{n}") for n in range(len(keys))])
    return held.select(*df.columns, *[best[v].alias(v) for v in values])


def status_by_key(inputs: DataFrame, direct: DataFrame, duplicates: DataFrame, known: DataFrame) -> DataFrame:
    """(input columns, reason): `in_index`, else `duplicate_in_index`, else `not_on_board` for known boards, else `unknown`.

    ``inputs`` has id and board, ``direct`` and ``duplicates`` (id, held_by),
    ``known`` (board). Every input stays, once.
    """
    hits = direct.select("id", F.lit(1).alias("p"), "held_by").unionByName(duplicates.select("id", F.lit(2).alias("p"), "held_by"))
    best = hits.groupBy("id").agg(F.min(F.struct("p", "held_by")).alias("hit"))
    boards = known.select("board").distinct().withColumn("__known", F.lit(True))
    joined = inputs.join(best, "id", "left").join(boards, "board", "left")
    reason = F.when(F.col("hit.p") == 1, "in_index").when(F.col("hit.p") == 2, "duplicate_in_index").when(F.col("__known"), "not_on_board").otherwise("unknown")
    return joined.select(*inputs.columns, reason.alias("reason"), F.col("hit.held_by").alias("held_by"))


def fill_missing(df: DataFrame, details: DataFrame, key: str, gone: str) -> DataFrame:
    """``df`` with its nulls filled from details of the same key; rows whose details are marked ``gone`` are dropped."""
    shared = [c for c in details.columns if c in df.columns and c != key]
    side = details.select(key, F.coalesce(F.col(gone), F.lit(False)).alias("__gone"), *[F.col(c).alias(f"__d_{c}") for c in shared])
    joined = df.join(side, key, "left").where(~F.coalesce(F.col("__gone"), F.lit(False)))
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__d_{c}")).alias(c) if c in shared else F.col(c) for c in df.columns])


def cross_rates(rates: DataFrame, base: str, unit: str = "EUR") -> DataFrame:
    """(day, currency, rate): each currency against ``base`` on the days that have both; ``rates`` are units for one ``unit``."""
    legs = rates.select("day", "currency", "rate")
    if base == unit:
        return legs.select("day", "currency", F.round("rate", 8).alias("rate"))
    own = legs.where(F.col("currency") == base).select("day", F.col("rate").alias("__base"))
    days = own.select("day", F.lit(unit).alias("currency"), F.lit(1.0).alias("rate"))
    quotes = legs.where(F.col("currency") != base).unionByName(days)
    return quotes.join(own, "day").select("day", "currency", F.round(F.col("rate") / F.col("__base"), 8).alias("rate"))


def follow_chain(links: DataFrame, hops: int = 5) -> DataFrame:
    """(start, goal, hops): where each source ends after at most ``hops`` links; one target a source. Loops stop at the limit."""
    at = links.select(F.col("src").alias("start"), F.col("dst").alias("goal"), F.lit(1).alias("hops"))
    for _ in range(hops - 1):
        step = links.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
        at = at.join(step, F.col("goal") == F.col("__s"), "left").select(
            "start", F.coalesce("__d", F.col("goal")).alias("goal"), (F.col("hops") + F.col("__d").isNotNull().cast("int")).alias("hops")
        )
    return at


def late_text(top: DataFrame, wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The wide columns for the few rows chosen on narrow ones; one wide row a key."""
    side = wide.select(key, *columns).dropDuplicates([key])
    return side.join(F.broadcast(top), key) if top.limit(10_001).count() <= 10_000 else top.join(side, key)
