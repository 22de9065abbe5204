"""Mixing of sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SOURCES = 100_000


def mixing_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, rate) of each target source.

    ``sized`` has source and tokens of each record. The total is the largest at
    which every source keeps its share without a record being used more than
    ``max_repeats`` times, so rates are share * total / tokens. A target
    without any tokens can't be met: its rate is 0 and the others' shares of
    the total rise in proportion. Records of other or null sources aren't used.
    """
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    goals = wanted.limit(MAX_SOURCES + 1).collect()
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = F.broadcast(wanted.select("source"))  # at most MAX_SOURCES rows, as checked
    sums = {r.source: r for r in sized.join(names, "source").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    able = [g for g in goals if g.source in sums and (sums[g.source].tokens or 0) > 0]
    total = min((g.max_repeats * sums[g.source].tokens / g.target_share for g in able), default=0.0)
    rows = []
    for g in goals:
        s = sums.get(g.source)
        tokens = int(s.tokens or 0) if s else 0
        rate = min(float(g.max_repeats), g.target_share * total / tokens) if tokens else 0.0
        rows.append((g.source, float(g.target_share), int(g.max_repeats), int(s.docs) if s else 0, tokens, rate))
    schema = "source string, target_share double, max_repeats int, docs long, tokens long, rate double"
    return sized.sparkSession.createDataFrame(rows, schema)


def mixed(sized: DataFrame, rates: DataFrame, key: Column, seed: int = 1) -> DataFrame:
    """``sized`` with ``copy`` from 1: floor(rate) copies of each record and one more with probability of the rest.

    The draw is a hash of seed and key, so it depends on neither order nor
    partitioning. ``rates`` has at most ``MAX_SOURCES`` rows.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**31)) / F.lit(float(2**31))
    small = F.broadcast(rates.select("source", "rate", "max_repeats"))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    each = sized.join(small, "source").withColumn("__n", F.least(copies, F.col("max_repeats")).cast("int")).where(F.col("__n") > 0)
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "rate", "max_repeats")


def reached_shares(mix: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target source: its rate, records and tokens in the mix, and the share reached of all tokens."""
    sums = mix.groupBy("source").agg(F.count(F.lit(1)).alias("mixed_docs"), F.sum("tokens").alias("mixed_tokens"), F.max("copy").alias("most_copies"))
    whole = rates.join(sums, "source", "left").na.fill(0, ["mixed_docs", "mixed_tokens", "most_copies"])
    total = whole.agg(F.sum("mixed_tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0)
    # One row on either side of the join: the total of at most MAX_SOURCES sources.
    return whole.join(F.broadcast(total)).withColumn("share", share).drop("all_tokens")
