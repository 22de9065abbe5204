"""Group aggregates with nested top lists, shares, streaks and shared terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested_top(df: DataFrame, group: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """(group, out): the ``n`` most frequent values, as text `value (count)` in order; ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*group).orderBy(F.col("__c").desc(), F.col(value))
    top = counts.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    shown = F.concat(F.col(value), F.lit(" ("), F.col("__c").cast("string"), F.lit(")"))
    listed = top.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__n", shown.alias("v")))).alias("__l"))
    return listed.select(*group, F.array_join(F.transform("__l", lambda x: x["v"]), "; ").alias(out))


def cross_board_openings(df: DataFrame, company: str, opening: str, board: str) -> DataFrame:
    """(company, openings): copies of an opening on other boards count once, repeats on one board each."""
    per_board = df.groupBy(company, opening, board).agg(F.count(F.lit(1)).alias("__c"))
    per_key = per_board.groupBy(company, opening).agg(F.max("__c").alias("__m"))
    return per_key.groupBy(company).agg(F.sum("__m").alias("openings"))


def counted_openings(df: DataFrame, company: str, opening: str, board: str, id_: str) -> DataFrame:
    """The rows that count towards the openings: with boards in order, those beyond the most that any earlier board had."""
    per_board = df.groupBy(company, opening, board).agg(F.count(F.lit(1)).alias("__c"))
    earlier = Window.partitionBy(company, opening).orderBy(board).rowsBetween(Window.unboundedPreceding, -1)
    had = per_board.withColumn("__had", F.coalesce(F.max("__c").over(earlier), F.lit(0))).drop("__c")
    nth = Window.partitionBy(company, opening, board).orderBy(id_)
    rows = df.withColumn("__n", F.row_number().over(nth)).join(had, [company, opening, board])
    return rows.where(F.col("__n") > F.col("__had")).drop("__n", "__had")


def shared_terms(df: DataFrame, group: str, id_: str, tokens: Column, share: float = 0.6, least: int = 3) -> DataFrame:
    """(group, term, records): terms of at least ``share`` of a group's records, in groups of ``least`` and more."""
    sizes = df.groupBy(group).agg(F.count_distinct(id_).alias("__size"))
    each = df.select(group, id_, F.explode(F.array_distinct(tokens)).alias("term")).distinct()
    counts = each.groupBy(group, "term").agg(F.count(F.lit(1)).alias("records"))
    return counts.join(sizes, group).where((F.col("__size") >= least) & (F.col("records") >= F.col("__size") * share)).drop("__size")


def boilerplate(df: DataFrame, group: str, id_: str, text: str, chars: int = 80, share: float = 0.5, least: int = 3) -> DataFrame:
    """(group, paragraph, records): paragraphs of ``chars`` and more that recur within a group."""
    sizes = df.groupBy(group).agg(F.count_distinct(id_).alias("__size"))
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda p: F.trim(p))
    each = df.select(group, id_, F.explode(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= chars))).alias("paragraph")).distinct()
    counts = each.groupBy(group, "paragraph").agg(F.count(F.lit(1)).alias("records"))
    bar = F.greatest(F.lit(least), F.ceil(F.col("__size") * share))
    return counts.join(sizes, group).where(F.col("records") >= bar).drop("__size")


def live_groups(df: DataFrame, group: str, at: str, days: int) -> DataFrame:
    """Rows of groups whose newest moment lies within ``days`` of the newest of all."""
    newest = df.groupBy(group).agg(F.max(at).alias("__newest"))
    last = newest.agg(F.max("__newest").alias("__last"))
    # One row on the right: the newest moment of all.
    live = newest.join(F.broadcast(last)).where(F.col("__newest") >= F.col("__last") - F.expr(f"INTERVAL {int(days)} DAYS")).select(group)
    return df.join(live, group, "left_semi")


def streaks(df: DataFrame, group: str, order: Sequence[Column], failed: Column) -> DataFrame:
    """(group, runs, failures, streak): failures in all, and those before the first success in the given order."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = df.select(group, failed.cast("int").alias("__f"), F.sum((~failed).cast("int")).over(window).alias("__ok"))
    return seen.groupBy(group).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("__f").alias("failures"), F.sum(F.when(F.col("__ok") == 0, F.col("__f")).otherwise(0)).alias("streak")
    )


def against_previous(df: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """``df`` with the value of the group's row before and the difference; null for the first."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(at))
    return df.withColumns({"previous": before, "delta": F.col(value) - before})


def rollups(df: DataFrame, dimensions: Sequence[str], count: str = "n") -> DataFrame:
    """(dimension, value, n) of each dimension by itself, in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("s")
    return df.select(each).groupBy("s.dimension", "s.value").agg(F.count(F.lit(1)).alias(count))


def occurrences(df: DataFrame, target: str, page: str, position: str, label: str, pages: int = 5) -> DataFrame:
    """Per target: first page, different pages, the first few of them, and the first label that isn't empty."""
    held = F.when(F.trim(F.coalesce(F.col(label), F.lit(""))) != "", F.col(label))
    return df.groupBy(target).agg(
        F.min_by(page, position).alias("first_page"), F.count_distinct(page).alias("pages"),
        F.array_join(F.slice(F.array_sort(F.collect_set(page)), 1, pages), ", ").alias("some_pages"),
        F.min_by(held, F.when(held.isNotNull(), F.col(position))).alias("label"),
    )


def voted(df: DataFrame, group: str, choice: str, weight: Column, n: int = 3) -> DataFrame:
    """(group, choice, votes, place): the choices with most weight, ties by name."""
    sums = df.groupBy(group, choice).agg(F.sum(weight).alias("votes"))
    order = Window.partitionBy(group).orderBy(F.col("votes").desc(), F.col(choice))
    return sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def one_currency_total(items: Column) -> Column:
    """The sum of amounts if they are in one currency, else the first amount; zero counts as missing.

    ``items`` is an array of (amount double, currency string).
    """
    held = F.filter(items, lambda x: F.coalesce(x["amount"], F.lit(0.0)) > 0)
    one = F.size(F.array_distinct(F.transform(held, lambda x: x["currency"]))) == 1
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x["amount"])
    return F.when(F.size(held) == 0, None).when(one, total).otherwise(F.get(held, 0)["amount"])
