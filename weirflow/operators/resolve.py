"""Entity resolution: token joins, same-entity edges and connected components."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.text import fold_accents
from weirflow.session import materialize

# Words that tell no two organisations apart.
NAME_STOP = ("THE", "OF", "AND", "CO", "COMPANY", "CORP", "CORPORATION", "LTD", "LIMITED", "LLC", "INC", "SA", "JSC", "OOO", "GMBH")
SPELLED_AT_ONCE = 1_000_000  # parameter of the work's division only: results don't depend on it


def name_norm(name: Column) -> Column:
    upper = F.upper(fold_accents(F.coalesce(name, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(upper, "[^A-Z0-9 ]", " "), " +", " "))


def name_tokens(name: Column) -> Column:
    stop = F.array(*map(F.lit, NAME_STOP))
    return F.array_distinct(F.filter(F.split(name_norm(name), " "), lambda t: (t != "") & ~F.array_contains(stop, t)))


def _named(rows: DataFrame, id_: str, name: str, repeats: str) -> DataFrame:
    """(id, name, repeats): the different names of each id as compared, and how often the id has each.

    Rows are dealt by id first, so that a table in few files is normalised by all tasks.
    """
    return rows.repartition(id_).groupBy(F.col(id_), name_norm(F.col("name")).alias(name)).agg(F.count(F.lit(1)).alias(repeats))


def alike_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(qn, mq, cn, mc, lq, lc, score): each pair of different names once, with the ids that have them.

    Pairs come from an equi-join on tokens; a name that an id has ``m`` times
    counts its tokens as often.
    """
    # Outer, as explode would have Spark look for tokens in every row of the tables, before names are told apart; a null token meets none.
    names = left.groupBy("qn", "mq").agg(F.count(F.lit(1)).alias("lq")).withColumn("ts", name_tokens(F.col("qn")))
    others = right.groupBy("cn", "mc").agg(F.count(F.lit(1)).alias("lc")).withColumn("ts", name_tokens(F.col("cn")))
    at_left = names.select("qn", "mq", "lq", F.size("ts").alias("nq"), F.explode_outer("ts").alias("t"))
    at_right = others.select("cn", "mc", "lc", F.size("ts").alias("nc"), F.explode_outer("ts").alias("t"))
    shared = at_left.join(at_right, "t").groupBy("qn", "mq", "cn", "mc", "lq", "lc", "nq", "nc").agg(F.count(F.lit(1)).alias("n"))
    shared = shared.withColumn("n", F.col("n") * F.col("mq") * F.col("mc"))
    union = F.col("nq") + F.col("nc") - F.col("n")  # 0 for some names that an id has twice; SQL divides by it
    both = F.lit(0.6) * F.col("n") / F.least("nq", "nc") + F.coalesce(F.try_divide(F.lit(0.4) * F.col("n"), union), F.lit(float("inf")))
    score = F.when(F.col("qn") == F.col("cn"), 1.0).otherwise(F.round(both, 3))
    return shared.select("qn", "mq", "cn", "mc", "lq", "lc", score.alias("score")).where(F.col("score") >= threshold)


def screen_names(queries: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """(q, c, score): names alike by their tokens, 1 for equal names.

    ``queries`` has (q, name), ``candidates`` (c, name). Different names are
    compared once, however many ids have them; only pairs of names that reach
    the threshold are spelled out for their ids, by a last join whose rows are
    the result. The ids of a name that makes many rows are dealt over slices of
    about ``SPELLED_AT_ONCE`` rows.
    """
    left, right = _named(queries, "q", "qn", "mq"), _named(candidates, "c", "cn", "mc")
    alike = materialize(alike_names(left, right, threshold), "names-alike")
    rows = F.sum(F.col("lq") * F.col("lc").cast("double"))
    spelled = alike.groupBy("cn", "mc").agg(F.least(F.max("lc"), F.ceil(rows / SPELLED_AT_ONCE)).alias("slices"))
    asking = left.join(alike.select("qn", "mq", "cn", "mc", "score"), ["qn", "mq"]).join(spelled, ["cn", "mc"])
    asking = asking.select("cn", "mc", "q", "score", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    dealt = right.join(spelled, ["cn", "mc"]).select("cn", "mc", "c", F.pmod(F.xxhash64("c"), "slices").alias("slice"))
    # Both sides are small and what they make is not: partitions go by the rows made, and neither side may be joined where it stands.
    made = alike.agg(rows.alias("n")).first().n or 0
    parts, keys = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(made / SPELLED_AT_ONCE)), ("cn", "mc", "slice")
    return dealt.repartition(parts, *keys).join(asking.repartition(parts, *keys).hint("merge"), list(keys)).select("q", "c", "score")


def overlap_edges(members: DataFrame, block: str, node: str, item: str, least: int, share: float) -> DataFrame:
    """(a, b): nodes of one block that have ``least`` items or ``share`` of the smaller's items in common.

    A pair must share an item among the rarest ones of its smaller node, all
    but as many as the overlap it needs less one: only these look for partners,
    so an item that a large part of all nodes hold makes pairs only of nodes
    that have hardly any other. Candidates are checked on their whole sets.
    """
    rows = members.select(F.col(block).alias("__b"), F.col(node).alias("__n"), F.col(item).alias("__i")).where(F.col("__i").isNotNull()).distinct()
    rows = materialize(rows, "members")
    held = rows.groupBy("__b", "__i").agg(F.count(F.lit(1)).alias("__held"))
    size = F.count(F.lit(1)).over(Window.partitionBy("__b", "__n"))
    order = Window.partitionBy("__b", "__n").orderBy("__held", "__i")
    ranked = rows.join(held, ["__b", "__i"]).select("__b", "__n", "__i", size.alias("__size"), F.row_number().over(order).alias("__at"))
    ranked = materialize(ranked, "ranked-members")
    needed = F.least(F.lit(least), F.greatest(F.lit(1), F.ceil(F.col("__size") * F.lit(share) - 1e-9)))
    first = ranked.where(F.col("__at") <= F.col("__size") - needed + 1).select("__b", "__i", F.col("__n").alias("a"), F.col("__size").alias("na"))
    others = ranked.select("__b", "__i", F.col("__n").alias("b"), F.col("__size").alias("nb"))
    pairs = first.join(others, ["__b", "__i"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = materialize(pairs.select("__b", "a", "b", "na", "nb").distinct(), "pairs")
    sets = rows.groupBy("__b", "__n").agg(F.collect_list("__i").alias("__s"))
    x, y = sets.select("__b", F.col("__n").alias("a"), F.col("__s").alias("sa")), sets.select("__b", F.col("__n").alias("b"), F.col("__s").alias("sb"))
    n = F.size(F.array_intersect("sa", "sb"))
    alike = pairs.join(x, ["__b", "a"]).join(y, ["__b", "b"]).where((n >= least) | (n >= F.col("na") * share))
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node is linked with, directly or through others.

    Alternating large-star and small-star steps. Each round's edges are written
    to the shared folder, which cuts the lineage; only their number and a
    checksum come to the driver. The rounds grow with the logarithm of the
    number of nodes; not to have converged after ``most_rounds`` is an error.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    mark = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        links = materialize(small, "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    out = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(roots, F.col("node") == F.col("u"), "left")
    return out.select("node", F.coalesce("component", F.col("node")).alias("component"))
