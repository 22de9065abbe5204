"""Keyword relevance, rank order, top-k and continuation by key."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.text import STOPWORDS, folded, search_text
from weirflow.operators.filters import all_of
from weirflow.session import materialize


def compile_keyword(keyword: str) -> tuple[str, list[str]]:
    """The normalised phrase, and its words without stop words unless all are."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", keyword) if not unicodedata.combining(c))
    phrase = re.sub("[^a-z0-9+#]+", " ", bare.lower()).strip()
    tokens = [w for w in phrase.split(" ") if w]
    return phrase, [w for w in tokens if w not in STOPWORDS] or tokens


def _at_word_start(text: Column, phrase: str) -> Column:
    return F.concat(F.lit(" "), text).contains(f" {phrase}")


def _forms(token: str) -> list[str]:
    return [token, f"{token}s", f"{token}es"]


def _has_words(held: Column, tokens: Sequence[str], everywhere: Column | None = None) -> Column:
    """Whether each token or its plural is a word of ``held``; in ``everywhere`` stop words and single characters are no words."""

    def one(token: str) -> Column:
        word = lambda forms: r"(?:^|[^a-z0-9+#])(?:" + "|".join(map(re.escape, forms)) + r")(?:$|[^a-z0-9+#])"
        # All forms begin with the token: texts without it need no expression.
        found = held.contains(token) & held.rlike(word(_forms(token)))
        telling = [f for f in _forms(token) if len(f) > 1 and f not in STOPWORDS]
        return found | (everywhere.contains(token) & everywhere.rlike(word(telling))) if everywhere is not None and telling else found

    return all_of(one(t) for t in tokens)


def ranked(
    df: DataFrame, keywords: Sequence[str], title: Column, unit: Sequence[Column], text: Column | None = None, every: bool = False
) -> DataFrame:
    """Rows that match, with ``match_score`` and ``matched_in``.

    Each keyword counts at its best place: title (the phrase at a word's
    start), unit (the phrase, or all its words or their plurals), text (all its
    words in title, unit or text, which is read whole). Base 90 for all in the
    title, 60 for some, 40 for the unit, 20 for the text, plus up to 10 for the
    share of keywords met. ``every`` asks for all keywords. Without keywords
    all rows pass with nulls. Texts are only looked through for words, and only
    where title and unit don't decide.
    """
    compiled = [k for k in map(compile_keyword, keywords) if k[0]]
    if not compiled:
        return df.withColumns({"match_score": F.lit(None).cast("int"), "matched_in": F.lit(None).cast("string")})
    whole = F.concat_ws(" ", folded(F.concat_ws(" ", *unit)), folded(text)) if text is not None else F.lit("")
    # A generator of one row keeps the optimiser from computing the texts anew for every keyword.
    held = F.struct(search_text(title).alias("title"), search_text(F.concat_ws(" ", *unit)).alias("unit"), whole.alias("text"))
    df = df.withColumn("__held", F.explode(F.array(held)))
    titles, units, texts = (F.col(f"__held.{x}") for x in ("title", "unit", "text"))
    places = []
    for phrase, tokens in compiled:
        by_unit = _at_word_start(units, phrase) | _has_words(units, tokens)
        place = F.when(_at_word_start(titles, phrase), 3).when(by_unit, 2)
        if text is not None:
            place = place.when(_has_words(titles, tokens, texts), 1)
        places.append(place.otherwise(0))
    df = df.withColumn("__places", F.explode(F.array(F.array(*places))))
    count = lambda n: F.size(F.filter("__places", lambda p: p == n))
    hits, total = F.size(F.filter("__places", lambda p: p > 0)), len(compiled)
    base = F.when(count(3) == total, 90).when(count(3) > 0, 60).when(count(2) > 0, 40).otherwise(20)
    where = F.when(count(3) > 0, "title").when(count(2) > 0, "department").otherwise("description")
    passed = df.where(hits == total if every else hits > 0)
    scored = passed.withColumns({"match_score": (base + F.floor(F.lit(10.0) * hits / total + 0.5)).cast("int"), "matched_in": where})
    return scored.drop("__held", "__places")


def word_points(text: Column, keywords: Sequence[str], points: int) -> Column:
    """Points for each keyword, or its plural, that stands in the lower-case text as whole words."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.when(text.rlike(rf"\b{re.escape(k.lower())}s?\b"), points).otherwise(0)
    return total


def additive(points: Sequence[tuple[Column, int]]) -> Column:
    """The sum of the points of the conditions that hold."""
    total = F.lit(0)
    for condition, n in points:
        total = total + F.when(condition, n).otherwise(0)
    return total


def rank_order(score: str = "match_score", at: str = "posted_at", key: str = "job_id") -> list[Column]:
    """Score first, then newest, then key: a total order where keys differ. Nulls last."""
    return [F.coalesce(F.col(score), F.lit(-1)).desc(), F.col(at).desc_nulls_last(), F.col(key).asc()]


def newest_order(at: str = "posted_at", key: str = "job_id") -> list[Column]:
    return [F.col(at).desc_nulls_last(), F.col(key).asc()]


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def after_key(df: DataFrame, score: int | None, at: object, key: str, names: tuple[str, str, str] = ("match_score", "posted_at", "job_id")) -> DataFrame:
    """Rows strictly behind the last one of the page before, in rank order; a null moment sorts behind all others."""
    s, t, k = (F.col(n) for n in names)
    own = F.coalesce(s, F.lit(-1))
    bound = F.lit(-1 if score is None else score)
    if at is None:
        later = t.isNull() & (k > key)
    else:
        moment = F.lit(at).cast("timestamp_ntz") if df.schema[names[1]].dataType.typeName() == "timestamp_ntz" else F.lit(at).cast("timestamp")
        later = t.isNull() | (t < moment) | ((t == moment) & (k > key))
    return df.where((own < bound) | ((own == bound) & later))


def capped(df: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group, in the given order."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= most).drop("__n")


def round_robin(df: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """The first row of every group, then the second ones, up to the limit."""
    window = Window.partitionBy(group).orderBy(key)
    turn = df.withColumn("turn", F.row_number().over(window)).where(F.col("turn") <= limit)
    return turn.orderBy("turn", F.col(group).asc_nulls_first(), key).limit(limit)


def rotated(df: DataFrame, key: str, day: int) -> DataFrame:
    """Place of each row when the list, ordered by its key, begins at another one every day.

    Rows are ordered in ranges: places count on from the sizes of the ranges
    before, of which there are as many as partitions, so no task orders all.
    Keys must differ and be few enough a range; nulls come first.
    """
    ranged = materialize(df.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, n = [], 0
    for number in sorted(sizes):
        starts.append((number, n))
        n += sizes[number]
    before = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    placed = ranged.join(F.broadcast(before), "__range").withColumn("place", F.col("__start") + nth)
    return placed.withColumn("place", F.pmod(F.col("place") - F.lit(day % max(n, 1)), F.lit(max(n, 1)))).drop("__range", "__start")
