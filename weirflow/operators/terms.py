"""Detection of many named terms in texts by one automaton, with rules that only hits have to pass.

All aliases of all terms form one Aho-Corasick automaton, so a text is read
once whatever the number of terms. A hit must stand between boundaries and, for
terms spelled like common words, in the term's own case; weak terms count only
beside a strong one. What the found terms exclude and imply follows by joins
with tables as small as the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weirflow.operators.rules import closure

MAX_ALIASES = 100_000


@dataclass(frozen=True)
class Term:
    """``aliases`` name ``name``; ``exact`` ones only in their own case, ``weak`` ones only beside a strong term of the same text."""

    name: str
    aliases: tuple[str, ...]
    exact: bool = False
    weak: bool = False
    implies: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether the stretch is no part of a longer word, as in C++, .NET or node.js."""
    if start and (text[start - 1].isalnum() or text[start - 1] in "_#+.@"):
        return False
    if end < len(text):
        after = text[end]
        if after.isalnum() or after in "_#+" or after == "." and end + 1 < len(text) and text[end + 1].isalnum():
            return False
    return True


def find_terms(text: str, automaton, terms: Sequence[Term]) -> dict[int, str]:
    """Number of each term named in the text, with the wording that names it first; weak ones alone are none."""
    low = text.lower()
    if len(low) != len(text):  # a few characters change their length in lower case; places then don't fit
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found: dict[int, str] = {}
    for last, hits in automaton.iter(low):
        for number, alias in hits:
            start = last + 1 - len(alias)
            if number not in found and _bounded(text, start, last + 1) and (not terms[number].exact or text[start : last + 1] == alias):
                found[number] = text[start : last + 1]
    if all(terms[n].weak for n in found):
        return {}
    return found


def automaton_of(terms: Sequence[Term]):
    import ahocorasick

    by_alias: dict[str, list[tuple[int, str]]] = {}
    for number, term in enumerate(terms):
        for alias in term.aliases:
            by_alias.setdefault(alias.lower(), []).append((number, alias))
    built = ahocorasick.Automaton()
    for alias, hits in by_alias.items():
        built.add_word(alias, tuple(hits))
    built.make_automaton()
    return built


def _named(batches: Iterator[pa.RecordBatch], terms: Sequence[Term], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    built = automaton_of(terms)
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if text:
                rows += [(key, terms[n].name, worded) for n, worded in find_terms(text, built, terms).items()]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["key", "name", "worded"])


def detect_terms(df: DataFrame, key: Column, text: Column, terms: Sequence[Term]) -> DataFrame:
    """(key, name, worded, implied) of the terms named in each text, less excluded ones, with what the rest imply.

    ``worded`` is the wording seen, null where a term is only implied. Null and
    empty texts name nothing; repeated rows with equal keys count once.
    """
    if sum(len(t.aliases) for t in terms) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    rows = df.select(key.alias("key"), text.alias("text"))
    field = rows.schema["key"].dataType
    if not terms:
        return df.sparkSession.createDataFrame([], f"key {field.simpleString()}, name string, worded string, implied boolean")
    named = rows.mapInArrow(partial(_named, terms=tuple(terms), kind=to_arrow_type(field)), f"key {field.simpleString()}, name string, worded string")
    named = named.groupBy("key", "name").agg(F.min("worded").alias("worded"))
    against = sorted({(t.name, x) for t in terms for x in t.excludes})
    if against:
        table = df.sparkSession.createDataFrame(against, "name string, other string")  # no more rows than the dictionary names
        out = named.join(F.broadcast(table), "name").select("key", F.col("other").alias("name")).distinct()
        named = named.join(out, ["key", "name"], "left_anti")
    found = named.withColumn("implied", F.lit(False))
    follows = sorted((a, b) for a, bs in closure({t.name: set(t.implies) for t in terms}).items() for b in bs)
    if follows:
        table = df.sparkSession.createDataFrame(follows, "name string, other string")
        more = found.join(F.broadcast(table), "name").select("key", F.col("other").alias("name"), F.lit(None).cast("string").alias("worded"), F.lit(True).alias("implied"))
        found = found.unionByName(more).groupBy("key", "name").agg(F.min("worded").alias("worded"), F.bool_and("implied").alias("implied"))
    return found


def suggest_terms(asked: str, terms: Sequence[Term], most: int = 5) -> list[str]:
    """Names of the terms that a question may mean: equal aliases first, then those that begin with it, then those that hold it."""
    low = asked.strip().lower()
    if not low:
        return []

    def rank(term: Term) -> int | None:
        forms = [a.lower() for a in (term.name, *term.aliases)]
        if low in forms:
            return 0
        if any(f.startswith(low) for f in forms):
            return 1
        return 2 if any(low in f for f in forms) else None

    ranked = sorted((r, t.name) for t in terms if (r := rank(t)) is not None)
    return [name for _, name in ranked[:most]]
