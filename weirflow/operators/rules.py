"""Rule engines: first matching rule, and detection with confidence, exclusions and implications."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` makes ``name`` present with a confidence; ``literal`` must occur in the text for it to be tried."""

    name: str
    pattern: str
    literal: str = ""
    confidence: int = 100
    implies: Sequence[str] = field(default_factory=tuple)
    excludes: Sequence[str] = field(default_factory=tuple)


def detect(df: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, name, confidence): sums of matching rules up to 100, less excluded names, with what the rest implies.

    Rules are code, at most ``MAX_RULES`` of them, and become one expression
    over each text: no text is joined with the rules. Implications are closed
    on the driver beforehand.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    low = F.lower(F.col(text))
    tries = []
    for rule in rules:
        hit = F.col(text).rlike(rule.pattern)
        if rule.literal:
            hit = low.contains(rule.literal.lower()) & hit
        tries.append(F.when(hit, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.confidence).alias("confidence"))))
    found = df.select(key, F.explode(F.filter(F.array(*tries), lambda x: x.isNotNull())).alias("r")).select(key, "r.name", "r.confidence")
    direct = found.groupBy(key, "name").agg(F.least(F.sum("confidence"), F.lit(100)).cast("int").alias("confidence"))
    against = {(r.name, x) for r in rules for x in r.excludes}
    if against:
        pairs = df.sparkSession.createDataFrame(sorted(against), "by string, name string")
        out = direct.select(key, F.col("name").alias("by")).join(F.broadcast(pairs), "by").select(key, "name").distinct()
        direct = direct.join(out, [key, "name"], "left_anti")
    return _expanded(direct, key, implications(rules))


def implications(rules: Sequence[Rule]) -> dict[str, set[str]]:
    """All that each name implies, directly or through others."""
    direct: dict[str, set[str]] = {}
    for rule in rules:
        direct.setdefault(rule.name, set()).update(rule.implies)
    return closure(direct)


def closure(implies: dict[str, set[str]]) -> dict[str, set[str]]:
    closed = {k: set(v) for k, v in implies.items()}
    changed = True
    while changed:
        changed = False
        for name, targets in closed.items():
            more = set().union(*(closed.get(t, set()) for t in targets), targets) - {name}
            if more - targets:
                closed[name] = targets | more
                changed = True
    return closed


def _expanded(direct: DataFrame, key: str, closed: dict[str, set[str]]) -> DataFrame:
    rows = sorted((a, b) for a, bs in closed.items() for b in bs)
    if not rows:
        return direct
    table = direct.sparkSession.createDataFrame(rows, "name string, other string")
    more = direct.join(F.broadcast(table), "name").select(key, F.col("other").alias("name"), "confidence")
    return direct.unionByName(more).groupBy(key, "name").agg(F.max("confidence").alias("confidence"))


def provider_of(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first (pattern, label) that matches; null for none."""
    found = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        found = F.when(value.rlike(pattern), label).otherwise(found)
    return found
