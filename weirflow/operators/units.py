"""Conversion of quantities between units, by a graph of affine functions.

Units are nodes, known conversions edges y = a*x + b with exact rational
coefficients. The shortest composition from every unit to each canonical target
is computed once on the driver over the unit tables (whose size is checked),
cycles are checked for consistency, and values are converted by an equi-join on
source unit and target.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import materialize

MAX_UNITS = 100_000
FACTORS = "unit string, target string, num double, den double, shift double"


@dataclass(frozen=True)
class Affine:
    """y = slope * x + shift."""

    slope: Fraction
    shift: Fraction = Fraction(0)

    def then(self, other: Affine) -> Affine:
        return Affine(self.slope * other.slope, self.shift * other.slope + other.shift)

    def inverse(self) -> Affine:
        return Affine(1 / self.slope, -self.shift / self.slope)


class ConversionGraph:
    """Units and the affine functions between them; every edge also holds in reverse."""

    def __init__(self) -> None:
        self.edges: dict[str, dict[str, Affine]] = {}

    def add(self, source: str, target: str, slope: Fraction | int | str, shift: Fraction | int | str = 0) -> None:
        """Add an edge. A zero slope, or a second edge that contradicts the first, is an error."""
        edge = Affine(Fraction(slope), Fraction(shift))
        if edge.slope == 0:
            raise ValueError(f"conversion from {source} to {target} loses its value")
        known = self.edges.setdefault(source, {}).setdefault(target, edge)
        if known != edge:
            raise ValueError(f"two different conversions from {source} to {target}")
        self.edges.setdefault(target, {}).setdefault(source, edge.inverse())

    def to_target(self, target: str, tolerance: Fraction = Fraction(1, 10**9)) -> dict[str, Affine]:
        """The shortest composition to ``target`` from each unit that reaches it.

        Every edge outside the search tree closes a cycle; the cycle must be
        the identity within ``tolerance``, relative.
        """
        found = {target: Affine(Fraction(1))}
        queue = deque([target])
        while queue:
            unit = queue.popleft()
            for near in self.edges.get(unit, {}):
                if near not in found:
                    found[near] = self.edges[near][unit].then(found[unit])
                    queue.append(near)
        for unit, edges in self.edges.items():
            for near, edge in edges.items():
                if unit in found and near in found:
                    around = edge.then(found[near])
                    limit = tolerance * max(1, abs(found[unit].slope))
                    if abs(around.slope - found[unit].slope) > limit or abs(around.shift - found[unit].shift) > limit:
                        raise ValueError(f"inconsistent cycle through {unit} and {near}")
        return found

    def factors(self, spark: SparkSession, target: str) -> DataFrame:
        rows = [
            (unit, target, float(f.slope.numerator), float(f.slope.denominator), float(f.shift))
            for unit, f in sorted(self.to_target(target).items())
        ]
        return spark.createDataFrame(rows, FACTORS)


def bounded_rows(df: DataFrame, limit: int = MAX_UNITS) -> list:
    """Rows of a unit table on the driver; a table beyond the bound is an error rather than a collect."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a unit table of more than {limit} rows")
    return rows


def parsed_once(df: DataFrame, text: str, parse: Callable[[Column], Column], out: str) -> DataFrame:
    """``df`` with ``parse(text)`` in ``out``, each distinct text parsed once; null for a null text.

    Texts repeat, so the dictionary of distinct ones is joined back by the text
    itself: one row a text on its side, so a text that many rows share may be
    split by adaptive skew handling on the other.
    """
    words = df.select(F.col(text).alias("__text")).where(F.col("__text").isNotNull()).distinct()
    known = materialize(words.select("__text", parse(F.col("__text")).alias(out)), "texts")
    return df.join(known, F.col(text) == F.col("__text"), "left").drop("__text")


def convert(df: DataFrame, value: Column, unit: Column, target: str, factors: DataFrame, out: str) -> DataFrame:
    """``df`` with ``value`` in the target unit; null where the value or unit is null or no conversion is known.

    ``factors`` has one row a unit and at most ``MAX_UNITS`` rows, which makes it safe to broadcast.
    """
    small = factors.where(F.col("target") == target).select(
        F.col("unit").alias("__unit"), F.col("num").alias("__num"), F.col("den").alias("__den"), F.col("shift").alias("__shift")
    )
    joined = df.withColumn("__unit", unit).join(F.broadcast(small), "__unit", "left")
    converted = value.cast("double") * F.col("__num") / F.col("__den") + F.col("__shift")
    return joined.withColumn(out, converted).drop("__unit", "__num", "__den", "__shift")
