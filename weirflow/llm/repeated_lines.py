"""Lines repeated across the documents of one source, found by mergeable heavy-hitter summaries.

Texts are read once for the hashes of their lines. Each task keeps a
Misra-Gries summary of line hashes for every source it meets and reports counts
with the error bound it has taken off, early whenever it holds too many.
Summaries merge by adding counts and bounds; lines that may reach the threshold
are counted exactly in a second pass over the hashes, the wording of confirmed
ones is read from one record each, and they are removed from each text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize

HELD_AT_ONCE = 400_000  # entries of all summaries of a task, beyond which they are reported and begun anew


def line_key(line: Column) -> Column:
    """Lower case, runs of digits as #, other runs of characters than letters, digits and # as one blank, trimmed."""
    masked = F.regexp_replace(F.lower(line), "[0-9]+", "#")
    return F.trim(F.regexp_replace(masked, r"[^\p{L}\p{Nd}#]+", " "))


def line_keys(text: Column) -> Column:
    """The different keys of a text's lines, empty ones left out; none for a null text."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), line_key)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


class _Summaries:
    """Misra-Gries counts of the sources that a task has met since they were last reported."""

    def __init__(self, slack: float, capacity: int) -> None:
        self.slack, self.capacity = slack, capacity
        self.clear()

    def clear(self) -> None:
        self.counts: dict[str, Counter] = defaultdict(Counter)
        self.errors: Counter = Counter()
        self.texts: Counter = Counter()
        self.held = 0

    def cut(self, source: str, off: int) -> None:
        before = self.counts[source]
        self.errors[source] += off
        self.counts[source] = Counter({k: n - off for k, n in before.items() if n > off})
        self.held -= len(before) - len(self.counts[source])

    def add(self, source: str, hashes: list[int]) -> None:
        own = self.counts[source]
        before = len(own)
        self.texts[source] += 1
        own.update(hashes)
        self.held += len(own) - before
        if len(own) > 2 * self.capacity:
            self.cut(source, sorted(own.values(), reverse=True)[self.capacity])

    def report(self) -> pa.RecordBatch:
        sources, keys, ns = [], [], []
        for source in self.texts:
            # What is left may be thinned by a share of the texts seen without losing any line that reaches the threshold.
            allowed = int(self.texts[source] * self.slack) - self.errors[source]
            if allowed > 0:
                self.cut(source, allowed)
            own = self.counts[source]
            sources += [source] * (len(own) + 1)
            keys += [*own, None]
            ns += [*own.values(), self.errors[source]]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(keys, pa.int64()), pa.array(ns, pa.int64())], ["source", "h", "n"])


def _summaries(batches: Iterator[pa.RecordBatch], slack: float, capacity: int, held: int) -> Iterator[pa.RecordBatch]:
    kept = _Summaries(slack, capacity)
    for batch in batches:
        for source, hashes in zip(batch.column("source").to_pylist(), batch.column("hashes").to_pylist()):
            kept.add(source, hashes)
            if kept.held + len(kept.texts) > held:
                yield kept.report()
    yield kept.report()


class RepeatedLines:
    """Lines found in at least ``least`` and at least ``share`` of the different records of a source.

    ``df`` is read for source, id and text. Rows with a null source belong to
    none and keep their texts; null ids don't count as records; null and empty
    texts have no lines but their ids count. Repeated rows change nothing.
    """

    def __init__(self, df: DataFrame, source: Column, id_: Column, text: Column, least: int = 5, share: float = 0.2, capacity: int = 4096) -> None:
        self._least, self._share, self._capacity = least, share, capacity
        rows = df.select(source.alias("source"), id_.alias("id"), text.alias("text"))
        self._rows = rows.where(F.col("source").isNotNull() & F.col("id").isNotNull())
        hashed = F.transform(line_keys(F.col("text")), lambda k: F.xxhash64(k))
        #: (source, id, hashes) of each row, which every later step but the wording reads.
        self.hashed = materialize(self._rows.select("source", "id", hashed.alias("hashes")), "line-hashes")

    def sizes(self) -> DataFrame:
        """(source, ids, bar): records of each source and the count that a line must reach."""
        ids = self.hashed.select("source", "id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("ids"))
        return ids.withColumn("bar", F.greatest(F.lit(float(self._least)), F.col("ids") * F.lit(self._share)))

    def candidates(self, sizes: DataFrame) -> DataFrame:
        """(source, h): hashes of lines that may reach the bar; none that reaches it is missing."""
        step = partial(_summaries, slack=self._share / 4, capacity=self._capacity, held=HELD_AT_ONCE)
        merged = self.hashed.select("source", "hashes").mapInArrow(step, "source string, h long, n long").groupBy("source", "h").agg(F.sum("n").alias("n"))
        merged = materialize(merged, "summaries")
        bounds = merged.where(F.col("h").isNull()).select("source", F.col("n").alias("error")).join(sizes, "source")
        lines = merged.where(F.col("h").isNotNull())
        # Where the merged error reaches the bar the summary tells nothing: all lines of that source are candidates.
        unclear = bounds.where(F.col("error") >= F.col("bar")).select("source")
        likely = lines.join(bounds, "source").where(F.col("n") + F.col("error") >= F.col("bar")).where(F.col("error") < F.col("bar")).select("source", "h")
        every = self.hashed.join(unclear, "source", "left_semi").select("source", F.explode("hashes").alias("h"))
        return likely.unionByName(every.distinct())

    def found(self) -> DataFrame:
        """(source, key, ids): confirmed lines with the exact number of records that hold them.

        Candidates, and records that hold a confirmed line, are written tables,
        so that their joins broadcast them only below the session's limit.
        """
        sizes = materialize(self.sizes(), "sizes")
        wanted = materialize(self.candidates(sizes), "line-candidates")
        lines = self.hashed.select("source", "id", F.explode("hashes").alias("h")).join(wanted, ["source", "h"], "left_semi").distinct()
        exact = lines.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        sure = exact.join(sizes, "source").where(F.col("n") >= F.col("bar")).select("source", "h", "id", F.col("n").alias("ids"))
        sure = materialize(sure, "lines-found")
        holders = self._rows.join(sure.select("source", "id").distinct(), ["source", "id"], "left_semi")
        worded = holders.select("source", F.explode(line_keys(F.col("text"))).alias("key")).withColumn("h", F.xxhash64("key"))
        return worded.join(sure.select("source", "h", "ids"), ["source", "h"]).select("source", "key", "ids").distinct()


def without_lines(df: DataFrame, source: str, text: str, lines: DataFrame, out: str = "text_clean") -> DataFrame:
    """``df`` with ``text`` in ``out`` less the lines (source, key) confirmed for its source.

    Line ends of the other lines stay as they are; a null text stays null. A
    line found in a share of a source's records makes at most lines a record /
    share sets entries, so no source's set grows with its records. The sets are
    a written table, broadcast below the session's limit and joined beyond it.
    """
    sets = materialize(lines.groupBy("source").agg(F.collect_set("key").alias("__keys")), "line-sets")
    joined = df.join(sets.withColumnRenamed("source", "__source"), F.col(source) == F.col("__source"), "left")
    pieces = F.transform(F.split(F.col(text), "\n"), lambda p: F.struct(p.alias("line"), line_key(p).alias("key")))
    kept = F.filter(pieces, lambda p: (p["key"] == "") | ~F.array_contains(F.col("__keys"), p["key"]))
    # A generator of one row keeps the optimiser from cutting the text anew for every use.
    held = F.when(F.col("__keys").isNotNull(), F.struct(F.transform(kept, lambda p: p["line"]).alias("lines"), F.size(pieces).alias("n")))
    marked = joined.withColumn("__held", F.explode(F.array(held)))
    clean = F.when(F.col("__held").isNull(), F.col(text)).otherwise(F.array_join("__held.lines", "\n"))
    removed = F.when(F.col("__held").isNull() | F.col(text).isNull(), 0).otherwise(F.col("__held.n") - F.size("__held.lines"))
    return marked.withColumn(out, clean).withColumn("lines_removed", removed).drop("__source", "__keys", "__held")
