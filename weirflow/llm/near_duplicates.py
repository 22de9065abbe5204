"""Near-duplicate records by anchor-point covering of minhash fingerprints.

A record's fingerprint is a word of G blocks of seven minhash symbols. The
anchors of a block come from the perfect [7,4] Hamming code (covering radius
1): the supports of its seven words of weight three, the lines of the Fano
plane. Two blocks at Hamming distance of at most two agree on a whole support,
and so do four fifths of those at distance three; so a fingerprint is
replicated to the seven anchors (code word, symbols on its support) that it
reaches within covering radius plus threshold, and records are compared per
anchor. Symbols are minhashes rather than bits because at a similarity of 0.45
unrelated records differ in half of all bits, so that balls of binary words
would cover most anchors. Shingles that more than three records in a hundred
hold weigh an eighth in the fingerprint (one counting pass finds them), so
that common phrases alone rarely make an anchor and none is held by many. A
record half of whose shingles are common belongs to a large family of edited
copies and has a second fingerprint in which all weigh alike.

Records with equal shingle sets are one class, named by a hash of the set, and
meet at an anchor once. Pairs of classes found are thinned by an estimate from
their fingerprints and then checked on the shingle sets of their whole texts.
``miss_chance`` states what anchors may miss; ``exact=True`` takes candidates
from shared rare shingles instead and misses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.session import materialize

# Supports of the weight-3 words of the [7,4] Hamming code, the lines of the Fano plane.
SUPPORTS = ((0, 1, 3), (1, 2, 4), (2, 3, 5), (3, 4, 6), (0, 4, 5), (1, 5, 6), (0, 2, 6))
BLOCKS = 12
SYMBOLS = BLOCKS * 7
COMMON_SHARE, COMMON_MOST, COMMON_SHIFT = 0.03, 65_536, 3  # parameters of the fingerprint only: links don't depend on them
COUNTED_AT_ONCE = 4_000_000
BITS, MOST_BITS = 16, 2**28  # parameters of what is shuffled only
_BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SEED = np.random.Generator(np.random.PCG64(20240229))
_MUL = _SEED.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _SEED.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


class Shingler:
    """Distinct hashes of runs of ``k`` consecutive words; hashes of words are kept while there are few enough."""

    KEPT = 500_000

    def __init__(self, k: int) -> None:
        self.k, self.known = k, _WordHashes()

    def words(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text in order: maximal runs of letters and digits, lower-cased."""
        low = (text or "").lower()
        if not low.isascii():
            for mark in set(low):
                if mark > "\x7f" and not mark.isalnum():
                    low = low.replace(mark, " ")
        words = low.encode("utf-8", "surrogatepass").translate(_BREAKS).split()
        if len(self.known) > self.KEPT:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of all runs, repeated ones too."""
        n = len(ids) - self.k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(self.k):
            total = (total ^ (total >> np.uint64(29))) * _STEP[4] + ids[i : i + n] * _STEP[i % 4]
        return _mix(total)

    def shingles(self, ids: np.ndarray) -> np.ndarray:
        found = np.sort(self.runs(ids))
        return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def _frequent(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles with the number of texts that hold them, less those too rare in a run of texts to be common; and the number of texts."""
    shingle = Shingler(k)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        kept = n >= max(2.0, len(sets) * COMMON_SHARE / 4)
        items, counts = [*found[kept].view(np.int64).tolist(), None], [*n[kept].tolist(), len(sets)]
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(counts, pa.int64())], ["item", "n"])

    held: list[np.ndarray] = []
    for batch in batches:
        for text in batch.column("text").to_pylist():
            s = shingle.shingles(shingle.words(text))
            if len(s):
                held.append(s)
                if sum(map(len, held[-64:])) > COUNTED_AT_ONCE or len(held) % 4096 == 0 and sum(map(len, held)) > COUNTED_AT_ONCE:
                    yield counted(held)
                    held = []
    if held:
        yield counted(held)


def _packed(low: np.ndarray) -> tuple[bytes, bytes]:
    """Symbols of 16 bits, and four bits of each, two symbols a byte."""
    symbols = ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")
    bits = (symbols & 15).astype(np.uint8)
    return symbols.tobytes(), (bits[::2] | (bits[1::2] << 4)).tobytes()


def _least(items: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, ~np.uint64(0))
    for at in range(0, len(items), 2048):
        low = np.minimum(low, (_MUL * items[at : at + 2048, None]).min(axis=0))
    return low


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(k)
    top = np.uint64(64 - COMMON_SHIFT)
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            s = shingle.shingles(shingle.words(text))
            if not len(s):
                continue
            held = common[np.searchsorted(common, s) % len(common)] == s if len(common) else np.zeros(len(s), bool)
            rare, often = _least(s[~held]), _least(s[held])
            name = _class_of(s)
            plain, sketch = _packed(np.minimum(rare, often))
            lighter = np.where(often >> top, ~np.uint64(0), often << np.uint64(COMMON_SHIFT))
            rows.append((key, name, 0, _packed(np.minimum(rare, lighter))[0], sketch))
            if 2 * held.sum() >= len(s):
                rows.append((key, name, 1, plain, sketch))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [batch.schema.field("id").type, pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "uid", "plain", "word", "sketch"])


def _class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        words, uid = _matrix(batch.column("word"), "<u2").astype(np.uint64), batch.column("uid").to_numpy()
        for block in range(BLOCKS):
            keys = []
            for number, support in enumerate(SUPPORTS):
                packed = np.zeros(len(words), np.uint64)
                for at in support:
                    packed = (packed << np.uint64(16)) | words[:, block * 7 + at]
                keys.append(_mix(packed ^ _SALT[block * 7 + number]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(uid, len(SUPPORTS)))], ["anchor", "uid"])


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            differ = _matrix(batch.column("wa"), "u1") ^ _matrix(batch.column("wb"), "u1")
            same = ((differ & 15) == 0).sum(axis=1) + ((differ >> 4) == 0).sum(axis=1)
            yield batch.filter(pa.array(same >= least)).select(["a", "b"])


def _named_texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(k)
    for batch in batches:
        sets = [shingle.shingles(shingle.words(t)) for t in batch.column("text").to_pylist()]
        out = pa.RecordBatch.from_arrays([pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), batch.column("text")], ["uid", "text"])
        yield out.filter(out.column("uid").is_valid())


def _shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(k)
    for batch in batches:
        sets = [shingle.shingles(shingle.words(t)) for t in batch.column("text").to_pylist()]
        keep = [s for s in sets if len(s)]
        items = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keep)], dtype=np.int32), pa.array(np.concatenate(keep).view(np.int64) if keep else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in keep], pa.int64()), items], ["uid", "items"])


def _exact(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    shingle, last, x = Shingler(k), None, np.empty(0, np.uint64)
    for batch in batches:
        share = []
        for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
            if a != last:  # the pairs of a class stand together after the join
                last, x = a, shingle.shingles(shingle.words(ta.as_py()))
            y = shingle.shingles(shingle.words(tb.as_py()))
            both = np.intersect1d(x, y, assume_unique=True).size
            share.append(both / (len(x) + len(y) - both))
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share, pa.float64())], ["a", "b", "share"])
        yield out.filter(pa.array([x >= threshold for x in share], pa.bool_()))


def _perhaps_in(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids``, and a few others: those at whose place in a broadcast bitmap an id of ``ids`` stands too.

    It has ``BITS`` bits for each id, at most ``MOST_BITS``; beyond, more rows
    pass, but none is lost. So a join by id shuffles hardly more than it keeps.
    """
    # Fixed value: Spark's bitmaps have 32,768 bits each.
    pages = max(1, min(MOST_BITS, ids.count() * BITS) // 32_768 + 1)
    place = F.pmod(F.xxhash64("id"), F.lit(pages * 32_768))
    page, at = F.floor(place / 32_768), place % 32_768
    bits = ids.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(at).alias("bits"))
    held = F.conv(F.hex(F.substring("bits", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.withColumns({"page": page, "at": at}).join(F.broadcast(bits), "page")
    return found.where(held.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 AS int))")) != 0).select(df.columns)


def _mapped(df: DataFrame, step: Callable, schema: str, **values: object) -> DataFrame:
    return df.mapInArrow(partial(step, **values) if values else step, schema)


class NearDuplicates:
    """Classes of equal records and the links between classes of a collection.

    ``df`` is read for ``id_`` and ``text`` only. Rows with a null id, and
    texts with fewer than ``k`` words (null and empty ones too), have no
    shingles and so no similarity to any other. Repeated rows change nothing.
    An id with several texts stands in the class of each. Classes are named by
    64-bit hashes of their shingle sets.

    Fingerprints are of the same runs as the shares, so that a pair's chance of
    meeting at an anchor depends on its share alone, in short texts too.
    """

    def __init__(self, df: DataFrame, id_: Column, text: Column, k: int = 5, threshold: float = 0.8) -> None:
        self._source = df.select(id_.alias("id"), text.alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
        self._k, self._threshold = k, threshold
        kind = self._source.schema["id"].dataType.simpleString()
        words = _mapped(self._source, _fingerprints, f"id {kind}, uid long, plain int, word binary, sketch binary", k=k, common=self._common())
        words = materialize(words, "fingerprints")
        #: (id, uid), one row for each record; uid names its class.
        self.records = words.where("plain = 0").select("id", "uid")
        #: One row for each class and kind of fingerprint, written so that all uses read the same.
        self.prints = materialize(words.select("uid", "plain", "word", "sketch").dropDuplicates(["uid", "plain"]), "prints")

    def _common(self) -> np.ndarray:
        """Hashes of the shingles that at least a ``COMMON_SHARE`` of the records hold, the most frequent ones if they exceed ``COMMON_MOST``.

        They are at most mean size / (0.75 COMMON_SHARE) many in any collection.
        """
        seen = _mapped(self._source.select("text"), _frequent, "item long, n long", k=self._k).groupBy("item").agg(F.sum("n").alias("n"))
        seen = materialize(seen, "common")
        total = seen.where(F.col("item").isNull()).select("n").first()
        # A quarter of the bar may have been left out a run of texts; in small collections two texts are no share.
        bar = max(8.0, 0.75 * COMMON_SHARE * (total.n if total else 0))
        rows = seen.where(F.col("item").isNotNull() & (F.col("n") >= bar)).orderBy(F.col("n").desc(), "item").limit(COMMON_MOST).select("item").collect()
        return np.sort(np.array([r.item for r in rows], np.int64).view(np.uint64))

    def least_alike(self) -> int:
        """Equal sketch symbols below which a pair can't be a link but by a chance of under one in a thousand."""
        p, n = self._threshold + (1 - self._threshold) / 16, SYMBOLS
        return max(1, int(n * p - 3.5 * (n * p * (1 - p)) ** 0.5))

    @staticmethod
    def miss_chance(share: float) -> float:
        """Chance that a pair meets at no anchor, by its share of (weighted) shingles; at 0.45 0.002, at 0.5 0.0003."""
        alike = [0.0, 0.0, 0.0, 7 / 35, 28 / 35, 1.0, 1.0, 1.0]  # of the sets of i equal symbols, those that hold a support
        meet = sum(comb(7, i) * share**i * (1 - share) ** (7 - i) * part for i, part in enumerate(alike))
        return (1 - meet) ** BLOCKS

    def candidates(self) -> DataFrame:
        """(a, b), a < b: classes that meet at an anchor and have fingerprints alike enough.

        Both sides of the join are the same shuffle of classes by anchor; a hot
        anchor is split by adaptive skew handling, which only takes shuffles
        that the join itself asks for.
        """
        at = _mapped(self.prints.select("uid", "word"), _anchors, "anchor long, uid long")
        pairs = at.alias("x").join(at.alias("y"), "anchor").where(F.col("x.uid") < F.col("y.uid"))
        pairs = pairs.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b"))
        sketch = self.prints.where("plain = 0").select("uid", "sketch")
        pairs = pairs.join(sketch.select(F.col("uid").alias("a"), F.col("sketch").alias("wa")), "a").dropDuplicates(["a", "b"])
        pairs = pairs.join(sketch.select(F.col("uid").alias("b"), F.col("sketch").alias("wb")), "b")
        return _mapped(pairs.select("a", "b", "wa", "wb"), _alike, "a long, b long", least=self.least_alike())

    def all_candidates(self) -> DataFrame:
        """(a, b), a < b: classes that share one of the rare shingles which every pair at the threshold must share.

        With shingles ordered by how many classes hold them, two sets of sizes
        m and n can't reach a share t unless the first m - ceil(t m) + 1 and
        n - ceil(t n) + 1 of them meet. Nothing is missed; it costs a row for
        each of those shingles where anchors cost ``SYMBOLS`` rows a class.
        """
        sets = self._sets(self.records.select("uid").distinct()).select("uid", F.explode("items").alias("item"))
        sets = materialize(sets, "items")
        seen = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("uid").orderBy("n", "item")
        size = F.count(F.lit(1)).over(Window.partitionBy("uid"))
        ranked = sets.join(seen, "item").select("uid", "item", F.row_number().over(order).alias("at"), size.alias("size"))
        first = ranked.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * F.lit(self._threshold) - 1e-9) + 1).select("uid", "item")
        pairs = first.alias("x").join(first.alias("y"), "item").where(F.col("x.uid") < F.col("y.uid"))
        return pairs.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct()

    def _ids(self, used: DataFrame) -> DataFrame:
        """(id): one record of each of the named classes."""
        return self.records.select("id", "uid").join(used, "uid", "left_semi").groupBy("uid").agg(F.min("id").alias("id")).select("id").distinct()

    def _sets(self, used: DataFrame) -> DataFrame:
        """(uid, items) of the named classes, read from one record of each."""
        texts = self._source.join(self._ids(used), "id", "left_semi")
        return _mapped(texts.select("text"), _shingle_sets, "uid long, items array<long>", k=self._k).dropDuplicates(["uid"])

    def _texts(self, used: DataFrame) -> DataFrame:
        """(uid, text) of the named classes, read from one record of each."""
        ids = materialize(self._ids(used), "ids")
        texts = _perhaps_in(self._source, ids).join(ids, "id", "left_semi")
        return _mapped(texts.select("text"), _named_texts, "uid long, text string", k=self._k).dropDuplicates(["uid"])

    def links(self, exact: bool = False) -> DataFrame:
        """(a, b, share) of each pair of classes whose share of common shingles reaches the threshold.

        Texts go to the pairs, not sets of hashes, which are three times as large and don't compress.
        """
        pairs = materialize(self.all_candidates() if exact else self.candidates(), "candidates")
        texts = self._texts(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
        joined = pairs.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
        joined = joined.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
        return _mapped(joined.select("a", "b", "ta", "tb"), _exact, "a long, b long, share double", k=self._k, threshold=self._threshold)

    def members(self) -> DataFrame:
        """(uid, id): the different records of each class."""
        return self.records.select("uid", "id").distinct()

    def classes(self, links: DataFrame) -> DataFrame:
        """(id, uid, first, copies, links): each record with its class, the class's least id, the records in it and the classes linked to it."""
        degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("links"))
        members = self.members()
        copies = members.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
        out = members.join(copies, "uid").join(degree, "uid", "left")
        return out.select("id", "uid", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def pairs(self, links: DataFrame) -> DataFrame:
        """(id_a, id_b), id_a < id_b: links spelled out for members, and members of one class with one another."""
        members = self.members()
        across = links.select("a", "b").unionByName(members.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("uid").alias("a"), F.col("uid").alias("b")))
        x = members.select(F.col("uid").alias("a"), F.col("id").alias("x"))
        y = members.select(F.col("uid").alias("b"), F.col("id").alias("y"))
        both = across.join(x, "a").join(y, "b").where((F.col("x") < F.col("y")) | (F.col("a") != F.col("b")) & (F.col("x") != F.col("y")))
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
