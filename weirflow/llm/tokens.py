"""Encoding of a whole corpus with a public byte-level BPE tokenizer, each distinct word once.

Texts are cut into pre-tokens, block by block: a block keeps its distinct words
and each text as places in that list. Distinct words of all blocks are shuffled
and encoded once, their ids joined back to the blocks, and texts put together
again by place. Decoding joins the table of token bytes.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import materialize

BLOCK_TEXTS, BLOCK_CHARS = 512, 500_000
# The pattern of pre-tokens that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Ranges in which all libraries agree on what is a letter, a number or a space.
RARE = re.compile("[^\u0000-՗‐- 　-〩ぁ-ゖァ-ヺ一-龥가-힣！-～]")


def default_tokenizer() -> str:
    """Path of byte_bpe_50k without its ending, as the installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json").removesuffix(".json")


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(f"{path}.json")
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=4)
def _ranks(path: str):
    import tiktoken

    with open(f"{path}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def pre_tokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a text in order; rare characters are left to the tokenizer's own library."""
    if not RARE.search(text):
        return _pattern().findall(text)
    return [text[a:b] for _, (a, b) in _library(path).pre_tokenizer.pre_tokenize_str(text)]


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    keys: list = []
    places: list[list[int]] = []
    slots: dict[str, int] = {}
    chars = 0
    kind = pa.string()

    def block() -> pa.RecordBatch:
        texts = pa.array([[{"key": k, "at": p} for k, p in zip(keys, places)]], pa.list_(pa.struct([("key", kind), ("at", pa.list_(pa.int32()))])))
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), texts, pa.array([list(slots)], pa.list_(pa.string()))], ["block", "texts", "words"])

    for batch in batches:
        kind = batch.schema.field("key").type
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            keys.append(key)
            places.append([slots.setdefault(w, len(slots)) for w in pre_tokens(text, path)] if text else [])
            chars += len(text or "")
            if len(keys) >= BLOCK_TEXTS or chars >= BLOCK_CHARS:
                yield block()
                keys, places, slots, chars = [], [], {}, 0
    if keys:
        yield block()


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word")
        ids = []
        for word in words.to_pylist():
            if RARE.search(word):
                ids.append(_library(path).encode(word, add_special_tokens=False).ids)
            else:
                ids.append(_ranks(path).encode_ordinary(word))
        yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])


def _coded_words(df: DataFrame, key: Column, text: Column, path: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of texts, their distinct words by place, and the ids of each distinct word of the corpus."""
    path = path or default_tokenizer()
    rows = df.select(key.alias("key"), text.alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"block string, texts array<struct<key: {kind}, at: array<int>>>, words array<string>"
    blocks = materialize(rows.mapInArrow(partial(_blocks, path=path), schema), "blocks")
    slots = blocks.select("block", F.posexplode("words").alias("slot", "word"))
    coded = slots.select("word").distinct().mapInArrow(partial(_encode, path=path), "word string, ids array<int>")
    return blocks, slots, coded


def encode_corpus(df: DataFrame, key: Column, text: Column, path: str | None = None) -> DataFrame:
    """(key, ids) of every row, without special tokens.

    The ids of an empty and of a null text are the empty list. Rows with equal
    or null keys each keep their own ids. Strings of special tokens in a text
    are ordinary text.
    """
    blocks, slots, coded = _coded_words(df, key, text, path)
    back = slots.join(coded, "word").groupBy("block").agg(F.collect_list(F.struct("slot", "ids")).alias("coded"))
    back = back.select("block", F.transform(F.array_sort("coded"), lambda c: c["ids"]).alias("coded"))
    whole = blocks.select("block", "texts").join(back, "block", "left")
    each = whole.select("coded", F.explode("texts").alias("t"))
    ids = F.flatten(F.transform("t.at", lambda i: F.get("coded", i)))
    return each.select(F.col("t.key").alias("key"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def count_tokens(df: DataFrame, key: Column, text: Column, path: str | None = None) -> DataFrame:
    """(key, tokens) of every row: how many ids ``encode_corpus`` gives, without putting them together.

    Only lengths travel: each distinct word is encoded once, and a text's
    tokens are the sum over its places. Empty and null texts have 0.
    """
    blocks, slots, coded = _coded_words(df, key, text, path)
    back = slots.join(coded.select("word", F.size("ids").alias("n")), "word").groupBy("block").agg(F.collect_list(F.struct("slot", "n")).alias("coded"))
    back = back.select("block", F.transform(F.array_sort("coded"), lambda c: c["n"]).alias("coded"))
    each = blocks.select("block", "texts").join(back, "block", "left").select("coded", F.explode("texts").alias("t"))
    total = F.aggregate("t.at", F.lit(0).cast("long"), lambda acc, i: acc + F.get("coded", i))
    return each.select(F.col("t.key").alias("key"), F.coalesce(total, F.lit(0)).alias("tokens"))


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, bytes) of each token as hexadecimal digits; as many rows as the fixed vocabulary has."""
    path = path or default_tokenizer()
    with open(f"{path}.tiktoken", "rb") as lines:
        rows = [(int(b), base64.b64decode(a).hex()) for a, b in map(bytes.split, lines)]
    return spark.createDataFrame(rows, "id int, bytes string")


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(key, text) of (key, ids); keys must differ. An empty list decodes to ''."""
    table = token_bytes(encoded.sparkSession, path)
    tokens = encoded.select("key", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    joined = tokens.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["bytes"]), "")), "UTF-8")
    found = joined.select("key", text.alias("text"))
    return encoded.select("key").join(found, "key", "left").select("key", F.coalesce("text", F.lit("")).alias("text"))


def vocabulary_size(path: str | None = None) -> int:
    with open(f"{path or default_tokenizer()}.json", encoding="utf-8") as f:
        return len(json.load(f)["model"]["vocab"])
