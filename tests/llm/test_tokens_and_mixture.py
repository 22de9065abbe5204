import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirflow.llm import mixture, queries, tokens

TEXTS = ["", None, " ", "Hello  world", "it's\n\n\tdon't ", "<|endoftext|> x", "naïve Ünïcode 日本語 한국어 emoji 🎉🎉", "ߊ rare ՘ ₏ letters ꟎ 1²³½ ١٢٣", "a" * 5000, "x y " * 20_000, "​﻿zero", "é combining", "Hello  world"]


def test_equals_the_library(spark):
    path = tokens.default_tokenizer()
    library = Tokenizer.from_file(f"{path}.json")
    library.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc int, text string, key string").repartition(3)
    encoded = tokens.encode_corpus(df, F.col("doc"), F.col("text"))
    got = {r.key: list(r.ids) for r in encoded.collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    back = {r.key: r.text for r in tokens.decode_corpus(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(df.limit(0), F.col("doc"), F.col("text")).count() == 0
    twice = tokens.encode_corpus(df.unionAll(df), F.col("doc"), F.col("text"))
    assert twice.count() == 2 * len(TEXTS)


def test_common_characters_split_alike():
    path = tokens.default_tokenizer()
    for start in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c <= 0xDFFF]
        text = " ".join(f"a{c}1{c}-" for c in chars if not tokens.RARE.search(c))
        if text:
            assert tokens._pattern().findall(text) == [text[a:b] for _, (a, b) in tokens._library(path).pre_tokenizer.pre_tokenize_str(text)]


def sized(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, tokens int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares(spark):
    rows = [(i, "big", 100) for i in range(4000)] + [(10_000 + i, "small", 50) for i in range(300)] + [(20_000, None, 9), (20_001, "other", 9), (20_002, "big", None), (20_003, "small", 0)]
    df = sized(spark, rows)
    goals = targets(spark, [("big", 0.7, 1), ("small", 0.28, 4), ("absent", 0.02, 2), (None, 0.5, 1)])
    rates = mixture.mixing_rates(df, goals)
    mix = mixture.mixed(df, rates, F.col("id"))
    by = {r.source: r for r in mixture.reached_shares(mix, rates).collect()}
    assert by["small"].rate == pytest.approx(4.0) and by["small"].mixed_docs == 4 * 301 and by["absent"].mixed_tokens == 0
    assert by["big"].share == pytest.approx(0.7 / 0.98, abs=0.02) and by["small"].share == pytest.approx(0.28 / 0.98, abs=0.02)
    assert mix.groupBy("id").count().agg(F.max("count")).first()[0] == 4
    again = mixture.mixed(df.repartition(7), rates, F.col("id"))
    assert mix.exceptAll(again).count() == 0 and mix.count() == again.count()


def test_empty_mix(spark):
    for df, goals in ((sized(spark, []), targets(spark, [("a", 1.0, 1)])), (sized(spark, [(1, "a", 5)]), targets(spark, []))):
        rates = mixture.mixing_rates(df, goals)
        mix = mixture.mixed(df, rates, F.col("id"))
        assert mix.count() == 0 and all(r.share == 0 for r in mixture.reached_shares(mix, rates).collect())


def test_whole_corpus_against_the_library(spark):
    """p7_ids, p8_shares and p8_mix over their whole tables, by the tokenizer's own library and plain arithmetic."""
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(f"{tokens.default_tokenizer()}.json")
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs}
    assert {r.doc_id: list(r.ids) for r in queries.p7_ids(spark, sf).collect()} == ids
    goals = {r.source: r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    sums = {s: sum(len(ids[r.doc_id]) for r in docs if r.source == s) for s in goals}
    total = min(g.max_repeats * sums[s] / g.target_share for s, g in goals.items() if sums[s])
    rates = {s: min(g.max_repeats, g.target_share * total / sums[s]) if sums[s] else 0.0 for s, g in goals.items()}
    copies = {}
    for r in queries.p8_mix(spark, sf).collect():
        assert r.tokens == len(ids[r.doc_id])
        copies.setdefault((r.doc_id, r.source), []).append(r.copy)
    for r in docs:
        rate = rates.get(r.source, 0.0)
        got = sorted(copies.get((r.doc_id, r.source), []))
        assert got == list(range(1, len(got) + 1)) and int(rate) <= len(got) <= int(rate) + (rate > int(rate))
    shares = {r.source: r for r in queries.p8_shares(spark, sf).collect()}
    used = {s: sum(len(ids[d]) * len(c) for (d, x), c in copies.items() if x == s) for s in goals}
    for s in goals:
        assert shares[s].rate == pytest.approx(rates[s]) and shares[s].mixed_tokens == used[s] and shares[s].share == pytest.approx(used[s] / sum(used.values()))
