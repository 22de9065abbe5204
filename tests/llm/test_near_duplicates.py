import random
import re

from pyspark.sql import functions as F

from weirflow.llm import near_duplicates
from weirflow.llm.near_duplicates import SUPPORTS, NearDuplicates


def runs(text, k):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def share(a, b, k):
    a, b = runs(a, k), runs(b, k)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_supports_cover_all_pairs_of_errors():
    for i in range(7):
        for j in range(7):
            assert any(i not in s and j not in s for s in SUPPORTS)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))]
        texts.append((f"d{i:04}a", " ".join(base)))
        for c in range(rng.randrange(3)):
            edited = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 12))):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice(([], [rng.choice(vocabulary)], [edited[at], rng.choice(vocabulary)]))
            texts.append((f"d{i:04}{'bc'[c]}", " ".join(edited).upper()))
    return texts


def test_against_all_pairs(spark):
    rng = random.Random(3)
    texts = corpus(rng, 150)
    texts += [("null", None), ("empty", ""), ("short", "two words"), (None, "w1 w2 w3 w4"), ("copy1", texts[0][1]), ("copy2", texts[0][1]), texts[5], ("long", "word " * 60_000)]
    df = spark.createDataFrame(texts, "id string, uid_text string").withColumn("uid", F.lit("clash"))
    for k, threshold in ((3, 0.45), (5, 0.8)):
        found = NearDuplicates(df, F.col("id"), F.col("uid_text"), k=k, threshold=threshold)
        links = found.links().cache()
        got = {(r.id_a, r.id_b) for r in found.pairs(links).collect()}
        clean = sorted({(i, t) for i, t in texts if i and t})
        expected = {(a, b): s for x, (a, ta) in enumerate(clean) for b, tb in clean[x + 1 :] if a < b and (s := share(ta, tb, k)) >= threshold}
        assert got <= expected.keys()
        lost = [p for p in expected if p not in got]
        assert len(lost) <= len(expected) * 0.01 and all(expected[p] < threshold + 0.25 for p in lost)
        classes = {r.id: r for r in found.classes(links).collect()}
        assert classes["copy1"].uid == classes["copy2"].uid and classes["copy1"].copies == 3 and "empty" not in classes


def test_empty_table(spark):
    found = NearDuplicates(spark.createDataFrame([], "id long, text string"), F.col("id"), F.col("text"))
    links = found.links()
    assert links.count() == 0 and found.pairs(links).count() == 0 and found.classes(links).count() == 0


def test_one_class_of_many_copies(spark):
    """A third of all rows in one class: anchors and links stay as few as for one row."""
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, F.lit(text)).otherwise(F.concat(F.lit(text), F.col("id").cast("string"), F.lit(" "), F.col("id").cast("string"))).alias("t"))
    df = df.where((F.col("id") < 1000) | (F.col("id") > 2990))
    found = NearDuplicates(df, F.col("id"), F.col("t"), k=3, threshold=0.8)
    links = found.links()
    assert links.count() == 9 * 8 // 2 + 9
    assert found.classes(links).where("copies = 1000 and links = 9").count() == 1000


def test_large_family_of_edited_copies(spark):
    """A third of all records edited from one text: common to many, yet no link is lost to the weights of common shingles."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join([rng.choice(vocabulary) for _ in range(120)])) for i in range(160)]
    for i in range(80):
        edited = list(base)
        for _ in range(rng.randrange(1, 12)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(edited)))
    df = spark.createDataFrame(rows, "id long, t string")
    found = NearDuplicates(df, F.col("id"), F.col("t"), k=3, threshold=0.45)
    got = {(r.id_a, r.id_b) for r in found.pairs(found.links()).collect()}
    expected = {(a, b) for x, (a, ta) in enumerate(rows) for b, tb in rows[x + 1 :] if share(ta, tb, 3) >= 0.45}
    assert got <= expected and len(got) >= 0.999 * len(expected) > 2000
    exact = {(r.id_a, r.id_b) for r in found.pairs(found.links(exact=True)).collect()}
    assert exact == expected


def test_miss_chance():
    assert NearDuplicates.miss_chance(0.45) < 0.003 and NearDuplicates.miss_chance(0.8) < 1e-9 and NearDuplicates.miss_chance(0) == 1


def test_short_near_duplicates(spark):
    """A text of k words and one of k + 1 that hold the same run share half of their runs."""
    rows = [(f"{i}{side}", f"a{i} b{i} c{i}" + end) for i in range(40) for side, end in (("x", ""), ("y", f" d{i}"))]
    found = NearDuplicates(spark.createDataFrame(rows, "id string, t string"), F.col("id"), F.col("t"), k=3, threshold=0.45)
    pairs = {(r.id_a, r.id_b) for r in found.pairs(found.links()).collect()}
    assert pairs <= {(f"{i}x", f"{i}y") for i in range(40)} and len(pairs) >= 38


def test_links_move_texts_of_candidates_only(spark, monkeypatch):
    """Few of many records are in a candidate pair: none of their texts is left out, hardly any other goes into the join, and no set of hashes does."""
    for kind in ("long", "string"):
        df = spark.range(40_000).select(F.col("id").cast(kind).alias("id"), F.lit("t").alias("text")).unionByName(spark.sql(f"SELECT cast(null AS {kind}) AS id, 't' AS text"))
        ids = df.where("cast(id AS long) % 40 = 7").select("id")
        for most in (near_duplicates.MOST_BITS, 1):
            monkeypatch.setattr(near_duplicates, "MOST_BITS", most)
            kept = near_duplicates._perhaps_in(df, ids)
            assert kept.columns == ["id", "text"] and kept.join(ids, "id", "left_semi").count() == 1000
            assert kept.count() < 6000
            monkeypatch.undo()
        assert near_duplicates._perhaps_in(df, ids.limit(0)).count() == 0
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(50)] + [(100, " ".join(f"w7x{j}" for j in range(19))), (7, "another text of the same id")]
    links = NearDuplicates(spark.createDataFrame(rows, "id long, t string"), F.col("id"), F.col("t"), k=3, threshold=0.8).links()
    assert links.count() == 1 and abs(links.first().share - 17 / 18) < 1e-12
    assert "items" not in links._jdf.queryExecution().toString()
