import json

from pyspark.sql import functions as F

from weirflow.operators import nested


def tables(spark, bodies):
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "id int, body string, _sk_ string")
    roots = df.select("id", nested.json_object(F.col("body")).alias("record")).where(F.col("record").isNotNull())
    schema = nested.infer_merged_schema(roots.select(F.to_json("record").alias("j")), "j")
    return nested.flatten_records(roots, "record", schema, F.col("id").cast("string")), schema


def test_places_and_links(spark):
    bodies = [
        json.dumps({"a": {"items": [{"k": 1, "tags": ["x", None, "y"]}, None, {"k": "two", "tags": "z"}]}}),
        json.dumps(json.dumps({"a": {"items": {"k": 3}}})), json.dumps({"a": "flat"}), json.dumps({"a": None}), '{"a": {"items": [', "", None, "[1]", "7", '"plain"',
    ]
    found, schema = tables(spark, bodies)
    assert schema.array_paths() == ["a.items", "a.items.tags"]
    items = found["a.items"].select("id", "_pos", nested.field("_value", "k").alias("k")).collect()
    assert sorted(map(tuple, items)) == [(0, 0, "1"), (0, 2, "two"), (1, 0, "3")]
    tags = found["a.items.tags"]
    assert sorted((r.id, r._pos, r.v, r.k) for r in tags.select("id", "_pos", nested.field("_value").alias("v"), nested.field("_parent", "k").alias("k")).collect()) == [(0, 0, "x", "1"), (0, 0, "z", "two"), (0, 2, "y", "1")]
    linked = tags.alias("t").join(found["a.items"].alias("i"), F.col("t._parent_sk") == F.col("i._sk"))
    assert linked.count() == 3 and tags.select("_sk").distinct().count() == 3
    assert nested.scalar_columns(found["a.items"], "a.items", schema).columns == ["_sk", "_parent_sk", "_pos", "k"]


def test_empty(spark):
    found, schema = tables(spark, [None, ""])
    assert schema.array_paths() == [] and found[""].count() == 0
