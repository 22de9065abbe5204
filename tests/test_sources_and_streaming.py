import pytest
from pyspark.sql import functions as F

from weirflow.sources import documents, index
from weirflow.streaming.incremental import deliver_unseen, read_state, windowed_counts


def test_index(spark, tmp_path):
    base = str(tmp_path / "index")
    now = F.lit("2026-01-10 00:00:00").cast("timestamp_ntz")
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 70, "hot").otherwise("cold").alias("ats"), (F.lit("2026-01-10 00:00:00").cast("timestamp") - F.make_dt_interval(F.col("id").cast("int"))).cast("timestamp_ntz").alias("at"))
    with pytest.raises(Exception):
        index.current_build(spark, base)
    first = index.write_index(df, base, "ats", "at", "id", now)
    index.publish(spark, base, first)
    index.write_index(df.limit(0), base, "ats", "at", "id", now)  # not published: not seen
    assert index.read_index(spark, base, "ats").count() == 100
    some = index.read_index(spark, base, "ats", ["hot"], [0, 1])
    assert some.count() == 4 and "PartitionFilters: [isnotnull" in some._jdf.queryExecution().toString()
    assert index.manifest(index.read_index(spark, base, "ats"), "ats", "at", "id").agg(F.sum("rows")).first()[0] == 100


def test_payloads(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,name\n1,"a ""b""\nc"\n')
    assert documents.read_csv_by_header(spark, str(path), ["id", "name"]).first().name == 'a "b"\nc'
    with pytest.raises(documents.SchemaChange):
        documents.read_csv_by_header(spark, str(path), ["price"])
    df = spark.createDataFrame([('{"a": {"k": 1}}',), ('{"a": {}}',), ("{bad",), (None,)], "body string")
    assert [r.k for r in documents.project_json(df, "body", "a STRUCT<k: INT>", {"k": "a.k"}, ["k"]).collect()] == [1]
    page = '<script type="application/ld+json">{"@graph": [{"n": 1}, {"n": 2}]}</script><script type="application/ld+json">{"n": 3}</script><script type="application/ld+json">{oops</script>'
    blocks = documents.json_ld(spark.createDataFrame([(page,)], "html string"), "html")
    assert sorted(r.n for r in blocks.select(F.try_variant_get("block", "$.n", "int").alias("n")).collect()) == [1, 2, 3]


def test_incremental(spark, tmp_path):
    source, got = tmp_path / "in", []
    schema = "id string, day string"
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], schema).coalesce(1).write.json(str(source))

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        deliver_unseen(stream, "id", lambda: 5, str(tmp_path / "state"), lambda df, n: got.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()

    run()
    assert sorted(got) == ["a", "b"]
    run()
    spark.createDataFrame([("b", "0"), ("c", "0")], schema).coalesce(1).write.mode("append").json(str(source))  # old dates, late
    run()
    assert sorted(got) == ["a", "b", "c"] and read_state(spark, str(tmp_path / "state")).count() == 3


def test_windows(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:01:00' ts, 'x' g union all select timestamp'2026-01-01 00:02:00', 'x' union all select timestamp'2026-01-01 01:00:00', 'x'").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, g string").parquet(str(tmp_path / "e"))
    query = windowed_counts(stream, "ts", "g").writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("w").collect()] == [2]
