"""Readers, writers and streams on small files."""

import gzip
import json
import sqlite3
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from loomstone.sources import readers as R
from loomstone.sources import schema, writers
from loomstone.streaming import incremental


def test_jsonl_zst(spark, tmp_path):
    data = "\n".join([*(json.dumps({"id": i, "text": f"t{i}"}) for i in range(2500)), "bad", ""]).encode()
    (tmp_path / "8_1.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(data))
    rows = R.jsonl_zst(spark, str(tmp_path), "id long, text string")
    assert rows.count() == 2500 and rows.agg(F.sum("id")).first()[0] == sum(range(2500))


def test_sqlite_and_first_text(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table d (id integer, a text, b text)")
        db.executemany("insert into d values (?, ?, ?)", [(1, " ", "x"), (2, "y", "z"), (3, None, None)])
    rows = R.sqlite(spark, str(tmp_path / "a.db"), "select id, a, b from d", "id long, a string, b string").select("id", R.first_text("a", "b").alias("t"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x"), (2, "y"), (3, None)]


def test_zip_members(spark, tmp_path):
    xml = "<d><s><w>Hello</w><w>,</w><w>world</w><w>!</w></s><s>plain  text</s></d>"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.md", "# One")
        z.writestr("two.xml", xml)
        z.writestr("three.xml.gz", gzip.compress(xml.encode()))
        z.writestr("bad.xml", "<d>")
    assert [tuple(r) for r in R.zip_markdown(spark, str(tmp_path)).collect()] == [("one.md", "# One")]
    assert sorted(tuple(r) for r in R.zip_xml(spark, str(tmp_path)).collect()) == [("three.xml.gz", "Hello, world!\nplain text"), ("two.xml", "Hello, world!\nplain text")]


def test_text_files_csv_and_discovery(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("alpha\nbeta")
    (tmp_path / "m.csv").write_text('filename,title\na.txt,"x, y"\nmissing.txt,z\n')
    got = R.text_files(spark, str(tmp_path / "t"), R.csv(spark, str(tmp_path / "m.csv")))
    assert sorted((r.filename, r.title, r.text) for r in got.collect()) == [("a.txt", "x, y", "alpha\nbeta"), ("missing.txt", "z", None)]
    assert R.discover(spark, str(tmp_path)).count() == 2


def test_paired_scan(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    name = next((tmp_path / "p").glob("*.parquet"))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.parquet").write_bytes(name.read_bytes())
    (tmp_path / "b" / "x.parquet").write_bytes(name.read_bytes())
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")).withColumnRenamed("id", "other")
    assert R.paired(a, b).where("id = other").count() == 10
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "q"))
    (tmp_path / "b" / "x.parquet").write_bytes(next((tmp_path / "q").glob("*.parquet")).read_bytes())
    with pytest.raises(ValueError):
        R.paired(a, spark.read.parquet(str(tmp_path / "b")).withColumnRenamed("id", "other"))


def test_vocabulary_and_metrics(spark, tmp_path):
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1}}}))
    assert sorted(tuple(r) for r in R.tokenizer_vocabulary(spark, str(tmp_path)).collect()) == [("a", 0), ("b", 1)]
    df = spark.createDataFrame([("v1", '{"fertility": {"el": 1.5, "en": 2}, "loss": 3.0}'), ("v2", None)], "variant string, m string")
    assert sorted(tuple(r) for r in R.metrics(df, "m").collect()) == [("v1", "fertility", "el", 1.5), ("v1", "fertility", "en", 2.0), ("v1", "loss", "global", 3.0)]


def test_registry_and_canonical_schema(spark):
    registry = R.Registry()
    registry.add("one")(lambda s: s.createDataFrame([("1", "t", "bad")], "source_doc_id string, text string, greek_badness_score string"))
    registry.add("two")(lambda s: s.createDataFrame([("2", "u", True)], "source_doc_id string, text string, contains_math boolean"))
    rows = schema.canonical(registry.build(spark))
    assert rows.columns == list(schema.CANONICAL) and rows.where("greek_badness_score is null").count() == 2
    assert sorted((r.source_dataset, r.contains_math) for r in rows.collect()) == [("one", False), ("two", True)]
    with pytest.raises(ValueError):
        registry.build(spark, ["three"])
    with pytest.raises(ValueError, match="missing columns: author"):
        schema.required(rows.drop("author"), ["text", "author"])


def test_writers(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("p"), F.lit(10).alias("tokens"), F.col("id").cast("string").alias("text"))
    writers.parquet(df, str(tmp_path / "w"), by=["p"], most_rows=20)
    assert len(list((tmp_path / "w").rglob("*.parquet"))) >= 6 and spark.read.parquet(str(tmp_path / "w")).count() == 100
    writers.replace_part(df.where("p = 1").limit(3), str(tmp_path / "w"), ["p"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 53
    writers.token_shards(df, str(tmp_path / "s"), "tokens", ["id"], 300)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4
    writers.manifest(spark, str(tmp_path / "m"), {"rows": 100, "é": [1]})
    assert writers.read_manifest(spark, str(tmp_path / "m")) == {"rows": 100, "é": [1]}
    files = spark.read.parquet(str(tmp_path / "s"))
    assert writers.head_of_files(files, 2).count() <= 2 * len(list((tmp_path / "s").rglob("*.parquet")))
    writers.csv(df, str(tmp_path / "c"))
    writers.jsonl(df, str(tmp_path / "j"))
    assert R.csv(spark, str(tmp_path / "c")).count() == R.jsonl(spark, str(tmp_path / "j"), "id long").count() == 100
    assert R.with_file(files).where("source_name like 'part%'").count() == 100
    hist = writers.histogram(spark.createDataFrame([("a", [1, 1, 2]), ("b", [])], "s string, ids array<int>"), "ids", "s")
    assert sorted(tuple(r) for r in hist.collect()) == [("a", 1, 2), ("a", 2, 1)]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"k{i % 7}", f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, t string, value double").select("key", F.to_timestamp("t").alias("ts"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    incremental.into_cache(stream, str(tmp_path / "cache"), str(tmp_path / "ck"), "key").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == sorted({r[0] for r in rows})
    df.limit(5).withColumn("key", F.concat(F.lit("new"), "key")).unionByName(df.limit(5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.into_cache(stream, str(tmp_path / "cache"), str(tmp_path / "ck"), "key").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 12
    q = incremental.first_seen(stream, "key", "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from seen").count() == 12
    q = incremental.windowed_counts(stream, "ts", [], "value").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "5 minutes")).count().count()
    assert spark.sql("select * from counts").count() == batch
