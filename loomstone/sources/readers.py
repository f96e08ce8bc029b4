"""Readers: files of many kinds into DataFrames. Every path goes through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import gzip
import io
import json
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, merge: bool = False) -> DataFrame:
    """Columns of Parquet files or globs; with ``merge`` files may lack columns that others have."""
    df = spark.read.option("mergeSchema", merge).parquet(path)
    return df.select(*columns) if columns else df


def with_file(df: DataFrame) -> DataFrame:
    """Adds file_path, file_row (the row's number in its file) and source_name (the file's name without its kinds and part number)."""
    name = F.regexp_replace(F.regexp_replace("file_path", r"^.*/", ""), r"(\.(parquet|jsonl|json|csv|zst|gz|txt|md))+$|(-\d+-of-\d+)?(\.(parquet|zst))+$", "")
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("file_row")).withColumn("source_name", name)


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, modified, fingerprint (of address, size and time) of all files below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.md5(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))).alias("fingerprint"))


def contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; bad lines and missing fields give nulls. Compressed as Spark's readers know it."""
    return spark.read.schema(schema).json(path)


def jsonl_zst(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in Zstandard files, which are read as a stream, file by file. Lines that are no JSON objects are left out."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as raw:
                    rows, held = io.TextIOWrapper(raw, encoding="utf-8", errors="replace"), []
                    for line in rows:
                        held.append(line.rstrip("\n"))
                        if len(held) == 1000:
                            yield pd.DataFrame({"path": name, "line": held})
                            held = []
                    if held:
                        yield pd.DataFrame({"path": name, "line": held})

    rows = contents(spark, path, "*.zst").mapInPandas(lines, "path string, line string")
    return rows.where(F.col("line").startswith("{")).select("path", F.from_json("line", schema).alias("row")).where("row is not null").select("path", "row.*")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows of a query on each SQLite file; a file travels as content, so that it can lie in any store."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for batch in batches:
            for content in batch["content"]:
                with sqlite3.connect(":memory:") as db:
                    db.deserialize(bytes(content))
                    for part in pd.read_sql_query(sql, db, chunksize=5000):
                        yield part

    return contents(spark, path, "*").mapInPandas(run, schema)


def first_text(*columns: str):
    """The first column that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def zip_members(spark: SparkSession, path: str, suffix: str, parse: Callable[[str, bytes], dict | None], schema: str) -> DataFrame:
    """One row for each member with this suffix, as ``parse`` gives it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [parse(m, z.read(m)) for m in sorted(z.namelist()) if m.endswith(suffix)]
                    rows = [r for r in rows if r]
                    if rows:
                        yield pd.DataFrame(rows)

    return contents(spark, path, "*.zip").mapInPandas(run, schema)


def zip_markdown(spark: SparkSession, path: str) -> DataFrame:
    return zip_members(spark, path, ".md", lambda name, data: {"name": name, "text": data.decode("utf-8", "replace")}, "name string, text string")


def joined_tokens(tokens: list[str]) -> str:
    """Words with single spaces, none before closing marks or after opening ones."""
    out = ""
    for t in tokens:
        glue = not out or t[:1] in ".,;:!?)»]%'" or out[-1] in "(«[" or not t
        out += t if glue else " " + t
    return out


def sentences_of(data: bytes) -> str:
    """The text of a document of sentences <s> with words <w>; plain text of a sentence where it has no words."""
    root = ET.fromstring(data)
    out = [joined_tokens([(w.text or "").strip() for w in s.iter("w")]) or " ".join("".join(s.itertext()).split()) for s in root.iter("s")]
    return "\n".join(x for x in out if x)


def zip_xml(spark: SparkSession, path: str) -> DataFrame:
    def parse(name: str, data: bytes) -> dict | None:
        try:
            return {"name": name, "text": sentences_of(gzip.decompress(data) if name.endswith(".gz") else data)}
        except (ET.ParseError, OSError):
            return None

    plain = zip_members(spark, path, ".xml", parse, "name string, text string")
    return plain.unionByName(zip_members(spark, path, ".xml.gz", parse, "name string, text string"))


def text_files(spark: SparkSession, path: str, metadata: DataFrame, name_col: str = "filename") -> DataFrame:
    """Metadata rows with the text of the file that each names; null where there is none."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias(name_col))
    return metadata.join(files, name_col, "left")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two sets of files with the same place: name of the file and number in it. Fails if the sets aren't aligned."""
    key = ["__file", "__row"]
    a = left.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    b = right.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    n, m = a.groupBy("__file").agg(F.count(F.lit(1)).alias("n")), b.groupBy("__file").agg(F.count(F.lit(1)).alias("m"))
    if n.join(m, "__file", "full").where(~F.col("n").eqNullSafe(F.col("m"))).limit(1).count():
        raise ValueError("the files differ in their counts of rows")
    return a.join(b, key).drop(*key)


def tokenizer_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id of a tokenizer file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                vocab = json.loads(bytes(content))["model"]["vocab"]
                yield pd.DataFrame({"token": list(vocab), "id": list(vocab.values())})

    return contents(spark, path, "*.json").mapInPandas(run, "token string, id int")


def metrics(df: DataFrame, column: str) -> DataFrame:
    """Rows of nested metrics {metric: {language: value}} or {metric: value} in a JSON column as language, metric, value."""
    outer = df.select(*[c for c in df.columns if c != column], F.explode(F.from_json(column, "map<string,string>")).alias("metric", "raw"))
    inner = F.from_json("raw", "map<string,double>")
    nested = F.when(F.col("raw").startswith("{"), inner).otherwise(F.create_map(F.lit("global"), F.col("raw").try_cast("double")))
    return outer.select(*[c for c in df.columns if c != column], "metric", F.explode(nested).alias("language", "value")).where("value is not null")


def side_of(df: DataFrame, pair: str, language: str) -> DataFrame:
    """One language's side of a bitext struct column, where it isn't blank."""
    return df.withColumn("text", F.trim(F.col(f"{pair}.{language}"))).where("text <> ''").drop(pair)


def in_language(df: DataFrame, languages: str, wanted: str) -> DataFrame:
    return df.where(F.array_contains(languages, wanted))


class Registry:
    """Named builders of canonical frames; ``build`` unites those that are asked for."""

    def __init__(self) -> None:
        self.builders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str):
        def register(fn):
            self.builders[name] = fn
            return fn

        return register

    def build(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        unknown = set(names or ()) - set(self.builders)
        if unknown:
            raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
        frames = [self.builders[n](spark).withColumn("source_dataset", F.lit(n)) for n in names or sorted(self.builders)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
