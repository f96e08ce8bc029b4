"""Writers. Files are committed by Spark, so that a lost task or a broken run leaves no half output behind."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators.selection import cut_shards


def parquet(df: DataFrame, path: str, by: list[str] | None = None, most_rows: int = 0, order: list[str] | None = None) -> None:
    """Zstandard Parquet, in folders by columns, in files of at most so many rows, in an order within files."""
    writer = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd")
    if most_rows:
        writer = writer.option("maxRecordsPerFile", most_rows)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace_part(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the folders that the rows fall into are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def token_shards(df: DataFrame, path: str, tokens: str, order: list[str], target: int, text: str = "text") -> None:
    """Text-only shards of about ``target`` tokens, a folder for each."""
    cut_shards(df, tokens, order, target).select(text, "shard").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, values: dict) -> None:
    """One JSON object, through Spark's committer."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def head_of_files(df: DataFrame, n: int) -> DataFrame:
    """The first rows of each file."""
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__file").orderBy("__row"))).where(F.col("__nth") <= n).drop("__file", "__row", "__nth")


def histogram(df: DataFrame, ids: str, by: str) -> DataFrame:
    """Sparse counts of the ids in an array column: only those that occur."""
    return df.select(by, F.explode(ids).alias("id")).groupBy(by, "id").agg(F.count(F.lit(1)).alias("n"))


def by_hash_prefix(df: DataFrame, path: str, key: str, digits: int = 1) -> None:
    """Folders by the first digits of the md5 of a column; a folder's rows come from all tasks and no task holds a whole folder."""
    df.withColumn("prefix", F.substring(F.md5(F.col(key).cast("string")), 1, digits)).write.mode("overwrite").partitionBy("prefix").parquet(path)
