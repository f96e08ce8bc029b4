"""The bundle of a dedup run: its tables and a manifest, written for builders and read back by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources import writers


def export(path: str, tables: dict[str, DataFrame], values: dict) -> None:
    """Each table as Parquet in a folder of its own; last the manifest, so that a bundle with a manifest is whole."""
    for name, rows in tables.items():
        writers.parquet(rows, f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    schemas = {name: rows.schema.simpleString() for name, rows in tables.items()}
    writers.manifest(spark, f"{path}/manifest", values | {"tables": schemas})


def load(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables; an error if a table's schema is not that of the manifest."""
    values = writers.read_manifest(spark, f"{path}/manifest")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in values["tables"]}
    for name, rows in tables.items():
        if rows.schema.simpleString() != values["tables"][name]:
            raise ValueError(f"table {name} of the bundle has another schema than its manifest says")
    return values, tables


def enriched(frame: DataFrame, metadata: DataFrame, keys: list[str], prefix: str = "dedup_") -> DataFrame:
    """The frame with the metadata's other columns under names of their own; rows without metadata keep their place with nulls."""
    theirs = metadata.select(*keys, *(F.col(c).alias(prefix + c) for c in metadata.columns if c not in keys))
    return frame.join(theirs, keys, "left")
