"""Incremental forms of batch operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: exact dedup of a stream with bounded state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def unseen(batch: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key the cache of earlier runs lacks."""
    return batch.join(cache.select(key).distinct(), key, "left_anti")


def into_cache(stream: DataFrame, cache_path: str, checkpoint: str, key: str):
    """A query that appends the keys which are new to a Parquet cache, batch by batch; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates([key])
        try:
            earlier = spark.read.parquet(cache_path).where(F.col("batch") != number)
            new = unseen(new, earlier, key)
        except Exception as e:  # the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(cache_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_drift(before: DataFrame, now: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """key, state: added, removed, changed or same, of a registered snapshot and the input as it is now."""
    old, new = before.select(F.col(key), F.col(fingerprint).alias("__old"), F.lit(True).alias("__was")), now.select(F.col(key), F.col(fingerprint).alias("__new"), F.lit(True).alias("__is"))
    state = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed").otherwise("same")
    return old.join(new, key, "full_outer").select(key, state.alias("state"))


def check_resumable(before: DataFrame, now: DataFrame, key: str, fingerprint: str = "fingerprint") -> None:
    """A run can be resumed only on the input that it was registered with."""
    drift = {r["state"]: r["n"] for r in snapshot_drift(before, now, key, fingerprint).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect() if r["state"] != "same"}
    if drift:
        raise ValueError("the input drifted since the run was registered: " + ", ".join(f"{n} {s}" for s, n in sorted(drift.items())))
