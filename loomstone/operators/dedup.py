"""Exact deduplication stages with keepers by priority, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_stage(docs: DataFrame, hash_col: str, priority: Column, key: str = "doc_key") -> DataFrame:
    """Adds keeper (the key with the least priority of each hash), group_size and kept.

    Keepers come from an aggregate that is combined before the shuffle and go back to the rows by a join that Spark
    splits where a hash is hot; no group is gathered. Rows with a null hash are alone.
    """
    groups = docs.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min_by(key, priority).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    joined = docs.join(groups, hash_col, "left")
    return joined.withColumns({"keeper": F.coalesce("keeper", key), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")}).withColumn("kept", F.col(key) == F.col("keeper"))


def docs_exact(docs: DataFrame, strict_hash: str, relaxed_hash: str, priority: Column, key: str = "doc_key") -> DataFrame:
    """The strict stage, then the relaxed stage over its survivors: strict_keeper, relaxed_keeper (null for rows that the
    strict stage dropped), kept_after_exact."""
    strict = exact_stage(docs, strict_hash, priority, key).withColumnsRenamed({"keeper": "strict_keeper", "group_size": "strict_size", "kept": "strict_kept"})
    # Dropped rows take no part in the relaxed stage: they have no relaxed hash there.
    strict = strict.withColumn("__relaxed", F.when(F.col("strict_kept"), F.col(relaxed_hash)))
    groups = strict.where("strict_kept").groupBy("__relaxed").agg(F.min_by(key, priority).alias("relaxed_keeper"), F.count(F.lit(1)).alias("relaxed_size"))
    joined = strict.join(groups, "__relaxed", "left").drop("__relaxed")
    return joined.withColumn("kept_after_exact", F.col("strict_kept") & (F.col(key) == F.col("relaxed_keeper")))


def final_keeper(exact: DataFrame, near: DataFrame | None = None, key: str = "doc_key") -> DataFrame:
    """key, final_keeper, stage: follows a row's keeper through the strict, relaxed and near stages. ``near``: key, near_keeper."""
    lookup = exact.select(F.col(key).alias("strict_keeper"), F.col("relaxed_keeper").alias("next_keeper"))
    out = exact.select(key, "strict_keeper", "strict_kept", "relaxed_keeper").join(lookup, "strict_keeper").withColumn("final_keeper", F.coalesce("next_keeper", "strict_keeper"))
    stage = F.when(~F.col("strict_kept"), "strict_exact").when(F.col(key) != F.col("relaxed_keeper"), "relaxed_exact")
    if near is not None:
        out = out.join(near.select(F.col(key).alias("final_keeper"), "near_keeper"), "final_keeper", "left")
        stage = stage.when(F.col("near_keeper").isNotNull() & (F.col(key) != F.col("near_keeper")), "near_duplicate")
        out = out.withColumn("final_keeper", F.coalesce("near_keeper", "final_keeper"))
    return out.select(key, "final_keeper", stage.otherwise("kept").alias("stage"))


def metadata_dedup(docs: DataFrame, key: Column, priority: Column) -> DataFrame:
    """Of rows with one metadata key the one with the least priority; rows without a key pass."""
    keyed = docs.withColumn("__key", key)
    best = keyed.where("__key is not null").groupBy("__key").agg(F.min_by(F.struct(*docs.columns), priority).alias("row"))
    return best.select("row.*").unionByName(keyed.where("__key is null").drop("__key"))


def families(exact: DataFrame, keeper: str, source: str = "source_dataset") -> DataFrame:
    """Adds family_id, family_size, family_source_count, mixed_source and pool: groups of rows with one final keeper."""
    groups = exact.groupBy(keeper).agg(F.count(F.lit(1)).alias("family_size"), F.collect_set(source).alias("__sources"))  # bounded by the sources
    n = F.size("__sources")
    pool = F.when(n > 1, F.concat(F.lit("shared:"), F.array_join(F.array_sort("__sources"), "+"))).otherwise(F.concat(F.lit("unique:"), F.get("__sources", F.lit(0))))
    groups = groups.select(keeper, F.md5(keeper).alias("family_id"), "family_size", n.cast("long").alias("family_source_count"), (n > 1).alias("mixed_source"), pool.alias("pool"))
    return exact.join(groups, keeper)


def decisions(exact: DataFrame, near: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, kept, stage, cluster_id, similarity: what becomes of every document, after the strict, relaxed and near stages. ``near``: what
    minhash.with_singletons gives over the survivors of the exact stages."""
    final = final_keeper(exact, near.select(key, F.col("representative").alias("near_keeper")), key)
    own = near.select(key, "cluster_id", "similarity")
    return final.join(own, key, "left").select(key, F.col("final_keeper").alias("kept"), "stage", "cluster_id", "similarity")
