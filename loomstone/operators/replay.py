"""Duplicate policies at build time: representatives by quality or by a balanced share of sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.components import connected_components

ACTIONS = ("ignore", "annotate", "drop_intra", "drop_intra_and_inter")


def quality_first(members: DataFrame, priority: Column, family: str | list[str] = "family_id", key: str = "doc_key") -> DataFrame:
    """Adds ``representative``, the member with the least priority of each family. For families within one source give family and source."""
    keys = [family] if isinstance(family, str) else family
    best = members.groupBy(*keys).agg(F.min_by(key, priority).alias("representative"))
    return members.join(best, keys)


def balanced(pool: pd.DataFrame, weights: dict[str, float]) -> dict[str, str]:
    """family -> representative, over the families of one pool in the order of their ids: of each source's best member the one whose
    source is then furthest below its share (characters over weight); of equals the source with the least so far, then by name."""
    mass: dict[str, float] = {}
    out = {}
    for family, rows in pool.sort_values(["family_id", "source_dataset", "rank", "doc_key"]).groupby("family_id", sort=True):
        best = rows.drop_duplicates("source_dataset")
        share = {r.source_dataset: weights.get(r.source_dataset, 1.0) for r in best.itertuples()}
        load = [((mass.get(r.source_dataset, 0.0) + r.chars) / share[r.source_dataset], mass.get(r.source_dataset, 0.0) / share[r.source_dataset], r.source_dataset, r) for r in best.itertuples()]
        *_, source, chosen = min(load, key=lambda x: x[:3])
        mass[source] = mass.get(source, 0.0) + chosen.chars
        out[family] = chosen.doc_key
    return out


def share_aware(members: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``representative``. Members: doc_key, source_dataset, family_id, pool, chars, rank.

    The choice depends on all choices before it in its pool, so a pool is one group; only families of several documents take part.
    """
    weights = weights or {}
    if any(w <= 0 for w in weights.values()):
        raise ValueError("source weights must be positive")

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(balanced(pool, weights).items()), columns=["family_id", "representative"])

    many = members.select("doc_key", "source_dataset", "family_id", "pool", "chars", "rank", F.count(F.lit(1)).over(_by("family_id")).alias("n")).where("n > 1")
    chosen = many.groupBy("pool").applyInPandas(choose, "family_id string, representative string")
    return members.join(chosen, "family_id", "left").withColumn("representative", F.coalesce("representative", "doc_key"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def apply_action(members: DataFrame, action: str, representative: str = "representative", key: str = "doc_key", priority: Column | None = None, family: str = "family_id", source: str = "source_dataset") -> DataFrame:
    """ignore and annotate keep all rows. drop_intra_and_inter keeps each family's representative. drop_intra parts families by
    source first, so that copies in different sources stay, and keeps the best row by ``priority`` of each part."""
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
    if action == "drop_intra":
        if priority is None:
            raise ValueError("drop_intra needs a priority, as a family has a representative in each source")
        members = quality_first(members.drop(representative), priority, [family, source], key)
    return members.where(F.col(key) == F.col(representative)) if action.startswith("drop") else members


def threshold(exported_floor: float, exported_default: float | None = None, asked: float | None = None) -> tuple[float, float]:
    """The floor of the exported candidates, and the threshold in force; one below the floor can't be answered from the export."""
    chosen = asked if asked is not None else exported_default if exported_default is not None else exported_floor
    if chosen < exported_floor:
        raise ValueError(f"similarity threshold {chosen} is below the exported candidate floor {exported_floor}")
    return exported_floor, chosen


def families_of(docs: DataFrame, hashes: list[str], pairs: DataFrame, least: float, same_source_only: bool = False, key: str = "doc_key", source: str = "source_dataset") -> DataFrame:
    """key, family: connected by equal hashes (stars to the least key of each, no pairs) and by pairs (left_key, right_key,
    estimated_jaccard) at the threshold and above; with ``same_source_only`` only within a source. A row without any is its own family."""
    edges = None
    for column in hashes:
        keys = [column, source] if same_source_only else [column]
        rows = docs.where(F.col(column).isNotNull() & (F.col(column) != "")).select(key, *keys)
        least_key = rows.groupBy(*keys).agg(F.min(key).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
        star = rows.join(least_key, keys).select(F.col(key).alias("u"), "v")
        edges = star if edges is None else edges.unionByName(star)
    near = pairs.where(F.col("estimated_jaccard") >= least).select(F.col("left_key").alias("u"), F.col("right_key").alias("v"))
    of = docs.select(F.col(key).alias("k"), F.col(source).alias("s"))
    near = near.join(of.withColumnsRenamed({"k": "u", "s": "su"}), "u").join(of.withColumnsRenamed({"k": "v", "s": "sv"}), "v")
    near = (near.where(F.col("su").eqNullSafe(F.col("sv"))) if same_source_only else near).select("u", "v")
    edges = near if edges is None else edges.unionByName(near)
    found = connected_components(edges).withColumnsRenamed({"node": key, "component": "family"})
    return docs.select(key).join(found, key, "left").withColumn("family", F.coalesce("family", key))


def selected_input(docs: DataFrame, keep: Column, dropped: DataFrame, action: str, members: DataFrame | None = None, priority: Column | None = None, key: str = "doc_key") -> DataFrame:
    """Rows that pass the filter, whose key is not on the drop list, and that the duplicate policy keeps. Only rows that have a family of
    several (``members``: key, family_id, source_dataset, representative and what the priority needs) go through the policy."""
    passed = docs.where(keep).join(dropped.select(key).distinct(), key, "left_anti")
    if members is None or not action.startswith("drop"):
        return passed
    present = members.join(passed.select(key), key, "left_semi")
    gone = present.select(key).join(apply_action(present, action, priority=priority, key=key).select(key), key, "left_anti")
    return passed.join(gone, key, "left_anti")
