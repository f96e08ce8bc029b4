"""Connected components of an undirected edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.session import written
from loomstone.plans.skew import hot_join

MOST_ROUNDS = 60


def star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: every node points its larger (or smaller) neighbours, and in the small step itself, to the least node around it.

    ``edges`` is a written table of ``total`` rows. The least neighbour is a minimum that is combined before the shuffle; of
    a node with very many edges it is broadcast to them, so a hub's edges are not dealt to one task.
    """
    if large:
        around, rows = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * total
    else:
        around, rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total
    least = around.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "v").alias("m"), "degree")
    moved = hot_join(around, least, ["u"], "degree", rows)
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """node, component: the least node that can be reached from each node that has an edge.

    Rows with a null end and loops say nothing; repeated edges do no harm; no edges give an empty table. Each round
    writes its edges to the shared folder, so lineage stays short and a lost executor costs a task. The driver gets
    two numbers a round.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = written(now, "components")
    seen, total = None, now.count()
    for _ in range(MOST_ROUNDS):
        if not total:
            break
        now = written(star(written(star(now, True, total), "components"), False, total), "components")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == seen:
            break
        seen, total = tuple(row), row[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
