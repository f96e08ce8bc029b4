"""Exact deduplication by progressive refinement, in DataFrame operations only.

1. Group by length: a text whose length no other text has is alone.
2. Of the rest, group by length and the hash of a prefix.
3. Of the rest, group by length, prefix hash and the full hash, and only here is the full content needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import id_and_text, lower_ascii
from loomstone.plans.session import written
from loomstone.plans.skew import hot_join

PREFIX = 64


def full_hash(text: Column) -> Column:
    """sha256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; of equal texts the row with the largest doc_id
    stays. A null text counts as empty; null ids lose to all others; of rows with equal text and equal doc_id one
    is kept; an empty table gives an empty table; other columns are left out.

    text_sha256 is null for rows that the refinement parts before their full content is needed, as they are alone.
    With ``digest`` every row has it; then the hash is made in the scan's own tasks, so that no text is dealt out.
    Every other step deals out rows of a few numbers; groupings are sums or maxima that are combined before the
    shuffle, and what belongs to a hot key is broadcast to its rows, which then stay where they are.
    """
    rows = id_and_text(docs, id_col, text_col)
    keys = ["length", "prefix"]
    sized = rows.select("doc_id", F.octet_length("text").alias("length"), F.xxhash64(lower_ascii(F.substring("text", 1, PREFIX))).alias("prefix"), (full_hash(F.col("text")) if digest else F.col("text")).alias("content"))
    sized = written(sized, "dedup-sized") if digest else sized

    short = written(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "dedup-short")
    total = short.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lengths = short.groupBy("length").agg(F.sum("n").alias("of_length")).where("of_length > 1").select("length")
    suspects = written(short.where("n > 1").join(lengths.hint("merge"), "length", "left_semi").withColumn("suspect", F.lit(True)), "dedup-suspects")

    flagged = hot_join(sized, suspects, keys, "n", total, "left")
    hashed = F.col("content") if digest else F.when(F.col("suspect"), full_hash(F.col("content")))
    flagged = written(flagged.select("doc_id", *keys, "suspect", hashed.alias("text_sha256")), "dedup-hashed")

    keys = [*keys, "text_sha256"]
    counted = written(flagged.where("suspect").groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("copies")), "dedup-counted")
    groups = written(counted.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "dedup-groups")
    copies = hot_join(counted, groups, keys, "group_size", total).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    alone = flagged.where("suspect is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256").unionByName(alone)


#: The result of exact_groups with digests over the table documents, for DuckDB.
ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns as they are, of each group of equal texts: the one that exact_groups keeps.

    Rows that equal the kept one in id and text are dropped too, whatever their other columns hold. The dropped
    ids grow with the input, so the join is a merge join at every size.
    """
    key = "__exact_dedup_sha256"
    groups = written(exact_groups(docs, id_col, text_col, digest=True), "dedup-groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("repeat"))
    rows = docs.withColumn(key, full_hash(F.coalesce(F.col(text_col), F.lit(""))))

    def same(other: DataFrame):
        return (rows[key] == other["__sha"]) & rows[id_col].cast("long").eqNullSafe(other["__id"])

    losers, repeats = gone.where("not repeat").hint("merge"), gone.where("repeat").select("__id", "__sha").distinct()
    kept = rows.join(losers, same(losers), "left_anti")
    if not repeats.isEmpty():
        kept = kept.join(repeats, same(repeats), "left_anti").unionByName(rows.join(repeats, same(repeats), "left_semi").dropDuplicates([id_col, key]))
    return kept.drop(key)
