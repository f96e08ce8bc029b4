"""Joins whose keys may be hot, and filters of a fixed size that are broadcast before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this part of all rows, so that there are at most so many hot keys.
HOT_PART = 1000


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each key and in ``count`` how many of the ``total`` rows have it.

    Hot keys, HOT_PART at most whatever the input, are broadcast, so their rows stay where they are; the others, none of which
    holds a HOT_PART-th of the rows, meet in a merge join. Both tables are read twice: give written ones. Null keys join
    nothing. ``how`` is inner or left.
    """
    least = max(2, total // HOT_PART)
    hot = F.broadcast(groups.where(F.col(count) >= least).withColumn("__hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    cold = marked.where("__hot is null").select(*rows.columns).join(groups.where(F.col(count) < least).hint("merge"), keys, how)
    return marked.where("__hot").select(*cold.columns).unionByName(cold)


#: Bits of a bitmap for each entry, as long as the bitmap is under its bound.
ENTRY_BITS = 512


def bitmap_of(hashes: DataFrame, column: str, entries: int, most_bits: int = 28) -> np.ndarray:
    """A bitmap of 64-bit hashes (a Bloom filter with two probes): uint64 words.

    It has ENTRY_BITS bits for each entry, so that one in 60,000 other hashes passes, and 2 ** most_bits bits at most, 32 MB, however
    many entries there are: above that more hashes pass that are not in it, none is missed. The driver gets at most one
    row for each word.
    """
    bits = min(most_bits, max(16, int(ENTRY_BITS * max(1, entries) - 1).bit_length()))
    first, second = F.shiftrightunsigned(column, 64 - bits), F.shiftrightunsigned(F.call_function("shiftleft", F.col(column), F.lit(32)), 64 - bits)
    place = hashes.select(F.explode(F.array(first, second)).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    found = place.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be in the bitmap."""
    shift = np.uint64(64 - 6 - (len(bitmap).bit_length() - 1))

    def there(place: np.ndarray) -> np.ndarray:
        return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    out = there(hashes >> shift)
    some = np.flatnonzero(out)
    out[some] = there((hashes[some] << np.uint64(32)) >> shift)
    return out
