"""Stable keys, hash priorities and selection priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_key(source: Column, doc_id: Column) -> Column:
    """A key of source and id, which are parted by a character that is in neither; a null is none of the texts."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("\x01"))
    return F.sha2(F.concat(part(source), F.lit("\x00"), part(doc_id)), 256)


def split_key(*parts: Column | str, salt: str = "") -> Column:
    """md5 over parts joined by colons; the same in any engine."""
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts), F.lit(salt)))


def priority(*parts: Column, seed: str = "") -> Column:
    """A number in [0, 1) from 52 bits of sha256."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def representative_score(length: Column, badness: Column) -> Column:
    """Length weighed by badness; 0 where either is unknown."""
    return F.when((length > 0) & badness.isNotNull(), F.greatest(F.lit(0.0), length * (1.0 - badness / 10.0))).otherwise(0.0)


def flag_rank(flag: Column) -> Column:
    return F.when(flag, 1.0).when(~flag, 0.0).otherwise(0.5)


def selection_priority(length: Column, badness: Column, mojibake: Column, needs_ocr: Column, ocr_success: Column, title: Column, author: Column, source: Column, doc_id: Column) -> Column:
    """The order in which one of several equal documents is chosen; less is better, unknown numbers come last."""
    unknown = F.lit(float("inf"))
    invalid = F.when(F.coalesce(needs_ocr, F.lit(False)) & ~F.coalesce(ocr_success, F.lit(False)), 1.0).otherwise(0.0)
    return F.struct(
        invalid.alias("invalid"), flag_rank(needs_ocr).alias("needs_ocr"), (-representative_score(length, badness)).alias("score"), F.coalesce(badness, unknown).alias("badness"),
        F.coalesce(mojibake, unknown).alias("mojibake"), (1.0 - flag_rank(ocr_success)).alias("ocr"),
        (F.coalesce(title, F.lit("")) == "").cast("int").alias("title"), (F.coalesce(author, F.lit("")) == "").cast("int").alias("author"), source.alias("source"), doc_id.alias("doc_id"),
    )


def projected_mask(mask: Column, layer: dict[int, int]) -> Column:
    """The bits of the layer above: each stands if any of its bits below (the key) does."""
    out = F.lit(0).cast("long")
    for below, above in layer.items():
        out = out.bitwiseOR(F.when(mask.bitwiseAND(F.lit(below)) != 0, F.lit(above)).otherwise(F.lit(0)).cast("long"))
    return out
