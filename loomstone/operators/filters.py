"""Predicates of the corpus filters; each builder returns a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import sub

#: Least badness that each quality preset rejects.
PRESETS = {"modern_strict": 25.0, "modern_relaxed": 30.0, "historical_tolerant": 35.0}


def all_of(*parts: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def sources(column: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    return all_of(column.isin(*include) if include is not None else None, ~column.isin(*exclude) if exclude else None)


def drop_needs_ocr(source: Column, needs_ocr: Column, of: list[str]) -> Column:
    return ~(source.isin(*of) & true(needs_ocr))


def flag_mode(flag: Column, mode: str) -> Column:
    """include: all rows; exclude: those without the flag; only: those with it."""
    modes = {"include": F.lit(True), "exclude": ~true(flag), "only": true(flag)}
    if mode not in modes:
        raise ValueError(f"mode must be one of {', '.join(modes)}")
    return modes[mode]


def quality_preset(preset: str, *, badness: Column, historical: Column, reliable: Column, needs_ocr: Column, ocr_success: Column, is_empty: Column, state: Column) -> Column:
    if preset == "none":
        return F.lit(True)
    if preset not in PRESETS:
        raise ValueError(f"unknown quality preset: {preset}")
    good = badness.isNull() | (badness < PRESETS[preset])
    good = true(historical) | good if preset == "historical_tolerant" else ~reliable | good
    return all_of(~true(is_empty), F.coalesce(state, F.lit("ok")).isin("ok", "keep", ""), ~true(needs_ocr) | true(ocr_success), good)


def standard_training(columns: list[str], *, badness_lt: float = 60.0, mojibake_lte: float | None = 0.1, allow_missing: bool = False, ratio_gte: float | None = 0.5, strict_sources: tuple[str, ...] = ()) -> Column:
    """The training filter, fitted to the columns that are there. Scores may be text; what isn't a number is missing."""

    def scored(name: str, test) -> Column | None:
        if name not in columns:
            if allow_missing:
                return None
            raise ValueError(f"input is missing {name}; cannot apply the training filter")
        value = F.col(name).try_cast("double")
        return value.isNull() | test(value) if allow_missing else value.isNotNull() & test(value)

    parts = [scored("badness_score", lambda v: v < badness_lt)]
    if mojibake_lte is not None:
        parts.append(scored("mojibake_score", lambda v: v <= mojibake_lte))
    if ratio_gte is not None and "charset_ratio" in columns:
        parts.append(F.col("charset_ratio").isNull() | (F.col("charset_ratio") >= ratio_gte))
    if "content_chars" in columns:
        parts.append(F.col("content_chars").isNull() | (F.col("content_chars") > 0))
    if "needs_ocr" in columns:
        clean = ~true(F.col("needs_ocr"))
        if "ocr_success" in columns:
            clean = F.when(F.col("source_dataset").isin(*strict_sources), clean).otherwise(clean | true(F.col("ocr_success"))) if strict_sources else clean | true(F.col("ocr_success"))
        parts.append(clean)
    return all_of(*parts)


def publishable(text: Column, badness: Column, below: float = 25.0) -> Column:
    """Non-empty text and a known badness below the bound."""
    return true((sub(F.coalesce(text, F.lit("")), r"\s+", "") != "") & (badness < below))


def badness_bucket(badness: Column) -> Column:
    return F.when(badness > 60, "bad").when(badness >= 10, "borderline").otherwise("ok")


def needs_rescoring(badness: Column, method: Column, latest: str) -> Column:
    return badness.isNull() | ~true(method == latest)


def experiment(source: Column, excluded: list[str], badness: Column, mojibake: Column | None, needs_ocr: Column | None = None, ocr_success: Column | None = None, badness_lt: float = 60.0, mojibake_lte: float = 0.1) -> Column:
    """Rows of an experiment: a known badness below the bound, no excluded source, mojibake unknown or low, no failed OCR."""
    clean = None if needs_ocr is None else ~true(needs_ocr) | (true(ocr_success) if ocr_success is not None else F.lit(False))
    return true(all_of(badness < badness_lt, ~source.isin(*excluded) if excluded else None, mojibake.isNull() | (mojibake <= mojibake_lte) if mojibake is not None else None, clean))


def web_crawl(quality: Column, register: Column, verdict: Column, text: Column, badness: Column, least_quality: int = 8, excluded_register: str = "MT", wanted: str = "keep", badness_max: float = 60.0) -> Column:
    """Pages of a crawl: a quality bin that is high enough, no machine translations, the wanted verdict, some text, badness unknown or low."""
    return all_of(true(quality >= least_quality), ~true(register == excluded_register), true(verdict == wanted), sub(F.coalesce(text, F.lit("")), r"\s+", "") != "", badness.isNull() | (badness <= badness_max))
