"""Normal forms that need Unicode composition and case folding, as vectorised functions over Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Characters without width.
ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍⁠﻿"))
#: Marks that count as one in the relaxed form.
RELAXED = str.maketrans({"’": "'", "‘": "'", "ʼ": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "–": "-", "—": "-", "…": "...", "·": "·"})
#: Marks and separators.
MARKS = regex.compile(r"[\p{P}\p{Z}]+")
#: The two Greek blocks, whose letters lose the marks after them.
GREEK_MARKED = regex.compile(r"([\u0370-\u03FF\u1F00-\u1FFF])\p{M}+")
#: A word that a line end parts.
WRAPPED = regex.compile(r"(?<=\p{L})-\s*\n\s*(?=\p{L})")


@functools.cache
def mark_patterns() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """What the relaxed form makes a space, marks and separators and the keys of RELAXED, which become marks: a table for ASCII, and patterns
    of the standard library, which is faster by far, for the basic plane and for all characters."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    runs = [(m[0], m[-1]) for m in MARKS.findall(every)] + [(chr(c), chr(c)) for c in RELAXED]
    basic, full = ("[" + "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in runs if a <= most) + "]+" for most in ("\uffff", chr(sys.maxunicode)))
    return {c: " " for c in range(128) if MARKS.match(chr(c))}, re.compile(basic), re.compile(full)


#: Characters outside the basic plane.
ASTRAL = re.compile("[^\u0000-\uffff]")


def spaced(text: str) -> str:
    """White space made one, none at the ends: what is split at is what ``\\s`` matches."""
    return " ".join(text.split())


def composed(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    for c in ZERO_WIDTH:
        text = text.replace(chr(c), "")
    return unicodedata.normalize("NFC", text)


def strict(text: str) -> str:
    return spaced(composed(text))


def without_greek_marks(text: str) -> str:
    """Greek letters lose their marks; those of other scripts stay."""
    return unicodedata.normalize("NFC", GREEK_MARKED.sub(r"\1", unicodedata.normalize("NFD", text)))


def relaxed(text: str, strip_marks: bool = False) -> str:
    folded = text.casefold()
    if strip_marks:
        folded = without_greek_marks(folded)
    table, basic, full = mark_patterns()
    if folded.isascii():
        return spaced(folded.translate(table))
    return spaced((full if ASTRAL.search(folded) else basic).sub(" ", folded.replace("­", "")))


def near(text: str, strip_marks: bool = False) -> str:
    """Relaxed form after words that a line end parts are joined."""
    return relaxed(WRAPPED.sub("", composed(text)), strip_marks)


def column_of(fn, *args):
    @F.pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t, *args))

    return apply


def exact_forms(text: str) -> tuple[str, str, int, int]:
    """md5 of the strict form and of its relaxed form, and the characters of both."""
    one = strict(text)
    two = relaxed(one)
    return hashlib.md5(one.encode()).hexdigest(), hashlib.md5(two.encode()).hexdigest(), len(one), len(two)


@F.pandas_udf(StructType([StructField("strict_md5", StringType()), StructField("relaxed_md5", StringType()), StructField("strict_chars", LongType()), StructField("relaxed_chars", LongType())]))
def exact_hashes(texts: pd.Series) -> pd.DataFrame:
    """Both forms of the exact stages in one pass over the texts; nulls for a null text."""
    return pd.DataFrame([(None, None, None, None) if t is None else exact_forms(t) for t in texts], columns=["strict_md5", "relaxed_md5", "strict_chars", "relaxed_chars"]).astype({"strict_chars": "Int64", "relaxed_chars": "Int64"})


strict_text = column_of(strict)
relaxed_text = column_of(relaxed)
relaxed_stripped_text = column_of(relaxed, True)
near_text = column_of(near)


@F.pandas_udf(ArrayType(StringType()))
def markdown_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else chunk_markdown(t))


def chunk_markdown(text: str, target: int = 1200, most: int = 2000) -> list[str]:
    """Sections by header, packed to the target; of those that are too long, paragraphs, then sentences, then hard cuts."""
    sections = re.split(r"\n(?=#{1,6}\s)", text)
    return [c for c in pack([p for s in sections for p in shrink(s, most)], target, most) if c.strip()]


def shrink(part: str, most: int) -> list[str]:
    if len(part) <= most:
        return [part]
    for cut in (r"\n\s*\n", r"(?<=[.!?;·])\s+"):
        parts = re.split(cut, part)
        if len(parts) > 1:
            return [q for p in parts for q in shrink(p, most)]
    return [part[i : i + most] for i in range(0, len(part), most)]


def pack(parts: list[str], target: int, most: int) -> list[str]:
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) < target and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out
