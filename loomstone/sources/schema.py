"""The canonical document row, and coercion to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the canonical row and their types; the first three booleans are never null.
CANONICAL = {
    "source_dataset": "string", "source_doc_id": "string", "text": "string", "title": "string", "author": "string", "source_metadata_json": "string",
    "is_historical_or_polytonic": "boolean", "contains_math": "boolean", "contains_latex": "boolean",
    "greek_percentage": "double", "latin_percentage": "double", "polytonic_ratio": "double", "table_ratio": "double", "greek_badness_score": "double", "len_greek": "long",
    "mojibake_badness_score": "double", "needs_ocr": "boolean", "ocr_success": "boolean", "is_empty": "boolean", "filter": "string", "quality_method": "string", "reevaluated_at": "timestamp",
}
NEVER_NULL = ("is_historical_or_polytonic", "contains_math", "contains_latex")


def canonical(df: DataFrame) -> DataFrame:
    """Missing columns become null, values that don't fit become null, other columns go; the order is fixed."""
    out = []
    for name, kind in CANONICAL.items():
        c = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(c, F.lit(False)) if name in NEVER_NULL else c).alias(name))
    return df.select(*out)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input is missing columns: {', '.join(missing)}")
    return df
