"""The driver's tables in the canonical document model, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions.ids import doc_key
from loomstone.plans.session import spread, table

#: The canonical table: a document with its flags from the labels (unlabelled: null) and a badness score of its own.
CANON = r"""
canon AS (
  SELECT d.source AS source_dataset, CAST(d.doc_id AS VARCHAR) AS source_doc_id, d.doc_id AS doc_id, d.text AS text, d.lang AS lang,
         length(d.text) AS chars, l.quality = 0 AS needs_ocr, l.toxic = 0 AS ocr_success,
         CASE WHEN length(d.text) > 0 THEN round(100.0 * length(regexp_replace(d.text, '[\p{L}\p{N}\s]', '', 'g')) / length(d.text), 4) END AS badness,
         sha256(coalesce(d.source, chr(1)) || chr(0) || coalesce(CAST(d.doc_id AS VARCHAR), chr(1))) AS doc_key
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
#: The strict form, and the relaxed form of it. Of case folding the letters of the tables' languages that lower() leaves as they are.
STRICT = r"trim(regexp_replace(nfc_normalize(regexp_replace({0}, '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g')), '\s+', ' ', 'g'), ' ')"
RELAXED = r"trim(regexp_replace(regexp_replace(replace(replace(replace(lower(" + STRICT + r"), 'ß', 'ss'), 'ς', 'σ'), chr(173), ''), '[\p{{P}}\p{{Z}}]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def canon(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.col("source").alias("source_dataset"), F.col("doc_id").cast("string").alias("source_doc_id"), "doc_id", "text", "lang", F.length("text").cast("long").alias("chars"),
        (F.col("quality") == 0).alias("needs_ocr"), (F.col("toxic") == 0).alias("ocr_success"), T.badness(F.col("text")).alias("badness"),
        doc_key(F.col("source"), F.col("doc_id")).alias("doc_key"),
    )
