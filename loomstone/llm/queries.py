"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import bpe, decontaminate, exact_dedup, language_id, line_dedup, lm_score, near_dup, quality, secrets, token_files
from loomstone.plans.session import shared_path, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text is empty."""
    return bpe.bpe_round_trip(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id, n_links, class_size. A null or empty text is linked to none."""
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted. Null and empty texts have a score too."""
    docs = documents(spark, sf_dir)
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item: doc_id, item_id, containment, token_start, verbatim, a row for each item."""
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, text without repeated passages, n_lines, removed_lines, removed_chunks."""
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as versions of files: doc_id, counts and spans of findings. The run begins a ledger of its own in the shared folder."""
    return secrets.digests(secrets.scan_with_ledger(documents(spark, sf_dir), shared_path(spark, "secret-ledger-of-documents")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, start, n_tokens, ids_crc32, from the files that were written and read back."""
    return token_files.read_token_files(token_files.write_token_files(documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: doc_id or page_id, and the language found."""
    docs = documents(spark, sf_dir)
    found = language_id.language_id(language_id.evidence_rows(docs, spread(table(spark, sf_dir, "pages"))), *language_id.train(docs))
    ids = [F.when(F.col("kind") == kind, F.col("id")).alias(name) for kind, name in (("document", "doc_id"), ("page", "page_id"))]
    return found.select(*ids, "lang", "probability", "text_lang", "declared")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm_score.lm_scores(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_near_duplicates, op3_quality, op4_decontamination, op5_line_dedup, op6_secret_scan, op7_token_files, op8_exact_dedup, op9_language_id, op10_lm_score)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.ORACLE}
