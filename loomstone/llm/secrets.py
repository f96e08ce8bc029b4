"""Secret scans with an incremental ledger of blobs, in DataFrame operations only.

Every version of a file is addressed by its content. The ledger says which blob was scanned under which rules and
what was found; a run scans only pairs of blob and rule version that the ledger does not hold, adds them to it, and
joins the findings back to all paths (here: documents) that have the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import id_and_text
from loomstone.plans.session import written
from loomstone.plans.skew import hot_join

#: Kinds in their order. The first three are the base; of a match of ``assign`` group 2 must have 6 characters, so
#: that rule is held against its group; the others state their least length in the pattern.
RULES = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
BASE = ("assign", "access", "hex")
LEAST_GROUP = {"assign": (2, 6)}
RULE_VERSION = "1"
LEDGER = "blob string, rule_version string, spans array<struct<start:int,rank:int,kind:string,end:int>>"


def matches_of(text: Column, kind: str) -> Column:
    """array<struct<rank, nth, gap, size, keep>> of one kind: leftmost, non-overlapping; the lengths of each match and of the gap
    before it, in code points, and whether it is long enough. Texts that have no match, nearly all, are scanned once."""
    pattern, rank = RULES[kind], list(RULES).index(kind)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group, least = LEAST_GROUP.get(kind, (0, 0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    parts = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("size"), sizes.alias("group"))
    rows = F.transform(parts, lambda p, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), p["gap"].alias("gap"), p["size"].alias("size"), (p["group"] >= least).alias("keep")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<rank:int,nth:int,gap:int,size:int,keep:boolean>>"))


def scan(blobs: DataFrame) -> DataFrame:
    """blob, text -> blob, rule_version, spans; one row for each row, whose blobs must differ.

    The matches of a text become rows, and a running sum over them, of one kind in one text, gives their places: work
    is in proportion to the matches, however many a text has.
    """
    found = written(blobs.select("blob", F.concat(*(matches_of(F.col("text"), k) for k in RULES)).alias("matches")), "secret-matches")
    rows = found.where(F.size("matches") > 0).select("blob", F.inline("matches"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    names = F.element_at(F.array(*map(F.lit, RULES)), F.col("rank") + 1)
    placed = rows.withColumn("end", end.cast("int")).where("keep")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", names.alias("kind"), "end")
    spans = placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # bounded by one text
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return found.select("blob").join(spans.hint("merge"), "blob", "left").select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.coalesce("spans", none).alias("spans"))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings for each row, and the ledger with this run's scans added.

    Findings: doc_id, blob (sha256 of the text in UTF-8), spans array<struct<start, rank, kind, end>> in order of start,
    then of the rules. A null text counts as empty and has no findings; repeated rows and null ids each have their row;
    an empty table gives none. ``ledger`` has blob, rule_version, spans; repeated entries in it do no harm.

    Of many rows with one text one is scanned: texts are dealt out by blob, copies merged before that, and with a
    ledger only those that it lacks.
    """
    scanned = scan_unseen(docs, ledger, id_col, text_col)
    ledger = scanned if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(scanned)
    return with_paths(addressed_rows(docs, id_col, text_col).select("doc_id", "blob"), ledger), ledger


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """New rows of the ledger: of blobs that it does not hold under the present rules."""
    blobs = addressed_rows(docs, id_col, text_col).select("blob", "text")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        blobs = blobs.join(seen.hint("merge"), "blob", "left_anti")
    return written(scan(blobs.groupBy("blob").agg(F.any_value("text").alias("text"))), "secret-ledger")


def addressed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def with_paths(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings of the ledger, under the present rules, joined back to all rows that have the blob; those of a blob that very many rows
    have are broadcast to them."""
    paths = written(paths, "secret-paths")
    copies = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    of_version = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    found = written(of_version.join(copies.hint("merge"), "blob"), "secret-found")
    joined = hot_join(paths, found, ["blob"], "copies", paths.count(), "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(of_version.schema["spans"].dataType)).alias("spans"))


def scan_with_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings as secret_scan gives them, with a ledger that lasts: the Parquet table at ``path`` is read, what this run scans
    for the first time is appended to it, and the findings are read from it.

    The files of a run are committed at once, so a broken run leaves the ledger as it was and can be repeated. Two runs at
    the same time may both add a blob; repeated entries do no harm.
    """
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    before = spark.read.schema(LEDGER).parquet(path) if known else None
    scan_unseen(docs, before, id_col, text_col).write.mode("append").parquet(path)
    return with_paths(addressed_rows(docs, id_col, text_col).select("doc_id", "blob"), spark.read.schema(LEDGER).parquet(path))


def digests(findings: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(rank: int) -> Column:
        return F.filter("spans", lambda s: s["rank"] == rank)

    spans, base = F.col("spans"), F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return findings.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
