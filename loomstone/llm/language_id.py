"""Language identification by fusion of Bayesian evidence: text likelihoods, declared markup language, address suffix and
priors of hosts that are smoothed over a hierarchy (host, site, suffix, all), all from grouped aggregation.

Likelihoods: naive Bayes over hashed byte trigrams, learned from documents with a known language. The other evidence has
no labels of its own; its tables are sums of the text posteriors over everything that shares a declaration,
suffix, site or host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes, crc_bucket, map_arrow
from loomstone.plans.session import written
from loomstone.plans.skew import hot_join

BINS = 1 << 16
#: Languages whose sums a counting task holds at once.
HELD_LANGUAGES = 64
#: A text counts as at most this many independent trigrams.
MOST_EVIDENCE = 60.0
#: Weight of the level above, in pages, in the prior of a host, a site and a suffix, and of all in a declaration.
PRIOR = 5.0

#: The attributes of the first html tag, and the language among them; each pattern passes over a page once.
HTML_TAG = r"(?is)<html\b([^<>]*)"
DECLARED = r"(?is)(?:^|[\s\"'])lang\s*=\s*[\"']?\s*([a-z]{2,3})"
#: Second labels under which countries register sites.
SECOND = "co|com|org|net|gov|edu|ac|ne|or|go"
SUFFIX = rf"(?:^|\.)((?:{SECOND})\.[a-z]{{2}}|[^.]+)$"
SITE = rf"(?:^|\.)([^.]+\.(?:(?:{SECOND})\.[a-z]{{2}}|[^.]+))$"

RAW = re.compile(rb"(?i)(script|style)\b")
ENTITY = re.compile(rb"(?i)&[a-z#0-9]+;")


def without_markup(page: bytes) -> bytes:
    """Tags, comments, scripts, styles and entities become spaces; what opens and never closes stays as text.

    One pass: an end that was looked for in vain is not looked for again, so broken markup takes no more time than good.
    """
    out, at, ends, low = [], 0, {}, None
    while (start := page.find(b"<", at)) >= 0:
        out.append(page[at:start])
        raw = RAW.match(page, start + 1)
        if raw:
            low = page.lower() if low is None else low
            close = b"</" + raw[1].lower()
            end = -1 if ends.get(close) else low.find(close, raw.end())
            ends[close] = end < 0
            end = end if end < 0 else page.find(b">", end)
        elif page.startswith(b"<!--", start):
            end = -1 if ends.get(b"-->") else page.find(b"-->", start + 4)
            ends[b"-->"] = end < 0
            end = end if end < 0 else end + 2
        else:
            end = -1
        if end < 0:
            end = -1 if ends.get(b">") else page.find(b">", start)
            ends[b">"] = end < 0
        if end < 0:  # nothing closes any more
            at = start
            break
        at = end + 1
    return ENTITY.sub(b" ", b" ".join([*out, page[at:]]))


def bins_of(text: bytes) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes, with spaces for all marks and digits; a space stands at both ends."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    letters = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letters, b, 32).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order of their names, and log10 probabilities (language, bin).

    From all rows with a language whose crc32(doc_id) mod 5 is not 2. The driver gets a row for each bin that a language has, and
    the table takes BINS numbers for each language that occurs.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.trim(lang_col)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = known.where("lang is not null and lang <> ''").where(crc_bucket(F.col("doc_id"), 5) != 2)
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    place = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            bins = {k: np.flatnonzero(v) for k, v in sums.items()}
            lang = np.repeat(np.array(list(bins), np.int32), [len(v) for v in bins.values()])
            at = np.concatenate([*bins.values(), np.zeros(0, np.int64)]).astype(np.int32)
            n = np.concatenate([*(sums[k][v] for k, v in bins.items()), np.zeros(0, np.int64)]).astype(np.int64)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bin", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                k = place[lang]
                if k not in sums:
                    if len(sums) >= HELD_LANGUAGES:
                        yield rows()
                    sums[k] = np.zeros(BINS, np.int64)
                sums[k] += np.bincount(bins_of(text), minlength=BINS)
        yield rows()

    table = np.full((len(languages), BINS), 0.5)
    summed = known.select("lang", "text").mapInArrow(count, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    table[summed.column("lang").to_numpy(), summed.column("bin").to_numpy()] += summed.column("n").to_numpy()
    return languages, np.log10(table / table.sum(axis=1, keepdims=True))


def likelihoods(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """Adds ``text_p`` array<double>: the posterior of the text alone with a flat prior, and drops ``text``. Markup is taken out of pages."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T.astype(np.float32)))  # a quarter of a MB for each language

    def make():
        model = shared.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.schema.names
            out = []
            for kind, text in zip(batch.column(names.index("kind")).to_pylist(), as_bytes(batch.column(names.index("text"))), strict=True):
                bins = bins_of(without_markup(text) if kind == "page" else text)
                if not len(bins):
                    out.append([1 / len(languages)] * len(languages))
                    continue
                mean = np.zeros(len(languages))
                for at in range(0, len(bins), 1 << 16):
                    mean += model[bins[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                mean *= min(len(bins), MOST_EVIDENCE) / len(bins)
                p = 10 ** np.maximum(mean - mean.max(), -12)
                out.append((p / p.sum()).tolist())
            keep = [n for n in names if n != "text"]
            return pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(out, pa.list_(pa.float64()))], [*keep, "text_p"])

        return fn

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return map_arrow(rows, make, schema + ", text_p array<double>", rows=256)


def sums_by(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Keys and ``sums`` array<double>: soft counts of the languages. Partial sums are made before the shuffle."""
    parts = [F.sum(F.col("text_p")[k]).alias(f"s{k}") for k in range(n)]
    return rows.groupBy(*keys).agg(*parts).select(*keys, F.array(*(F.col(f"s{k}") for k in range(n))).alias("sums"))


def smoothed(sums: Column, own: Column, above: Column) -> Column:
    """The distribution above and the soft counts of all other rows (a row's own posterior is taken out), as one distribution."""
    others = F.zip_with(F.coalesce(sums, own), own, lambda s, o: F.greatest(s - o, F.lit(0.0)))
    total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x) + PRIOR
    return F.zip_with(others, above, lambda s, a: (s + PRIOR * a) / total)


def evidence_rows(docs: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Documents and pages under one schema: kind, id, host, site, suffix, declared, text. A document's host is its source; it has no markup."""
    out = None
    none = F.lit(None).cast("string")
    if docs is not None:
        out = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("host"), F.lit("").alias("site"), F.lit("").alias("suffix"), none.alias("declared"), F.coalesce("text", F.lit("")).alias("text"))
    if pages is not None:
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        declared = F.lower(F.regexp_extract(F.regexp_extract(F.coalesce("html", F.lit("")), HTML_TAG, 1), DECLARED, 1))
        page = pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), host.alias("host"), F.nullif(declared, F.lit("")).alias("declared"), F.coalesce("html", F.lit("")).alias("text"))
        page = page.withColumn("site", F.regexp_extract("host", SITE, 1)).withColumn("suffix", F.regexp_extract("host", SUFFIX, 1))
        page = page.select("kind", "id", "host", "site", "suffix", "declared", "text")
        out = page if out is None else out.unionByName(page)
    return out


def language_id(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """One row per row of evidence_rows: kind, id, lang, probability, text_lang, declared.

    Null and empty texts have a flat likelihood, so the other evidence decides; ties go to the first language by name.
    Null addresses have the empty host. With no languages known lang is null. Repeated rows each have a row; an empty table
    gives an empty table. A row's own text is left out of the sums of its host, site, suffix and declaration, so it counts once.
    A host that a third of all rows share is one key of sums that are combined before the shuffle, and is broadcast to its rows.
    A document's host is its source; documents that carry a language train the text model.
    """
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("kind", "id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared")
    scored = written(likelihoods(rows, languages, table), "language-likelihoods")
    hosts = sums_by(scored, n, "kind", "suffix", "site", "host")

    def up(sums: DataFrame, *keys: str) -> DataFrame:
        return sums_by(sums.withColumnRenamed("sums", "text_p"), n, *keys)

    sites = up(hosts, "kind", "suffix", "site")
    suffixes = up(sites, "kind", "suffix")
    total = up(suffixes).select("sums").first()
    total = np.array(total.sums if total and total.sums[0] is not None else [0.0] * n)
    # Everything in one distribution, with one row more of each language; of hosts, sites and suffixes the sums side by side.
    everything, all_rows = F.array(*(F.lit(float(x) + 1) for x in total)), float(total.sum()) + n
    priors = hosts.withColumnRenamed("sums", "of_host").join(sites.withColumnRenamed("sums", "of_site"), ["kind", "suffix", "site"]).join(suffixes.withColumnRenamed("sums", "of_suffix"), ["kind", "suffix"])
    priors = written(priors.join(scored.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("rows")), ["kind", "host"]).select("kind", "host", "rows", "of_host", "of_site", "of_suffix"), "language-priors")
    joined = hot_join(scored, priors, ["kind", "host"], "rows", scored.count())
    declared = sums_by(scored.where("declared is not null"), n, "declared").select("declared", F.col("sums").alias("of_declared"))
    joined = joined.join(declared, "declared", "left")
    own, flat = F.col("text_p"), F.array(*[F.lit(1.0 / n)] * n)
    above = F.zip_with(everything, own, lambda a, o: (a - o) / (all_rows - 1.0))
    joined = joined.withColumn("above", above)
    for level in ("of_suffix", "of_site", "of_host"):
        joined = joined.withColumn("prior", smoothed(F.col(level), own, F.col("above" if level == "of_suffix" else "prior")))
    # Of a declaration: how much likelier it makes each language than it is over all.
    lift = F.when(F.col("of_declared").isNull(), flat).otherwise(F.zip_with(smoothed(F.col("of_declared"), own, F.col("above")), "above", lambda d, a: d / a))
    weight = F.zip_with(F.zip_with("text_p", "prior", lambda a, b: a * b), lift, lambda a, b: a * b)
    weighed = joined.select("kind", "id", "declared", "text_p", weight.alias("w"))
    best = F.array_max("w")
    names = F.array(*map(F.lit, languages))
    return weighed.select(
        "kind", "id", F.get(names, F.array_position("w", best).cast("int") - 1).alias("lang"), (best / F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("probability"),
        F.get(names, F.array_position("text_p", F.array_max("text_p")).cast("int") - 1).alias("text_lang"), "declared",
    )
