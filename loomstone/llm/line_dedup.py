"""Removal of repeated passages of lines, wherever they begin and end.

Every two lines in a row that are not blank (with the blank lines between them) are a window, and so is a line of
LONG_WORDS words or more. Windows that occur more than once in the corpus are compared byte by byte, and the lines of
all but the first occurrence are removed. A passage of two lines or more is the union of its windows, so it is found
whole, with its first and last line, whatever stands around it. The first occurrence of each line stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes, id_and_text, map_arrow
from loomstone.plans.session import written
from loomstone.plans.skew import bitmap_of, hot_join, in_bitmap

LONG_WORDS = 50


def is_long(line: bytes) -> bool:
    return len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS


def chunks(text: bytes) -> list[tuple[int, int]]:
    """First line and end (exclusive) of each chunk, a line with the blank ones before it; together they are all lines of the text."""
    lines = text.split(b"\n")
    out, first = [], 0
    for i, line in enumerate(lines):
        if line.strip():
            out.append((first, i + 1))
            first = i + 1
    if first < len(lines):
        out.append((first, len(lines)))
    return out


def windows(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """First chunk, chunks and bytes of each window: of each two lines in a row, and of each long line. How many blank lines
    stand between two lines doesn't matter."""
    before = None
    for k, line in enumerate(x for x in text.split(b"\n") if x.strip()):
        if is_long(line):
            yield k, 1, line
        if before is not None:
            yield k - 1, 2, before + b"\n" + line
        before = line


def eligible(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Number of each chunk that may be removed and the bytes for whose repetition it is, once for each window that it is in."""
    for first, n, data in windows(text):
        for k in range(n):
            yield first + k, b"%d|" % k + data


def document_key(doc_id: int | None, text: bytes) -> bytes:
    """Rows that equal each other in id and text are one document."""
    return hashlib.blake2b(b"%d|" % doc_id + text if doc_id is not None else b"|" + text, digest_size=16).digest()


def window_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text -> hash of each window."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [xxhash.xxh3_64_intdigest(data) for text in as_bytes(batch.column(1)) for _, _, data in windows(text)]
            return pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["hash"])

        return fn

    return map_arrow(docs.select("doc_id", "text"), make, "hash long", rows=256)


def window_rows(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id, text -> doc_id, doc, chunk, span, hash, bytes: one row for each window whose hash may be in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        repeated = shared.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = list(windows(text))
                hashes = np.array([xxhash.xxh3_64_intdigest(data) for *_, data in found], np.uint64)
                kept = np.flatnonzero(in_bitmap(repeated, hashes)).tolist()
                doc = document_key(doc_id, text) if kept else b""
                out += [(doc_id, doc, *found[i][:2], int(hashes[i].view(np.int64)), found[i][2]) for i in kept]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            names, kinds = ["doc_id", "doc", "chunk", "span", "hash", "bytes"], [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        return fn

    return map_arrow(docs, make, "doc_id long, doc binary, chunk int, span int, hash long, bytes binary", rows=256)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (without the repeated passages), n_lines, removed_lines, removed_chunks (lines that are not blank).

    Of a repeated window the occurrence with the least doc_id stays (null ids come last; then the first in the text).
    Rows that equal each other in id and text are one document and get one result. A null text counts as empty and
    has one empty line; an empty table gives an empty table; other columns are left out. A line goes with the blank lines before it and
    its line end; what is left is joined by line ends.

    Counts are summed before the shuffle. A bitmap of the repeated hashes, of a fixed size, keeps nearly all other windows
    from being dealt out, and a window that a third of all documents share is one row that is broadcast to them.
    """
    rows = id_and_text(docs, id_col, text_col)
    hashes = written(window_hashes(rows).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "lines-hashes")
    maybe = window_rows(rows, bitmap_of(hashes, "hash", hashes.count()))
    repeated = written(maybe.join(hashes.hint("merge"), "hash", "left_semi"), "lines-repeated")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", "chunk")
    # Grouping by the bytes themselves is the comparison: equal hashes of different bytes part here.
    groups = written(repeated.groupBy("hash", "bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "lines-groups")
    gone = hot_join(repeated, groups, ["hash", "bytes"], "n", repeated.count())
    gone = gone.where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("chunk") == F.col("first.chunk"))))
    gone = gone.select("doc", F.explode(F.sequence("chunk", F.col("chunk") + F.col("span") - 1)).alias("chunk")).groupBy("doc").agg(F.collect_set("chunk").alias("gone"))  # bounded by a document's own chunks
    gone = written(gone, "lines-gone")

    def make_keys():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            return pa.RecordBatch.from_arrays([pa.array([document_key(i, t) for i, t in zip(ids, texts, strict=True)], pa.binary()), *batch.columns], ["doc", "doc_id", "text"])

        return fn

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, drop in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines, drop, kept, removed = text.split(b"\n"), set(drop or ()), [], 0
                for k, (first, end) in enumerate(chunks(text)) if drop else ():
                    if k in drop:
                        removed += end - first
                    else:
                        kept += lines[first:end]
                out.append((b"\n".join(kept).decode() if drop else text.decode(), len(lines), removed, len(drop)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "text", "n_lines", "removed_lines", "removed_chunks"])

        return fn

    keyed = map_arrow(rows, make_keys, "doc binary, doc_id long, text string", rows=256)
    joined = keyed.join(gone.hint("merge"), "doc", "left").select("doc_id", "text", "gone")
    return map_arrow(joined, make, "doc_id long, text string, n_lines long, removed_lines long, removed_chunks long", rows=256)
