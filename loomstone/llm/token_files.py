"""Token ids in files of word-aligned blocks (Simple-8b), written in order of doc_id and read back.

A file holds a run of documents:

    magic
    blocks     each: n_ids u32, n_words u32, n_escapes u32, reserved u32, words u64[n_words], escapes u64[n_escapes]
    documents  doc_id i64[n], null u8[n], n_tokens u32[n]
    offsets    of each block, u64[n_blocks]
    footer     n_blocks u64, n_documents u64, offset of the documents u64, offset of the offsets u64, magic

A word has a selector in its top four bits; the selector says how many values of how many bits follow, lowest
first. Selector 0 is an escape: the word holds the place of one value, of over 60 bits, among the block's
escapes. Blocks hold a fixed count of ids, so they can be decoded alone and at once by selector.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.bpe import byte_of_char
from loomstone.llm.common import Known, as_bytes, id_and_text, resident, slices
from loomstone.plans.session import partitions_for, shared_path, written

MAGIC = b"LSTS8B01"
#: Count and width of the values in a word, for selectors 1 to 14.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK_IDS = 1 << 16
SHARD_BYTES = 16 << 20
WORD_CACHE = 800_000
#: Words of ASCII marks, digits and letters and of the letters of Latin-1, which normalisation only lower-cases.
SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Fixed value: the pre-tokenizer's pattern for such words in lower case.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Marks that often end words.
ENDS = b".,;:!?"
#: The character that stands for each byte in the vocabulary.
SHOWN = {b: c for c, b in byte_of_char().items()}


def both(first: np.ndarray, second: np.ndarray, distance: int) -> np.ndarray:
    out = first.copy()
    np.maximum(first[:-distance], second[distance:], out=out[:-distance])
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of one block, and its escapes (both uint64)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # The widest of the next ``count`` values, for each place, from the widest of fewer; behind the end there is nothing.
    widest = {1: np.zeros(n + 60, np.uint8)}
    widest[1][:n] = np.maximum(np.frexp(ids.astype(np.float64))[1], 1)
    selector, step = np.zeros(n, np.uint8), np.ones(n, np.uint8)
    for s in range(len(LAYOUT), 0, -1):  # higher counts come later and win
        count, bits = LAYOUT[s - 1]
        if count > 1:
            half = max(c for c in widest if c < count)
            rest = max(c for c in widest if c <= count - half)
            while half + rest < count:
                widest[half + rest] = both(widest[half], widest[rest], half)
                half, rest = half + rest, max(c for c in widest if c <= count - half - rest)
            widest[count] = both(widest[half], widest[rest], half)
        fits = widest[count][:n] <= bits
        np.copyto(selector, s, where=fits)
        np.copyto(step, count, where=fits)
    at = np.arange(n)
    nexts, starts, i = (at + step).tolist(), [], 0
    while i < n:
        starts.append(i)
        i = nexts[i]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        which = np.flatnonzero(chosen == s)
        if s == 0:
            words[which] = np.arange(len(which), dtype=np.uint64)
            escapes = ids[starts[which]]
            continue
        count, bits = LAYOUT[s - 1]
        for k in range(count):
            words[which] |= padded[starts[which] + k] << np.uint64(k * bits)
    return words, escapes if (chosen == 0).any() else np.zeros(0, np.uint64)


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block, selector by selector."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in LAYOUT), 0], np.int64)[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        which = selector == s
        if s == 0:
            out[starts[which]] = escapes[body[which].astype(np.int64)]
            continue
        count, bits = LAYOUT[s - 1]
        for k in range(count):
            out[starts[which] + k] = (body[which] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out[:n]


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one file in a stream: at most one block of ids is held."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, base = open_store(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.url = f"{base}/{name}", f"{folder}/{name}"
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.offsets, self.waiting, self.held = len(MAGIC), [], [], 0
        self.ids, self.nulls, self.counts = [], [], []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(tokens))
        self.waiting.append(tokens)
        self.held += len(tokens)
        if self.held >= BLOCK_IDS:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self.block(ids[i : i + BLOCK_IDS])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids)
        data = np.array([len(ids), len(words), len(escapes), 0], "<u4").tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        """The file's address, its documents and its tokens."""
        if self.held:
            self.block(np.concatenate(self.waiting))
        documents = np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(documents)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([len(self.offsets), len(self.ids), self.at, self.at + len(documents)], "<u8").tobytes() + MAGIC)
        self.out.close()
        return self.url, len(self.ids), sum(self.counts)


class ShardReader:
    def __init__(self, url: str) -> None:
        fs, path = open_store(url)
        self.file = fs.open_input_file(path)
        footer = self.read(self.file.size() - 40, 40)
        if footer[32:] != MAGIC:
            raise ValueError(f"{url} is not a complete token file")
        blocks, n, at, offsets = np.frombuffer(footer[:32], "<u8").astype(int).tolist()
        data = self.read(at, 13 * n)
        self.ids, self.nulls, self.counts = np.frombuffer(data[: 8 * n], "<i8"), np.frombuffer(data[8 * n : 9 * n], "u1"), np.frombuffer(data[9 * n :], "<u4")
        self.offsets = [*np.frombuffer(self.read(offsets, 8 * blocks), "<u8").astype(int).tolist(), at]

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at) if size else b""

    def block(self, k: int) -> np.ndarray:
        data = self.read(self.offsets[k], self.offsets[k + 1] - self.offsets[k])
        n, words, escapes, _ = np.frombuffer(data[:16], "<u4").tolist()
        return unpack(np.frombuffer(data[16 : 16 + 8 * words], "<u8"), np.frombuffer(data[16 + 8 * words : 16 + 8 * (words + escapes)], "<u8"), n)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document with its ids, in pieces of at most a block."""
        k, ids, at = -1, np.zeros(0, np.uint64), 0
        for doc, null, count in zip(self.ids.tolist(), self.nulls.tolist(), self.counts.tolist(), strict=True):
            pieces = []
            while count:
                if at == len(ids):
                    k, at = k + 1, 0
                    ids = self.block(k)
                piece = ids[at : at + count]
                pieces.append(piece)
                at += len(piece)
                count -= len(piece)
            yield (None if null else doc), pieces


class WordTokenizer:
    """The tokenizers library, asked once for each distinct piece.

    Normaliser and pre-tokenizer of the vocabulary never join what ASCII white space parts, so a text's ids are
    those of its words, one after the other. A word of simple characters is lower-cased, which there is the whole of
    normalisation, and parted as the pre-tokenizer does it, and the library's model encodes its pieces; any other
    word goes through the whole of the library. Words and pieces are kept in bounded caches.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model.tokenize
        self.words, self.pieces = Known(self.word, WORD_CACHE), Known(self.piece, WORD_CACHE)

    def piece(self, p: str) -> bytes:
        return array("I", [t.id for t in self.model(p if p.isascii() else p.encode().decode("latin-1").translate(SHOWN))]).tobytes()

    def word(self, w: bytes) -> bytes:
        if w.isalpha():  # ASCII letters, one piece
            return self.pieces[w.lower().decode()]
        core = w.rstrip(ENDS)
        if core.isalpha():  # and marks behind them, another
            return self.pieces[core.lower().decode()] + self.pieces[w[len(core) :].decode()]
        text = w.decode()
        if SIMPLE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, t.split())), "<u4") for t in texts]


def word_tokenizer(path: str) -> WordTokenizer:
    return resident(("word-bpe", path), lambda: WordTokenizer(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, append ``end_id`` to each and write them in ascending order of doc_id, null ids first, one
    file for each range of ids. Rows that share an id are ordered by their text. Returns the manifest: shard, path,
    n_docs, n_tokens, one row for each file.

    The texts are dealt out once, by ranges of doc_id. A file's name holds the attempt's own random part and only the
    manifest, which Spark commits, says which files count: lost or repeated attempts do no harm. A null text counts
    as empty (only the end id); an empty table gives an empty manifest.
    """
    spark, path = docs.sparkSession, tokenizer or default_path()
    folder = folder or shared_path(spark, "tokens")
    rows = id_and_text(docs, id_col, text_col)
    ordered = rows.repartitionByRange(partitions_for(docs, SHARD_BYTES), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, writer = word_tokenizer(path), TaskContext.get().partitionId(), None
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, 512):
                writer = writer or ShardWriter(folder, f"{shard:07d}-{uuid.uuid4().hex}.s8b")
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(as_bytes(part.column(1))), strict=True):
                    writer.add(doc, np.concatenate([ids, end]))
        if writer:
            url, n, tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [url], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return written(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document in the manifest's files: doc_id, start (ids of all documents before it), n_tokens (with
    the end id), ids_crc32 (of all its ids as little-endian unsigned 32-bit integers). Blocks are decoded one by one.

    The running sum goes over one row for each file, not over documents.
    """
    files = manifest.withColumn("start", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    files = files.select("path", F.coalesce("start", F.lit(0)).alias("start"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for doc, pieces in ShardReader(url).documents():
                    crc, count = 0, 0
                    for p in pieces:
                        crc, count = zlib.crc32(p.astype("<u4").tobytes(), crc), count + len(p)
                    rows.append((doc, start, count, crc))
                    start += count
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def iter_file(url: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All documents of one file, for training loops that read without Spark."""
    for doc, pieces in ShardReader(url).documents():
        yield doc, np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
