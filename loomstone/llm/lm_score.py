"""Language-model scores from a log-frequency Bloom filter of word n-grams (order 1 and 2).

Counting: each task turns its training texts into 64-bit keys of n-grams, sums them in sorted arrays and deals these out
by ranges of keys (shards), as a few blocks of bytes. A shard's task sums again and makes the shard's part of the
filter: an n-gram of count c is entered once for each level 1 .. 1 + floor(log2 c), so that probing the levels one
after the other until one is missing gives its quantised count. The exact counts of single tokens go beside it, for
the base score.

Scoring: while filter and counts together are under BROADCAST_BYTES they are broadcast, shard by shard, and one
narrow pass scores the texts. Above that, nothing is broadcast: each chunk of documents sends its distinct keys to
their shards, in rows of bounded size, and gets the answers back. Both ways give the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes, crc_bucket, id_and_text, map_arrow, slices
from loomstone.llm.shingles import STEP, WordHasher, mix
from loomstone.plans.session import size_in_bytes, written

#: Bits for each entry, and probes; about 2 % of absent n-grams seem to have a count of one.
BITS, PROBES = 8, 5
LEVELS = 48
#: Weight of the single-token distribution in that of a context, in tokens.
PRIOR = 64.0
BROADCAST_BYTES = 160 << 20
SHARD_BYTES = 4 << 20
#: Bounds the shards, which are tasks, and so the records that a flush of a counting task makes.
MOST_SHARD_BITS = 15
#: Bytes in one row of a question or an answer: Spark reads 4,096 rows of a file at once.
PIECE_BYTES = 32 << 10
BUFFER_TOKENS, COMPACT_BYTES = 1_000_000, 64 << 20
CHUNK_DOCS = 1024

END = np.uint64(0x5EED_0E0D_0000_0001)
SINGLE, PAIR = np.uint64(0), np.uint64(1)


def shard_bits(docs: DataFrame) -> int:
    """2 to this power is the number of shards: one for each SHARD_BYTES of input, MOST_SHARD_BITS at most; above that shards
    grow with the input. Where Spark has no estimate of the size, the texts' bytes are summed."""
    size = size_in_bytes(docs)
    if size >= 1 << 60:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MOST_SHARD_BITS, max(4, math.ceil(math.log2(max(1, size / SHARD_BYTES)))))


class Tokens:
    """Keys of the tokens and pairs of texts. A text's tokens are its words, A-Z lower-cased, parted by ASCII white space, and the end."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all tokens, of each with the one before it (before the first: the end), and token counts of the texts."""
        parts, sizes = [], []
        for t in texts:
            words = t.lower().split()
            sizes.append(len(words) + 1)
            parts += words
        sizes = np.array(sizes, np.int64)
        ends = np.cumsum(sizes) - 1
        tokens = np.zeros(int(sizes.sum()), np.uint64)
        word = np.ones(len(tokens), bool)
        word[ends] = False
        tokens[word] = self.hasher(parts)
        tokens[ends] = END
        before = np.concatenate([[END], tokens[:-1]])
        single = mix(tokens) & ~PAIR
        return single, mix(mix(before) * STEP + tokens) | PAIR, sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def by_shard(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Shard and place of each run of sorted keys."""
    shards = (keys >> np.uint64(64 - bits)).astype(np.int64)
    found, starts = np.unique(shards, return_index=True)
    return list(zip(found.tolist(), starts.tolist(), [*starts.tolist()[1:], len(keys)], strict=True))


def first_and_step(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """What the places of a key's probes on a level start from, and how far apart they are."""
    first = mix(keys + np.array([level], np.uint64) * STEP)
    return first, mix(first) | np.uint64(1)


def place(first: np.ndarray, step: np.ndarray, probe: int, size: int) -> np.ndarray:
    return ((first + np.uint64(probe) * step) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)


def filter_of(keys: np.ndarray, counts: np.ndarray, entry_bits: int = BITS) -> bytes:
    level = np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)
    entries = int(level.sum())
    size = min(max(64, entries * entry_bits + 7 & ~7), 1 << 31)
    flags = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        first, step = first_and_step(keys[level >= j], j)
        for i in range(PROBES):
            flags[place(first, step, i, size).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def levels_in(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """The quantised counts: probe level after level while all bits are there."""
    bits = np.frombuffer(filter_bytes, np.uint8)
    out, alive = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    for j in range(1, LEVELS):
        first, step = first_and_step(keys[alive], j)
        for i in range(PROBES):
            at = place(first, step, i, 8 * len(bits))
            there = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            if not there.all():
                alive, first, step = alive[there], first[there], step[there]
        if not len(alive):
            break
        out[alive] = j
    return out


def answers(keys: np.ndarray, filter_bytes: bytes, single_keys: bytes, single_counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Levels of sorted keys of one shard, and the exact counts of the single tokens among them (0: none, or a pair)."""
    known, counts = np.frombuffer(single_keys, np.uint64), np.frombuffer(single_counts, np.int64)
    exact = np.zeros(len(keys), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        exact[hit] = counts[at[hit]]
    return levels_in(filter_bytes, keys), exact


def train(docs: DataFrame, entry_bits: int = BITS, compact_bytes: int = COMPACT_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text of the training documents -> the shards (shard, filter, single_keys, single_counts, n_tokens, n_distinct), and the bits of a shard number."""
    bits = shard_bits(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, n = Tokens(), [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for shard, lo, hi in by_shard(keys, bits):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([keys[lo:hi].tobytes()], pa.binary()), pa.array([counts[lo:hi].astype(np.uint32).tobytes()], pa.binary())], ["shard", "keys", "counts"])

        for batch in batches:
            for part in slices(batch, CHUNK_DOCS):
                single, pair, _ = tokens.read(as_bytes(part.column(1)))
                held += [single, pair]
                n += len(single)
                if n >= BUFFER_TOKENS:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_of(blocks):
            return summed(np.concatenate([k for k, _ in blocks]), np.concatenate([c for _, c in blocks]).astype(np.int64))

        def made(shard, blocks):
            keys, counts = all_of(blocks)
            single = (keys & PAIR) == SINGLE
            row = [shard, filter_of(keys, counts, entry_bits), keys[single].tobytes(), counts[single].tobytes(), int(counts[single].sum()), int(single.sum())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["shard", "filter", "single_keys", "single_counts", "n_tokens", "n_distinct"])

        now, blocks, waiting = None, [], 0
        for batch in batches:
            for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and blocks:
                    yield made(now, blocks)
                    blocks, waiting = [], 0
                now = shard
                blocks.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)))
                waiting += len(keys)
                if waiting > compact_bytes:  # sums so far, so that a shard takes the room of its distinct keys
                    blocks, waiting = [all_of(blocks)], 0
        if blocks:
            yield made(now, blocks)

    counted = docs.mapInArrow(count, "shard int, keys binary, counts binary").repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard")
    return written(counted.mapInArrow(build, "shard int, filter binary, single_keys binary, single_counts binary, n_tokens long, n_distinct long"), "lm-shards"), bits


def scores(single: np.ndarray, inverse_single: np.ndarray, inverse_pair: np.ndarray, sizes: np.ndarray, level: np.ndarray, exact: np.ndarray, n: int, v: int) -> list[np.ndarray]:
    """Token counts, known tokens, base score and score of each text of a chunk."""
    starts = np.cumsum(sizes) - sizes
    c = exact[inverse_single]
    base = np.log10((c + 1) / (n + 1 * (v + 1)))
    value = np.concatenate([[0.0, 1.0], 1.5 * 2.0 ** np.arange(1, LEVELS) - 0.5])
    one, two = value[level[inverse_single]], value[level[inverse_pair]]
    before = np.concatenate([[0.0], one[:-1]])
    end = one[starts + sizes - 1]
    before[starts] = end  # the context of a text's first token is the end
    p = (np.minimum(two, before) + PRIOR * (one + 1) / (n + v + 1)) / (before + PRIOR)
    return [sizes, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
OUT_SQL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_by_broadcast(rows: DataFrame, shards: DataFrame, bits: int, n: int, v: int) -> DataFrame:
    """``shards`` is known to be under BROADCAST_BYTES; the driver holds one shard at a time."""
    context = rows.sparkSession.sparkContext
    parts = {r.shard: context.broadcast((bytes(r["filter"]), bytes(r.single_keys), bytes(r.single_counts))) for r in shards.select("shard", "filter", "single_keys", "single_counts").toLocalIterator()}

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        tokens = Tokens()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            single, pair, sizes = tokens.read(as_bytes(batch.column(1)))
            keys, inverse = np.unique(np.concatenate([single, pair]), return_inverse=True)
            level, exact = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int64)
            for shard, lo, hi in by_shard(keys, bits):
                if shard in parts:
                    level[lo:hi], exact[lo:hi] = answers(keys[lo:hi], *parts[shard].value)
            found = scores(single, inverse[: len(single)], inverse[len(single) :], sizes, level, exact, n, v)
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], schema=OUT)

        return fn

    return map_arrow(rows, make, OUT_SQL, rows=CHUNK_DOCS)


def score_by_shards(rows: DataFrame, shards: DataFrame, bits: int, n: int, v: int) -> DataFrame:
    """For models of any size: keys travel to their shards and answers back; a task holds one shard, then one chunk of documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, chunk = Tokens(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, CHUNK_DOCS):
                single, pair, sizes = tokens.read(as_bytes(part.column(1)))
                keys, inverse = np.unique(np.concatenate([single, pair]), return_inverse=True)
                ids = part.column(0).to_pylist()
                head = np.array([len(ids), len(single)], np.int64).tobytes() + np.array([i is None for i in ids], np.int64).tobytes() + np.array([i or 0 for i in ids], np.int64).tobytes() + sizes.tobytes() + inverse.astype(np.uint32).tobytes()
                for shard, data in [(-1, head), *((s, keys[lo:hi].tobytes()) for s, lo, hi in by_shard(keys, bits))]:
                    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
                    n = len(pieces)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.binary())], ["chunk", "shard", "piece", "data"])
                chunk += 1

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, (b"\0" * 8, b"", b"")
        for batch in batches:
            for chunk, shard, piece, data, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    now, model = shard, (b"\0" * 8, b"", b"")
                if chunk is None:
                    model = (data, *own)
                    continue
                level, exact = answers(np.frombuffer(data, np.uint64), *model)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([shard], pa.int32()), pa.array([piece], pa.int32()), pa.array([level.tobytes() + exact.tobytes()], pa.binary())], ["chunk", "shard", "piece", "data"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts):
            head = b"".join([p for shard, p in parts if shard < 0])
            docs, size = np.frombuffer(head, np.int64, 2).tolist()
            numbers = np.frombuffer(head, np.int64, 3 * docs, 16)
            null, ids, sizes = numbers[:docs].astype(bool), numbers[docs : 2 * docs], numbers[2 * docs :]
            inverse = np.frombuffer(head, np.uint32, -1, 16 + 24 * docs).astype(np.int64)
            found = [p for shard, p in parts if shard >= 0]
            level = np.concatenate([np.frombuffer(p[: len(p) // 9], np.uint8) for p in found])
            exact = np.concatenate([np.frombuffer(p[len(p) // 9 :], np.int64) for p in found])
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), *map(pa.array, scores(None, inverse[:size], inverse[size:], sizes, level, exact, n, v))], schema=OUT)

        now, parts = None, []
        for batch in batches:
            for chunk, shard, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now and parts:
                    yield made(parts)
                    parts = []
                now = chunk
                parts.append((shard, data))
        if parts:
            yield made(parts)

    schema = "chunk long, shard int, piece int, data binary"
    asked = written(rows.mapInArrow(ask, schema), "lm-asked")
    none, no = F.lit(None).cast("binary"), F.lit(None)
    models = shards.select(no.cast("long").alias("chunk"), "shard", no.cast("int").alias("piece"), F.col("filter").alias("data"), "single_keys", "single_counts")
    to_shards = asked.where("shard >= 0").select("chunk", "shard", "piece", "data", none.alias("single_keys"), none.alias("single_counts")).unionByName(models)
    replies = to_shards.repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard", F.col("chunk").asc_nulls_first(), "piece").mapInArrow(reply, schema)
    back = asked.where("shard = -1").unionByName(replies).repartition(1 << bits, "chunk").sortWithinPartitions("chunk", "shard", "piece")
    return back.mapInArrow(finish, OUT_SQL)


def lm_scores(docs: DataFrame, buckets: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, entry_bits: int = BITS, compact_bytes: int = COMPACT_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 bucket is not ``held``. A null or empty text has one token, the end; a null id counts
    as empty text in the crc; repeated rows count as often as they occur; an empty table gives an empty table; with
    no training rows all counts are zero. Other columns are left out.
    """
    rows = id_and_text(docs, id_col, text_col)
    shards, bits = train(rows.where(crc_bucket(F.col("doc_id"), buckets) != held), entry_bits, compact_bytes)
    stored = F.length("filter") + F.length("single_keys") + F.length("single_counts")
    n, v, size = shards.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum(stored), F.lit(0))).first()
    scored = (score_by_broadcast if size <= broadcast_bytes else score_by_shards)(rows, shards, bits, n, v)
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), buckets) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
