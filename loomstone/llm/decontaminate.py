"""Benchmark decontamination by templates: numbers, units and names become typed placeholders, windows of template
tokens are hash-joined with those of the benchmark, and the fillers of the slots must map consistently, so that
re-parameterised questions are caught as well as literal copies.

1. An item is held only if nearly all of its windows are. So of any few more than may be missing one is there: of each item the
   rarest so many windows of the benchmark are its heads, and a document that holds it holds one of its heads.
2. One pass over the documents, narrow, looks the hashes of their windows up in a bitmap of the heads, which has a fixed size
   however large the benchmark is. Documents with a hash in it, few, are written with these hashes.
3. These hashes are joined with the heads, and pairs of document and item are verified in full, document by document.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import id_and_text, map_arrow, slices
from loomstone.llm.shingles import LONG_WORD, SHINGLE, WORD_CACHE, windows, windows_at
from loomstone.plans.session import partitions_for, written
from loomstone.plans.skew import bitmap_of, in_bitmap

CONTAINMENT = 0.8
#: A region of a document that may hold an item, in windows of the item.
STRETCH = 1.25
#: Rows of a hash or an item that many documents have are dealt out to this many tasks.
SALTS = 16
#: Items that a verifying task keeps ready.
ITEM_CACHE = 4096
#: An item whose slots are filled anew must show this many literal words; windows without any are found beside others.
LITERALS = 2

TOKEN = re.compile(rb"[0-9]+(?:[.,][0-9]+)*|[A-Za-z\x80-\xff][A-Za-z0-9\x80-\xff]*|[.!?:\n]")
#: Words that are units when they follow a number.
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms ton tons tonne tonnes "
    "ml cl l liter liters litre litres gallon gallons meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit hz khz mhz ghz w kw mw v kb mb gb tb mph kmh".split()
)
#: Words that stand for numbers ("one" is mostly none).
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
#: START: capitalised and first in a sentence, so a name or a word.
WORD, NUMBER, UNIT, NAME, MARK, START = range(6)


def slot_hash(kind: int) -> int:
    return xxhash.xxh3_64_intdigest(b"\x00slot%d" % kind)


SLOTS = np.array([slot_hash(NAME if k == START else k) for k in range(6)], np.uint64)


KIND_BITS = 7


class Templates:
    """Template tokens of texts. Tokens are classified once each, in a bounded cache."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def token(self, raw: bytes) -> int:
        """Hash of the lower-cased token with its kind in the lowest bits; a unit or a name is only possible, its neighbours decide."""
        if raw[0] in b".!?:\n":
            return MARK
        text = raw.decode()
        low = text.lower()
        kind = NUMBER if raw[0] in b"0123456789" or low in NUMBER_WORDS else UNIT if low in UNITS else NAME if len(text) > 1 and text[0].isupper() and text[1:].islower() else WORD
        value = xxhash.xxh3_64_intdigest(low.encode()) & ~KIND_BITS | kind
        if len(raw) <= LONG_WORD:
            if len(self.known) > WORD_CACHE:
                self.known.clear()
            self.known[raw] = value
        return value

    def read_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain hashes, kinds and text numbers of the texts' tokens. A unit follows a number; what begins a sentence or text may be a name."""
        get, make, find = self.known.get, self.token, TOKEN.findall
        values, sizes = [], []
        for t in texts:
            found = find(t.encode())
            values += [get(x) or make(x) for x in found]
            values.append(MARK)
            sizes.append(len(found) + 1)
        values, of = np.array(values, np.uint64), np.repeat(np.arange(len(texts)), sizes)
        kind = (values & np.uint64(KIND_BITS)).astype(np.int64)
        before = np.concatenate([[MARK], kind[:-1]])
        kind[(kind == UNIT) & (before != NUMBER)] = WORD
        kind[(kind == NAME) & (before == MARK)] = START
        real = kind != MARK
        return (values & ~np.uint64(KIND_BITS))[real], kind[real], of[real]

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.read_all([text])[:2]


def template_windows(plain: np.ndarray, kind: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of all windows: with numbers and units as slots, and, where it has names, with names as slots too, once
    without and once with the capitalised words that begin sentences.

    Windows without any literal word keep their plain words.
    """
    n = len(plain) - size + 1
    if n <= 0:
        return []
    literal = windows(plain, size)
    slot, name, start = (kind == NUMBER) | (kind == UNIT), kind == NAME, kind == START

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[size:] - sums[:-size]

    def hashed(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the windows at these places, with slots in them."""
        tokens = np.where(flags, SLOTS[kind], plain)
        found = windows_at(tokens, at, size)
        return np.where(inside(flags)[at] == size, literal[at], found)

    first = literal.copy()
    at = np.flatnonzero(inside(slot))
    if len(at):
        first[at] = hashed(slot, at)
    out = [(np.arange(n), first)]
    at = np.flatnonzero(inside(name))
    if len(at):
        out.append((at, hashed(slot | name, at)))
    at = np.flatnonzero(inside(start))
    if len(at):
        out.append((at, hashed(slot | name | start, at)))
    return out


def slot_kinds(kind: np.ndarray) -> np.ndarray:
    return np.where(kind == START, NAME, kind)


class Benchmark:
    """Window tables of some items."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        reader = Templates()
        self.items, rows = [], []
        for item, text in items:
            plain, kind = reader.read(text or "")
            if not len(plain):
                continue
            size = min(SHINGLE, len(plain))
            k = len(self.items)
            self.items.append((item, plain, kind, size, len(plain) - size + 1))
            for at, hashes in template_windows(plain, kind, size):
                rows += [(h, k, p, size) for h, p in zip(hashes.tolist(), at.tolist(), strict=True)]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.sizes = sorted({r[3] for r in rows})
        self.distinct = np.unique(self.hashes)

    def matches(self, plain: np.ndarray, kind: np.ndarray, known: dict | None = None) -> list[tuple[int | None, float, int, bool]]:
        """Of each item found: its id, the containment, the place of its first window in the document's tokens, and
        whether its slots are filled as in the benchmark. ``known`` keeps the document's windows for other items."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = {} if known is None else known
        for size in self.sizes:
            if size not in known:
                known[size] = template_windows(plain, kind, size)
            for at, hashes in known[size]:
                k = np.searchsorted(self.distinct, hashes)
                k[k == len(self.distinct)] = 0
                there = self.distinct[k] == hashes
                for p, h in zip(at[there].tolist(), hashes[there], strict=True):
                    lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
                    for i in range(lo, hi):
                        if self.items[self.item[i]][3] == size:
                            hits[int(self.item[i])].append((p, int(self.place[i])))
        out = []
        for k, found in sorted(hits.items()):
            item, item_plain, item_kind, size, n = self.items[k]
            found += self.beside(found, kind, item_kind, size, n)
            if len({q for _, q in found}) < CONTAINMENT * n:
                continue
            best = self.region(sorted(set(found)), n, plain, kind, item_plain, item_kind, size)
            if best:
                out.append((item, *best))
        return out

    @staticmethod
    def beside(found, kind, item_kind, size, n) -> list[tuple[int, int]]:
        """Windows of slots only, on the diagonals of the windows found: they match where the kinds do."""
        mine, theirs = slot_kinds(item_kind), slot_kinds(kind)
        dense = [q for q in range(n) if (mine[q : q + size] != WORD).all()] if size > 1 else []
        if not dense:
            return []
        out = []
        for d in sorted({p - q for p, q in found}):
            for q in dense:
                if 0 <= q + d <= len(theirs) - size and np.array_equal(mine[q : q + size], theirs[q + d : q + d + size]):
                    out.append((q + d, q))
        return out

    @staticmethod
    def region(found, n, plain, kind, item_plain, item_kind, size):
        """The best region of the document of about the item's length, if it holds enough of the item's windows, consistently."""
        length, best, first = int(STRETCH * n) + size, None, 0
        inside: Counter = Counter()
        for last, (p, q) in enumerate(found):
            inside[q] += 1
            while found[first][0] < p - length:
                inside[found[first][1]] -= 1
                if not inside[found[first][1]]:
                    del inside[found[first][1]]
                first += 1
            if len(inside) >= CONTAINMENT * n and (best is None or len(inside) > best[0]):
                part = found[first : last + 1]
                consistent, same = consistent_windows(part, plain, kind, item_plain, item_kind, size)
                literal = {q + k for q in consistent for k in range(size) if item_kind[q + k] in (WORD, START)}
                if not same and len(literal) < LITERALS:
                    continue
                if len(consistent) >= CONTAINMENT * n and (best is None or len(consistent) > best[0]):
                    best = len(consistent), part[0][0], same
                    if len(consistent) == n:
                        break
        return best and (best[0] / n, best[1], best[2])


def consistent_windows(part, plain, kind, item_plain, item_kind, size):
    """The item's windows in this region whose fillers agree with the region's mapping: each of the item's fillers, by kind,
    stands for the filler that it meets most often. And whether all of them stand for themselves."""
    item_kind = slot_kinds(item_kind)  # a name is one slot, first in a sentence or not
    votes: dict[tuple, Counter] = defaultdict(Counter)
    slotted = [(p, q, [k for k in range(size) if plain[p + k] != item_plain[q + k]]) for p, q in part]
    aligned = defaultdict(set)
    for p, q, _ in slotted:
        for k in range(size):
            aligned[(p + k, q + k)].add(1)
    for p, q in aligned:
        if item_kind[q] != WORD:
            votes[(int(item_kind[q]), int(item_plain[q]))][int(plain[p])] += 1
    mapping = {slot: min(c, key=lambda v: (-c[v], v != slot[1], v)) for slot, c in votes.items()}
    good, same = set(), True
    for p, q, changed in slotted:
        if all(mapping.get((int(item_kind[q + k]), int(item_plain[q + k]))) == int(plain[p + k]) for k in range(size) if item_kind[q + k] != WORD):
            good.add(q)
            same &= not changed
    return good, same


def item_rows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """k (a number of the row), item_id, text; a null text is empty."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(items.withColumn("k", F.monotonically_increasing_id()).select("k", "item_id", "text"), "leak-items")


def heads_of(items: DataFrame) -> DataFrame:
    """hash, k, size: windows of which a document must hold one for each item that it holds.

    Of n windows at least CONTAINMENT n are held, so of any n - CONTAINMENT n + 1 one is. Windows of slots only may be held for the sake
    of a window beside them, without their hash: they count only where an item has too few others, and then all its windows do. Of
    the others the rarest in the benchmark are taken. An item's own windows are the largest group that is ordered.
    """

    def make():
        reader = Templates()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain, kind = reader.read(text)
                size = min(SHINGLE, len(plain))
                if not size:
                    continue
                n = len(plain) - size + 1
                dense = [bool((slot_kinds(kind)[q : q + size] != WORD).all()) and size > 1 for q in range(n)]
                need = n - math.ceil(CONTAINMENT * n - 1e-9) + 1
                for at, hashes in template_windows(plain, kind, size):
                    out += [(k, q, h, size, dense[q], need, n - sum(dense)) for q, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "place", "hash", "size", "dense", "need", "others"])

        return fn

    windows_ = written(map_arrow(items.select("k", "text"), make, "k long, place int, hash long, size int, dense boolean, need int, others int", rows=256), "leak-windows")
    common = windows_.groupBy("hash").agg(F.count(F.lit(1)).alias("common"))
    places = windows_.join(common, "hash").groupBy("k", "place", "dense", "need", "others").agg(F.max("common").alias("common"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("dense", "common", "place"))
    chosen = places.withColumn("rank", rank).where("rank <= need or others < need").select("k", "place")
    return written(windows_.join(chosen, ["k", "place"]).select("hash", "k", "size").distinct(), "leak-heads")


def suspects_of(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text, hashes array<long>: rows that may hold a head, by one narrow pass."""
    hashes = heads.select("hash").distinct()
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(hashes, "hash", hashes.count()))  # 32 MB at most
    sizes = sorted(r[0] for r in heads.select("size").distinct().collect())  # SHINGLE at most

    def make():
        filled, reader = bitmap.value, Templates()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            texts = batch.column(1).to_pylist()
            plain, kind, of = reader.read_all(texts)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for size in sizes:
                for at, hashes in template_windows(plain, kind, size):
                    hit = in_bitmap(filled, hashes) & (of[at] == of[at + size - 1])  # within one text
                    found.append((of[at[hit]], hashes[hit]))
            doc, value = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(doc):
                return None
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
            doc, value = doc[first], value[first]
            kept, starts = np.unique(doc, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(value)], pa.int32()), pa.array(value.view(np.int64)))
            part = batch.take(pa.array(kept))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "text", "hashes"])

        return fn

    return map_arrow(rows, make, "doc_id long, text string, hashes array<long>", rows=256)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, containment, token_start, verbatim.

    An item is held if at least CONTAINMENT of its windows of five template tokens stand in a region of about its
    length and their slots are filled consistently; an item of fewer tokens is one window. Null and empty texts
    hold nothing and are held by nothing; null ids stay null; repeated rows give repeated findings; empty tables give
    none; other columns are left out. The documents are read once, whatever the size of the benchmark.
    """
    return leaks_with(docs, benchmark, id_col, text_col, item_col).drop("text_hash", "text_sha")


def leaks_with(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """What find_leaks gives, with two hashes of the document's text."""
    items = item_rows(benchmark, item_col, text_col)
    heads = heads_of(items)
    suspects = written(suspects_of(id_and_text(docs, id_col, text_col), heads).withColumn("row", F.monotonically_increasing_id()), "leak-suspects")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    hits = suspects.select("row", salt, F.explode("hashes").alias("hash"))
    pairs = hits.join(heads.select("hash", "k").distinct().select("hash", "k", salts).hint("merge"), ["hash", "salt"]).select("row", "salt", "k").distinct()
    pairs = pairs.join(items.select("k", "item_id", "text", salts).hint("merge"), ["k", "salt"])
    none = F.lit(None)
    held = suspects.select("row", none.cast("long").alias("k"), F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("text_hash"), F.sha2("text", 256).alias("text_sha"))
    asked = pairs.select("row", "k", F.col("item_id").alias("id"), "text", none.cast("long").alias("text_hash"), none.cast("string").alias("text_sha"))
    # A document, then the items that it may hold.
    units = held.join(pairs.select("row").distinct().hint("merge"), "row", "left_semi").unionByName(asked)
    units = units.repartition(partitions_for(suspects, 16 << 20), "row").sortWithinPartitions("row", F.col("k").asc_nulls_first())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, ready, document = Templates(), {}, None
        for batch in batches:
            out = []
            for part in slices(batch, 256):
                for _, k, own, text, text_hash, text_sha in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if k is None:
                        document = (own, text_hash, text_sha, *reader.read(text), {})
                        continue
                    if k not in ready:
                        if len(ready) >= ITEM_CACHE:
                            ready.clear()
                        ready[k] = Benchmark([(own, text)])
                    doc_id, text_hash, text_sha, plain, kind, known = document
                    out += [(doc_id, *m, text_hash, text_sha) for m in ready[k].matches(plain, kind, known)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FOUND.types, strict=True)], schema=FOUND)

    return units.mapInArrow(verify, "doc_id long, item_id long, containment double, token_start long, verbatim boolean, text_hash long, text_sha string")


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64()), ("token_start", pa.int64()), ("verbatim", pa.bool_()), ("text_hash", pa.int64()), ("text_sha", pa.string())])


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows, all columns as they are, whose text holds no item of the benchmark; null and empty texts, repeated rows and null ids
    stay. With an empty benchmark all rows stay.

    Only rows whose text's hash is in a bitmap of those to go are dealt out, to be held against them; the others pass.
    """
    numbered = docs.withColumn("__number", F.lit(None).cast("long"))
    leaks = leaks_with(numbered, benchmark, "__number", text_col, item_col).select(F.col("text_hash").alias("__hash"), F.col("text_sha").alias("__sha")).distinct()
    leaks = written(leaks, "leak-texts")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(leaks, "__hash", leaks.count()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.withColumn("__hash", F.xxhash64(text))

    def rows_with(wanted: bool) -> DataFrame:
        def make():
            filled = bitmap.value

            def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
                hit = in_bitmap(filled, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
                return batch.filter(pa.array(hit == wanted))

            return fn

        return map_arrow(hashed, make, hashed.schema, rows=1024)

    doubtful = rows_with(True).withColumn("__sha", F.sha2(text, 256)).join(leaks.hint("merge"), ["__hash", "__sha"], "left_anti")
    return rows_with(False).drop("__hash").unionByName(doubtful.drop("__hash", "__sha"))
