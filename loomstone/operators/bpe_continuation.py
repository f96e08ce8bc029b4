"""Continuing a BPE vocabulary: segment counts and pair counts come from the cluster; the loop over distinct segments runs on the driver
(``merge_steps``) or with the segments in the shared folder (``merge_steps_at_scale``)."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.session import written


def segment_counts(docs: DataFrame, text: str = "text", pattern: str = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+") -> DataFrame:
    """segment, n: how often each pre-token occurs."""
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("segment")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(segments: DataFrame) -> DataFrame:
    """left, right, n: adjacent characters weighed by the segments' counts."""
    chars = F.split("segment", "")
    pairs = F.get(F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.get(c, i - 1).alias("left"), F.get(c, i).alias("right")))), F.lit(0))
    return segments.where(F.length("segment") > 1).select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def merge_steps(sequences: dict[tuple[int, ...], int], vocabulary: dict[str, int], steps: int, least: int = 1) -> list[tuple[str, str, int, int]]:
    """(left, right, id, count) of each merge: the most frequent pair, of equals the one with the smallest ids; a pair whose token
    exists already is passed over, and the loop ends below the least count. Counts are kept up to date, not made anew."""
    names = {i: t for t, i in vocabulary.items()}
    words = [(list(s), n) for s, n in sorted(sequences.items())]
    counts: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, (s, n) in enumerate(words):
        for pair in zip(s, s[1:]):
            counts[pair] += n
            where[pair].add(k)
    out, passed, free = [], set(), max(names, default=-1) + 1
    while len(out) < steps:
        open_ = [(-n, p) for p, n in counts.items() if n >= least and p not in passed]
        if not open_:
            break
        n, pair = min(open_)
        token = names[pair[0]] + names[pair[1]]
        if token in vocabulary:
            passed.add(pair)
            continue
        vocabulary[token], names[free] = free, token
        out.append((names[pair[0]], names[pair[1]], free, -n))
        for k in list(where[pair]):
            s, weight = words[k]
            for p in zip(s, s[1:]):
                counts[p] -= weight
                where[p].discard(k)
            merged, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    merged.append(free)
                    i += 2
                else:
                    merged.append(s[i])
                    i += 1
            words[k] = (merged, weight)
            for p in zip(merged, merged[1:]):
                counts[p] += weight
                where[p].add(k)
        counts += Counter()
        free += 1
    return out


#: First number of a merged token at scale, above all code points, and bits of the right half of a pair.
MERGED, HALF = 1 << 21, 32
#: Segments of one stored block, and merges that one pass counts ahead.
BLOCK, AHEAD = 1 << 14, 6


def weighed_pairs(flat: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct adjacent pairs of tokens, as one number, and the sum of their segments' weights. -1 ends a segment."""
    inside = (flat[:-1] >= 0) & (flat[1:] >= 0)
    found, place = np.unique((flat[:-1][inside].astype(np.int64) << HALF) | flat[1:][inside], return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, place, weights[:-1][inside])
    return found, sums


def merged(flat: np.ndarray, weights: np.ndarray, left: int, right: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and weights after a merge, from left to right in each segment, and by how much it changed which pairs."""
    at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
    if left == right and len(at):  # of a run of equal tokens every second place begins a pair
        first = np.r_[True, np.diff(at) != 1]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
    if not len(at):
        return flat, weights, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(flat < 0)
    hit = np.zeros(len(ends), bool)
    hit[np.searchsorted(ends, at)] = True
    sizes = np.diff(ends, prepend=-1)
    old = np.repeat(hit, sizes)
    pairs, sums = weighed_pairs(flat[old], weights[old])
    flat = flat.copy()
    flat[at] = token
    keep = np.ones(len(flat), bool)
    keep[at + 1] = False
    now = old & keep
    new_pairs, new_sums = weighed_pairs(flat[now], weights[now])
    return flat[keep], weights[keep], np.concatenate([pairs, new_pairs]), np.concatenate([-sums, new_sums])


def tokens_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens, and for each the weight of its segment, block by block."""
    for flat, weights in zip(*(column.to_pylist() for column in batch.columns), strict=True):
        flat = np.frombuffer(flat, np.int32)
        yield flat, np.repeat(np.frombuffer(weights, np.int64), np.diff(np.flatnonzero(flat < 0), prepend=-1))


def blocks_of(flat: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends = np.flatnonzero(flat < 0)
    for at in range(0, len(ends), BLOCK):
        part = ends[at : at + BLOCK]
        low = ends[at - 1] + 1 if at else 0
        yield pa.RecordBatch.from_arrays([pa.array([flat[low : part[-1] + 1].astype(np.int32).tobytes()], pa.binary()), pa.array([weights[part].tobytes()], pa.binary())], ["flat", "weights"])


def stored_segments(segments: DataFrame) -> DataFrame:
    """Blocks of segments as code points, each segment ended by -1, with one weight for each segment; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                segments = batch.column(0).to_pylist()
                sizes = np.fromiter(map(len, segments), np.int64, len(segments))
                flat = np.insert(np.frombuffer("".join(segments).encode("utf-32-le"), np.int32), np.cumsum(sizes), -1)
                yield from blocks_of(flat, np.repeat(batch.column(1).to_numpy(), sizes + 1))

    return written(segments.select("segment", "n").mapInArrow(run, "flat binary, weights binary"), "bpe-segments")


def changes(blocks: DataFrame, merges: list[tuple[int, int, int]], known: int) -> dict[int, dict[int, int]]:
    """What each merge after the first ``known`` changes in the counts of pairs, by its place; merges are made one after the other. With
    no merges: the counts, at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, weights in tokens_of(batch):
                found = [(-1, *weighed_pairs(flat, weights))] if not merges else []
                for k, merge in enumerate(merges):
                    flat, weights, pairs, sums = merged(flat, weights, *merge)
                    if k >= known:
                        found.append((k, pairs, sums))
                for k, pairs, sums in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), k, np.int32)), pa.array(pairs), pa.array(sums)], ["k", "pair", "n"])

    out: dict[int, dict[int, int]] = defaultdict(dict)
    table = blocks.mapInArrow(run, "k int, pair long, n long").groupBy("k", "pair").agg(F.sum("n").alias("n")).where("n <> 0").toArrow()
    for k, pair, n in zip(*(table.column(c).to_pylist() for c in ("k", "pair", "n")), strict=True):
        out[k][pair] = n
    return out


def stored_merges(blocks: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, weights in tokens_of(batch):
                for merge in merges:
                    flat, weights, _, _ = merged(flat, weights, *merge)
                yield from blocks_of(flat, weights)

    return written(blocks.mapInArrow(run, "flat binary, weights binary"), "bpe-segments")


def merge_steps_at_scale(segments: DataFrame, steps: int, least: int = 1, every: int = 12) -> list[tuple[str, str, int, int]]:
    """What ``merge_steps`` gives from single characters, with the segments in the shared folder: the driver holds the counts of pairs only.

    A pass over the segments counts what the best pair's merge changes, and ahead of need the merges of the next best pairs, in this order; an
    answer is used only if the next pair by the exact counts is the one that was guessed. Every ``every`` merges the segments are written anew.
    """
    blocks = stored_segments(segments.where("length(segment) >= 2"))
    counts = Counter(changes(blocks, [], 0)[-1])
    halves = lambda pair: (pair >> HALF, pair & ((1 << HALF) - 1))
    chars = sorted({c for pair in counts for c in halves(pair)})
    names = {c: chr(c) for c in chars}
    number = {c: k for k, c in enumerate(chars)}
    known, out, made = set(names.values()), [], []
    passed: set[int] = set()

    def best(most: int) -> list[int]:
        """The next pairs to merge by the counts as they are; a pair whose token exists is passed over for good."""
        found, tokens = [], set()
        open_ = [(-n, p) for p, n in counts.items() if n >= least and p not in passed]
        heapq.heapify(open_)
        while open_:
            pair = heapq.heappop(open_)[1]
            token = "".join(names[h] for h in halves(pair))
            if token in known:
                passed.add(pair)
            elif token not in tokens:
                tokens.add(token)
                found.append(pair)
                if len(found) == most:
                    break
        return found

    while len(out) < steps:
        guesses = best(min(AHEAD, steps - len(out)))
        if not guesses:
            break
        plan = [(*halves(p), MERGED + len(out) + k) for k, p in enumerate(guesses)]
        found = changes(blocks, made + plan, len(made))
        first = len(made)
        for k, pair in enumerate(guesses):
            if k and best(1) != [pair]:
                break
            left, right, token = plan[k]
            names[token], number[token] = names[left] + names[right], len(chars) + len(out)
            known.add(names[token])
            out.append((names[left], names[right], number[token], counts[pair]))
            made.append(plan[k])
            counts.update(found[first + k])
        counts = Counter({p: n for p, n in counts.items() if n > 0})
        if len(made) >= every:
            blocks, made = stored_merges(blocks, made), []
    return out
