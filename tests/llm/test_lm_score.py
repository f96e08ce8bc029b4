"""LM scores: exact parts against brute force, the filter against its counts, both ways of scoring against each other."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomstone.llm import lm_score

SCHEMA = "doc_id long, text string, score double, held_out string, shard int"


def corpus(n=200):
    rng = random.Random(6)
    words = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(500)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t", "\n", "  ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (None, "The the THE É é"), (n + 2, "x" * 100_000), (3, texts[3])]


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in lower:
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, *([word] if word else []), None]


def brute(rows):
    bucket = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter(t for i, x in rows if bucket(i) != 2 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, bucket(i) == 2, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in rows), key=str)


@pytest.mark.parametrize("most", [lm_score.BROADCAST_BYTES, 0])
def test_base_score(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = lm_score.lm_scores(docs, broadcast_bytes=most).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_both_ways_agree(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in corpus()], SCHEMA)
    a, b = (sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lm_score.lm_scores(docs, broadcast_bytes=m).collect()) for m in (1 << 30, 0))
    assert len(a) == len(b) and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-9 for x, y in zip(a, b, strict=True))


def test_no_training_rows_and_empty(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, "a b", 0.5, "x", 1) for i in held], SCHEMA)
    for most in (1 << 30, 0):
        assert {(r.n_known, r.train_tokens, r.base_score) for r in lm_score.lm_scores(docs, broadcast_bytes=most).collect()} == {(0, 0, 0.0)}
        assert lm_score.lm_scores(docs.limit(0), broadcast_bytes=most).count() == 0


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    counts = rng.integers(1, 1000, len(keys))
    data = lm_score.filter_of(keys, counts)
    want = 1 + np.floor(np.log2(counts)).astype(int)
    got = lm_score.levels_in(data, keys)
    assert (got >= want).all() and (got > want).mean() < 0.05
    absent = lm_score.levels_in(data, rng.integers(2**63, 2**64, 20_000, dtype=np.uint64))
    assert (absent > 0).mean() < 0.05
    assert lm_score.levels_in(lm_score.filter_of(keys[:0], counts[:0]), keys[:5]).tolist() == [0] * 5


def test_bigrams_help_on_held_out_text(spark):
    rng = random.Random(2)
    follow = {k: [rng.randrange(60) for _ in range(2)] for k in range(60)}

    def text():
        w = rng.randrange(60)
        out = []
        for _ in range(80):
            out.append(f"t{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(), 0.5, "x", 1) for i in range(300)], SCHEMA)
    held = [r for r in lm_score.lm_scores(docs).collect() if r.held_out]
    assert held and np.mean([r.score > r.base_score for r in held]) > 0.95


def brute_model(rows):
    """The model's score with exact counts that are quantised as the filter's levels are."""
    bucket = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    one, two = Counter(), Counter()
    for i, x in rows:
        if bucket(i) != 2:
            t = tokens(x)
            one.update(t)
            two.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    value = lambda c: 0.0 if not c else 1.0 if c == 1 else 1.5 * 2 ** math.floor(math.log2(c)) - 0.5
    out = []
    for i, x in rows:
        t, score = tokens(x), 0.0
        for a, b in zip([None, *t[:-1]], t, strict=True):
            context = value(one[a])
            score += math.log10(min(1.0, (min(value(two[a, b]), context) + lm_score.PRIOR * (value(one[b]) + 1) / (n + v + 1)) / (context + lm_score.PRIOR)))
        out.append((i, round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [lm_score.BROADCAST_BYTES, 0])
def test_score_equals_brute_force(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, round(r.score, 6)) for r in lm_score.lm_scores(docs, broadcast_bytes=most, entry_bits=2048).collect()), key=str)  # hardly an absent n-gram seems to be there
    want = brute_model(rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert sum(abs(a[1] - b[1]) > 1e-5 for a, b in zip(got, want, strict=True)) <= 2


def test_counts_above_32_bits(spark):
    """Sums of a shard that is compacted again and again keep their size."""
    keys = np.array([2, 4], np.uint64)
    blocks = [(keys, np.array([2**32 - 1, 1], np.uint32))] * 3
    k, c = lm_score.summed(np.concatenate([x for x, _ in blocks]), np.concatenate([x for _, x in blocks]).astype(np.int64))
    assert k.tolist() == [2, 4] and c.tolist() == [3 * (2**32 - 1), 3]
    rows = corpus()
    got = lm_score.lm_scores(spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], SCHEMA), compact_bytes=0).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
