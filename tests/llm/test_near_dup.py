"""The n-gram Jaccard join against all pairs, and components against union-find."""

import random
from collections import Counter

import pytest

from loomstone.llm import near_dup
from loomstone.llm.shingles import words_of
from loomstone.operators.components import connected_components

SCHEMA = "doc_id long, text string, fp string, n int, sig string, component int"


def sets_of(texts):
    out = []
    for t in texts:
        w = words_of(t or "")
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, texts, threshold=0.8):
    sets, n = sets_of(texts), len(texts)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    sizes = Counter(find(i) for i in range(n))
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], least.get(find(i)), links[i], sizes[find(i)]) for i in range(n)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((", " if rng.random() < 0.3 else " ").join(copy).upper())
    return [*texts, None, "", "?!", "one", "One.", "a b c d"]


def test_near_duplicates_equal_all_pairs(spark):
    texts = corpus()
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in zip(ids, texts)], SCHEMA)
    got = sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == brute(ids, texts)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_large_group_over_many_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = ["v%d" % i for i in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            copy[rng.randrange(120)] = "z%d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    texts += texts[:30]
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 16)
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(texts)], SCHEMA)
    got = sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == brute(range(len(texts)), texts)


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "", 0, "", 0), (1, "h i j k l m n", "", 0, "", 0), (2, "h i j k l m n", "", 0, "", 0), (1, "a b c d e f g", "", 0, "", 0)], SCHEMA)
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == [(1, 1, 1, 2), (1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, None), (401, 401)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_depth_shortens_to_recall():
    k = near_dup.depth_for(0.8, 0.999)
    assert 1 - (1 - 0.8**k) ** near_dup.TREES >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** near_dup.TREES


def test_more_blocks_than_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 16)
    words = ["b%d" % k for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == [(1, 1, 1, 2), (2, 1, 1, 2), (3, 3, 0, 1)]


def near_copies(rng, base, share):
    """A copy whose shingles have about this Jaccard similarity with those of the base."""
    copy = list(base)
    for at in rng.sample(range(len(base)), max(1, round(len(base) * (1 - share) / (1 + share) / 5))):
        copy[at] = "c%d" % rng.randrange(10**9)
    return copy


def test_recall_at_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for k in range(300):
        base = ["k%d_%d" % (k, i) for i in range(200)]
        texts += [" ".join(base), " ".join(near_copies(rng, base, 0.81))]
    sets = sets_of(texts)
    linked = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, 600, 2)]
    got = {r.doc_id: r.n_links for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    recall = sum(got[2 * i] == 1 for i, x in enumerate(linked) if x) / sum(linked)
    print("recall at 0.8", recall, "of", sum(linked))
    assert sum(linked) > 200 and recall >= 0.99


def test_unlike_texts_in_one_node_make_no_component(spark):
    """Texts that share a long passage pairwise far below the threshold fall into common nodes, but no edges come of it."""
    rng = random.Random(6)
    common = ["m%d" % i for i in range(60)]
    texts = [" ".join([*common, *("o%d" % rng.randrange(10**9) for _ in range(60))]) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = near_dup.signatures(docs).withColumnRenamed("doc_id", "cid")
    assert near_dup.candidates(classes, 0.8, 0.999, near_dup.MARGIN, 4).count() == 0
    assert near_dup.forest_of(classes, [4]).groupBy("d4").count().where("count > 1").count() > 0


def test_prefixes_are_shortened_class_by_class():
    assert near_dup.depths(0.8, 0.999) == [8, 6, 4] and near_dup.depths(0.5, 0.999)[-1] == near_dup.depth_for(0.5, 0.999)
    rng = random.Random(7)
    sig = [rng.randrange(1 << 16) for _ in range(128)]
    pack = lambda s: b"".join(x.to_bytes(2, "little") for x in s)
    rows = [(k, 0, k != 2, pack(sig[:-k] + [0] * k if k else sig)) for k in range(3)]
    found = near_dup.agreements(rows, True, 0.8, 0.2, 8)
    assert [(c, r, n) for c, r, n, _ in found] == [(0, 0, 2), (1, 0, 2), (2, 0, 2)] and all(0 <= m < 1e-3 for *_, m in found)
    closed = [(c, 0, False, s) for c, _, _, s in rows]
    assert near_dup.agreements(closed, True, 0.8, 0.2, 8) == []


def test_few_rows_make_few_files(spark, monkeypatch):
    """The comparison of signatures makes tasks and files for its rows, not for the partitions of the input; large nodes still part."""
    made = []

    def kept(df, name, write=near_dup.written):
        out = write(df, name)
        if name == "near-edges":
            made.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dup, "written", kept)
    texts = corpus()
    classes = near_dup.signatures(near_dup.id_and_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).where("sig is not null").withColumnRenamed("doc_id", "cid")
    few = near_dup.candidates(classes, 0.8, 0.999, near_dup.MARGIN, 12)
    want = connected_components(few, "cid", "root").collect()
    assert made == [1, 1, 1]
    made.clear()
    monkeypatch.setattr(near_dup, "TASK_ROWS", 16)
    many = near_dup.candidates(classes, 0.8, 0.999, near_dup.MARGIN, 12)
    assert max(made) > 4
    assert sorted(connected_components(many, "cid", "root").collect()) == sorted(want)
