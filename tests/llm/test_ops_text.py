"""Quality classifier, decontamination and the pipeline."""

import random
import zlib

import numpy as np
import corpus_pipeline
from loomstone.llm import decontaminate, exact_dedup, near_dup, quality

SCHEMA = "doc_id long, text string, label string, score string, item_id int"
ITEM = "A train leaves Springfield at 60 km per hour and Maria buys 12 apples for 3 dollars each while Maria walks 5 miles to the old station near the green river bank"
MOVED = "intro words here. A train leaves Shelbyville at 80 km per hour and Edna buys 17 apples for 4 euros each while Edna walks 9 miles to the old station near the green river bank. outro"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def prose(rng, n, good):
    words = [rng.choice(["the", "river", "of", "stone", "and", "walked", "green", "under", "light", "song"]) for _ in range(n)]
    return " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)


def labelled(n=240):
    rng = random.Random(4)
    return [(i, prose(rng, rng.randint(5, 60), i % 4 != 0), int(i % 4 != 0)) for i in range(n)]


def test_quality_held_out_accuracy(spark):
    rows = labelled()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (9001, "x" * 200_000), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (8, 0, 1), (7, 3, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    assert len(got) == len(rows) + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 20 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.predicted)
    assert quality.quality_scores(docs.limit(0), model).count() == 0


def test_quality_ignores_held_out_labels(spark):
    rows = labelled(80)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, _, q in rows]
    a = quality.train(docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"))
    b = quality.train(docs, spark.createDataFrame(flip, "doc_id long, quality int, toxic int"))
    assert np.array_equal(a["w"], b["w"]) and a["threshold"] == b["threshold"]
    one = quality.train(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").where("doc_id > 5"))
    assert quality.quality_scores(docs, one).count() == 80


def test_quality_threshold_does_not_hang_on_the_sample(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(5, 60), i % 7 != 0 or rng.random() < 0.3), int(i % 7 != 0)) for i in range(420)]
    docs = frame(spark, [(i, t) for i, t, _ in rows]).repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    trained = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    kept = []
    for most, few in ((6000, 10_000), (30, 10)):
        monkeypatch.setattr(quality, "SAMPLE_ROWS", most)
        monkeypatch.setattr(quality, "FEW", few)
        model = quality.train(docs, labels)
        got = {r.doc_id: r.predicted for r in quality.quality_scores(docs, model).collect()}
        kept.append(sum(got[i] for i, _ in trained) / len(trained))
    good = np.mean([q for _, q in trained])
    assert all(abs(k - good) < 0.03 for k in kept)


def leaks(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return sorted((r.doc_id, r.item_id, r.verbatim) for r in decontaminate.find_leaks(docs, bench).collect())


def test_leaks_found_and_clean_left_alone(spark):
    docs = frame(spark, [(1, ITEM), (2, "Before. " + ITEM.upper() + " after"), (3, MOVED), (5, "A train leaves at 9."), (6, ITEM.replace(" ", ", ")), (7, None), (8, ""), (9, "z " * 20000 + ITEM), (1, ITEM), (10, ITEM[: len(ITEM) // 2]), (11, "here a tiny item too")])
    items = [(70, ITEM, "a"), (71, None, "b"), (72, "", "c"), (73, "tiny item", "d")]
    assert leaks(spark, docs, items) == [(1, 70, True), (1, 70, True), (2, 70, True), (3, 70, False), (6, 70, True), (9, 70, True), (11, 73, True)]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [5, 7, 8, 10]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_slots_must_be_consistent():
    table, reader = decontaminate.Benchmark([(1, "Ann had 7 red pens and gave 7 to Bob so then Bob had 7 of the red pens")]), decontaminate.Templates()
    same = "Ann had 9 red pens and gave 9 to Bob so then Bob had 9 of the red pens"
    mixed = "Ann had 9 red pens and gave 4 to Bob so then Bob had 2 of the red pens"
    assert table.matches(*reader.read(same)) and not table.matches(*reader.read(mixed))


def test_names_that_begin_sentences_and_dense_numbers():
    reader = decontaminate.Templates()
    problem = "{0} buys 3 red pens at the shop on the corner. {0} sells 2 of them to the teacher of music. {0} keeps the rest in a box under the old desk. How many are in the box"
    table = decontaminate.Benchmark([(1, problem.format("Ana"))])
    found = table.matches(*reader.read("Some text before it. " + problem.format("Zoe") + ". And after"))
    assert [(m[0], m[1], m[3]) for m in found] == [(1, 1.0, False)]
    mixed = problem.replace("{0} sells", "Tom sells").replace("{0} keeps", "Eva keeps")
    assert all(m[1] < 0.9 for m in table.matches(*reader.read(mixed.format("Zoe"))))
    numbers = "Add the numbers {} and {} then {} {} {} {} {} {} {} {} to find the mean"
    table = decontaminate.Benchmark([(2, numbers.format(*range(10, 20))), (3, "Buy 5")])
    assert [(m[0], m[1], m[3]) for m in table.matches(*reader.read(numbers.format(*range(31, 41))))] == [(2, 1.0, False)]
    assert not table.matches(*reader.read("they buy 7 and " + " ".join(map(str, range(50, 90)))))
    assert [m[0] for m in table.matches(*reader.read("they buy 5"))] == [3]


def test_like_items_are_told_apart(spark):
    items = [(k, ITEM.replace("green river", f"word{k} river").replace("old station", f"place{k} station"), "a") for k in range(6)]
    docs = frame(spark, [(k, t) for k, t, _ in items])
    assert [(d, i) for d, i, v in leaks(spark, docs, items) if v] == [(k, k) for k in range(6)]


def test_leaks_equal_verification_of_all_pairs(spark):
    """The join by heads finds what holding every document against every item finds."""
    rng = random.Random(14)
    words = ["stone", "river", "they", "sells", "with", "under", "kilo", "Ana", "Tom", "7", "12", "3.5", "two", "kg", ".", "hours", "box"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 5, 6, 9, 14, 30, 60])))) for k in range(40)]
    swap = {"Ana": "Eva", "Tom": "Max", "7": "8", "12": "90", "3.5": "1.25", "two": "six", "stone": "sand"}
    docs = []
    for k in range(300):
        body = rng.choice(items)[1].split()
        change = {a: b for a, b in swap.items() if rng.random() < 0.4}
        body = [change.get(w, w) for w in body]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            body[rng.randrange(len(body))] = rng.choice(words)
        docs.append((k, " ".join([*rng.choices(words, k=rng.randrange(12)), *body, *rng.choices(words, k=rng.randrange(12))])))
    reader, want = decontaminate.Templates(), []
    tables = [decontaminate.Benchmark([item]) for item in items]
    for k, text in docs:
        plain, kind = reader.read(text)
        want += [(k, *m) for t in tables for m in t.matches(plain, kind)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()]
    assert sorted(got) == sorted(want) and len({r[0] for r in want}) > 100
    assert any(not r[4] for r in want)
    left = decontaminate.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in left.collect()) == sorted({k for k, _ in docs} - {r[0] for r in want})


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, ITEM, 5, "x"), (None, None, 6, "y"), (None, ITEM, 7, "z"), (2, "", None, None)], "doc_id long, text string, k long, text_hash string")
    got = decontaminate.without_leaks(docs, spark.createDataFrame([(70, ITEM)], "item_id long, text string"))
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, [docs.collect()[1], docs.collect()[3]]))


def brute_pipeline(docs, labels_model):
    kept = [(i, t) for i, t in docs if quality.score(labels_model, np.array([quality.features(t or "")]))[0] >= quality.CUT]
    best = {}
    for i, t in kept:
        key = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        best[key] = max(best.get(key, (i, t)), (i, t), key=lambda x: x[0])
    return sorted(i for i, _ in best.values())


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = labelled(160)
    docs = [(i, t) for i, t, _ in rows] + [(1000, rows[1][1]), (1001, rows[1][1].upper()), (1002, rows[2][1])]
    long = " ".join("w%d" % rng.randrange(10**5) for _ in range(200)).split()
    near = list(long)
    near[50] = "changed"
    docs += [(2000, " ".join(long) + "."), (2001, " ".join(near) + "."), (2002, "The first words. " + ITEM + ".")]
    frame_ = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame_.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(70, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    now, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < 4:
            assert out.columns == frame_.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        sizes.append(sorted(r.doc_id for r in now.select("doc_id").collect()))
    model = quality.train(frame_, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sizes[1] == brute_pipeline(docs, model)
    assert {2000, 2001} <= set(sizes[1]) and 2000 in sizes[2] and 2001 not in sizes[2]
    assert 2002 in sizes[2] and 2002 not in sizes[3] and set(sizes[2]) - set(sizes[3]) == {2002}
    assert sizes[4] == sizes[3]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sizes[4]


def test_without_copies_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (1, "A", "q"), (1, "a", "r"), (None, "a", "s"), (2, "b", "t"), (None, None, "u"), (None, "", "v")], "doc_id long, text string, __id string")
    got = exact_dedup.without_copies(docs).collect()
    assert len(got) == 3 and sorted((r.doc_id or 0) for r in got) == [0, 1, 2]


def test_without_near_copies_keeps_null_ids(spark):
    text = " ".join("w%d" % k for k in range(100))
    docs = spark.createDataFrame([(5, text), (3, text + " more"), (None, text), (9, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in near_dup.without_near_copies(docs).collect()) == [0, 3, 9]
