"""Operators without SQL, golden cases and edge cases."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstone.functions import ids, normalize
from loomstone.functions import text as T
from loomstone.operators import bpe_continuation, dedup, filters, minhash, mix, replay
from loomstone.operators import selection as S
from loomstone.plans.prefix_sum import running_sum


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (normalize.relaxed, "«Θάλασσα» πλατιά·", "θάλασσα πλατιά"),
        (normalize.relaxed, "ουρά­νιο", "ουράνιο"),
        (normalize.near, "ουρά-\nνιο", "ουράνιο"),
        (normalize.relaxed, "ουρά-\nνιο", "ουρά νιο"),
        (normalize.strict, " a\r\n​b\tc ", "a b c"),
        (normalize.strict, "é", "é"),
        (normalize.relaxed, "", ""),
    ],
)
def test_normal_forms(fn, text, want):
    assert fn(text) == want


def test_greek_marks_only():
    assert normalize.without_greek_marks("Λόγος é") == "Λογος é"


def test_udf_forms_keep_nulls(spark):
    rows = spark.createDataFrame([("Ä  b",), (None,)], "t string").select(normalize.relaxed_text("t").alias("r")).collect()
    assert [r.r for r in rows] == ["ä b", None]


def test_char_budget_takes_the_nearer_prefix(spark):
    df = spark.createDataFrame([("a", 50_100), ("b", 51_200)], "k string, chars long")
    assert [r.k for r in S.char_budget(df, "chars", ["k"], 46_000).collect()] == ["a"]
    assert S.char_budget(df, "chars", ["k"], 0).count() == 0
    assert S.char_budget(df, "chars", ["k"], 10**6).count() == 2
    assert sorted(r.k for r in S.char_budget(df, "chars", ["k"], 90_000).collect()) == ["a", "b"]


def test_running_sum_over_many_ranges(spark, monkeypatch):
    from loomstone.plans import prefix_sum

    monkeypatch.setattr(prefix_sum, "partitions_for", lambda df, size, least: 7)
    rows = [(i, (i * 37) % 11 if i % 5 else None) for i in range(300)]
    got = {r.k: r.run for r in running_sum(spark.createDataFrame(rows, "k int, v long"), "v", ["k"], "run").collect()}
    total, want = 0, {}
    for k, v in rows:
        total += v or 0
        want[k] = total
    assert got == want


def entries(*parts):
    return [dict(zip(("name", "include_sources", "fraction", "fraction_mode"), p, strict=True)) for p in parts]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_key string, source_dataset string, chars long")


def test_mix_of_group_and_of_total(spark):
    df = docs_of(spark, [("a", "x", 30), ("b", "y", 40), ("c", "hplt", 30), ("d", "hplt", 15), ("e", "hplt", 15)])
    got = mix.apply_mix(df, [{"name": "fixed", "exclude_sources": ["hplt"], "fraction": 1.0, "fraction_mode": "of_group"}, *entries(("web", ["hplt"], 0.3, "of_total"))], "chars", ["doc_key"])
    sums = {r.component: (r.n, r.c) for r in got.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c")).collect()}
    assert sums == {"fixed": (2, 70), "web": (1, 30)}


def test_mix_of_total_only(spark):
    df = docs_of(spark, [("a", "x", 40), ("b", "x", 30), ("c", "y", 10), ("d", "y", 20)])
    got = mix.apply_mix(df, entries(("x", ["x"], 0.7, "of_total"), ("y", ["y"], 0.3, "of_total")), "chars", ["doc_key"])
    assert got.count() == 4 and got.agg(F.sum("chars")).first()[0] == 100


@pytest.mark.parametrize(
    "bad",
    [
        entries(("x", ["x"], 0.5, "of_total")),
        entries(("x", ["x"], 1.0, "of_group"), ("y", ["y"], 1.0, "of_total")),
        entries(("x", ["none"], 1.0, "of_group")),
        entries(("x", ["x"], 1.0, "of_group"), ("z", ["x"], 1.0, "of_group")),
        entries(("x", ["x"], 1.5, "of_group")),
        entries(("x", ["x"], 0.5, "other")),
        entries(("x", ["x"], 1.0, "of_group"), ("y", ["y"], 0.9, "of_total")),
    ],
)
def test_mix_errors(spark, bad):
    with pytest.raises(ValueError):
        mix.apply_mix(docs_of(spark, [("a", "x", 40), ("c", "y", 10)]), bad, "chars", ["doc_key"])


def test_standard_filter_needs_scores(spark):
    df = spark.createDataFrame([("10", "0.0"), (None, "0.0"), ("", "0.0"), ("70", "0.0")], "badness_score string, mojibake_score string")
    assert [r.badness_score for r in df.where(filters.standard_training(df.columns)).collect()] == ["10"]
    assert df.where(filters.standard_training(df.columns, allow_missing=True)).count() == 3
    with pytest.raises(ValueError, match="missing badness_score"):
        filters.standard_training(["text"])
    with pytest.raises(ValueError):
        filters.quality_preset("other", badness=None, historical=None, reliable=None, needs_ocr=None, ocr_success=None, is_empty=None, state=None)


def test_exact_stages_golden(spark):
    texts = {"doc-1": "a  b", "doc-2": "a b", "doc-3": "C d!", "doc-4": "c D", "doc-5": "λόγος", "doc-6": "λογος"}
    rows = [(k, t, "s", 5.0, k != "doc-1") for k, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_key string, text string, source string, badness double, ok boolean").withColumns({"sh": F.md5(normalize.strict_text("text")), "rh": F.md5(normalize.relaxed_text("text"))})
    prio = F.struct(~F.col("ok"), F.when(F.col("doc_key") == "doc-4", 0).otherwise(1), "doc_key")
    got = dedup.docs_exact(df, "sh", "rh", prio)
    assert sorted(r.doc_key for r in got.where("kept_after_exact").collect()) == ["doc-2", "doc-4", "doc-5", "doc-6"]
    final = {r.doc_key: (r.final_keeper, r.stage) for r in dedup.final_keeper(got).collect()}
    assert final["doc-1"] == ("doc-2", "strict_exact") and final["doc-3"] == ("doc-4", "relaxed_exact") and final["doc-5"][1] == "kept"
    near = spark.createDataFrame([("doc-5", "doc-6"), ("doc-6", "doc-6")], "doc_key string, near_keeper string")
    final = {r.doc_key: (r.final_keeper, r.stage) for r in dedup.final_keeper(got, near).collect()}
    assert final["doc-5"] == ("doc-6", "near_duplicate")


def test_null_hash_is_alone(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "h"), ("d", "h")], "doc_key string, h string")
    got = {r.doc_key: (r.keeper, r.group_size, r.kept) for r in dedup.exact_stage(df, "h", F.struct("doc_key")).collect()}
    assert got == {"a": ("a", 1, True), "b": ("b", 1, True), "c": ("c", 2, True), "d": ("c", 2, False)}


def test_minhash_against_big_integers():
    values = [0, 1, 12345678901234567, 2**61 - 2, 2**61 - 1, 2**64 - 1]
    a, b = minhash.permutations()
    p = minhash.PRIME
    want = [min((int(x) * (v % p) + int(y)) % p for v in values) for x, y in zip(a, b, strict=True)]
    assert minhash.minhash(values).tolist() == want


def test_short_texts_have_no_shingles():
    assert not len(minhash.shingle_hashes("one two three")) and len(minhash.shingle_hashes(" ".join(map(str, range(30))))) == 26
    assert len(minhash.shingle_hashes("abcdefg", "char", 5)) == 3
    with pytest.raises(ValueError):
        minhash.shingle_hashes("x", "other")


def test_representative_validation_golden():
    members = [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    similar = {("a", "b"): 0.875, ("a", "c"): 0.75, ("b", "d"): 0.8, ("a", "d"): 0.5}
    got = sorted(minhash.resolve_component(members, similar, 0.75))
    assert got == [("a", "a", 1.0), ("b", "a", 0.875), ("c", "a", 0.75), ("d", "d", 1.0)]


def test_candidate_pairs_find_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    copy = list(base)
    copy[100] = "other"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(f"x{i}" for i in range(200))), (4, " ".join(base)), (5, None), (6, "short")], "doc_key long, text string")
    sigs = minhash.signatures(docs)
    pairs = {(r.left_key, r.right_key): r.estimated_jaccard for r in minhash.candidate_pairs(sigs).collect()}
    assert set(pairs) == {(1, 2), (1, 4), (2, 4)} and pairs[(1, 4)] == 1.0
    ranks = spark.createDataFrame([(k, float(-k)) for k in range(1, 7)], "doc_key long, rank double")
    got = {r.doc_key: r.representative for r in minhash.clusters(minhash.candidate_pairs(sigs), ranks).collect()}
    assert got == {1: 4, 2: 4, 4: 4}


def members(spark, rows):
    return spark.createDataFrame(rows, "doc_key string, source_dataset string, family_id string, pool string, chars long, rank double")


def test_share_aware_balances_sources(spark):
    rows = [(f"{s}-{f}", s, f"f{f}", "shared:alpha+beta", 10, 0.0) for f in (1, 2) for s in ("alpha", "beta")] + [("lone", "alpha", "f9", "unique:alpha", 5, 0.0)]
    got = {r.family_id: r.representative for r in replay.share_aware(members(spark, rows)).collect()}
    assert got == {"f1": "alpha-1", "f2": "beta-2", "f9": "lone"}
    with pytest.raises(ValueError):
        replay.share_aware(members(spark, rows), {"alpha": 0})


def test_share_aware_by_projected_characters(spark):
    rows = [(f"{s}-{f}", s, f"f{f}", "shared:a+b", 10 if s == "a" else 100, 0.0) for f in (1, 2) for s in ("a", "b")]
    kept = replay.apply_action(replay.share_aware(members(spark, rows)), "drop_intra_and_inter")
    assert sorted(r.doc_key for r in kept.collect()) == ["a-1", "a-2"]
    assert replay.apply_action(members(spark, rows), "annotate").count() == 4
    with pytest.raises(ValueError):
        replay.apply_action(members(spark, rows), "other")


def test_bpe_step_golden():
    vocabulary = {t: i for i, t in enumerate("xyz")}
    assert bpe_continuation.merge_steps({(0, 1, 2): 7, (0, 1): 4}, vocabulary, 1) == [("x", "y", 3, 11)]


def test_bpe_steps_against_recounting():
    rng = random.Random(4)
    seqs = {tuple(rng.choices(range(4), k=rng.randint(2, 9))): rng.randint(1, 9) for _ in range(40)}
    got = bpe_continuation.merge_steps(dict(seqs), {c: i for i, c in enumerate("abcd")}, 8)
    words, names, vocab, want = [(list(s), n) for s, n in seqs.items()], dict(enumerate("abcd")), set("abcd"), []
    while len(want) < 8:
        counts = {}
        for s, n in words:
            for p in zip(s, s[1:]):
                counts[p] = counts.get(p, 0) + n
        n, p = min((-n, p) for p, n in counts.items() if names[p[0]] + names[p[1]] not in vocab)
        new, token = len(names), names[p[0]] + names[p[1]]
        want.append((names[p[0]], names[p[1]], new, -n))
        vocab.add(token)
        names[new] = token
        for k, (s, w) in enumerate(words):
            out, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == p:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[k] = (out, w)
    assert got == want


def test_markdown_chunks_keep_all_text():
    rng = random.Random(2)
    text = "\n".join(("# Title\n" if rng.random() < 0.1 else "") + "Word. " * rng.randint(1, 80) for _ in range(60)) + "x" * 5000
    chunks = normalize.chunk_markdown(text)
    assert all(len(c) <= 2000 for c in chunks) and "".join("".join(chunks).split()) == "".join(text.split())
    assert normalize.chunk_markdown("") == []


def test_scalars_on_edges(spark):
    df = spark.createDataFrame([("  a ,b\n", '{"b": " ", "id": "1", "z": "y", "a": "x"}', ["T ", None, " "], "N/A"), (None, "no json", None, None), ("", None, [], " u ")], "t string, j string, p array<string>, u string")
    rows = df.select(T.normalize_whitespace(F.col("t")).alias("w"), T.metadata_json(F.col("j")).alias("j"), T.normalize_title(F.col("p")).alias("p"), T.normalize_author(F.col("p")).alias("a"), T.placeholder_url(F.col("u")).alias("u"), T.clean_text(F.col("t")).alias("c"), T.token_estimate(F.col("t")).alias("n"), T.badness(F.col("t")).alias("b")).collect()
    assert [r.w for r in rows] == ["a,b", None, None] and [r.c for r in rows] == ["a ,b", "", ""]
    assert [r.j for r in rows] == ['{"a":"x","z":"y"}', None, None] and rows[0].p == "T" and rows[0].a == "T"
    assert [r.u for r in rows] == [None, None, "u"] and [r.n for r in rows] == [3, 0, 0] and rows[2].b is None


def test_priorities(spark):
    df = spark.range(2000).select(ids.priority(F.col("id"), seed="s").alias("p"), ids.representative_score(F.lit(10), F.lit(None).cast("double")).alias("z"))
    got = [r.p for r in df.collect()]
    assert all(0 <= p < 1 for p in got) and math.isclose(sum(got) / 2000, 0.5, abs_tol=0.03) and df.first().z == 0.0


def test_quotas(spark):
    groups = spark.createDataFrame(pd.DataFrame({"g": ["a", "b", "c"], "w": [1, 1, 1]}))
    assert sorted((r.g, r.quota) for r in S.largest_remainder(groups, "w", "g", 10).collect()) == [("a", 4), ("b", 3), ("c", 3)]


def test_bins():
    assert S.pack_bins([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == [("a", 5, 0), ("b", 4, 1), ("c", 3, 1), ("d", 3, 0)]


def test_mojibake_reads_whole_texts(spark, tmp_path):
    from loomstone.queries.rules import mojibake_recovery

    rows = [(1, "a" * 300 + "é"), (2, "a" * 300), (3, "é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in mojibake_recovery(spark, str(tmp_path)).collect()) == [(1, True, True), (2, True, False), (3, True, True)]


def test_merge_steps_count_rare_and_long_segments(spark, tmp_path):
    from loomstone.queries.tokens import bpe_merge_steps

    text = " ".join(["ab" + x for x in "cdefghijkl"] + ["xy" * 30])  # ab ten times, each segment once; one segment over 40 characters
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.left, r.right, r.n) for r in bpe_merge_steps(spark, str(tmp_path)).orderBy("id").collect()]
    assert got[:2] == [("x", "y", 30), ("xy", "xy", 29)] and ("a", "b", 10) in got and all(n >= 10 for _, _, n in got)


def test_shards_begin_anew_at_each_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "partitions_for", lambda df, size, least: 9)
    rng = random.Random(12)
    for target in (50, 400, 10**6):
        rows = [(i, rng.choice([0, 3, 20, 70, None, 600])) for i in range(400)]
        want, shard, held = {}, 0, 0
        for i, n in rows:
            want[i] = shard
            held += n or 0
            if held >= target:
                shard, held = shard + 1, 0
        got = {r.k: r.shard for r in S.cut_shards(spark.createDataFrame(rows, "k int, n long"), "n", ["k"], target).collect()}
        assert got == want
    assert S.cut_shards(spark.createDataFrame([], "k int, n long"), "n", ["k"], 5).count() == 0


def test_running_sum_within_groups(spark, monkeypatch):
    from loomstone.plans import prefix_sum

    monkeypatch.setattr(prefix_sum, "partitions_for", lambda df, size, least: 5)
    rows = [(i, None if i % 7 == 0 else "abc"[i % 3], i % 5) for i in range(200)]
    totals, want = {}, {}
    for i, g, v in rows:
        totals[g] = totals.get(g, 0) + v
        want[i] = totals[g]
    assert {r.k: r.run for r in running_sum(spark.createDataFrame(rows, "k int, g string, v long"), "v", ["k"], "run", ["g"]).collect()} == want


def test_keys_of_parts_that_run_together(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("a", "b|c")], "s string, i string")
    assert rows.select(ids.doc_key(F.col("s"), F.col("i")).alias("k")).distinct().count() == 4


def test_unicode_white_space(spark):
    row = spark.createDataFrame([("\u00a0a \u2003\x1cb\u3000",)], "t string").select(T.normalize_whitespace(F.col("t")).alias("w"), T.clean_text(F.col("t")).alias("c"), *(v.alias(k) for k, v in T.text_metrics(F.col("t")).items())).first()
    assert row.w == "a b" and row.c == "a \u2003\x1cb" and row.words == 2 and row.non_ws_chars == 2
    composed = spark.createDataFrame([("e\u0301\u00a0x",), ("\u00e9 x",)], "t string").select(normalize.exact_hashes("t").alias("f"))
    assert composed.select("f.strict_md5").distinct().count() == 1


def test_comments_in_one_pass(spark):
    import time

    cases = {"a<!-- b -->c": "ac", "<!-- a": "<!-- a", "a --> b": "a --> b", "x<!-- <!-- y -->z-->": "xz-->", "": "", "<!-- a --><!-- b -->": ""}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select(T.without_comments(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    began = time.monotonic()
    spark.createDataFrame([("<!-- " * 200_000,), ("![" * 400_000,)], "t string").select(T.low_information(F.col("t")).alias("x")).collect()
    assert time.monotonic() - began < 20


def test_drop_intra_keeps_copies_in_other_sources(spark):
    rows = [("a1", "x", "f", "p", 1, 0.0), ("a2", "x", "f", "p", 1, 1.0), ("b1", "y", "f", "p", 1, 2.0), ("c1", "x", "g", "p", 1, 0.0)]
    kept = lambda action: sorted(r.doc_key for r in replay.apply_action(replay.quality_first(members(spark, rows), F.col("rank")), action, priority=F.struct("rank", "doc_key")).collect())
    assert kept("drop_intra") == ["a1", "b1", "c1"] and kept("drop_intra_and_inter") == ["a1", "c1"] and len(kept("ignore")) == 4
    with pytest.raises(ValueError):
        replay.apply_action(members(spark, rows).withColumn("representative", F.col("doc_key")), "drop_intra")


def test_share_aware_tie_goes_to_the_lighter_source():
    pool = pd.DataFrame([("a-1", "a", "f1", 10, 0.0), ("a-2", "a", "f2", 5, 0.0), ("b-2", "b", "f2", 15, 0.0)], columns=["doc_key", "source_dataset", "family_id", "chars", "rank"])
    assert replay.balanced(pool, {}) == {"f1": "a-1", "f2": "b-2"}  # both would have 15; b has none so far


def test_thresholds_and_families_by_union(spark):
    assert replay.threshold(0.85) == (0.85, 0.85) and replay.threshold(0.8, 0.9) == (0.8, 0.9) and replay.threshold(0.8, 0.9, 0.82) == (0.8, 0.82)
    with pytest.raises(ValueError, match="below"):
        replay.threshold(0.85, asked=0.5)
    docs = spark.createDataFrame([("a", "x", "h"), ("b", "y", "h"), ("c", "x", None), ("d", "x", ""), ("e", "y", "k")], "doc_key string, source_dataset string, h string")
    pairs = spark.createDataFrame([("c", "d", 0.9), ("d", "e", 0.86), ("a", "c", 0.5)], "left_key string, right_key string, estimated_jaccard double")
    of = lambda same: {r.doc_key: r.family for r in replay.families_of(docs, ["h"], pairs, 0.85, same).collect()}
    assert of(False) == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}
    assert of(True) == {"a": "a", "b": "b", "c": "c", "d": "c", "e": "e"}


def test_large_buckets_lose_no_pair(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(130)]
    docs = spark.createDataFrame([(k, " ".join(base[: 130 - 2 * k])) for k in range(20)], "doc_key long, text string")
    sigs = minhash.signatures(docs)
    pairs = lambda most: sorted((r.left_key, r.right_key, r.matched_bands) for r in minhash.candidate_pairs(sigs, most_in_bucket=most).collect())
    assert pairs(1) == pairs(5000) and len(pairs(1)) > 50


def test_clusters_hold_representatives_against_all_members(spark):
    sigs = spark.createDataFrame([(1, [1] * 10), (2, [1] * 8 + [2] * 2), (3, [1] * 9 + [3]), (4, [4] * 10)], "doc_key long, signature array<long>")
    pairs = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.8)], "left_key long, right_key long, estimated_jaccard double")
    ranks = spark.createDataFrame([(k, float(k), "same") for k in range(1, 5)], "doc_key long, rank double, rank_head string")
    found = minhash.clusters(pairs, ranks, 0.8, sigs=sigs)
    rows = {r.doc_key: r for r in minhash.with_singletons(found, sigs).collect()}
    assert {k: (r.representative, r.reason) for k, r in rows.items()} == {1: (1, "representative"), 2: (1, "near_duplicate"), 3: (1, "near_duplicate"), 4: (4, "singleton")}
    assert rows[3].similarity == 0.9 and rows[1].cluster_size == rows[1].component_size == 3 and rows[1].narrow_margin and not rows[1].large_component
    assert len({rows[k].cluster_id for k in (1, 2, 3)}) == 1 and rows[4].cluster_id != rows[1].cluster_id
    assert {(r.doc_key, r.kept) for r in minhash.drop_list(minhash.with_singletons(found, sigs)).collect()} == {(2, 1), (3, 1)}


def test_record_fields_and_titles(spark):
    text = "Τίτλος:  Περί  δοκιμών \nP8_TA(2015)0042\nshort\nA line that is long enough here"
    row = spark.createDataFrame([(text,)], "t string").select(T.adopted_text_title(F.col("t")).alias("a"), T.adopted_text_code(F.col("t")).alias("b"), T.adopted_text_title(F.substring("t", 24, 1000)).alias("c"), T.act_title(F.lit("| a |\n---\nAB\nCD\nEF\nGH")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("Περί δοκιμών", "TA-8-2015-0042", "A line that is long enough here", "EF GH")


def test_bundle_round_trip(spark, tmp_path):
    from loomstone.operators import bundle

    bundle.export(str(tmp_path / "b"), {"documents": spark.createDataFrame([(1, "f")], "doc_id long, family_id string")}, {"floor": 0.85})
    values, tables = bundle.load(spark, str(tmp_path / "b"))
    assert values["floor"] == 0.85
    got = bundle.enriched(spark.createDataFrame([(1,), (2,)], "doc_id long"), tables["documents"], ["doc_id"])
    assert {r.doc_id: r.dedup_family_id for r in got.collect()} == {1: "f", 2: None}


def test_resume_only_on_the_same_input(spark):
    from loomstone.streaming.incremental import check_resumable, snapshot_drift

    before, now = (spark.createDataFrame(rows, "k int, fingerprint string") for rows in ([(1, "a"), (2, "b"), (3, None)], [(1, "a"), (2, "c"), (4, "d")]))
    assert {r.k: r.state for r in snapshot_drift(before, now, "k").collect()} == {1: "same", 2: "changed", 3: "removed", 4: "added"}
    check_resumable(before, before, "k")
    with pytest.raises(ValueError, match="drifted"):
        check_resumable(before, now, "k")


def test_hot_join_equals_join(spark):
    from loomstone.plans.skew import hot_join

    rows = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(3000)] + [(None, 9)], "g int, v int")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("g is not null and g % 2 = 0")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(groups, "g", how).collect()))
        assert sorted(map(str, hot_join(rows, groups, ["g"], "n", 3001, how).collect())) == want


def test_bitmap_misses_nothing(spark):
    import numpy as np

    from loomstone.plans.skew import bitmap_of, in_bitmap

    rng = np.random.default_rng(3)
    inside, outside = (rng.integers(-(2**63), 2**63, 3000) for _ in range(2))
    bitmap = bitmap_of(spark.createDataFrame([(int(x),) for x in inside], "h long"), "h", len(inside))
    assert in_bitmap(bitmap, inside.view(np.uint64)).all() and in_bitmap(bitmap, outside.view(np.uint64)).mean() < 0.001


def test_arrival_numbers_go_on_over_files(spark, tmp_path):
    from loomstone.queries.corpus import arrival_numbers

    path = tmp_path / "documents.parquet"
    path.mkdir()
    for k, ids_of in enumerate(([5, 3, 9], [1], [8, 2])):
        pd.DataFrame({"doc_id": ids_of}).to_parquet(path / f"part-{k}.parquet")
    assert [r.doc_id for r in arrival_numbers(spark, str(tmp_path)).orderBy("arrival").collect()] == [5, 3, 9, 1, 8, 2]
    assert sorted(r.arrival for r in arrival_numbers(spark, str(tmp_path)).collect()) == list(range(6))


def test_clusters_take_many_components_in_a_batch(spark):
    rng = random.Random(5)
    pairs, ranks, want = [], {}, {}
    for c in range(300):
        keys = [c * 10 + k for k in range(rng.randrange(2, 6))]
        ranks |= {k: rng.random() for k in keys}
        edges = {(a, b): rng.choice([0.86, 0.9, 1.0]) for a, b in zip(keys, keys[1:])}
        pairs += [(a, b, s) for (a, b), s in edges.items()]
        want |= {k: (r, s, keys[0], len(keys)) for k, r, s in minhash.resolve_component([(ranks[k], k) for k in keys], edges, 0.85)}
    found = minhash.clusters(spark.createDataFrame(pairs, "left_key long, right_key long, estimated_jaccard double"), spark.createDataFrame(list(ranks.items()), "doc_key long, rank double"))
    assert {r.doc_key: (r.representative, r.similarity, r.component, r.component_size) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan  # one call of Python for each component took most of the time


def test_words_and_forms_of_all_characters():
    for c in (chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000):
        form = f"a{c}b"
        assert minhash.words_of(form) == minhash.WORDS.findall(form)
        marks = normalize.MARKS.sub(" ", form.casefold().replace("­", "").translate(normalize.RELAXED))
        assert normalize.relaxed(form) == " ".join(marks.split())


def test_near_stage_hashes_once_and_writes_no_texts(spark, tmp_path, monkeypatch):
    from loomstone.queries import dedup as Q

    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[k % 7 :]) + (" z" if k % 2 else ""), "en", f"src{k % 3}") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names, written = [], Q.written

    def noted(df, name):
        names.append((name, "text" in df.columns))
        return written(df, name)

    monkeypatch.setattr(Q, "written", noted)
    got = {r.doc_id: r.kept for r in Q.full_decisions(spark, str(tmp_path)).collect()}
    assert len(got) == 34 and not any(text for _, text in names)
    assert [n for n, _ in names].count("exact-hashes") == 1


def test_merge_steps_with_segments_in_files(spark, monkeypatch):
    monkeypatch.setattr(bpe_continuation, "BLOCK", 7)
    rng = random.Random(3)
    for alphabet, steps, least in (("ab", 25, 1), ("abcé😀", 30, 3)):
        rows = list({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))): rng.randrange(1, 9) for _ in range(150)}.items())
        long = [(s, n) for s, n in rows if len(s) >= 2]
        vocabulary = {c: k for k, c in enumerate(sorted({c for s, _ in long for c in s}))}
        want = bpe_continuation.merge_steps({tuple(vocabulary[c] for c in s): n for s, n in long}, dict(vocabulary), steps, least)
        assert bpe_continuation.merge_steps_at_scale(spark.createDataFrame(rows, "segment string, n long"), steps, least, every=9) == want
    assert bpe_continuation.merge_steps_at_scale(spark.createDataFrame([], "segment string, n long"), 5) == []
