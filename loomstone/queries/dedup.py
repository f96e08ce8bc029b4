"""Queries over the dedup stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import ids
from loomstone.functions import normalize
from loomstone.operators import dedup as D
from loomstone.operators import minhash, replay
from loomstone.operators.selection import top_per_group
from loomstone.plans.session import table, written
from loomstone.queries import query
from loomstone.queries.tables import CANON, RELAXED, STRICT, canon, documents

#: The selection priority, and the same as an ORDER BY.
ORDER = """CASE WHEN coalesce(needs_ocr, false) AND NOT coalesce(ocr_success, false) THEN 1 ELSE 0 END, CASE WHEN needs_ocr THEN 1.0 WHEN NOT needs_ocr THEN 0.0 ELSE 0.5 END,
-CASE WHEN chars > 0 AND badness IS NOT NULL THEN greatest(0.0, chars * (1.0 - badness / 10.0)) ELSE 0.0 END, coalesce(badness, 'infinity'::DOUBLE), CASE WHEN ocr_success THEN 0.0 WHEN NOT ocr_success THEN 1.0 ELSE 0.5 END, source_dataset, source_doc_id"""
STAGES = f"""{CANON}, h AS (SELECT *, md5({STRICT.format("text")}) AS sh, md5({RELAXED.format("text")}) AS rh FROM canon),
s AS (SELECT *, first_value(doc_key) OVER (PARTITION BY sh ORDER BY {ORDER}) AS strict_keeper, count(*) OVER (PARTITION BY sh) AS strict_size FROM h),
r AS (SELECT doc_key AS k, first_value(doc_key) OVER (PARTITION BY rh ORDER BY {ORDER}) AS relaxed_keeper FROM s WHERE doc_key = strict_keeper),
x AS (SELECT s.*, r.relaxed_keeper AS relaxed_keeper, doc_key = strict_keeper AS strict_kept, doc_key = strict_keeper AND r.relaxed_keeper IS NOT DISTINCT FROM doc_key AS kept_after_exact FROM s LEFT JOIN r ON s.doc_key = r.k)"""
FINAL = STAGES + """, f AS (SELECT x.*, coalesce(r.relaxed_keeper, x.strict_keeper) AS final_keeper, CASE WHEN NOT x.strict_kept THEN 'strict_exact' WHEN x.relaxed_keeper <> x.doc_key THEN 'relaxed_exact' ELSE 'kept' END AS stage FROM x LEFT JOIN r ON x.strict_keeper = r.k)"""


def priority():
    return ids.selection_priority(F.col("chars"), F.col("badness"), F.lit(None).cast("double"), F.col("needs_ocr"), F.col("ocr_success"), F.lit(""), F.lit(""), F.col("source_dataset"), F.col("source_doc_id"))


def hashed(spark, sf):
    """Narrow rows with the hashes of both forms, written once, as every stage reads them."""
    docs = canon(spark, sf).withColumn("f", normalize.exact_hashes("text"))
    return written(docs.withColumns({"sh": F.col("f.strict_md5"), "rh": F.col("f.relaxed_md5")}).drop("text", "f"), "exact-hashes")


def stages(spark, sf):
    return D.docs_exact(hashed(spark, sf), "sh", "rh", priority())


def final(spark, sf):
    exact = written(stages(spark, sf), "exact-stages")
    return exact.join(D.final_keeper(exact), "doc_key")


@query(f"WITH {STAGES} SELECT doc_id, strict_keeper = doc_key AS kept, strict_keeper AS keeper, strict_size AS group_size FROM s")
def exact_strict_keepers(spark, sf):
    return D.exact_stage(hashed(spark, sf), "sh", priority()).select("doc_id", "kept", "keeper", "group_size")


@query(f"WITH {STAGES} SELECT doc_id, relaxed_keeper AS keeper FROM x WHERE strict_kept")
def exact_relaxed_keepers(spark, sf):
    return stages(spark, sf).where("strict_kept").select("doc_id", F.col("relaxed_keeper").alias("keeper"))


@query(f"WITH {STAGES} SELECT doc_id, source_dataset, strict_kept, strict_keeper, relaxed_keeper, kept_after_exact FROM x")
def docs_exact(spark, sf):
    return stages(spark, sf).select("doc_id", "source_dataset", "strict_kept", "strict_keeper", "relaxed_keeper", F.coalesce("kept_after_exact", F.lit(False)).alias("kept_after_exact"))


@query(f"WITH {FINAL} SELECT doc_id, final_keeper, stage FROM f")
def dedup_decisions(spark, sf):
    return final(spark, sf).select("doc_id", "final_keeper", "stage")


@query(f"WITH {FINAL} SELECT final_keeper, count(*) AS members FROM f GROUP BY final_keeper HAVING count(*) > 1")
def lineage_resolution(spark, sf):
    return final(spark, sf).groupBy("final_keeper").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


@query(f"WITH {STAGES} SELECT sh AS cluster, count(*) AS size, count(*) FILTER (NOT strict_kept) AS dropped, count(DISTINCT source_dataset) > 1 AS mixed_source FROM x GROUP BY sh HAVING count(*) > 1")
def exact_cluster_summary(spark, sf):
    return stages(spark, sf).groupBy(F.col("sh").alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("strict_kept")).alias("dropped"), (F.count_distinct("source_dataset") > 1).alias("mixed_source")).where("size > 1")


@query(f"WITH {FINAL} SELECT d.source_dataset AS from_source, k.source_dataset AS to_source, d.stage AS stage, count(*) AS dropped, CAST(sum(d.chars) AS BIGINT) AS chars FROM f d JOIN f k ON d.final_keeper = k.doc_key WHERE d.stage <> 'kept' GROUP BY 1, 2, 3")
def drop_flow_matrix(spark, sf):
    f = written(final(spark, sf).select("doc_key", "source_dataset", "final_keeper", "stage", "chars"), "decisions")
    kept = f.select(F.col("doc_key").alias("final_keeper"), F.col("source_dataset").alias("to_source"))
    return f.where("stage <> 'kept'").join(kept, "final_keeper").groupBy(F.col("source_dataset").alias("from_source"), "to_source", "stage").agg(F.count(F.lit(1)).alias("dropped"), F.sum("chars").alias("chars"))


@query(f"WITH {FINAL} SELECT source_dataset, count(*) AS rows, count(*) FILTER (stage = 'strict_exact') AS strict_dropped, count(*) FILTER (stage = 'relaxed_exact') AS relaxed_dropped, count(*) FILTER (stage = 'kept') AS kept, round(1.0 - 1.0 * count(*) FILTER (stage = 'kept') / count(*), 6) AS drop_rate FROM f GROUP BY source_dataset")
def source_dedup_summary(spark, sf):
    n, kept = F.count(F.lit(1)), F.count_if(F.col("stage") == "kept")
    return final(spark, sf).groupBy("source_dataset").agg(n.alias("rows"), F.count_if(F.col("stage") == "strict_exact").alias("strict_dropped"), F.count_if(F.col("stage") == "relaxed_exact").alias("relaxed_dropped"), kept.alias("kept"), F.round(1.0 - kept / n, 6).alias("drop_rate"))


FAMILY = FINAL + """, g AS (SELECT final_keeper AS fk, md5(final_keeper) AS family_id, count(*) AS family_size, count(DISTINCT source_dataset) AS family_source_count, string_agg(DISTINCT source_dataset, '+' ORDER BY source_dataset) AS sources FROM f GROUP BY final_keeper),
m AS (SELECT f.*, family_id, family_size, family_source_count, family_source_count > 1 AS mixed_source, CASE WHEN family_source_count > 1 THEN 'shared:' ELSE 'unique:' END || sources AS pool FROM f JOIN g ON f.final_keeper = g.fk)"""


@query(f"WITH {FAMILY} SELECT doc_id, family_id, family_size, family_source_count, mixed_source FROM m")
def family_membership(spark, sf):
    return D.families(final(spark, sf), "final_keeper").select("doc_id", "family_id", "family_size", "family_source_count", "mixed_source")


@query(f"WITH {FAMILY} SELECT pool, count(*) AS rows, count(DISTINCT family_id) AS families, CAST(sum(chars) AS BIGINT) AS chars FROM m GROUP BY pool")
def pool_keys(spark, sf):
    return D.families(final(spark, sf), "final_keeper").groupBy("pool").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("family_id").alias("families"), F.sum("chars").alias("chars"))


@query(f"WITH {FAMILY} SELECT doc_id, representative FROM (SELECT doc_id, first_value(doc_key) OVER (PARTITION BY family_id ORDER BY {ORDER}) AS representative FROM m)")
def quality_first_representatives(spark, sf):
    return replay.quality_first(D.families(final(spark, sf), "final_keeper"), priority()).select("doc_id", "representative")


@query(f"WITH {FAMILY} SELECT doc_id FROM (SELECT doc_id, doc_key, first_value(doc_key) OVER (PARTITION BY family_id ORDER BY {ORDER}) AS representative FROM m) WHERE doc_key = representative")
def drop_action_mix(spark, sf):
    return replay.apply_action(replay.quality_first(D.families(final(spark, sf), "final_keeper"), priority()), "drop_intra_and_inter").select("doc_id")


@query(f"WITH {FAMILY} SELECT doc_id FROM (SELECT doc_id, doc_key, first_value(doc_key) OVER (PARTITION BY family_id, source_dataset ORDER BY {ORDER}) AS representative FROM m) WHERE doc_key = representative")
def drop_intra_mix(spark, sf):
    """Copies within a source go, those in different sources stay."""
    return replay.apply_action(D.families(final(spark, sf), "final_keeper"), "drop_intra", priority=priority()).select("doc_id")


@query(f"WITH {FAMILY}, k AS (SELECT * FROM m WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND badness < 12), w AS (SELECT *, first_value(doc_key) OVER (PARTITION BY family_id, source_dataset ORDER BY {ORDER}) AS representative FROM k) SELECT doc_id FROM w WHERE doc_key = representative")
def selected_input(spark, sf):
    """The filter, the drop list, and drop_intra of what is left."""
    docs = written(D.families(final(spark, sf), "final_keeper"), "selected-members")
    dropped = docs.join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    return replay.selected_input(docs, F.col("badness") < 12, dropped, "drop_intra", docs.where("family_size > 1"), priority()).select("doc_id")


@query(f"WITH RECURSIVE {FAMILY}, e AS (SELECT DISTINCT sh AS h, 's' AS kind, doc_id FROM m UNION SELECT rh, 'r', doc_id FROM m), leasts AS (SELECT h, kind, min(doc_id) AS v FROM e GROUP BY h, kind), b AS (SELECT e.doc_id AS u, leasts.v AS v FROM e JOIN leasts ON e.h = leasts.h AND e.kind = leasts.kind WHERE e.doc_id <> leasts.v), y AS (SELECT u, v FROM b UNION SELECT v, u FROM b), c AS (SELECT doc_id AS node, doc_id AS seen FROM m UNION SELECT c.node, y.v FROM c JOIN y ON c.seen = y.u) SELECT node AS doc_id, min(seen) AS family FROM c GROUP BY node")
def families_by_union(spark, sf):
    """Families from strict and relaxed hashes of all rows."""
    rows = hashed(spark, sf).select("doc_id", "source_dataset", "sh", "rh")
    none = spark.createDataFrame([], "left_key long, right_key long, estimated_jaccard double")
    return replay.families_of(rows, ["sh", "rh"], none, replay.threshold(0.85)[1], key="doc_id")


@query()
def share_aware_representatives(spark, sf):
    """Sequential by its rule; tests hold it against golden cases."""
    members = D.families(final(spark, sf), "final_keeper").withColumn("rank", -F.col("chars").cast("double"))
    return replay.share_aware(members).select("doc_id", "pool", "representative")


@query(f"""WITH {CANON}, k AS (SELECT *, CASE WHEN source_dataset IN ('src0', 'src1', 'src2') THEN source_dataset || '|' || lower(string_split(text, chr(10))[1]) END AS key FROM canon),
o AS (SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN needs_ocr THEN 1.0 WHEN NOT needs_ocr THEN 0.0 ELSE 0.5 END, coalesce(badness, 'infinity'::DOUBLE), -chars, source_doc_id) AS rn FROM k)
SELECT doc_id FROM o WHERE key IS NULL OR rn = 1""")
def metadata_exact_dedup(spark, sf):
    docs = canon(spark, sf).withColumn("head", F.lower(F.substring_index("text", "\n", 1))).drop("text")
    key = F.when(F.col("source_dataset").isin("src0", "src1", "src2"), F.concat_ws("|", "source_dataset", "head"))
    prio = F.struct(ids.flag_rank(F.col("needs_ocr")), F.coalesce("badness", F.lit(float("inf"))), -F.col("chars"), "source_doc_id")
    return D.metadata_dedup(docs, key, prio).select("doc_id")


@query(f"""WITH {STAGES}, a AS (SELECT DISTINCT sh, source_dataset FROM x) SELECT p.source_dataset AS source, count(DISTINCT x.doc_id) AS docs_shared, count(DISTINCT x.sh) AS groups FROM a p JOIN a q ON p.sh = q.sh AND q.source_dataset <> p.source_dataset JOIN x ON x.sh = p.sh AND x.source_dataset = p.source_dataset GROUP BY 1""")
def counterpart_counts(spark, sf):
    docs = hashed(spark, sf).select("doc_id", "sh", "source_dataset")
    mixed = docs.groupBy("sh").agg(F.count_distinct("source_dataset").alias("n")).where("n > 1").select("sh")
    return docs.join(mixed, "sh", "left_semi").groupBy(F.col("source_dataset").alias("source")).agg(F.count_distinct("doc_id").alias("docs_shared"), F.count_distinct("sh").alias("groups"))


@query(f"WITH {FAMILY} SELECT family_id, size, source_dataset, doc_id FROM (SELECT family_id, family_size AS size, source_dataset, doc_id, row_number() OVER (PARTITION BY source_dataset ORDER BY family_size DESC, doc_id) AS rn FROM m WHERE family_size > 1) WHERE rn <= 2")
def largest_family_sample(spark, sf):
    members = D.families(final(spark, sf), "final_keeper").where("family_size > 1").select("family_id", F.col("family_size").alias("size"), "source_dataset", "doc_id")
    return top_per_group(members, ["source_dataset"], [F.desc("size"), "doc_id"], 2)


@query()
def unicode_normal_forms(spark, sf):
    """Strict, relaxed and near forms with Unicode composition and case folding: vectorised Python, held against plain Python by tests."""
    docs = canon(spark, sf).select("doc_id", "text")
    forms = docs.select("doc_id", normalize.strict_text("text").alias("s"), normalize.relaxed_text("text").alias("r"), normalize.relaxed_stripped_text("text").alias("g"), normalize.near_text("text").alias("n"))
    return forms.select("doc_id", *(F.md5(c).alias(n) for c, n in (("s", "strict_md5"), ("r", "relaxed_md5"), ("g", "stripped_md5"), ("n", "near_md5"))))


def near_input(spark, sf, planted, exact=None):
    """Survivors of the exact stages (equal texts make no pairs), written without their texts; with ``planted`` also a copy of each without its
    last word, so that there is something to find at every size."""
    exact = stages(spark, sf) if exact is None else exact
    docs = exact.where("kept_after_exact").select("source_dataset", "source_doc_id", "doc_id", "chars", "needs_ocr", "ocr_success", "badness")
    if planted:
        docs = docs.withColumn("doc_id", F.explode(F.array("doc_id", F.col("doc_id") + PLANTED)))
        docs = docs.withColumn("source_doc_id", F.col("doc_id").cast("string"))
    return written(docs, "near-input")


def near_texts(spark, sf, docs, planted):
    """Texts of what ``near_input`` gave."""
    texts = documents(spark, sf).select("doc_id", "text").join(docs.select("doc_id"), "doc_id", "left_semi")
    if not planted:
        return texts
    shorter = F.reverse(F.regexp_replace(F.reverse("text"), r"^\s*\S+\s*", ""))
    both = texts.select(F.explode(F.array(F.struct("doc_id", "text"), F.struct((F.col("doc_id") + PLANTED).alias("doc_id"), shorter.alias("text")))).alias("d"))
    return both.select("d.doc_id", "d.text")


#: Ids of planted copies begin here.
PLANTED = 1_000_000_000


def near_stage(spark, sf, planted=True, exact=None):
    """Documents, signatures and pairs, each written once."""
    docs = near_input(spark, sf, planted, exact)
    sigs = written(minhash.signatures(near_texts(spark, sf, docs, planted), "doc_id"), "minhash-signatures")
    return docs, sigs, written(minhash.candidate_pairs(sigs, key="doc_id", stored=True), "minhash-pairs")


@query()
def minhash_candidate_pairs(spark, sf):
    return near_stage(spark, sf, False)[2]


@query()
def near_components(spark, sf):
    from loomstone.operators.components import connected_components

    return connected_components(near_stage(spark, sf)[2], "left_key", "right_key").withColumnRenamed("node", "doc_id")


def resolved(spark, sf, exact=None):
    """Documents, and what the near stage says of each of them."""
    docs, sigs, pairs = near_stage(spark, sf, exact=exact)
    order = priority()
    head = F.to_json(F.struct(*(order.getField(f) for f in ("invalid", "needs_ocr", "score", "badness", "mojibake", "ocr", "title"))))
    ranks = docs.select("doc_id", order.alias("rank"), head.alias("rank_head"))
    found = minhash.clusters(pairs, ranks, key="doc_id", sigs=sigs)
    return docs, written(minhash.with_singletons(found, docs, "doc_id"), "near-decided")


@query()
def near_clusters(spark, sf):
    return resolved(spark, sf)[1].select("doc_id", "representative", "similarity", "cluster_id", "cluster_size", "component_size", "large_component", "narrow_margin", "reason")


@query()
def near_cluster_summary(spark, sf):
    docs, found = resolved(spark, sf)
    c = found.join(docs.select("doc_id", "source_dataset"), "doc_id")
    return c.groupBy("cluster_id", "representative").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("doc_id") != F.col("representative")).alias("dropped"), (F.count_distinct("source_dataset") > 1).alias("mixed_source"), F.min("similarity").alias("least"))


@query()
def near_drop_list(spark, sf):
    return minhash.drop_list(resolved(spark, sf)[1], "doc_id")


@query()
def full_decisions(spark, sf):
    """Every document (copies of the near stage too) with the document that stays for it and the stage that dropped it."""
    exact = written(stages(spark, sf), "exact-stages")
    docs, near = resolved(spark, sf, exact)
    exact = exact.select(F.col("doc_id"), F.col("strict_keeper"), "strict_kept", "relaxed_keeper", "doc_key")
    keys = written(exact.select("doc_key", F.col("doc_id").alias("id")), "decision-keys")
    of = lambda name: keys.select(F.col("doc_key").alias(name), F.col("id").alias(f"{name}_id"))
    exact = exact.join(of("strict_keeper"), "strict_keeper").join(of("relaxed_keeper"), "relaxed_keeper", "left")
    exact = exact.select("doc_id", F.col("strict_keeper_id").alias("strict_keeper"), "strict_kept", F.col("relaxed_keeper_id").alias("relaxed_keeper"))
    made = docs.where(F.col("doc_id") >= PLANTED).select("doc_id", F.col("doc_id").alias("strict_keeper"), F.lit(True).alias("strict_kept"), F.col("doc_id").alias("relaxed_keeper"))
    return D.decisions(written(exact.unionByName(made), "decision-exact"), near, "doc_id")


@query()
def near_doc_stats(spark, sf):
    """Of each document with pairs: how many, how many within and across sources, and the best."""
    docs, _, pairs = near_stage(spark, sf)
    pairs = pairs.select("left_key", "right_key", "estimated_jaccard")
    both = pairs.unionByName(pairs.select(F.col("right_key").alias("left_key"), F.col("left_key").alias("right_key"), "estimated_jaccard"))
    source = lambda name: docs.select(F.col("doc_id").alias(f"{name}_key"), F.col("source_dataset").alias(f"{name}_source"))
    both = both.join(source("left"), "left_key").join(source("right"), "right_key").withColumn("same", F.col("left_source").eqNullSafe(F.col("right_source")))
    best = F.min_by("right_key", F.struct(-F.col("estimated_jaccard"), "right_key"))
    return both.groupBy(F.col("left_key").alias("doc_id")).agg(F.count(F.lit(1)).alias("matches"), F.count_if("same").alias("same_source"), F.count_if(~F.col("same")).alias("cross_source"), best.alias("best_match"), F.max("estimated_jaccard").alias("best_jaccard"))


@query()
def near_pairs_enriched(spark, sf):
    """Pairs with what is known of both documents."""
    docs, _, pairs = near_stage(spark, sf)
    of = lambda name: docs.select(F.col("doc_id").alias(f"{name}_key"), F.col("source_dataset").alias(f"{name}_source"), F.col("chars").alias(f"{name}_chars"), F.col("badness").alias(f"{name}_badness"))
    return pairs.join(of("left"), "left_key").join(of("right"), "right_key")


@query()
def edge_audit_sample(spark, sf):
    """Pairs near the threshold, with unlike lengths, or with containment, in the order of a hash."""
    pairs = near_stage(spark, sf)[2]
    why = F.when(F.abs(F.col("estimated_jaccard") - minhash.THRESHOLD) <= 0.02, "near_threshold").when(F.col("length_ratio") < 0.8, "length_ratio").when(F.col("containment"), "containment")
    rows = pairs.withColumns({"reason": why, "p": F.md5(F.concat_ws("|", F.col("left_key").cast("string"), F.col("right_key").cast("string")))}).where("reason is not null")
    return top_per_group(rows, ["reason"], ["p"], 256).drop("p")
