"""Queries over rule tables, audits, lookups and small numeric methods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators.selection import pack_bins
from loomstone.plans.session import table
from loomstone.queries import query
from loomstone.queries.tables import CANON, canon, documents
from loomstone.queries.tokens import WORDS, words


def count():
    return F.count(F.lit(1))


@query(r"""SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g')), '^_+|_+$', '', 'g') AS stem, regexp_replace(p_name || CASE p_partkey % 3 WHEN 0 THEN '.xml.gz' WHEN 1 THEN '.gz' ELSE '' END, '(\.(xml|gz|txt))+$', '') AS bare FROM part""")
def file_stems(spark, sf):
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".xml.gz").when(F.col("p_partkey") % 3 == 1, ".gz").otherwise("")
    stem = F.regexp_replace(F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9._-]+", "_")), "^_+|_+$", "")
    return table(spark, sf, "part").select("p_partkey", stem.alias("stem"), F.regexp_replace(F.concat("p_name", suffix), r"(\.(xml|gz|txt))+$", "").alias("bare"))


SCORES = "s AS (SELECT doc_id, unnest(['news', 'forum', 'legal', 'story']) AS label, unnest([(doc_id * 7) % 11, (doc_id * 5) % 11, (doc_id * 3) % 11, doc_id % 11]) AS score FROM documents)"


def label_scores(spark, sf):
    k = F.col("doc_id")
    return documents(spark, sf).select("doc_id", F.create_map(F.lit("news"), (k * 7) % 11, F.lit("forum"), (k * 5) % 11, F.lit("legal"), (k * 3) % 11, F.lit("story"), k % 11).alias("scores"))


@query(f"WITH {SCORES} SELECT doc_id, label AS top_label, score AS top_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn FROM s) WHERE rn = 1")
def top_labels(spark, sf):
    entries = F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("score"), e["key"].alias("label"))))
    return label_scores(spark, sf).select("doc_id", F.get(entries, F.lit(0)).alias("e")).select("doc_id", F.col("e.label").alias("top_label"), (-F.col("e.score")).alias("top_score"))


PARENTS = {"news": "IN", "forum": "ID", "legal": "LE", "story": "NA"}


@query(f"""WITH {SCORES}, t AS (SELECT doc_id, label, CASE label WHEN 'news' THEN 'IN' WHEN 'forum' THEN 'ID' WHEN 'legal' THEN 'LE' ELSE 'NA' END AS parent, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn FROM s),
m AS (SELECT d.doc_id, CASE d.lang WHEN 'en' THEN 'IN' WHEN 'fr' THEN 'ID' WHEN 'de' THEN 'LE' ELSE 'NA' END AS main, t.parent AS parent, t.label AS label FROM documents d JOIN t ON d.doc_id = t.doc_id AND t.rn = 1)
SELECT main, count(*) AS rows, count(*) FILTER (main = parent) AS agree, round(1.0 * count(*) FILTER (main <> parent) / count(*), 6) AS mismatch_share FROM m GROUP BY main""")
def register_agreement(spark, sf):
    """A main label stands only where the top sub label's parent agrees with it; the taxonomy is a table of a few rows."""
    taxonomy = spark.createDataFrame(list(PARENTS.items()), "top_label string, parent string")
    main = F.when(F.col("lang") == "en", "IN").when(F.col("lang") == "fr", "ID").when(F.col("lang") == "de", "LE").otherwise("NA")
    rows = top_labels(spark, sf).join(taxonomy, "top_label").join(documents(spark, sf).select("doc_id", main.alias("main")), "doc_id")
    agree = F.count_if(F.col("main") == F.col("parent"))
    return rows.groupBy("main").agg(count().alias("rows"), agree.alias("agree"), F.round((count() - agree) / count(), 6).alias("mismatch_share"))


ALIASES = (("en", "eng|english|en"), ("fr", "fra|fre|french|fr"), ("de", "deu|ger|german|de|en"), ("es", "spa|spanish|es"))


@query("""WITH a AS (SELECT code, ord, unnest(string_split(names, '|')) AS alias FROM (VALUES ('en', 1, 'eng|english|en'), ('fr', 2, 'fra|fre|french|fr'), ('de', 3, 'deu|ger|german|de|en'), ('es', 4, 'spa|spanish|es')) t(code, ord, names)),
f AS (SELECT alias, arg_min(code, ord) AS code FROM a GROUP BY alias) SELECT doc_id, f.code AS code FROM documents d LEFT JOIN f ON d.lang = f.alias""")
def iso_lookup(spark, sf):
    """Keys with aliases; of a repeated alias the first declaration holds."""
    declared = spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate(ALIASES)], "code string, ord int, names string")
    lookup = declared.select("code", "ord", F.explode(F.split("names", r"\|")).alias("lang")).groupBy("lang").agg(F.min_by("code", "ord").alias("code"))
    return documents(spark, sf).select("doc_id", "lang").join(lookup, "lang", "left").select("doc_id", "code")


@query(f"""WITH {WORDS}, v AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(word, '[0-9]') THEN 'mixed' WHEN length(word) = 1 THEN 'single' WHEN regexp_matches(word, '[^a-z]') THEN 'accented' WHEN length(word) > 15 THEN 'long' ELSE 'plain' END AS category, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS mass FROM v GROUP BY 1""")
def token_categories(spark, sf):
    w = F.col("word")
    category = F.when(w.rlike("^[0-9]+$"), "digits").when(w.rlike("[0-9]"), "mixed").when(F.length(w) == 1, "single").when(w.rlike("[^a-z]"), "accented").when(F.length(w) > 15, "long").otherwise("plain")
    v = words(spark, sf).groupBy("word").agg(count().alias("n"))
    return v.groupBy(category.alias("category")).agg(count().alias("tokens"), F.sum("n").alias("mass"))


@query(f"""WITH {WORDS}, v AS (SELECT DISTINCT lang, word, CASE WHEN length(word) <= 3 THEN 'short' ELSE 'other' END AS category FROM w) SELECT category, count(*) AS tokens, count(*) FILTER (arms > 1) AS shared FROM (SELECT word, category, count(*) AS arms FROM v GROUP BY word, category) GROUP BY category""")
def vocabulary_by_arm(spark, sf):
    category = F.when(F.length("word") <= 3, "short").otherwise("other").alias("category")
    arms = words(spark, sf, "lang").groupBy("word", category).agg(F.count_distinct("lang").alias("arms"))
    return arms.groupBy("category").agg(count().alias("tokens"), F.count_if(F.col("arms") > 1).alias("shared"))


@query(f"""WITH {WORDS}, v AS (SELECT word, count(*) AS n, count(DISTINCT lang) AS langs FROM w GROUP BY word) SELECT decision, count(*) AS tokens FROM (SELECT CASE WHEN n < 3 AND length(word) > 12 THEN 'remove_rare_long' WHEN regexp_matches(word, '[0-9]') THEN 'remove_digits' WHEN langs = 4 THEN 'keep_shared' WHEN n >= 20 THEN 'keep_frequent' ELSE 'review' END AS decision FROM v) GROUP BY decision""")
def removal_policy(spark, sf):
    v = words(spark, sf, "lang").groupBy("word").agg(count().alias("n"), F.count_distinct("lang").alias("langs"))
    decision = (
        F.when((F.col("n") < 3) & (F.length("word") > 12), "remove_rare_long").when(F.col("word").rlike("[0-9]"), "remove_digits").when(F.col("langs") == 4, "keep_shared")
        .when(F.col("n") >= 20, "keep_frequent").otherwise("review")
    )
    return v.groupBy(decision.alias("decision")).agg(count().alias("tokens"))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS x FROM c), k AS (SELECT *, CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) AS cum FROM r), z AS (SELECT *, (x - 1.0) / (SELECT max(x) - 1 FROM k) AS nx, (cum - (SELECT min(cum) FROM k)) / (SELECT max(cum) - min(cum) FROM k) AS ny, n - lag(n, 1, 0) OVER (ORDER BY x) AS step FROM k)
SELECT arg_max(x, struct_pack(d := round(ny - nx, 9), k := -x)) AS knee, min(x) FILTER (cum >= 0.8 * (SELECT max(cum) FROM k)) AS point_80, count(*) FILTER (n >= 0.01 * (SELECT max(cum) FROM k)) AS above_floor, min(x) FILTER (n <= (SELECT max(n) FROM k) / 2.0) AS half_marginal FROM z""")
def knee_statistics(spark, sf):
    """Where a curve of gains bends: one row for each source."""
    c = documents(spark, sf).groupBy("source").agg(count().alias("n"))
    rank, everything = Window.orderBy(F.desc("n"), "source"), Window.partitionBy()
    k = c.select("n", F.row_number().over(rank).cast("long").alias("x"), F.sum("n").over(rank.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("cum"))
    k = k.select("n", "x", "cum", F.max("cum").over(everything).alias("total"), F.min("cum").over(everything).alias("least"), F.max("x").over(everything).alias("last"), F.max("n").over(everything).alias("most"))
    gap = F.round((F.col("cum") - F.col("least")) / (F.col("total") - F.col("least")) - (F.col("x") - 1.0) / (F.col("last") - 1), 9)
    return k.agg(
        F.max_by("x", F.struct(gap, -F.col("x"))).alias("knee"), F.min(F.when(F.col("cum") >= 0.8 * F.col("total"), F.col("x"))).alias("point_80"),
        F.count_if(F.col("n") >= 0.01 * F.col("total")).alias("above_floor"), F.min(F.when(F.col("n") <= F.col("most") / 2.0, F.col("x"))).alias("half_marginal"),
    )


@query("""WITH now AS (SELECT source, md5(string_agg(md5(text), '|' ORDER BY md5(text))) AS digest, count(*) AS n FROM documents GROUP BY source), before AS (SELECT source, md5(string_agg(md5(text), '|' ORDER BY md5(text))) AS digest FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 2 = 0 GROUP BY source)
SELECT now.source AS source, n, CASE WHEN before.digest IS NULL THEN 'new' WHEN before.digest = now.digest THEN 'reuse' ELSE 'redo' END AS state FROM now LEFT JOIN before ON now.source = before.source""")
def incremental_reuse(spark, sf):
    """Groups whose members' digest is that of the run before are taken over. Digests are sums of hashes, so no group is gathered; equality of
    digests, not their values, is what counts."""
    docs = documents(spark, sf).select("doc_id", "source", F.xxhash64("text").cast("decimal(38,0)").alias("h"))

    def digest(rows):
        return rows.groupBy("source").agg(F.sum("h").alias("digest"), count().alias("n"))

    before = digest(docs.where(~F.col("source").isin("src1", "src2") | (F.col("doc_id") % 2 == 0))).select("source", F.col("digest").alias("old"), F.col("n").alias("old_n"))
    same = (F.col("old") == F.col("digest")) & (F.col("old_n") == F.col("n"))
    return digest(docs).join(before, "source", "left").select("source", "n", F.when(F.col("old").isNull(), "new").when(same, "reuse").otherwise("redo").alias("state"))


@query(r"""WITH p AS (SELECT doc_id, source, md5(text) AS h, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) >= 4)) AS ws FROM documents), g AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
f AS (SELECT p.* FROM p JOIN g ON p.h = g.h), k AS (SELECT h, arg_min(doc_id, doc_id) AS first_doc FROM f GROUP BY h)
SELECT f.doc_id AS doc_id, k.first_doc AS first_doc, f.doc_id = k.first_doc AS is_best, CAST(len(ws) AS BIGINT) AS words FROM f JOIN k ON f.h = k.h""")
def group_audit(spark, sf):
    """Members of groups of equal texts with the best candidate of each and the words that mark them."""
    marked = F.array_distinct(F.filter(T.word_tokens(F.lower("text")), lambda x: F.length(x) >= 4))
    rows = documents(spark, sf).select("doc_id", F.md5("text").alias("h"), F.size(marked).cast("long").alias("words"))
    groups = rows.groupBy("h").agg(count().alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    return rows.join(groups, "h").select("doc_id", "first_doc", (F.col("doc_id") == F.col("first_doc")).alias("is_best"), "words")


@query(f"""WITH {CANON}, g AS (SELECT md5(text) AS h, count(*) AS n, count(DISTINCT source_dataset) AS sources, max(chars) AS chars, max(badness) AS badness FROM canon GROUP BY 1 HAVING count(*) > 1)
SELECT reason, count(*) AS groups, CAST(sum(n) AS BIGINT) AS docs FROM (SELECT *, CASE WHEN chars < 100 THEN 'tiny_text' WHEN badness > 10 THEN 'noisy' WHEN sources > 1 THEN 'cross_source' WHEN n > 2 THEN 'large_internal' ELSE 'internal_pair' END AS reason FROM g) GROUP BY reason""")
def duplicate_group_reasons(spark, sf):
    g = canon(spark, sf).groupBy(F.md5("text").alias("h")).agg(count().alias("n"), F.count_distinct("source_dataset").alias("sources"), F.max("chars").alias("chars"), F.max("badness").alias("badness")).where("n > 1")
    reason = F.when(F.col("chars") < 100, "tiny_text").when(F.col("badness") > 10, "noisy").when(F.col("sources") > 1, "cross_source").when(F.col("n") > 2, "large_internal").otherwise("internal_pair")
    return g.groupBy(reason.alias("reason")).agg(count().alias("groups"), F.sum("n").alias("docs"))


@query("""WITH h AS (SELECT md5(text) AS h, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT a.source AS a, b.source AS b, count(*) AS overlap, CAST(sum(least(a.n, b.n)) AS BIGINT) AS docs FROM h a JOIN h b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2), t AS (SELECT source, count(*) AS total FROM documents GROUP BY source)
SELECT p.a AS source_a, p.b AS source_b, overlap, docs, CASE WHEN 1.0 * docs / least(x.total, y.total) > 0.1 THEN 'prefer_larger' WHEN overlap > 1 THEN 'review' ELSE 'ignore' END AS advice FROM p JOIN t x ON p.a = x.source JOIN t y ON p.b = y.source""")
def pair_recommendations(spark, sf):
    docs = documents(spark, sf).select(F.md5("text").alias("h"), "source")
    groups = docs.groupBy("h", "source").agg(count().alias("n")).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s")).where(F.size("s") > 1)  # bounded by the sources
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["source"] > a["source"]), lambda b: F.struct(a["source"].alias("a"), b["source"].alias("b"), F.least(a["n"], b["n"]).alias("n")))))
    p = groups.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("source_a"), F.col("p.b").alias("source_b")).agg(count().alias("overlap"), F.sum("p.n").alias("docs"))
    total = docs.groupBy("source").agg(count().alias("total"))
    out = p.join(total.select(F.col("source").alias("source_a"), F.col("total").alias("ta")), "source_a").join(total.select(F.col("source").alias("source_b"), F.col("total").alias("tb")), "source_b")
    advice = F.when(F.col("docs") / F.least("ta", "tb") > 0.1, "prefer_larger").when(F.col("overlap") > 1, "review").otherwise("ignore")
    return out.select("source_a", "source_b", "overlap", "docs", advice.alias("advice"))


@query("""SELECT source, n, CAST(round(n * rate, 4) AS DOUBLE) AS consumed, round(n * rate / sum(n * rate) OVER (), 6) AS share FROM (SELECT source, count(*) AS n, CAST(CASE source WHEN 'src0' THEN 2.0 WHEN 'src1' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS rate FROM documents GROUP BY source)""")
def stage_consumption(spark, sf):
    rate = F.when(F.col("source") == "src0", 2.0).when(F.col("source") == "src1", 0.5).otherwise(1.0)
    used = documents(spark, sf).groupBy("source").agg(count().alias("n")).withColumn("used", F.col("n") * rate)
    return used.select("source", "n", F.round("used", 4).alias("consumed"), F.round(F.col("used") / F.sum("used").over(Window.partitionBy()), 6).alias("share"))


@query(r"""SELECT part, count(*) AS rows, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS deviation, min(v) AS least, max(v) AS most FROM (SELECT CASE WHEN l_shipdate <= DATE '1995-06-30' THEN 'early' ELSE 'late' END AS part, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) GROUP BY part""")
def numeric_profile(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_shipdate") <= F.lit("1995-06-30").cast("date"), "early").otherwise("late").alias("part"), F.col("l_quantity").cast("double").alias("v"))
    return rows.groupBy("part").agg(count().alias("rows"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most"))


@query()
def shard_bin_packing(spark, sf):
    """Sources to four shards, the largest first, each to the shard with the least load: one row for each source."""
    sizes = documents(spark, sf).groupBy("source").agg(F.sum(F.length("text")).alias("size"))
    return spark.createDataFrame(pack_bins([(r["source"], r["size"]) for r in sizes.collect()], 4), "source string, size long, shard int")


@query()
def mojibake_recovery(spark, sf):
    """Texts that were read in the wrong encoding, and what they were: UTF-8 bytes that stand as Latin-1 characters."""
    docs = documents(spark, sf).select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("broken"), "text")
    fixed = F.decode(F.encode("broken", "ISO-8859-1"), "UTF-8")
    return docs.select("doc_id", (fixed == F.col("text")).alias("recovered"), (F.col("broken") != F.col("text")).alias("was_broken"))
