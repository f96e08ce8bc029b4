"""Queries over joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.plans.session import table
from loomstone.queries import query
from loomstone.queries.tables import CANON, canon, documents

def N():
    return F.count(F.lit(1))


def pct(part, whole, digits=6):
    return F.round(part / whole, digits)


@query("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def attach_labels(spark, sf):
    return documents(spark, sf).select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def exclude_doc_keys(spark, sf):
    drop = table(spark, sf, "labels").where("quality = 0").select("doc_id").distinct()
    return documents(spark, sf).select("doc_id", "source").join(drop, "doc_id", "left_anti")


@query("""SELECT source, count(*) AS excluded, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY source""")
def excluded_counts(spark, sf):
    drop = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return documents(spark, sf).join(drop, "doc_id", "left_semi").groupBy("source").agg(N().alias("excluded"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT doc_id FROM documents d WHERE doc_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 10 <> 0 AND md5(t.text) = md5(d.text))""")
def heldout_antijoin(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.md5("text").alias("h"))
    return docs.where("doc_id % 10 = 0").join(docs.where("doc_id % 10 <> 0").select("h"), "h", "left_anti").select("doc_id")


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def benchmark_contamination(spark, sf):
    """Literal copies by a hash join: the second to fifth word of each item are looked up in the document's runs of four words.

    Items have at least six words, so these four have white space around them wherever the item stands.
    """
    docs = documents(spark, sf).select("doc_id", F.lower("text").alias("t"))
    items = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("b")).withColumn("v", F.split("b", T.spelled(r"\s+"))).where(F.size("v") >= 6)
    items = items.select("item_id", "b", F.xxhash64(F.array_join(F.slice("v", 2, 4), " ")).alias("head"))

    def runs(words):  # the words are a lambda's variable: parted once for each text, not once for each run
        return F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 3), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(4)), " "))))

    windows = docs.select("doc_id", F.explode(F.array_distinct(F.get(F.transform(F.array(F.split("t", T.spelled(r"\s+"))), runs), F.lit(0)))).alias("head"))
    found = windows.join(items, "head").select("doc_id", "item_id", "b")
    return found.join(docs.select("doc_id", "t"), "doc_id").where(F.contains("t", F.col("b"))).select("doc_id", "item_id").distinct()


@query("""SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def left_chain(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return c.join(names, c.c_nationkey == names.n_nationkey, "left").select("c_custkey", "n_name", "r_name")


@query("""WITH s AS (SELECT source, count(*) AS strict_n FROM documents WHERE lang = 'en' GROUP BY source), r AS (SELECT source, count(*) AS relaxed_n FROM documents WHERE lang <> 'en' AND doc_id % 3 = 0 GROUP BY source)
SELECT coalesce(s.source, r.source) AS source, coalesce(strict_n, 0) AS strict_n, coalesce(relaxed_n, 0) AS relaxed_n FROM s FULL OUTER JOIN r ON s.source = r.source""")
def cross_source_full_outer(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", "lang")
    s = docs.where("lang = 'en'").groupBy("source").agg(N().alias("strict_n"))
    r = docs.where("lang <> 'en' and doc_id % 3 = 0").groupBy("source").agg(N().alias("relaxed_n"))
    return s.join(r, "source", "full").na.fill(0, ["strict_n", "relaxed_n"])


@query("""WITH h AS (SELECT DISTINCT md5(text) AS h, source FROM documents) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared_groups FROM h a JOIN h b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2""")
def source_pair_overlap(spark, sf):
    """Pairs of sources that share a text. Sources of one text are few, so the pairs are made inside one array."""
    return source_pairs(documents(spark, sf).select(F.md5("text").alias("h"), "source"), False)


def source_pairs(rows, with_self):
    groups = rows.groupBy("h").agg(F.array_sort(F.collect_set("source")).alias("s"))
    if not with_self:
        groups = groups.where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b: (b >= a) if with_self else (b > a)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return groups.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("source_a"), F.col("p.b").alias("source_b")).agg(N().alias("shared_groups"))


@query("""WITH h AS (SELECT DISTINCT md5(text) AS h, source FROM documents) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared_groups FROM h a JOIN h b ON a.h = b.h AND a.source <= b.source GROUP BY 1, 2""")
def source_pair_summary(spark, sf):
    return source_pairs(documents(spark, sf).select(F.md5("text").alias("h"), "source"), True)


@query("""SELECT o_custkey, string_agg(o_comment, chr(10) || chr(10) ORDER BY o_orderdate, o_orderkey) AS body, count(*) AS sections, arg_min(o_orderstatus, o_orderkey) AS first_status FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS o_comment FROM orders) GROUP BY o_custkey""")
def section_concat(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("body")).alias("s"))
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("s")).alias("s"), N().alias("sections"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"))
    return g.select("o_custkey", F.array_join("s.body", "\n\n").alias("body"), "sections", "first_status")


@query(r"""SELECT source, count(*) AS rows, CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) AS BIGINT) AS tokens FROM documents GROUP BY source ORDER BY tokens DESC, source""")
def mix_summary(spark, sf):
    return documents(spark, sf).groupBy("source").agg(N().alias("rows"), F.sum(T.token_estimate(F.col("text"))).alias("tokens")).orderBy(F.desc("tokens"), "source")


@query("""SELECT quality, toxic, lang, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality, toxic, lang""")
def pool_summary(spark, sf):
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.groupBy("quality", "toxic", "lang").agg(N().alias("rows"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {CANON} SELECT count(*) AS rows_before, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars_before, count(*) FILTER (badness < 10) AS rows_after, CAST(coalesce(sum(chars) FILTER (badness < 10), 0) AS BIGINT) AS chars_after FROM canon""")
def filter_effect(spark, sf):
    good = F.col("badness") < 10
    return canon(spark, sf).agg(N().alias("rows_before"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars_before"), F.count_if(good).alias("rows_after"), F.coalesce(F.sum(F.when(good, F.col("chars"))), F.lit(0)).alias("chars_after"))


@query(f"""WITH {CANON} SELECT source_dataset, count(*) AS rows, count(*) FILTER (trim(text) = '') AS empty_texts, count(*) - count(DISTINCT md5(text)) AS duplicate_texts, count(*) - count(DISTINCT source_doc_id) AS duplicate_ids, count(*) FILTER (needs_ocr IS NULL) AS unlabelled FROM canon GROUP BY source_dataset""")
def validate_corpus(spark, sf):
    return canon(spark, sf).groupBy("source_dataset").agg(
        N().alias("rows"), F.count_if(F.trim("text") == "").alias("empty_texts"), (N() - F.count_distinct(F.md5("text"))).alias("duplicate_texts"),
        (N() - F.count_distinct("source_doc_id")).alias("duplicate_ids"), F.count_if(F.col("needs_ocr").isNull()).alias("unlabelled"),
    )


@query("""SELECT source, count(*) AS rows, count(DISTINCT lang) AS langs FROM documents GROUP BY source""")
def row_counts(spark, sf):
    return documents(spark, sf).groupBy("source").agg(N().alias("rows"), F.count_distinct("lang").alias("langs"))


@query(r"""SELECT coalesce(source, 'all') AS part, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM documents GROUP BY ROLLUP (source)""")
def prepare_manifest(spark, sf):
    docs = documents(spark, sf).select("source", *(T.text_metrics(F.col("text"))[k].alias(k) for k in ("chars", "words")))
    return docs.rollup("source").agg(N().alias("rows"), F.sum("chars").alias("chars"), F.sum("words").alias("words")).select(F.coalesce("source", F.lit("all")).alias("part"), "rows", "chars", "words")


@query(f"""WITH {CANON} SELECT source_dataset, count(*) FILTER (needs_ocr) AS bad, count(*) FILTER (NOT needs_ocr) AS good, count(*) FILTER (needs_ocr IS NULL) AS unknown, round(1.0 * count(*) FILTER (needs_ocr) / count(*), 6) AS bad_share FROM canon GROUP BY source_dataset""")
def source_conditional_counts(spark, sf):
    bad = F.count_if(F.col("needs_ocr"))
    return canon(spark, sf).groupBy("source_dataset").agg(bad.alias("bad"), F.count_if(~F.col("needs_ocr")).alias("good"), F.count_if(F.col("needs_ocr").isNull()).alias("unknown"), pct(bad, N()).alias("bad_share"))


@query("""SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 20""")
def lang_topk(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(N().alias("n")).orderBy(F.desc("n"), "lang").limit(20)


@query("""WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 GROUP BY lang)
SELECT coalesce(a.lang, k.lang) AS lang, round(100.0 * coalesce(k.n, 0) / (SELECT sum(n) FROM k) - 100.0 * coalesce(a.n, 0) / (SELECT sum(n) FROM a), 6) AS delta FROM a FULL OUTER JOIN k ON a.lang = k.lang""")
def label_shift(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang")
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")

    def share(rows, name):
        n = rows.groupBy("lang").agg(N().alias("n"))
        return n.select("lang", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # one row for each language

    joined = share(docs, "a").join(share(docs.join(good, "doc_id"), "k"), "lang", "full")
    return joined.select("lang", F.round(F.coalesce("k", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6).alias("delta"))


@query("""SELECT count(*) FILTER (l.quality IS NULL) AS missing_quality, count(*) FILTER (l.toxic IS NULL) AS missing_toxic, count(*) FILTER (d.lang IS NULL) AS missing_lang, count(*) AS rows FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def missing_field_counts(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.agg(*(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("quality", "toxic", "lang")), N().alias("rows"))


@query("""WITH s AS (SELECT count(*) AS n FROM documents GROUP BY md5(text)) SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, max(n) AS most FROM s""")
def cluster_size_percentiles(spark, sf):
    sizes = documents(spark, sf).groupBy(F.md5("text")).agg(N().alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.9).alias("p90"), F.max("n").alias("most"))


@query("""WITH b AS (SELECT doc_id % 10 AS bin, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1) SELECT bin, bytes, round(bytes / (SELECT sum(bytes) FROM b), 6) AS share, CASE WHEN bin >= 8 THEN round(bytes / (SELECT sum(bytes) FROM b WHERE bin >= 8), 6) END AS kept_share FROM b""")
def quality_bin_share(spark, sf):
    b = documents(spark, sf).groupBy((F.col("doc_id") % 10).alias("bin")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    kept, everything = F.col("bin") >= 8, Window.partitionBy()  # ten rows
    return b.select("bin", "bytes", pct(F.col("bytes"), F.sum("bytes").over(everything)).alias("share"), F.when(kept, pct(F.col("bytes"), F.sum(F.when(kept, F.col("bytes"))).over(everything))).alias("kept_share"))


PATTERNS = {"license": "(?i)licen[cs]e", "secret": "(?i)(password|api_?key|token)", "email": "[a-zA-Z0-9._]+@[a-zA-Z0-9.]+", "phone": r"\+?[0-9][0-9 ()-]{7,}[0-9]", "table": r"\|"}


@query("SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}_docs" for n, p in PATTERNS.items()) + " FROM documents")
def pattern_doc_counts(spark, sf):
    return documents(spark, sf).agg(*(F.count_if(F.col("text").rlike(p)).alias(f"{n}_docs") for n, p in PATTERNS.items()))


@query("SELECT source, " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {n}_hits" for n, p in PATTERNS.items()) + " FROM documents GROUP BY source")
def pattern_hit_counts(spark, sf):
    return documents(spark, sf).groupBy("source").agg(*(F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(f"{n}_hits") for n, p in PATTERNS.items()))


@query("""SELECT flags, count(*) AS n FROM (SELECT concat_ws('+', CASE WHEN lang = 'en' THEN 'en' END, CASE WHEN length(text) > 2000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END) AS flags FROM documents) GROUP BY flags""")
def flag_venn(spark, sf):
    flags = F.concat_ws("+", F.when(F.col("lang") == "en", "en"), F.when(F.length("text") > 2000, "long"), F.when(F.contains("text", F.lit("|")), "table"))
    return documents(spark, sf).groupBy(flags.alias("flags")).agg(N().alias("n"))


@query("""SELECT source, metric, value FROM (SELECT source, CAST(count(*) AS DOUBLE) AS rows, CAST(avg(length(text)) AS DOUBLE) AS mean_chars, CAST(max(length(text)) AS DOUBLE) AS max_chars FROM documents GROUP BY source) UNPIVOT (value FOR metric IN (rows, mean_chars, max_chars))""")
def metrics_melt(spark, sf):
    wide = documents(spark, sf).groupBy("source").agg(N().cast("double").alias("rows"), F.avg(F.length("text")).alias("mean_chars"), F.max(F.length("text")).cast("double").alias("max_chars"))
    return wide.unpivot("source", ["rows", "mean_chars", "max_chars"], "metric", "value")


@query("""SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source""")
def metric_pivot(spark, sf):
    return documents(spark, sf).groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(N()).na.fill(0)


@query("""WITH a AS (SELECT DISTINCT lang, regexp_extract(text, '^[^ ]+') AS w FROM documents) SELECT x.lang AS lang_a, y.lang AS lang_b, count(*) AS shared FROM a x JOIN a y ON x.w = y.w GROUP BY 1, 2""")
def set_intersections(spark, sf):
    sets = documents(spark, sf).select("lang", F.regexp_extract("text", "^[^ ]+", 0).alias("w")).groupBy("w").agg(F.collect_set("lang").alias("langs"))
    pairs = sets.select(F.explode("langs").alias("lang_a"), "langs").select("lang_a", F.explode("langs").alias("lang_b"))
    return pairs.groupBy("lang_a", "lang_b").agg(N().alias("shared"))


@query("""SELECT DISTINCT lang, source FROM documents EXCEPT SELECT DISTINCT lang, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0""")
def set_difference(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang", "source")
    bad = docs.join(table(spark, sf, "labels").where("quality = 0"), "doc_id", "left_semi").select("lang", "source")
    return docs.select("lang", "source").distinct().join(bad.distinct(), ["lang", "source"], "left_anti")


@query("""SELECT o_custkey, max(o_totalprice) AS most, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) AS best_order, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""")
def arg_max_per_group(spark, sf):
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), best.alias("best_order"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("""SELECT component, count(*) AS sources, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'web' WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'books' ELSE 'other' END AS component, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY component""")
def component_rollup(spark, sf):
    component = F.when(F.col("source").isin("src0", "src1"), "web").when(F.substring("source", 4, 9).cast("int") < 10, "books").otherwise("other")
    n = documents(spark, sf).groupBy(component.alias("component"), "source").agg(N().alias("n"))
    return n.groupBy("component").agg(N().alias("sources"), F.sum("n").alias("rows"))


@query("""SELECT lang, best FROM (SELECT lang, CASE greatest(a, b, c) WHEN a THEN 'short' WHEN b THEN 'medium' ELSE 'long' END AS best FROM (SELECT lang, count(*) FILTER (length(text) < 500) AS a, count(*) FILTER (length(text) BETWEEN 500 AND 2000) AS b, count(*) FILTER (length(text) > 2000) AS c FROM documents GROUP BY lang))""")
def dominant_component(spark, sf):
    size = F.length("text")
    n = documents(spark, sf).groupBy("lang").agg(F.count_if(size < 500).alias("a"), F.count_if(size.between(500, 2000)).alias("b"), F.count_if(size > 2000).alias("c"))
    top = F.greatest("a", "b", "c")
    return n.select("lang", F.when(top == F.col("a"), "short").when(top == F.col("b"), "medium").otherwise("long").alias("best"))
