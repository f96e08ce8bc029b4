"""Queries over token histograms, vocabularies, lines and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import normalize
from loomstone.functions import text as T
from loomstone.operators import bpe_continuation as B
from loomstone.plans.session import table
from loomstone.queries import query
from loomstone.queries.tables import documents

WORDS = r"w AS (SELECT source, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents)"


def words(spark, sf, *keep):
    return documents(spark, sf).select(*keep, F.explode(T.word_tokens(F.lower("text"))).alias("word"))


def n():
    return F.count(F.lit(1)).alias("n")


@query(f"WITH {WORDS} SELECT source, length(word) AS size, count(*) AS n FROM w GROUP BY source, length(word)")
def source_token_histogram(spark, sf):
    return words(spark, sf, "source").groupBy("source", F.length("word").cast("long").alias("size")).agg(n())


@query(r"""SELECT source, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'))) AS BIGINT) AS tokens FROM documents GROUP BY source""")
def source_denominators(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count(F.lower("text"), F.lit(T.WORD))).cast("long").alias("tokens"))


@query(f"WITH {WORDS}, c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY lang, word) SELECT lang, CAST(sum(n) AS BIGINT) AS total, count(*) AS fired, count(*) FILTER (n >= 10) AS fired_10, count(*) FILTER (n >= 100) AS fired_100 FROM c GROUP BY lang")
def language_fired_thresholds(spark, sf):
    c = words(spark, sf, "lang").groupBy("lang", "word").agg(n())
    return c.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("fired"), F.count_if(F.col("n") >= 10).alias("fired_10"), F.count_if(F.col("n") >= 100).alias("fired_100"))


@query(f"WITH {WORDS}, c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY lang, word) SELECT word, CAST(sum(n) AS BIGINT) AS total, count(*) AS langs, count(*) FILTER (n >= 10) AS langs_10 FROM c GROUP BY word HAVING count(*) > 1")
def token_language_counts(spark, sf):
    c = words(spark, sf, "lang").groupBy("lang", "word").agg(n())
    return c.groupBy("word").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("langs"), F.count_if(F.col("n") >= 10).alias("langs_10")).where("langs > 1")


SEGMENTS = r"s AS (SELECT segment, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+')) AS segment FROM documents) GROUP BY segment)"
PAIRS = SEGMENTS + ", i AS (SELECT segment, n, unnest(range(1, length(segment))) AS k FROM s WHERE length(segment) > 1), p AS (SELECT substr(segment, k, 1) AS l, substr(segment, k + 1, 1) AS r, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY 1, 2)"


@query(f"WITH {SEGMENTS} SELECT segment, n FROM s WHERE n >= 20")
def segment_counts(spark, sf):
    return B.segment_counts(documents(spark, sf)).where("n >= 20")


@query(f'WITH {PAIRS} SELECT l AS "left", r AS "right", n FROM p')
def adjacent_pair_stats(spark, sf):
    return B.pair_counts(B.segment_counts(documents(spark, sf)))


@query(f'WITH {PAIRS} SELECT l AS "left", r AS "right", n FROM p ORDER BY n DESC, l, r LIMIT 1')
def bpe_best_pair(spark, sf):
    return B.pair_counts(B.segment_counts(documents(spark, sf))).orderBy(F.desc("n"), "left", "right").limit(1)


VOCAB = f"{WORDS}, v AS (SELECT word, count(*) AS n FROM w GROUP BY word), ranked AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS id FROM (SELECT * FROM v ORDER BY n DESC, word LIMIT 2000))"


def vocabulary(spark, sf):
    top = words(spark, sf).groupBy("word").agg(n()).orderBy(F.desc("n"), "word").limit(2000)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long"))  # 2000 rows


CUTS = (250, 500, 1000, 2000)


@query(f"WITH {VOCAB}, c AS (SELECT unnest([250, 500, 1000, 2000]) AS cutoff) SELECT cutoff, CASE WHEN length(word) <= 2 THEN 'short' WHEN length(word) <= 6 THEN 'medium' ELSE 'long' END AS kind, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS mass FROM c JOIN ranked ON id <= cutoff GROUP BY 1, 2")
def cutoff_distribution(spark, sf):
    cuts = F.explode(F.array(*map(F.lit, CUTS))).alias("cutoff")
    kind = F.when(F.length("word") <= 2, "short").when(F.length("word") <= 6, "medium").otherwise("long")
    return vocabulary(spark, sf).select("*", cuts).where("id <= cutoff").groupBy("cutoff", kind.alias("kind")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("mass"))


@query(f"WITH {VOCAB}, c AS (SELECT unnest([250, 500, 1000, 2000]) AS cutoff), m AS (SELECT cutoff, CAST(sum(n) AS BIGINT) AS mass FROM c JOIN ranked ON id <= cutoff GROUP BY cutoff) SELECT cutoff, mass, mass - lag(mass, 1, 0) OVER (ORDER BY cutoff) AS gain FROM m")
def marginal_gain(spark, sf):
    cuts = F.explode(F.array(*map(F.lit, CUTS))).alias("cutoff")
    m = vocabulary(spark, sf).select("n", "id", cuts).where("id <= cutoff").groupBy("cutoff").agg(F.sum("n").alias("mass"))
    return m.withColumn("gain", F.col("mass") - F.lag("mass", 1, 0).over(Window.orderBy("cutoff")))


PMI = f"{WORDS}, c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY lang, word), l AS (SELECT lang, sum(n) AS lang_n FROM c GROUP BY lang), t AS (SELECT word, sum(n) AS word_n FROM c GROUP BY word), q AS (SELECT c.lang AS lang, c.word AS word, n, log10((n + 0.5) * (SELECT sum(n) FROM c) / (CAST(lang_n AS DOUBLE) * (word_n + 0.5))) AS pmi FROM c JOIN l ON c.lang = l.lang JOIN t ON c.word = t.word)"


def pmi(spark, sf):
    c = words(spark, sf, "lang").groupBy("lang", "word").agg(n())
    langs = c.groupBy("lang").agg(F.sum("n").alias("lang_n")).withColumn("all_n", F.sum("lang_n").over(Window.partitionBy()))  # one row for each language
    totals = c.groupBy("word").agg(F.sum("n").alias("word_n"))
    score = F.log10((F.col("n") + 0.5) * F.col("all_n") / (F.col("lang_n").cast("double") * (F.col("word_n") + 0.5)))
    return c.join(langs, "lang").join(totals, "word").select("lang", "word", "n", score.alias("pmi"))


@query(f"WITH {PMI} SELECT lang, word, n, round(pmi, 6) AS pmi FROM q WHERE n >= 10 AND pmi >= 0.3")
def pmi_promotion(spark, sf):
    return pmi(spark, sf).where("n >= 10 and pmi >= 0.3").withColumn("pmi", F.round("pmi", 6))


@query(f"WITH {PMI}, s AS (SELECT lang, word FROM q WHERE n >= 5 AND pmi >= 0.05) SELECT a.lang AS lang_a, b.lang AS lang_b, count(*) AS shared FROM s a JOIN s b ON a.word = b.word GROUP BY 1, 2")
def pmi_overlap_matrix(spark, sf):
    langs = pmi(spark, sf).where("n >= 5 and pmi >= 0.05").groupBy("word").agg(F.collect_set("lang").alias("langs"))  # bounded by the languages
    pairs = langs.select(F.explode("langs").alias("lang_a"), "langs").select("lang_a", F.explode("langs").alias("lang_b"))
    return pairs.groupBy("lang_a", "lang_b").agg(F.count(F.lit(1)).alias("shared"))


@query("""SELECT item_id, bit_or(CAST(1 AS BIGINT) << CAST(ascii(c) % 31 AS INTEGER)) AS any_mask, bit_and(CAST(2147483647 AS BIGINT) - (CAST(1 AS BIGINT) << CAST(ascii(c) % 31 AS INTEGER))) AS all_mask FROM (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '' GROUP BY item_id""")
def codepoint_mask_and(spark, sf):
    chars = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    bit = F.expr("shiftleft(1L, cast(ascii(c) % 31 as int))")
    return chars.groupBy("item_id").agg(F.bit_or(bit).alias("any_mask"), F.bit_and(F.lit(2147483647).cast("long") - bit).alias("all_mask"))


LINES = "li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


def lines(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


RESIDUE = r"[#$%&*]{3}|!!|\|"


@query(f"WITH {LINES}, m AS (SELECT doc_id, line_no, len(regexp_extract_all(line, '{RESIDUE}')) AS matches, length(line) AS size, length(line) - length(regexp_replace(line, '{RESIDUE}', '', 'g')) AS covered FROM li) SELECT CAST(line_no AS BIGINT) AS line_no, doc_id, CAST(matches AS BIGINT) AS matches, round(1.0 * covered / size, 6) AS coverage FROM m WHERE matches > 0")
def residue_lines(spark, sf):
    return residues(lines(spark, sf)).select(F.col("line_no").cast("long").alias("line_no"), "doc_id", "matches", "coverage")


def residues(rows):
    covered = F.length("line") - F.length(F.regexp_replace("line", RESIDUE, ""))
    return rows.select("doc_id", "line_no", F.regexp_count("line", F.lit(RESIDUE)).cast("long").alias("matches"), F.round(covered / F.length("line"), 6).alias("coverage")).where("matches > 0")


@query(f"WITH {LINES}, m AS (SELECT len(regexp_extract_all(line, '{RESIDUE}')) AS matches, 1.0 * (length(line) - length(regexp_replace(line, '{RESIDUE}', '', 'g'))) / length(line) AS coverage FROM li WHERE regexp_matches(line, '{RESIDUE}')) SELECT CASE WHEN matches = 1 THEN '1' WHEN matches <= 5 THEN '2-5' WHEN matches <= 20 THEN '6-20' ELSE '21+' END AS count_bin, CASE WHEN round(coverage, 6) < 0.05 THEN 'low' WHEN round(coverage, 6) < 0.25 THEN 'mid' ELSE 'high' END AS coverage_bin, count(*) AS n FROM m GROUP BY 1, 2")
def residue_bins(spark, sf):
    m = residues(lines(spark, sf))
    count_bin = F.when(F.col("matches") == 1, "1").when(F.col("matches") <= 5, "2-5").when(F.col("matches") <= 20, "6-20").otherwise("21+")
    coverage_bin = F.when(F.col("coverage") < 0.05, "low").when(F.col("coverage") < 0.25, "mid").otherwise("high")
    return m.groupBy(count_bin.alias("count_bin"), coverage_bin.alias("coverage_bin")).agg(n())


@query(f"WITH {LINES}, m AS (SELECT doc_id, len(regexp_extract_all(line, '{RESIDUE}')) AS matches FROM li) SELECT doc_id, CAST(max(matches) AS BIGINT) AS most, CAST(sum(matches) AS BIGINT) AS total, count(*) FILTER (matches > 0) AS lines FROM m GROUP BY doc_id HAVING sum(matches) > 0")
def residue_documents(spark, sf):
    return residues(lines(spark, sf)).groupBy("doc_id").agg(F.max("matches").alias("most"), F.sum("matches").alias("total"), F.count(F.lit(1)).alias("lines"))


@query(rf"""WITH f AS (SELECT doc_id, replace(text, '. ', chr(10) || CASE WHEN doc_id % 2 = 0 THEN '```' || chr(10) ELSE '' END) AS text FROM documents), li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM f),
c AS (SELECT *, coalesce(sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences FROM li)
SELECT context, count(*) AS n FROM (SELECT CASE WHEN starts_with(trim(line), '```') THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN contains(line, '|') THEN 'table' WHEN regexp_matches(trim(line), '^#{{1,6}}\s') THEN 'header' WHEN regexp_matches(trim(line), '^[-*+]\s') THEN 'list' WHEN regexp_matches(trim(line), '^\d+[.)]\s') THEN 'numbered' ELSE 'prose' END AS context FROM c) GROUP BY context""")
def line_context(spark, sf):
    cut = F.when(F.col("doc_id") % 2 == 0, "\n```\n").otherwise("\n")
    rows = documents(spark, sf).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), cut), "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fences = F.coalesce(F.sum(F.trim("line").startswith("```").cast("int")).over(before), F.lit(0))
    return rows.withColumn("fences", fences).groupBy(T.line_context(F.col("line"), F.col("fences")).alias("context")).agg(n())


@query("WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents), b AS (SELECT doc_id, k, replace(line, 'the', 'THE') AS after FROM a WHERE k % 5 <> 0) SELECT a.doc_id, count(*) AS lines, count(*) FILTER (b.after IS NULL) AS lost, count(*) FILTER (b.after <> a.line) AS changed FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.k = b.k GROUP BY a.doc_id")
def line_comparison(spark, sf):
    a = lines(spark, sf)
    b = a.where("line_no % 5 <> 0").select("doc_id", "line_no", F.replace("line", F.lit("the"), F.lit("THE")).alias("after"))
    return a.join(b, ["doc_id", "line_no"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("after").isNull()).alias("lost"), F.count_if(F.col("after") != F.col("line")).alias("changed"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, round(CAST(length(text) AS DOUBLE) / len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 6) AS chars_per_token, round(CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS DOUBLE) / strlen(text), 6) AS tokens_per_byte FROM documents""")
def fertility(spark, sf):
    tokens = T.token_estimate(F.col("text"))
    return documents(spark, sf).select("doc_id", F.regexp_count("text", F.lit(T.spelled(r"\S+"))).cast("long").alias("words"), F.round(F.length("text") / tokens, 6).alias("chars_per_token"), F.round(tokens / F.octet_length("text"), 6).alias("tokens_per_byte"))


@query()
def markdown_chunks(spark, sf):
    """Chunks in order; tests hold that they have all text and keep to the bound."""
    rows = documents(spark, sf).select("doc_id", F.posexplode(normalize.markdown_chunks("text")).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", F.length("text").alias("chars"), F.md5("text").alias("chunk_md5"))


@query()
def bpe_merge_steps(spark, sf):
    """The first merges from single characters, of pairs that occur at least ten times; all distinct segments feed the loop."""
    merges = B.merge_steps_at_scale(B.segment_counts(documents(spark, sf)), 100, 10)
    return spark.createDataFrame(merges, "left string, right string, id int, n long")
