"""Queries over row functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import ids, normalize
from loomstone.functions import text as T
from loomstone.operators import filters
from loomstone.plans.session import table
from loomstone.queries import query
from loomstone.queries.tables import CANON, RELAXED, STRICT, canon, documents


@query(rf"""SELECT doc_id, md5({STRICT.format("text")}) AS strict_md5, length({STRICT.format("text")}) AS strict_chars FROM documents""")
def strict_norm_stats(spark, sf):
    return documents(spark, sf).select("doc_id", normalize.exact_hashes("text").alias("f")).select("doc_id", "f.strict_md5", "f.strict_chars")


@query(rf"""SELECT doc_id, md5({RELAXED.format("text")}) AS relaxed_md5, length({RELAXED.format("text")}) AS relaxed_chars FROM documents""")
def relaxed_norm_stats(spark, sf):
    return documents(spark, sf).select("doc_id", normalize.exact_hashes("text").alias("f")).select("doc_id", "f.relaxed_md5", "f.relaxed_chars")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS fast_tokens FROM documents""")
def token_estimate(spark, sf):
    return documents(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.token_estimate_fast(F.col("text")).alias("fast_tokens"))


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def word_tokens_topk(spark, sf):
    words = documents(spark, sf).select(F.explode(T.word_tokens(F.lower("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(r"""SELECT source, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(regexp_replace(text, '\s+', '', 'g'))) AS BIGINT) AS non_ws_chars,
CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM documents GROUP BY source""")
def text_metrics_by_source(spark, sf):
    docs = documents(spark, sf).select("source", *(c.alias(n) for n, c in T.text_metrics(F.col("text")).items()))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(n).alias(n) for n in ("chars", "non_ws_chars", "bytes", "words")))


MARKED = """SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' \\frac{a}{b}' WHEN 1 THEN ' ∑ x' WHEN 2 THEN ' $$y$$' ELSE '' END AS text FROM documents"""


@query(rf"""SELECT doc_id, regexp_matches(text, '{T.LATEX.replace("'", "''")}') AS latex, regexp_matches(text, '{T.LATEX.replace("'", "''")}') OR regexp_matches(text, '{T.MATH}') AS math FROM ({MARKED})""")
def latex_math_flags(spark, sf):
    mark = F.when(F.col("doc_id") % 4 == 0, F.lit(r" \frac{a}{b}")).when(F.col("doc_id") % 4 == 1, " ∑ x").when(F.col("doc_id") % 4 == 2, " $$y$$").otherwise("")
    docs = documents(spark, sf).select("doc_id", F.concat("text", mark).alias("text"))
    return docs.select("doc_id", T.contains_latex(F.col("text")).alias("latex"), T.contains_math(F.col("text")).alias("math"))


@query("""SELECT c_custkey, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) OR coalesce(c_acctbal / 400000.0 >= 0.02, false) OR coalesce(1800 + c_custkey % 200 < 1900 AND c_custkey % 3 = 0, false) AS historical FROM customer""")
def historical_flags(spark, sf):
    year = F.when(F.col("c_custkey") % 3 == 0, (1800 + F.col("c_custkey") % 200).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", T.historical(F.col("c_mktsegment"), ("BUILDING", "MACHINERY"), (F.col("c_acctbal").cast("double") / 400000.0).cast("string"), year).alias("historical"))


@query(f"""WITH {CANON} SELECT doc_id, coalesce(badness, greatest(0.0, 100.0 - try_cast(source_doc_id AS DOUBLE))) AS share, round(coalesce(greatest(0.0, 100.0 - try_cast(source_doc_id AS DOUBLE)), 0.0), 4) AS other FROM canon""")
def share_percentages(spark, sf):
    docs = canon(spark, sf)
    return docs.select("doc_id", T.share_percentage(F.col("badness"), F.col("source_doc_id")).alias("share"), F.round(F.coalesce(T.share_percentage(F.lit(None).cast("string"), F.col("source_doc_id")), F.lit(0.0)), 4).alias("other"))


def preset(spark, sf, name):
    docs = canon(spark, sf)
    good = filters.quality_preset(
        name, badness=F.col("badness"), historical=F.col("lang") == "de", reliable=F.col("source_dataset") != "src0", needs_ocr=F.col("needs_ocr"), ocr_success=F.col("ocr_success"),
        is_empty=F.length("text") == 0, state=F.when(F.col("doc_id") % 7 == 0, "drop"),
    )
    return docs.where(good).select("doc_id", "source_dataset", "badness")


PRESET = f"""WITH {CANON} SELECT doc_id, source_dataset, badness FROM canon WHERE length(text) > 0 AND doc_id % 7 <> 0
AND (NOT coalesce(needs_ocr, false) OR coalesce(ocr_success, false)) AND """


@query(PRESET + "(source_dataset = 'src0' OR badness IS NULL OR badness < 25)")
def quality_preset_strict(spark, sf):
    return preset(spark, sf, "modern_strict")


@query(PRESET + "(source_dataset = 'src0' OR badness IS NULL OR badness < 30)")
def quality_preset_relaxed(spark, sf):
    return preset(spark, sf, "modern_relaxed")


@query(PRESET + "(lang = 'de' OR badness IS NULL OR badness < 35)")
def quality_preset_historical(spark, sf):
    return preset(spark, sf, "historical_tolerant")


SCORED = f"""WITH {CANON}, scored AS (SELECT doc_id, source_dataset, text, needs_ocr, ocr_success,
CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(badness AS VARCHAR) END AS badness_score, CAST((doc_id % 10) / 50.0 AS VARCHAR) AS mojibake_score, chars AS content_chars,
CASE WHEN doc_id % 3 > 0 THEN (doc_id % 100) / 100.0 END AS charset_ratio FROM canon)"""


def scored(spark, sf):
    docs, k = canon(spark, sf), F.col("doc_id")
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, "n/a").otherwise(F.col("badness").cast("string"))
    return docs.select("doc_id", "source_dataset", "needs_ocr", "ocr_success", text.alias("badness_score"), ((k % 10) / 50.0).cast("string").alias("mojibake_score"), F.col("chars").alias("content_chars"), F.when(k % 3 > 0, (k % 100) / 100.0).alias("charset_ratio"))


@query(SCORED + """ SELECT doc_id, source_dataset FROM scored WHERE try_cast(badness_score AS DOUBLE) < 60 AND try_cast(mojibake_score AS DOUBLE) <= 0.1 AND (charset_ratio IS NULL OR charset_ratio >= 0.5)
AND content_chars > 0 AND CASE WHEN source_dataset = 'src3' THEN NOT coalesce(needs_ocr, false) ELSE NOT coalesce(needs_ocr, false) OR coalesce(ocr_success, false) END""")
def standard_training_filter(spark, sf):
    docs = scored(spark, sf)
    return docs.where(filters.standard_training(docs.columns, strict_sources=("src3",))).select("doc_id", "source_dataset")


@query(SCORED + """ SELECT source_dataset, count(*) AS rows FROM scored WHERE (try_cast(badness_score AS DOUBLE) IS NULL OR try_cast(badness_score AS DOUBLE) < 60) AND (try_cast(mojibake_score AS DOUBLE) IS NULL OR try_cast(mojibake_score AS DOUBLE) <= 0.1)
AND (charset_ratio IS NULL OR charset_ratio >= 0.5) AND content_chars > 0 AND (NOT coalesce(needs_ocr, false) OR coalesce(ocr_success, false)) GROUP BY source_dataset""")
def split_export_filter(spark, sf):
    docs = scored(spark, sf)
    return docs.where(filters.standard_training(docs.columns, allow_missing=True)).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {CANON} SELECT doc_id, badness FROM canon WHERE length(trim(text)) > 0 AND badness < 25""")
def publish_filter(spark, sf):
    docs = canon(spark, sf)
    return docs.where(filters.publishable(F.col("text"), F.col("badness"))).select("doc_id", "badness")


@query(f"""WITH {CANON} SELECT CASE WHEN badness > 60 THEN 'bad' WHEN badness >= 10 THEN 'borderline' ELSE 'ok' END AS bucket, count(*) AS rows, CAST(sum(chars) AS BIGINT) AS chars FROM canon GROUP BY 1""")
def badness_buckets(spark, sf):
    return canon(spark, sf).groupBy(filters.badness_bucket(F.col("badness")).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"))


@query(f"""WITH {CANON} SELECT doc_id FROM canon WHERE source_dataset IN ('src1', 'src2', 'src3') AND source_dataset <> 'src2' AND NOT (source_dataset = 'src3' AND coalesce(needs_ocr, false)) AND NOT coalesce(lang = 'de', false)""")
def source_and_flag_filters(spark, sf):
    docs, source = canon(spark, sf), F.col("source_dataset")
    keep = filters.all_of(filters.sources(source, ["src1", "src2", "src3"], ["src2"]), filters.drop_needs_ocr(source, F.col("needs_ocr"), ["src3"]), filters.flag_mode(F.col("lang") == "de", "exclude"))
    return docs.where(keep).select("doc_id")


LOW = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '<!-- x -->' WHEN 3 THEN '![a](b.png)' WHEN 4 THEN '*** --' ELSE text END AS text FROM documents"""


@query(rf"""SELECT why, count(*) AS rows FROM (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN 'empty' WHEN trim(regexp_replace(text, '(?s)<!--.*?-->', '', 'g')) = '' THEN 'comment_only'
WHEN trim(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g')) = '' THEN 'image_only'
WHEN NOT regexp_matches(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '[\p{{L}}\p{{N}}]') THEN 'symbol_only' ELSE 'informative' END AS why FROM ({LOW})) GROUP BY why""")
def low_information_class(spark, sf):
    k = F.col("doc_id") % 8
    text = F.when(k == 0, F.lit(None)).when(k == 1, "  ").when(k == 2, "<!-- x -->").when(k == 3, "![a](b.png)").when(k == 4, "*** --").otherwise(F.col("text"))
    docs = documents(spark, sf).select(text.alias("text"))
    return docs.groupBy(F.coalesce(T.low_information(F.col("text")), F.lit("informative")).alias("why")).agg(F.count(F.lit(1)).alias("rows"))


SHAPE = r"""shape AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g') <> '') AS lines FROM documents),
shaped AS (SELECT doc_id, source, CAST(len(lines) AS BIGINT) AS line_count, CAST(len(list_filter(lines, lambda x: contains(x, '|'))) AS BIGINT) AS table_lines, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^#{1,6}\s'))) AS BIGINT) AS header_lines,
CAST(len(list_filter(lines, lambda x: length(x) < 20)) AS BIGINT) AS short_lines, CAST(length(regexp_replace(text, '[^\p{N}]', '', 'g')) AS BIGINT) AS digit_chars, CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS upper_chars,
CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS word_count FROM shape)"""


@query(f"WITH {SHAPE} SELECT doc_id, line_count, table_lines, header_lines, short_lines, digit_chars, upper_chars, word_count, CASE WHEN line_count > 0 THEN round(CAST(table_lines AS DOUBLE) / line_count, 6) ELSE 0.0 END AS table_share FROM shaped")
def text_shape_metrics(spark, sf):
    return documents(spark, sf).select("doc_id", *(c.alias(n) for n, c in T.text_shape(F.col("text")).items()))


@query(f"WITH {SHAPE} SELECT source, count(*) AS docs, median(word_count) AS median_words, median(line_count) AS median_lines, round(100.0 * avg(CASE WHEN word_count < 50 THEN 1 ELSE 0 END), 4) AS pct_short, round(100.0 * avg(CASE WHEN table_lines > 0 THEN 1 ELSE 0 END), 4) AS pct_tables FROM shaped GROUP BY source")
def text_shape_medians(spark, sf):
    docs = documents(spark, sf).select("source", *(c.alias(n) for n, c in T.text_shape(F.col("text")).items()))
    pct = lambda c: F.round(100.0 * F.avg(F.when(c, 1).otherwise(0)), 4)
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.median("word_count").alias("median_words"), F.median("line_count").alias("median_lines"), pct(F.col("word_count") < 50).alias("pct_short"), pct(F.col("table_lines") > 0).alias("pct_tables"))


@query("""SELECT hint, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, CASE WHEN length(text) < 200 THEN 'tiny' WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 5000 THEN 'medium' ELSE 'long' END AS hint FROM documents) GROUP BY hint""")
def size_hint(spark, sf):
    docs = documents(spark, sf)
    return docs.groupBy(T.size_hint(F.length("text")).alias("hint")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(r"""SELECT url_host, count(*) AS n FROM (SELECT nullif(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), '') AS url_host FROM pages) GROUP BY url_host ORDER BY n DESC, url_host LIMIT 20""")
def url_host_topk(spark, sf):
    return table(spark, sf, "pages").groupBy(T.host(F.col("url")).alias("url_host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "url_host").limit(20)


@query("""SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""")
def html_href_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(T.hrefs(F.col("html"))).alias("href"))


@query(r"""SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS rendered, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_render(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat_ws("", "role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")).alias("t"))
    groups = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.count(F.lit(1)).alias("turns"))  # bounded by one conversation
    return groups.select("conv_id", F.array_join(F.col("ts.line"), "\n").alias("rendered"), "turns")


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x, '#*| -' || chr(9)), '\s+', ' ', 'g'), ' +([,.;:])', '\1', 'g'), ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^\d{4}/\d+$'))[1] AS line FROM documents""")
def first_meaningful_line(spark, sf):
    return documents(spark, sf).select("doc_id", T.first_meaningful_line(F.col("text")).alias("line"))


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)""")
def metadata_first_value(spark, sf):
    values = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.get(F.map_values(values), F.lit(0)).alias("value"))


@query("""SELECT event_type, k AS field, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY event_type, k""")
def metadata_key_counts(spark, sf):
    keys = F.explode(F.json_object_keys("props")).alias("field")
    return table(spark, sf, "events").select("event_type", keys).groupBy("event_type", "field").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, md5(source || ':' || CAST(doc_id AS VARCHAR) || ':' || 'salt-1') AS split_key, md5('chunk::' || source || '::' || CAST(doc_id AS VARCHAR)) AS chunk_key, sha256(coalesce(source, chr(1)) || chr(0) || coalesce(CAST(doc_id AS VARCHAR), chr(1))) AS doc_key FROM documents""")
def stable_keys(spark, sf):
    chunk = F.md5(F.concat_ws("::", F.lit("chunk"), "source", F.col("doc_id").cast("string")))
    return documents(spark, sf).select("doc_id", ids.split_key(F.col("source"), F.col("doc_id"), salt="salt-1").alias("split_key"), chunk.alias("chunk_key"), ids.doc_key(F.col("source"), F.col("doc_id")).alias("doc_key"))


@query(r"""SELECT doc_id, trim(substr(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 80), '') AS excerpt FROM documents""")
def excerpts(spark, sf):
    return documents(spark, sf).select("doc_id", T.excerpt(F.col("text"), 80).alias("excerpt"))


@query("""SELECT p_partkey, nullif(trim(p_name), '') AS title, CASE WHEN lower(p_brand) IN ('na', 'n/a', 'none', 'null', 'nan', '-', '_') THEN NULL ELSE p_brand END AS brand, regexp_replace(regexp_replace(p_type, '\\s+', ' ', 'g'), ' +([,.;:])', '\\1', 'g') AS kind FROM part""".replace("\\\\", "\\"))
def cleaned_scalars(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.blank_to_null(F.col("p_name")).alias("title"), T.placeholder_url(F.col("p_brand")).alias("brand"), T.normalize_whitespace(F.col("p_type")).alias("kind"))


@query("""SELECT doc_id, 'part_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS surrogate_id, source || '::' || lang || '::' || CAST(doc_id AS VARCHAR) AS positional_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS position, CAST(string_split(source || '_' || CAST(doc_id AS VARCHAR), '_')[2] AS BIGINT) AS bin FROM documents""")
def derived_ids(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.format_string("part_%06d", "doc_id").alias("surrogate_id"), F.concat_ws("::", "source", "lang", F.col("doc_id").cast("string")).alias("positional_id"),
        F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("position"), F.split(F.concat_ws("_", "source", F.col("doc_id").cast("string")), "_")[1].cast("long").alias("bin"),
    )


@query(r"""SELECT doc_id, regexp_matches(text, '[\x{00C0}-\x{024F}]') AS latin_extended, regexp_matches(text, '[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]') AS greek, regexp_matches(text, '[\x{0400}-\x{04FF}]') AS cyrillic, regexp_matches(text, '^[\x{0000}-\x{007F}]*$') AS ascii,
regexp_matches(text, '\p{Lu}{4,}') AS shouting FROM documents""")
def script_flags(spark, sf):
    flags = {"latin_extended": r"[\x{00C0}-\x{024F}]", "greek": r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]", "cyrillic": r"[\x{0400}-\x{04FF}]", "ascii": r"^[\x{0000}-\x{007F}]*\z", "shouting": r"\p{Lu}{4,}"}
    return documents(spark, sf).select("doc_id", *(F.col("text").rlike(p).alias(n) for n, p in flags.items()))
