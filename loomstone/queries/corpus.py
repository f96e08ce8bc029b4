"""Queries over record fields, corpus filters, joins of metadata, bundles and ledgers of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import bundle, filters
from loomstone.operators import dedup as D
from loomstone.operators import selection as S
from loomstone.plans.session import shared_path, table
from loomstone.queries import query
from loomstone.queries.dedup import FAMILY, final
from loomstone.queries.rules import PARENTS
from loomstone.queries.selection import GROUPED, TOKENS, grouped_splits
from loomstone.queries.tables import CANON, canon, documents
from loomstone.streaming.incremental import snapshot_drift


def one_space(x: str) -> str:
    """SQL of a text with white space made one and none before marks; a blank is null."""
    return rf"nullif(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g'), ' '), ' +([,.;:])', '\1', 'g'), '')"


CODED = "SELECT doc_id, CASE WHEN length(text) > 600 THEN 'P' || CAST(length(text) % 9 AS VARCHAR) || '_TA(' || CAST(2000 + length(text) % 20 AS VARCHAR) || ')' || lpad(CAST(length(text) % 10000 AS VARCHAR), 4, '0') || chr(10) ELSE '' END || text AS text FROM documents"


def coded(spark, sf):
    n = F.length("text")
    code = F.concat(F.lit("P"), (n % 9).cast("string"), F.lit("_TA("), (2000 + n % 20).cast("string"), F.lit(")"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("\n"))
    return documents(spark, sf).select("doc_id", F.concat(F.when(n > 600, code).otherwise(""), "text").alias("text"))


CODE = r"CASE WHEN regexp_matches(substr(text, 1, 2500), 'P(\d+)_TA\((\d{4})\)(\d{4})') THEN 'TA-' || regexp_extract(substr(text, 1, 2500), 'P(\d+)_TA\((\d{4})\)(\d{4})', 1) || '-' || regexp_extract(substr(text, 1, 2500), 'P(\d+)_TA\((\d{4})\)(\d{4})', 2) || '-' || regexp_extract(substr(text, 1, 2500), 'P(\d+)_TA\((\d{4})\)(\d{4})', 3) END"
HEAD = "list_filter(list_transform(string_split(text, chr(10))[1:{n}], lambda x: " + one_space("x") + "), lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, {CODE} AS code FROM ({CODED})")
def adopted_text_codes(spark, sf):
    return coded(spark, sf).select("doc_id", T.adopted_text_code(F.col("text")).alias("code"))


@query(rf"SELECT doc_id, list_filter({HEAD.format(n=30)}, lambda x: NOT regexp_matches(x, '^P\d+_TA\(\d{{4}}\)\d{{4}}$') AND NOT regexp_matches(x, '^PE.*\d') AND length(x) >= 16)[1] AS title FROM ({CODED})")
def adopted_text_titles(spark, sf):
    return coded(spark, sf).select("doc_id", T.adopted_text_title(F.col("text")).alias("title"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter({HEAD.format(n=20)}, lambda x: NOT starts_with(x, '|') AND x <> '---')[1:4] AS ls FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '\p{{Ll}}'))) > 0 THEN list_filter(ls, lambda x: regexp_matches(x, '\p{{Ll}}'))[1] WHEN len(ls) >= 3 THEN array_to_string(ls[3:4], ' ') ELSE ls[1] END AS title FROM l""")
def act_titles(spark, sf):
    return documents(spark, sf).select("doc_id", T.act_title(F.col("text")).alias("title"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN c_mktsegment ELSE c_name END AS title, CASE WHEN c_nationkey > 5 THEN c_name || '; ' || c_mktsegment ELSE c_name END AS author FROM customer""")
def record_fields(spark, sf):
    """Titles and authors of JSON records: a citation list, a title, one author or a list of them."""
    c = table(spark, sf, "customer")
    quoted = lambda x: F.concat(F.lit('"  '), x, F.lit('  "'))
    cite = F.when(F.col("c_nationkey") > 12, F.concat(F.lit('"cite": ["1", '), quoted(F.col("c_mktsegment")), F.lit("], "))).otherwise("")
    author = F.when(F.col("c_nationkey") > 5, F.concat(F.lit("["), quoted(F.col("c_name")), F.lit(', " ", '), quoted(F.col("c_mktsegment")), F.lit("]"))).otherwise(quoted(F.col("c_name")))
    record = F.concat(F.lit("{"), cite, F.lit('"title": '), quoted(F.col("c_name")), F.lit(', "authors": '), author, F.lit("}"))
    return c.select("c_custkey", T.record_title(record, "cite", "title").alias("title"), T.record_author(record, "authors").alias("author"))


@query(f"SELECT p_partkey, lower({one_space('p_name')}) AS token FROM part")
def dedup_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.dedup_token(F.col("p_name")).alias("token"))


@query("""SELECT doc_id, array_to_string(list_filter([lang, NULL, '', source], lambda x: x IS NOT NULL AND x <> ''), '|') AS langs FROM documents""")
def html_langs(spark, sf):
    values = F.array("lang", F.lit(None).cast("string"), F.lit(""), "source")
    return documents(spark, sf).select("doc_id", T.html_lang(values).alias("langs"))


@query("""SELECT o_orderkey, TRY_CAST(split_part(CASE WHEN o_totalprice > 100000 THEN CAST(o_orderkey % 13 AS VARCHAR) || '_' || CAST(o_custkey AS VARCHAR) ELSE 'part_' || CAST(o_custkey AS VARCHAR) END, '_', 1) AS INTEGER) AS quality FROM orders""")
def quality_bins(spark, sf):
    name = F.when(F.col("o_totalprice") > 100000, F.concat_ws("_", (F.col("o_orderkey") % 13).cast("string"), F.col("o_custkey").cast("string"))).otherwise(F.concat_ws("_", F.lit("part"), F.col("o_custkey").cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", T.quality_bin(name).alias("quality"))


@query("""SELECT s_suppkey, s_name AS md_path, CAST(s_nationkey AS DOUBLE) AS greek_badness_score, 1.5 :: DOUBLE AS latin_percentage, NULL :: DOUBLE AS table_ratio, 0.25 :: DOUBLE AS polytonic_ratio, CAST(s_suppkey AS BIGINT) AS len_greek FROM supplier""")
def noise_rows(spark, sf):
    row = F.array("s_name", F.col("s_nationkey").cast("string"), F.lit("1.5"), F.lit("x"), F.lit("0.25"), F.col("s_suppkey").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", *(c.alias(n) for n, c in T.noise_row(row).items()))


CLEANED = r"SELECT doc_id, text AS a, regexp_replace(text, '[\p{N}|#]', '', 'g') AS b FROM documents"
KINDS = {"lines": r"[^\n]+", "digits": r"\p{N}", "marks": r"\p{P}", "spaces": r"\s", "upper": r"\p{Lu}", "words": r"\S+", "tables": r"(?m)^[^\n]*\|"}


@query("SELECT doc_id, CAST(length(a) AS BIGINT) AS chars_before, CAST(length(b) AS BIGINT) AS chars_after, CAST(length(a) - length(b) AS BIGINT) AS chars_removed, CASE WHEN length(a) > 0 THEN round(CAST(length(a) - length(b) AS DOUBLE) / length(a), 6) ELSE 0.0 END AS removed_share, "
       + ", ".join(f"CAST(len(regexp_extract_all({c}, '{p}')) AS BIGINT) AS {k}_{w}" for k, p in KINDS.items() for c, w in (("a", "before"), ("b", "after"))) + f" FROM ({CLEANED})")
def cleaner_statistics(spark, sf):
    after = F.regexp_replace("text", r"[\p{N}|#]", "")
    return documents(spark, sf).select("doc_id", *(c.alias(n) for n, c in T.cleaner_statistics(F.col("text"), after).items()))


@query(f"WITH {CANON} SELECT doc_id FROM canon WHERE badness < 12 AND source_dataset NOT IN ('src1', 'src4') AND (coalesce(needs_ocr, false) = false OR coalesce(ocr_success, false) = true)")
def experiment_filter(spark, sf):
    c = F.col
    return canon(spark, sf).where(filters.experiment(c("source_dataset"), ["src1", "src4"], c("badness"), None, c("needs_ocr"), c("ocr_success"), 12.0)).select("doc_id")


@query(f"WITH {CANON} SELECT doc_id FROM canon WHERE chars % 12 >= 8 AND coalesce(lang, '') <> 'fr' AND ocr_success AND (badness IS NULL OR badness <= 14)")
def web_crawl_filter(spark, sf):
    c = F.col
    verdict = F.when(c("ocr_success"), "keep").otherwise("drop")
    return canon(spark, sf).where(filters.web_crawl(c("chars") % 12, c("lang"), verdict, c("text"), c("badness"), 8, "fr", "keep", 14.0)).select("doc_id")


@query(f"WITH d AS (SELECT doc_id, {CODE} AS code FROM ({CODED})), m AS (SELECT 'TA-' || CAST(p_size % 9 AS VARCHAR) || '-' || CAST(2000 + p_size % 20 AS VARCHAR) || '-' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') AS code, arg_min(p_name, p_partkey) AS title FROM part GROUP BY 1) SELECT d.doc_id, d.code AS code, m.title AS title FROM d LEFT JOIN m ON d.code = m.code")
def metadata_by_code(spark, sf):
    """Documents with the metadata of the code in their text; of metadata that repeat a code the first counts."""
    p = table(spark, sf, "part")
    code = F.concat(F.lit("TA-"), (F.col("p_size") % 9).cast("string"), F.lit("-"), (2000 + F.col("p_size") % 20).cast("string"), F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 4, "0"))
    meta = p.groupBy(code.alias("code")).agg(F.min_by("p_name", "p_partkey").alias("title"))
    return adopted_text_codes(spark, sf).join(meta, "code", "left").select("doc_id", "code", "title")


@query("""SELECT d.doc_id, c.c_name AS title FROM documents d LEFT JOIN customer c ON c.c_custkey - 1 = d.doc_id""")
def metadata_by_position(spark, sf):
    """Documents with the metadata of the row that the number at the end of their id names."""
    docs = documents(spark, sf).select("doc_id", F.regexp_extract(F.concat(F.lit("act_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), r"(\d+)$", 1).cast("long").alias("position"))
    meta = table(spark, sf, "customer").select((F.col("c_custkey") - 1).cast("long").alias("position"), F.col("c_name").alias("title"))
    return docs.join(meta, "position", "left").select("doc_id", "title")


@query(f"WITH {FAMILY} SELECT doc_id, family_id, family_size FROM m WHERE family_size > 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def reduced_bundle(spark, sf):
    """Family rows of the documents that a drop list leaves."""
    kept = documents(spark, sf).select("doc_id").join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    return D.families(final(spark, sf), "final_keeper").where("family_size > 1").join(kept, "doc_id", "left_semi").select("doc_id", "family_id", "family_size")


@query("""WITH h AS (SELECT md5(text) AS h, max(length(text)) AS n, count(*) AS c FROM documents GROUP BY 1) SELECT doc_id, source FROM documents WHERE md5(text) IN (SELECT h FROM h WHERE c > 1) AND md5(text) NOT IN (SELECT h FROM h WHERE n < 300)""")
def informative_copies(spark, sf):
    """Members of groups of equal texts, but for the groups whose text says little."""
    docs = documents(spark, sf).select("doc_id", "source", F.md5("text").alias("h"), F.length("text").alias("n"))
    groups = docs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    return docs.join(groups.where("c > 1").select("h"), "h", "left_semi").join(groups.where("n < 300").select("h"), "h", "left_anti").select("doc_id", "source")


@query("""SELECT coalesce(r.r_name, 'none') AS collection, count(*) AS rows FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1""")
def collection_map(spark, sf):
    """Rows with the collection that their JSON metadata names."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("place"), F.col("r_name").alias("collection"))
    metadata = F.concat(F.lit('{"place": {"id": "'), F.col("s_nationkey").cast("string"), F.lit('"}}'))
    rows = table(spark, sf, "supplier").select(F.get_json_object(metadata, "$.place.id").alias("place"))
    return rows.join(nations, "place", "left").groupBy(F.coalesce("collection", F.lit("none")).alias("collection")).agg(F.count(F.lit(1)).alias("rows"))


@query(GROUPED + " SELECT d.doc_id, a.split AS split, length(d.text) AS chars FROM documents d JOIN a ON a.source_dataset = d.source AND a.doc_id = d.doc_id WHERE a.split <> 'train'")
def assigned_split_rows(spark, sf):
    """Texts of the rows that a split was assigned to, by source and id."""
    assigned = grouped_splits(spark, sf).where("split <> 'train'").select(F.col("source_dataset").alias("source"), "doc_id", "split")
    return documents(spark, sf).join(assigned, ["source", "doc_id"]).select("doc_id", "split", F.length("text").cast("long").alias("chars"))


@query(f"WITH {FAMILY} SELECT d.doc_id, d.lang AS lang, m.family_id AS dedup_family_id, m.family_size AS dedup_family_size, m.chars AS dedup_chars FROM documents d LEFT JOIN (SELECT * FROM m WHERE family_size > 1) m ON m.source_dataset = d.source AND m.doc_id = d.doc_id")
def bundle_enrichment(spark, sf):
    """The bundle of a dedup run is written with its manifest, read back and joined to the documents under names of its own."""
    families = D.families(final(spark, sf), "final_keeper").where("family_size > 1").select("doc_key", F.col("source_dataset").alias("source"), "doc_id", "family_id", "family_size", "chars")
    path = shared_path(spark, "bundle")
    bundle.export(path, {"documents": families}, {"candidate_score_floor": 0.85})
    _, tables = bundle.load(spark, path)
    return bundle.enriched(documents(spark, sf).select("doc_id", "source", "lang"), tables["documents"], ["source", "doc_id"]).select("doc_id", "lang", "dedup_family_id", "dedup_family_size", "dedup_chars")


@query("""WITH f AS (SELECT doc_id, md5(text) AS a, md5(lower(text)) AS b FROM documents) SELECT DISTINCT doc_id FROM f WHERE a IN (SELECT a FROM f GROUP BY a HAVING count(*) > 1) OR b IN (SELECT b FROM f GROUP BY b HAVING count(*) > 1)""")
def touched_documents(spark, sf):
    f = documents(spark, sf).select("doc_id", F.md5("text").alias("a"), F.md5(F.lower("text")).alias("b"))
    parts = [f.join(f.groupBy(h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(h), h, "left_semi").select("doc_id") for h in ("a", "b")]
    return parts[0].unionByName(parts[1]).distinct()


@query(f"WITH {TOKENS} SELECT t.lang AS lang, CAST(sum(tokens) + 2 * count(*) AS BIGINT) AS tokens, CAST(sum(strlen(d.text)) AS BIGINT) AS bytes, count(*) AS docs FROM t JOIN documents d ON d.doc_id = t.doc_id GROUP BY 1")
def encoded_totals(spark, sf):
    """Tokens with a mark at the beginning and at the end of each document, bytes and documents."""
    docs = documents(spark, sf).select("lang", T.token_estimate(F.col("text")).alias("t"), F.octet_length("text").alias("b"))
    return docs.groupBy("lang").agg((F.sum("t") + 2 * F.count(F.lit(1))).alias("tokens"), F.sum("b").cast("long").alias("bytes"), F.count(F.lit(1)).alias("docs"))


@query("""SELECT source, count(DISTINCT entry) AS entries FROM (SELECT source, 'first' AS entry FROM documents WHERE source IN ('src0', 'src1', 'src2') UNION ALL SELECT source, 'second' FROM documents WHERE source NOT IN ('src0', 'src3') UNION ALL SELECT source, 'third' FROM documents WHERE lang = 'en') GROUP BY source HAVING count(DISTINCT entry) > 1""")
def overlapping_entries(spark, sf):
    """Sources that more than one entry of a mix would take."""
    docs = documents(spark, sf).select("source", "lang")
    first, second, third = docs.where(F.col("source").isin("src0", "src1", "src2")), docs.where(~F.col("source").isin("src0", "src3")), docs.where("lang = 'en'")
    members = [part.select("source", F.lit(name).alias("entry")) for name, part in (("first", first), ("second", second), ("third", third))]
    return members[0].unionByName(members[1]).unionByName(members[2]).groupBy("source").agg(F.count_distinct("entry").alias("entries")).where("entries > 1")


@query("""SELECT doc_id, row_number() OVER () - 1 AS arrival FROM documents""")
def arrival_numbers(spark, sf):
    """The place of each row in the table, the same in every run: files in the order of their paths, rows as they lie in them."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "file").select("doc_id", (F.col("at") + F.col("offset")).alias("arrival"))


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS rn FROM documents) WHERE rn <= 25""")
def quota_fill(spark, sf):
    """Each language's quota from the shards (here: sources) in their order; what comes after a full quota is not looked at."""
    return S.top_per_group(documents(spark, sf).select("doc_id", "source", "lang"), ["lang"], ["source", "doc_id"], 25)


@query("""WITH b AS (SELECT doc_id, md5(text) AS h, length(text) AS n FROM documents), a AS (SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN md5(text || 'x') ELSE md5(text) END AS h FROM documents WHERE length(text) % 11 > 0)
SELECT state, count(*) AS rows FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id) GROUP BY state""")
def run_drift(spark, sf):
    """What changed between the snapshot that a run was registered with and the input now."""
    docs = documents(spark, sf).select("doc_id", "text")
    size = F.length("text")
    before = docs.where(size % 11 > 0).select("doc_id", F.when(size % 5 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("fingerprint"))
    return snapshot_drift(before, docs.select("doc_id", F.md5("text").alias("fingerprint")), "doc_id").groupBy("state").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 1) AS prefix, count(*) AS rows, count(DISTINCT l_orderkey) AS keys FROM lineitem GROUP BY 1""")
def hash_prefix_parts(spark, sf):
    """Rows in sixteen folders by the first digit of a hash, written and read back."""
    from loomstone.sources import writers

    path = shared_path(spark, "hash-prefix")
    writers.by_hash_prefix(table(spark, sf, "lineitem").select("l_orderkey"), path, "l_orderkey")
    return spark.read.parquet(path).groupBy(F.col("prefix").cast("string").alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("l_orderkey").alias("keys"))


@query(f"WITH {CANON} SELECT doc_id, coalesce(CASE WHEN needs_ocr THEN NULL ELSE badness + 1 END, badness) AS badness, CASE WHEN coalesce(needs_ocr, false) THEN 'filled' ELSE 'given' END AS origin FROM canon")
def missing_quality(spark, sf):
    """Only scores that are missing are computed and filled in; those that are there stay."""
    given = F.when(F.col("needs_ocr"), F.lit(None).cast("double")).otherwise(F.col("badness") + 1)
    docs = canon(spark, sf).select("doc_id", "text", given.alias("badness"), F.coalesce("needs_ocr", F.lit(False)).alias("missing"))
    return docs.select("doc_id", F.coalesce("badness", T.badness(F.col("text"))).alias("badness"), F.when(F.col("missing"), "filled").otherwise("given").alias("origin"))


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents), p AS (SELECT lang, word FROM w GROUP BY lang, word HAVING count(*) >= 10) SELECT lang, count(*) AS promoted FROM p GROUP BY lang HAVING count(*) >= 5 ORDER BY promoted DESC, lang LIMIT 3""")
def language_selection(spark, sf):
    """The languages with the most promoted words, of those with enough of them."""
    words = documents(spark, sf).select("lang", F.explode(T.word_tokens(F.lower("text"))).alias("word"))
    promoted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return promoted.groupBy("lang").agg(F.count(F.lit(1)).alias("promoted")).where("promoted >= 5").orderBy(F.desc("promoted"), "lang").limit(3)


@query("""SELECT d.doc_id, md5(coalesce(CASE WHEN length(d.text) % 3 = 0 THEN NULL ELSE d.text END, s.text, '')) AS text_md5 FROM documents d LEFT JOIN documents s ON s.doc_id = d.doc_id""")
def repaired_texts(spark, sf):
    """Files whose text was lost take it from the source with the same id."""
    docs = documents(spark, sf).select("doc_id", "text")
    broken = docs.select("doc_id", F.when(F.length("text") % 3 != 0, F.col("text")).alias("mine"))
    return broken.join(docs, "doc_id", "left").select("doc_id", F.md5(F.coalesce("mine", "text", F.lit(""))).alias("text_md5"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in PARENTS.items()) + ") t(label, parent)")
def taxonomy_table(spark, sf):
    return spark.createDataFrame(list(PARENTS.items()), "label string, parent string")


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN (l_linenumber & 3) <> 0 THEN 1 ELSE 0 END) | (CASE WHEN (l_linenumber & 12) <> 0 THEN 2 ELSE 0 END) AS families FROM lineitem""")
def projected_masks(spark, sf):
    """Bits of a layer (languages) as bits of the layer above (families)."""
    from loomstone.functions.ids import projected_mask

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", projected_mask(F.col("l_linenumber"), {3: 1, 12: 2}).cast("int").alias("families"))


@query("""WITH t AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source) SELECT d.doc_id, d.chars AS chars, round(CAST(d.chars AS DOUBLE) / t.chars, 9) AS share FROM (SELECT doc_id, source, length(text) AS chars FROM documents) d JOIN t ON t.source = d.source WHERE d.chars > t.chars / 20.0""")
def heavy_documents(spark, sf):
    """Documents that hold more than a twentieth of their source."""
    docs = documents(spark, sf).select("doc_id", "source", F.length("text").cast("long").alias("chars"))
    total = docs.groupBy("source").agg(F.sum("chars").alias("total"))
    return docs.join(total, "source").where(F.col("chars") > F.col("total") / 20.0).select("doc_id", "chars", F.round(F.col("chars") / F.col("total"), 9).alias("share"))
