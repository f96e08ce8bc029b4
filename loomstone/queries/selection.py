"""Queries over windows, budgets, splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import mix
from loomstone.operators import selection as S
from loomstone.plans.prefix_sum import running_sum
from loomstone.plans.session import table
from loomstone.queries import query
from loomstone.queries.tables import CANON, canon, documents

RUN = f"WITH {CANON}, r AS (SELECT *, CAST(sum(chars) OVER (ORDER BY doc_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM canon)"


@query(RUN + " SELECT doc_id, run AS running_chars, run - chars AS before FROM r")
def running_chars(spark, sf):
    out = running_sum(canon(spark, sf).select("doc_id", "doc_key", "chars"), "chars", ["doc_key"], "running_chars")
    return out.select("doc_id", "running_chars", (F.col("running_chars") - F.col("chars")).alias("before"))


@query(RUN + """ SELECT doc_id, chars FROM r WHERE run < 500000 OR (run >= 500000 AND run - chars < 500000 AND (run = chars OR abs(500000 - run) < abs(500000 - (run - chars))))""")
def char_budget_select(spark, sf):
    return S.char_budget(canon(spark, sf).select("doc_id", "doc_key", "chars"), "chars", ["doc_key"], 500_000).select("doc_id", "chars")


TOKENS = r"t AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS tokens FROM documents)"


def tokens(spark, sf):
    return documents(spark, sf).select("doc_id", "source", "lang", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH {TOKENS} SELECT doc_id, tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY tokens DESC, source, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS before FROM t) WHERE before < 100000")
def token_budget_select(spark, sf):
    return S.token_budget(tokens(spark, sf), "tokens", ["source", "doc_id"], 100_000).select("doc_id", "tokens")


@query(f"""WITH {TOKENS}, g AS (SELECT lang, CAST(sum(tokens) AS BIGINT) AS group_tokens FROM t GROUP BY lang), s AS (SELECT *, group_tokens / (SELECT sum(group_tokens) FROM g) <= 0.12 AS small FROM g),
b AS (SELECT *, greatest(0, 120000 - coalesce(sum(group_tokens) OVER (PARTITION BY small ORDER BY group_tokens, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM s),
q AS (SELECT *, CASE WHEN small THEN least(room, group_tokens) ELSE 0 END AS taken FROM b)
SELECT lang, group_tokens, CAST(CASE WHEN small THEN taken ELSE floor((120000 - (SELECT sum(taken) FROM q)) * (group_tokens / (SELECT CAST(sum(group_tokens) AS DOUBLE) FROM q WHERE NOT small))) END AS BIGINT) AS quota FROM q""")
def thresholded_allocation(spark, sf):
    return S.thresholded_quotas(tokens(spark, sf), "tokens", "lang", 120_000, 0.12)


@query(f"""WITH {TOKENS}, g AS (SELECT lang, CAST(sum(tokens) AS BIGINT) AS group_tokens FROM t GROUP BY lang), s AS (SELECT *, group_tokens / (SELECT sum(group_tokens) FROM g) <= 0.12 AS small FROM g),
b AS (SELECT *, greatest(0, 120000 - coalesce(sum(group_tokens) OVER (PARTITION BY small ORDER BY group_tokens, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM s),
q AS (SELECT *, CASE WHEN small THEN least(room, group_tokens) ELSE 0 END AS taken FROM b),
z AS (SELECT lang, CAST(CASE WHEN small THEN taken ELSE floor((120000 - (SELECT sum(taken) FROM q)) * (group_tokens / (SELECT CAST(sum(group_tokens) AS DOUBLE) FROM q WHERE NOT small))) END AS BIGINT) AS quota FROM q),
w AS (SELECT t.*, sum(tokens) OVER (PARTITION BY lang ORDER BY tokens DESC, source, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS before FROM t)
SELECT doc_id, w.lang AS lang, tokens FROM w JOIN z ON w.lang = z.lang WHERE before < quota""")
def thresholded_selection(spark, sf):
    """The documents that the quotas take."""
    docs = tokens(spark, sf)
    quotas = S.thresholded_quotas(docs, "tokens", "lang", 120_000, 0.12).select("lang", "quota")
    return S.token_budget_by_group(docs.join(quotas, "lang"), "tokens", "lang", ["source", "doc_id"], "quota").select("doc_id", "lang", "tokens")


@query(RUN + """ SELECT doc_id, CASE WHEN run - chars < 100000 THEN 'val' WHEN run - chars < 300000 THEN 'test' ELSE 'train' END AS split FROM r""")
def split_assignment_global(spark, sf):
    out = running_sum(canon(spark, sf).select("doc_id", "doc_key", "chars"), "chars", ["doc_key"], "run")
    return out.select("doc_id", S.split_by_chars(F.col("run"), F.col("chars"), [("val", 100_000), ("test", 200_000)], "train").alias("split"))


GROUPED = f"WITH {CANON}, r AS (SELECT *, CAST(sum(chars) OVER (PARTITION BY lang ORDER BY doc_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, CAST(sum(chars) OVER (PARTITION BY lang) AS BIGINT) AS total FROM canon), a AS (SELECT *, CASE WHEN run - chars < total / 100.0 * 5 THEN 'val' WHEN run - chars < total / 100.0 * 15 THEN 'test' ELSE 'train' END AS split FROM r)"


def grouped_splits(spark, sf):
    docs = canon(spark, sf).select("doc_id", "doc_key", "lang", "chars", "source_dataset")
    totals = docs.groupBy("lang").agg(F.sum("chars").alias("total"))
    before = F.col("run") - F.col("chars")
    split = F.when(before < F.col("total") / 100.0 * 5, "val").when(before < F.col("total") / 100.0 * 15, "test").otherwise("train")
    return running_sum(docs, "chars", ["doc_key"], "run", ["lang"]).join(totals, "lang").withColumn("split", split)


@query(GROUPED + " SELECT doc_id, lang, split FROM a")
def split_assignment_by_group(spark, sf):
    return grouped_splits(spark, sf).select("doc_id", "lang", "split")


@query(GROUPED + " SELECT split, source_dataset, count(*) AS rows, CAST(sum(chars) AS BIGINT) AS chars FROM a GROUP BY split, source_dataset")
def split_summary(spark, sf):
    return grouped_splits(spark, sf).groupBy("split", "source_dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"))


@query(f"WITH {CANON}, g AS (SELECT source_dataset, CAST(sum(chars) AS BIGINT) AS chars FROM canon GROUP BY source_dataset) SELECT source_dataset, chars, round(chars / (SELECT CAST(sum(chars) AS DOUBLE) FROM g), 6) AS share, chars >= 100000 AS above_cutoff FROM g")
def quota_summary(spark, sf):
    g = canon(spark, sf).groupBy("source_dataset").agg(F.sum("chars").alias("chars"))
    return g.select("source_dataset", "chars", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy()), 6).alias("share"), (F.col("chars") >= 100_000).alias("above_cutoff"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id % 3 ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 10")
def stratified_sample(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang", "source", (F.col("doc_id") % 3).alias("b"), F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"))).alias("p"))
    return S.top_per_group(docs, ["lang", "b"], ["p", "doc_id"], 10).select("doc_id", "lang", "source")


@query("SELECT doc_id, source FROM documents ORDER BY md5(source || '|' || CAST(doc_id AS VARCHAR)) LIMIT 100")
def deterministic_sample(spark, sf):
    return S.hash_sample(documents(spark, sf).select("source", "doc_id"), ["source", "doc_id"], 100).select("doc_id", "source")


@query("""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, n, 97.0 * n / (SELECT sum(n) FROM g) AS x FROM g), f AS (SELECT *, floor(x) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS rk FROM e)
SELECT lang, n, CAST(fl + CASE WHEN rk <= 97 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def largest_remainder_quota(spark, sf):
    return S.largest_remainder(documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "n", "lang", 97)


@query("""WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM a WHERE rn <= 2)
SELECT doc_id, lang, source FROM b WHERE rk <= 15""")
def host_capped_sample(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang", "source", F.md5(F.col("doc_id").cast("string")).alias("p"))
    return S.capped_sample(docs, "lang", "source", ["p", "doc_id"], 2, 15).select("doc_id", "lang", "source")


@query("""SELECT doc_id, source, chars FROM (SELECT doc_id, source, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn <= 3""")
def topk_per_source(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", F.length("text").cast("long").alias("chars"))
    return S.top_per_group(docs, ["source"], [F.desc("chars"), "doc_id"], 3)


@query("""SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256('s|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < 429496729""")
def bernoulli_sample(spark, sf):
    return documents(spark, sf).select("doc_id").where(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("s"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") < 429_496_729)


@query(f"WITH RECURSIVE {CANON}, o AS (SELECT doc_id, chars, row_number() OVER (ORDER BY doc_key) AS rn FROM canon), c AS (SELECT rn, doc_id, CAST(0 AS BIGINT) AS shard, CAST(chars AS BIGINT) AS held FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.doc_id, c.shard + CASE WHEN c.held >= 200000 THEN 1 ELSE 0 END, CASE WHEN c.held >= 200000 THEN 0 ELSE c.held END + o.chars FROM c JOIN o ON o.rn = c.rn + 1) SELECT doc_id, shard FROM c")
def shard_cut(spark, sf):
    return S.cut_shards(canon(spark, sf).select("doc_id", "doc_key", "chars"), "chars", ["doc_key"], 200_000).select("doc_id", "shard")


MIX = [
    {"name": "web", "include_sources": ["src0", "src1", "src2"], "fraction": 0.5, "fraction_mode": "of_group"},
    {"name": "books", "include_sources": ["src3"], "fraction": 1.0, "fraction_mode": "of_group"},
    {"name": "rest", "exclude_sources": ["src0", "src1", "src2", "src3"], "fraction": 0.4, "fraction_mode": "of_total"},
]


@query(f"""WITH {CANON}, e AS (SELECT *, CASE WHEN source_dataset IN ('src0', 'src1', 'src2') THEN 'web' WHEN source_dataset = 'src3' THEN 'books' ELSE 'rest' END AS component FROM canon),
n AS (SELECT component, CAST(sum(chars) AS DOUBLE) AS available FROM e GROUP BY component), f AS (SELECT sum(CASE component WHEN 'web' THEN 0.5 * available WHEN 'books' THEN available ELSE 0 END) AS fixed FROM n),
t AS (SELECT component, available, floor(CASE component WHEN 'web' THEN 0.5 * available WHEN 'books' THEN available ELSE fixed / 0.6 * 0.4 END + 0.000000001) AS target FROM n, f),
r AS (SELECT e.*, sum(chars) OVER (PARTITION BY e.component ORDER BY doc_key ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc_id, r.component AS component FROM r JOIN t ON r.component = t.component WHERE run < target OR target >= available OR (run >= target AND run - chars < target AND (run = chars OR abs(target - run) < abs(target - (run - chars))))""")
def source_mix_select(spark, sf):
    return mix.apply_mix(canon(spark, sf).select("doc_id", "doc_key", "chars", "source_dataset"), MIX, "chars", ["doc_key"]).select("doc_id", "component")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER w AS nth, lag(o_totalprice, 1, 0) OVER w AS previous, CAST(round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS DOUBLE) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_shapes(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf, "orders")
    return orders.select(
        "o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("nth"), F.lag("o_totalprice", 1, 0).over(w).alias("previous"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).cast("double").alias("running"),
    )
