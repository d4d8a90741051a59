"""Corpus scans, splits, budgets and repackaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from palinode.operators import selection, store
from palinode.operators.ordered import dense_index, scan
from palinode.operators.ranking import seeded_order
from palinode.plans.registry import query, u32, uniform
from palinode.session import table
from palinode.sources.corpus import read_corpus, read_text


@query("""
SELECT 'documents.parquet' AS file, lang, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars,
       sum(strlen(text))::BIGINT AS bytes
FROM documents GROUP BY lang""")
def corpus_scan_stats(spark, d):
    docs = read_corpus(spark, f"{d}/documents.parquet", ["lang", "text"])
    return docs.groupBy("file", "lang").agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"),
        F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query(f"""
SELECT CASE WHEN {uniform(42, 'doc_id')} < 0.1 THEN 'val' ELSE 'train' END AS split, lang,
       count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars
FROM documents GROUP BY ALL""")
def split_by_hash(spark, d):
    docs = selection.split_by_hash(table(spark, d, "documents"), "doc_id", 0.1)
    return docs.groupBy("split", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("""
WITH i AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT (idx // 32) % 8 AS stream_id, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars,
       min(doc_id) AS first_doc, max(idx // 32) AS last_group
FROM i GROUP BY 1""")
def stream_assignment(spark, d):
    docs = dense_index(table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"])
    return selection.assign_stream(docs, 8, group=32).groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"),
        F.max("row_group").alias("last_group"))


@query("""
WITH i AS (SELECT item_id, length(text) AS n, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)
SELECT item_id, n FROM i WHERE idx % 4 = 1""")
def rank_share(spark, d):
    items = dense_index(table(spark, d, "benchmark"), ["item_id"])
    return selection.rank_share(items, 1, 4).select("item_id", F.length("text").cast("long").alias("n"))


@query("""
SELECT source, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source""")
def shard_stats(spark, d):
    return store.shard_stats(table(spark, d, "documents"), "source")


@query("""
WITH c AS (SELECT doc_id, substr(text, 1, 10000) AS text FROM documents WHERE regexp_matches(text, '[^\\s]')),
b AS (SELECT doc_id, length(text) AS n_chars, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS chars_before FROM c)
SELECT doc_id, n_chars::BIGINT AS n_chars, chars_before::BIGINT AS chars_before FROM b WHERE chars_before <= 1500000""")
def drop_blank_crop_budget(spark, d):
    docs = selection.crop_chars(selection.drop_blank(table(spark, d, "documents").select("doc_id", "text")), 10_000)
    sized = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return selection.char_budget(sized, 1_500_000, "doc_id")


@query("""
WITH i AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT lang, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_doc
FROM i WHERE idx >= 137 GROUP BY lang""")
def skip_docs(spark, d):
    docs = selection.skip(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), 137, "doc_id")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"),
                                    F.min("doc_id").alias("first_doc"))


@query("""
SELECT doc_id, source, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS chars_so_far,
       sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS source_chars_so_far
FROM documents""")
def running_chars(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    whole = scan(docs, ["doc_id"], {"chars_so_far": ("sum", F.col("n_chars"))})
    return scan(whole, ["doc_id"], {"source_chars_so_far": ("sum", F.col("n_chars"))}, ["source"]).drop("n_chars")


@query("""
WITH RECURSIVE k AS (
  SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) - 1 AS position
  FROM documents),
g AS (SELECT position // 8 AS grp, sum(n_chars) AS chars, count(*) AS n FROM k GROUP BY 1),
cut(grp, held, shard) AS (
  SELECT 0::BIGINT, (SELECT chars FROM g WHERE grp = 0)::HUGEINT, 0::BIGINT
  UNION ALL
  SELECT g.grp, CASE WHEN c.held >= 100000 THEN g.chars ELSE c.held + g.chars END::HUGEINT,
         CASE WHEN c.held >= 100000 THEN c.shard + 1 ELSE c.shard END
  FROM cut c JOIN g ON g.grp = c.grp + 1)
SELECT k.doc_id, k.position, cut.shard AS shard_id FROM k JOIN cut ON cut.grp = k.position // 8""")
def repackage_plan(spark, d):
    return store.repackage_plan(table(spark, d, "documents"), "doc_id", "n_chars", 100_000, 8)


@query(f"""
SELECT page_id, length(url)::BIGINT AS n_chars, md5(url) AS digest FROM pages WHERE regexp_matches(url, '[^\\s]')""")
def text_fallback(spark, d):
    pages = read_text(table(spark, d, "pages"), "text", order="page_id")
    return pages.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("""
SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '7', doc_id)), doc_id) - 1 AS position FROM documents""")
def seeded_shuffle(spark, d):
    order = seeded_order(table(spark, d, "documents").select("doc_id"), "doc_id", 7)
    return dense_index(order, ["shuffle_key", "doc_id"], "position", uniform_hex=True).drop("shuffle_key")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source
             ORDER BY md5(concat_ws(':', '1337', source, doc_id)), doc_id) AS rn, source FROM documents)
SELECT source, doc_id FROM r WHERE rn <= 25""")
def cap_per_task(spark, d):
    return selection.cap_per_task(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 25)


@query("""
WITH i AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT source AS file, (idx // 16)::BIGINT AS row_group, count(*)::BIGINT AS docs FROM i
WHERE source > (SELECT min(source) FROM documents) OR (source = (SELECT min(source) FROM documents) AND idx // 16 > 1)
GROUP BY ALL""")
def resume_position(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    grouped = dense_index(docs, ["doc_id"], "idx", ["source"]).withColumn("row_group", F.expr("idx div 16"))
    first = docs.agg(F.min("source")).first()[0]
    rest = selection.resume_after(grouped, F.col("source"), F.col("row_group"), (first, 1))
    return rest.groupBy(F.col("source").alias("file"), "row_group").agg(F.count("*").alias("docs"))


@query("""
SELECT e.epoch::BIGINT AS epoch, lang, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars
FROM documents, (SELECT unnest([1, 2, 3]) AS epoch) e GROUP BY ALL""")
def epoch_counts(spark, d):
    return selection.epochs(table(spark, d, "documents"), 3).groupBy(F.col("epoch").cast("long").alias("epoch"), "lang").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query(f"""
SELECT doc_id, {u32('sha', 'doc_id')} AS draw, ('0x' || substr(sha256(source), 1, 8))::BIGINT AS name_seed FROM documents""")
def seed_from_name(spark, d):
    from palinode.functions.seeded import name_seed, seed_u32

    return table(spark, d, "documents").select(
        "doc_id", seed_u32("sha", "doc_id").alias("draw"), name_seed(F.col("source")).alias("name_seed"))
