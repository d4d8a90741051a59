"""Sinks and sources: what is written from a table and read back, and the streaming jobs."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from palinode.functions.sequences import ids_digest, ids_text
from palinode.functions.text import LOG_FILTER
from palinode.functions.tokens import LAB_SPECIALS, text_word_ids
from palinode.operators import packing, report, selection, store
from palinode.operators.ordered import dense_index
from palinode.plans.catalogue.chat import SQL_CHECK
from palinode.plans.catalogue.tokens import SQL_STREAM, VOCAB, documents_with_ids
from palinode.plans.registry import query
from palinode.session import scratch_dir, table
from palinode.sources import corpus, runs, tasks
from palinode.streaming import streams
from palinode.streaming.epochs import epoch_stream


@query("""
WITH k AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
SELECT CASE WHEN lang = (SELECT max(lang) FROM documents) THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars FROM k GROUP BY 1""")
def split_by_last_shard(spark, d):
    """One shard per language: the last by name validates."""
    path = scratch_dir(spark, "shards")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    # a shard is a folder: a language is spread over tasks, each of which writes a file of it
    by_lang = docs.repartitionByRange("lang", "doc_id").withColumn("shard", F.concat(F.lit("shard_"), "lang"))
    by_lang.drop("doc_id", "lang").write.partitionBy("shard").parquet(path)
    names = spark.read.parquet(path).select(F.col("shard").alias("file"), "n_chars")
    last = names.agg(F.max("file")).first()[0]
    train, val = (corpus.split_by_shard(names, last, s).withColumn("split", F.lit(s)) for s in ("train", "val"))
    return train.unionByName(val).groupBy("split").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("""
WITH RECURSIVE k AS (SELECT doc_id, n_chars, text, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) - 1 AS position FROM documents),
g AS (SELECT position // 64 AS grp, sum(n_chars) AS chars FROM k GROUP BY 1),
cut(grp, held, shard) AS (SELECT 0::BIGINT, (SELECT chars FROM g WHERE grp = 0)::HUGEINT, 0
  UNION ALL SELECT g.grp, CASE WHEN c.held >= 300000 THEN g.chars ELSE c.held + g.chars END::HUGEINT, CASE WHEN c.held >= 300000 THEN c.shard + 1 ELSE c.shard END
  FROM cut c JOIN g ON g.grp = c.grp + 1)
SELECT cut.shard AS shard_id, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM k JOIN cut ON cut.grp = k.position // 64 GROUP BY 1""")
def repackaged_shards(spark, d):
    path = scratch_dir(spark, "repack")
    docs = table(spark, d, "documents")
    corpus.write_shards(docs, store.repackage_plan(docs, "doc_id", "n_chars", 300_000, 64), "doc_id", path)
    written = spark.read.parquet(path).withColumn("n", F.length("text").cast("long"))
    return store.shard_stats(written, "shard_id", "n").select(F.col("shard_id").cast("int").alias("shard_id"), "docs", "chars")


@query(f"""WITH {SQL_STREAM}
SELECT (p // 1000)::BIGINT AS block_id, count(*)::BIGINT AS n, md5(string_agg(tok, ',' ORDER BY p)) AS digest, 'uint16' AS dtype FROM stream GROUP BY 1""")
def token_store_round_trip(spark, d):
    path = scratch_dir(spark, "store")
    corpus.write_token_store(store.store_blocks(documents_with_ids(spark, d), "doc_id", LAB_SPECIALS["<eos>"], 1000), path, VOCAB,
                             dataset_name="documents")
    blocks, meta = corpus.read_token_store(spark, path)
    return blocks.select("block_id", F.size("tokens").cast("long").alias("n"), F.md5(ids_text(F.col("tokens"))).alias("digest"), F.lit(meta["dtype"]).alias("dtype"))


@query("""SELECT count(*)::BIGINT AS n_conversations, sum(n)::BIGINT AS n_messages, sum(c)::BIGINT AS chars FROM (
  SELECT conv_id, count(*) AS n, sum(length(text)) AS c FROM conversations GROUP BY 1)""")
def conversations_jsonl_round_trip(spark, d):
    path = scratch_dir(spark, "jsonl")
    tasks.write_conversations(table(spark, d, "conversations"), path)
    back = tasks.read_conversations_jsonl(spark, path)
    return back.agg(F.count("*").alias("n_conversations"), F.sum(F.size("messages")).cast("long").alias("n_messages"),
                    F.sum(F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"]))).alias("chars"))


@query("""WITH w AS (SELECT DISTINCT p_name AS word FROM part) SELECT count(*)::BIGINT AS n, sum(length(word))::BIGINT AS chars FROM w""")
def word_list_round_trip(spark, d):
    path = scratch_dir(spark, "words")
    table(spark, d, "part").select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("value")).distinct().write.text(path)
    return tasks.read_words(spark, path).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars"))


# ---- run logs: each user's events written as the log of a training run; many runs share a file, a line begins with its run

def _write_logs(spark, d, path):
    ev = dense_index(table(spark, d, "events").select("event_id", "user_id", "value"), ["event_id"], "step", ["user_id"])
    text = F.concat(
        F.when(F.col("step") == 0, F.concat(F.lit("wte                     : "), F.format_number(F.col("user_id") * 1000 + 1, 0), F.lit("\nTotal batch size 524,288 => steps\nnoise\n")))
        .otherwise(""),
        F.format_string("step %05d/00100 (1.00%%) | loss: %.6f | lrm: 1.00 | dt: %.2fms | tok/sec: %s | bf16_mfu: 50.00 | epoch: 1 pq: 0 rg: 3 | total time: 1.0m\n",
                        F.col("step"), F.col("value"), F.col("value") * 10, F.format_number(F.floor(F.col("value") * 100), 0)),
        F.when(F.pmod("step", F.lit(7)) == 0, F.format_string("Step %05d | Validation bpb: %.6f\n", F.col("step"), F.col("value") / 100)).otherwise(""))
    lines = ev.select(F.col("user_id").alias("run"), "step", F.explode(F.split(F.rtrim(text, F.lit("\n")), "\n")).alias("value"))
    numbered = lines.repartitionByRange("run", "step").sortWithinPartitions("run", "step")
    numbered.select(F.concat(F.coalesce(F.col("run").cast("string"), F.lit("")), F.lit("\t"), "value")).write.text(path)


def _run_and_line(value):
    """(run, line) of a written line; an event without a user belongs to the run null."""
    run = F.substring_index(value, "\t", 1)
    return F.when(run != "", run), F.substring(value, F.length(run) + 2, F.length(value))


def _logs(spark, d):
    path = scratch_dir(spark, "logs")
    _write_logs(spark, d, path)
    # a long run is spread over part files, numbered along its steps
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    run, line = _run_and_line(F.col("value"))
    return spark.read.text(path).select(run.alias("run"), at.alias("line_no"), line.alias("line"))


@query("""
WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)
SELECT user_id::VARCHAR AS run, (user_id * 1000 + 1)::BIGINT AS params_wte, 524288::BIGINT AS batch_size, arg_max(printf('%.6f', value / 100), step) AS val_bpb, 0.0::DOUBLE AS core_score
FROM c WHERE step % 7 = 0 GROUP BY user_id""")
def run_log_summary(spark, d):
    s = runs.run_summary(_logs(spark, d))
    return s.select("run", "params_wte", "batch_size", F.format_string("%.6f", "val_bpb").alias("val_bpb"), "core_score")


@query("""
WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)
SELECT user_id::VARCHAR AS run, count(*)::BIGINT AS n_steps, round(sum(round(value, 6)), 4) AS loss, sum(floor(value * 100)::BIGINT)::BIGINT AS tok_sec FROM c GROUP BY 1""")
def run_log_steps(spark, d):
    steps = runs.train_steps(_logs(spark, d))
    return steps.groupBy("run").agg(F.count("*").alias("n_steps"), F.round(F.sum("loss"), 4).alias("loss"), F.sum("tok_sec").alias("tok_sec"))


@query("""
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)
SELECT (count(*) + sum((step % 7 = 0)::INT) + sum((step = 0)::INT))::BIGINT AS n FROM c""")
def log_filter(spark, d):
    return selection.filter_log_lines(_logs(spark, d), LOG_FILTER).agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, round(avg(l_discount), 6) AS accuracy, round(avg(l_tax), 6) AS centered FROM lineitem GROUP BY 1""")
def core_csv_round_trip(spark, d):
    path = scratch_dir(spark, "core")
    acc = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("task")).agg(
        F.avg("l_discount").alias("accuracy"), F.avg("l_tax").alias("centered"))
    runs.write_core_csv(acc, acc.agg(F.avg("centered").alias("core")), path)
    back = runs.read_core_csv(spark, path).where(F.col("task") != "CORE")
    return back.select(F.col("task").cast("long").alias("l_suppkey"), F.round("accuracy", 6).alias("accuracy"), F.round("centered", 6).alias("centered"))


@query("""SELECT o_orderstatus AS experiment, count(*)::BIGINT * 2 AS n, round(sum(o_totalprice) * 2, 2) AS loss FROM orders GROUP BY 1""")
def sweep_csv_append(spark, d):
    path = scratch_dir(spark, "sweep")
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderstatus").alias("experiment"), F.col("o_totalprice").alias("best_val_loss"), F.col("o_totalprice").alias("final_val_loss"),
                    F.lit(1.0).alias("final_ppl"), F.col("o_orderkey").alias("params"), F.lit("forward").alias("eval_direction"), F.lit("a, b").alias("notes"))
    runs.append_runs(rows, path)
    runs.append_runs(rows, path)
    back = runs.read_runs(spark, path, runs.SWEEP_RESULTS)
    return back.groupBy("experiment").agg(F.count("*").alias("n"), F.round(F.sum("best_val_loss"), 2).alias("loss"))


@query("""SELECT 'd' || (o_custkey % 9 + 4) AS tag, max(o_orderkey) AS last_step, (o_custkey % 9 + 4)::INT AS depth FROM orders GROUP BY ALL""")
def checkpoint_catalogue(spark, d):
    listing = table(spark, d, "orders").select(
        F.format_string("/ckpt/d%d/model_%06d.pt", F.pmod("o_custkey", F.lit(9)) + 4, F.col("o_orderkey")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return report.checkpoint_catalogue(listing).select("tag", "last_step", "depth")


# ---- streaming -----------------------------------------------------------------------------------------

def _stream(spark, d, name):
    """A table as a stream. It is one file of the data folder or a folder of files itself, which come in eight micro-batches."""
    rows = table(spark, d, name)
    files = rows.inputFiles()
    if any(f.rsplit("/", 1)[-1] != f"{name}.parquet" for f in files):
        return streams.document_stream(spark, f"{d}/{name}.parquet", rows.schema, -(-len(files) // 8))
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(d)


@query("""SELECT lang, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang""")
def stream_documents(spark, d):
    counted = _stream(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return streams.run_to_table(counted, scratch_dir(spark, "sd"), scratch_dir(spark, "sdc"), "complete")


@query("""SELECT user_id, round(min(value), 6) AS min_bpb, round(coalesce(sum(CASE WHEN event_id > 10 THEN value END), 0), 4) AS train_time, round(avg(value), 6) AS mean_loss,
  count(*)::BIGINT AS n_steps FROM events GROUP BY 1""")
def stream_meters(spark, d):
    m = streams.meter_stream(_stream(spark, d, "events"), "user_id", "event_id", "value", "value", "value")
    out = streams.run_to_table(m, scratch_dir(spark, "sm"), scratch_dir(spark, "smc"), "complete")
    return out.select("user_id", F.round("min_bpb", 6).alias("min_bpb"), F.round("train_time", 4).alias("train_time"), F.round("mean_loss", 6).alias("mean_loss"), "n_steps")


STREAMS = 4


def _token_docs(docs):
    ids = F.array_prepend(text_word_ids(F.col("text"), VOCAB), LAB_SPECIALS["<bos>"])
    return docs.select("doc_id", ids.alias("ids"), F.pmod("doc_id", F.lit(STREAMS)).cast("int").alias("stream_id"))


def _own_stores(spark, streams: int) -> int:
    """The least number of state stores of which streams 0 to streams - 1 have one each."""
    hashes = [r[0] for r in spark.range(streams).select(F.hash(F.col("id").cast("int"))).collect()]
    return next(n for n in itertools.count(streams) if len({h % n for h in hashes}) == streams)


def _streamed_rows(spark, d, files: int = 8):
    """Rows packed from a folder to which the documents come in `files` shards, one a micro-batch."""
    path, sink, checkpoint = (scratch_dir(spark, x) for x in ("shards", "sp", "spc"))
    docs = table(spark, d, "documents", "doc_id")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    ends = [low + -(-i * (high - low + 1) // files) for i in range(files + 1)]
    # every micro-batch opens and commits every store; of a shard cut finely, no core is left with the last large piece
    settings = {"spark.sql.shuffle.partitions": str(_own_stores(spark, STREAMS)), "spark.sql.files.maxPartitionBytes": "16m"}
    for i in range(files):  # a shard is written by many tasks; the stream goes on from its checkpoint
        # row groups of other ids are not read; a shard has many, so that many tasks read it
        shard = docs.where(F.col("doc_id").between(ends[i], ends[i + 1] - 1))
        shard.write.mode("append").option("parquet.block.size", 2 << 20).parquet(path)
        arrived = streams.document_stream(spark, path, docs.schema, files_per_trigger=2**31 - 1)
        rows = streams.run_to_table(streams.pack_stream(_token_docs(arrived), 512, buffer=20, refill=8), sink, checkpoint, settings=settings)
    return rows


@query()
def stream_pack(spark, d):
    return _streamed_rows(spark, d).select("stream_id", "row_id", ids_digest(F.col("tokens")).alias("digest"))


@query("""SELECT DISTINCT (doc_id % 4)::INT AS stream_id, true AS streamed_rows, 0::BIGINT AS only_streamed, 0::BIGINT AS only_batch FROM documents""")
def stream_pack_equals_batch(spark, d):
    """Rows packed over eight micro-batches with carried state are the first ones of a batch over the whole table; what the
    batch packs from its last buffer is still in the state."""
    batch = packing.pack_bestfit_crop(_token_docs(table(spark, d, "documents", "doc_id")), 512, "doc_id", buffer=20, refill=8)
    sides = [rows.select("stream_id", "row_id", ids_digest(F.col("tokens")).alias(side))
             for rows, side in ((_streamed_rows(spark, d), "streamed"), (batch, "batch"))]
    last = sides[0].groupBy("stream_id").agg(F.max("row_id").alias("last"))
    both = sides[0].join(sides[1], ["stream_id", "row_id"], "full").join(last, "stream_id", "left")
    differ = ~F.col("streamed").eqNullSafe(F.col("batch"))
    return both.groupBy("stream_id").agg(
        (F.count("streamed") > 0).alias("streamed_rows"), F.count_if(differ & F.col("streamed").isNotNull()).alias("only_streamed"),
        F.count_if(differ & F.col("streamed").isNull() & (F.col("row_id") <= F.col("last"))).alias("only_batch"))


@query("""WITH placed AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - 1) AS k FROM documents WHERE doc_id % 5 < 4),
dealt AS (SELECT *, k // 64 AS g FROM placed)
SELECT epoch, g % 3 AS rank, g AS row_group, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, min(doc_id)::BIGINT AS first_doc,
  max(doc_id)::BIGINT AS last_doc, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS digest
FROM dealt, (SELECT unnest([1, 2]) AS epoch) e GROUP BY epoch, doc_id % 5, g""")
def stream_epochs(spark, d):
    """Two epochs of a sharded corpus dealt to three ranks, stopped after the first batch and resumed from the checkpoint."""
    path, sink, checkpoint = (scratch_dir(spark, x) for x in ("shards", "se", "sec"))
    docs = table(spark, d, "documents")
    (docs.repartitionById(5, F.pmod("doc_id", F.lit(5)).cast("int")).sortWithinPartitions("doc_id")
     .write.option("parquet.block.row.count.limit", 64).parquet(path))
    # 32 steps a micro-batch; of a large corpus more, so that their number does not grow with it
    steps = max(32, docs.count() * 2 // (64 * 3 * 24))
    columns = "doc_id long, text string, n_chars long"
    for trigger in ({"availableNow": True}, {"processingTime": "0 seconds"}):
        rows = epoch_stream(spark, path, columns, world=3, epochs=2, steps_per_trigger=steps)
        run = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        if "processingTime" in trigger:
            run.processAllAvailable()
            run.stop()
        run.awaitTermination()
    texts = F.array_sort(F.collect_list(F.struct("row_index", F.md5("text").alias("md5"))))
    return spark.read.schema(rows.schema).parquet(sink).groupBy("epoch", "rank", "file", "row_group").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.md5(F.array_join(F.transform(texts, lambda t: t["md5"]), "")).alias("digest")).drop("file").select(
        F.col("epoch"), F.col("rank").cast("long").alias("rank"), F.col("row_group").cast("long").alias("row_group"), "docs", "chars", "first_doc", "last_doc", "digest")


@query(f"""WITH {SQL_CHECK} SELECT count(*)::BIGINT AS n FROM chk WHERE reason = 'ok' AND NOT sys""")
def stream_conversations(spark, d):
    source, sink = scratch_dir(spark, "sc"), scratch_dir(spark, "scs")
    tasks.write_conversations(table(spark, d, "conversations"), source)
    lines = spark.readStream.text(source).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", "array<struct<role:string,content:string>>").alias("messages"))
    good = parsed.where(streams.messages_valid(F.col("messages"))).select("value")
    return streams.run_to_table(good, sink, scratch_dir(spark, "scc")).agg(F.count("*").alias("n"))


@query("""SELECT count(*)::BIGINT AS n_steps, round(sum(round(value, 6)), 3) AS loss FROM events""")
def stream_logs(spark, d):
    path = scratch_dir(spark, "sl")
    _write_logs(spark, d, path)
    run, line = _run_and_line(F.col("value"))
    lines = spark.readStream.text(path).select(run.alias("run"), line.alias("line")).where(F.col("line").rlike(LOG_FILTER))
    fields = [streams.log_field(F.col("line"), f).alias(f) for f in ("step", "loss")]
    out = streams.run_to_table(lines.select("run", *fields), scratch_dir(spark, "slo"), scratch_dir(spark, "slc"))
    return out.where(F.col("step").isNotNull()).agg(F.count("*").alias("n_steps"), F.round(F.sum("loss"), 3).alias("loss"))

