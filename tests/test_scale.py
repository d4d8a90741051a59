"""How work grows: what is broadcast, how a step is dealt to tasks, tables that come as folders."""

import glob
import hashlib
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from palinode.functions import sequences as S
from palinode.functions.math import throughput_cols
from palinode.functions.text import counting_lines
from palinode.functions.tokens import word_ids
from palinode.llm import byte_bpe, components, ngram_join, segments
from palinode.operators import bpe, language_model, metrics, mixture, packing, toolcalls
from palinode.plans.catalogue import files, tokens
from palinode.streaming import epochs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def written(monkeypatch, tmp_path):
    """Scratch folders of the file queries, by name."""
    monkeypatch.setattr(files, "scratch_dir", lambda spark, name: f"{tmp_path}/{name}")
    return tmp_path


def test_lm_correct_broadcasts_no_token_rows(spark):
    scored = spark.range(40).select(F.lit("t").alias("task"), F.expr("id div 8").alias("idx"), F.expr("int(id % 8)").alias("pos"),
                                    F.expr("int(id)").alias("tok"), F.expr("int(id + 1 + int(id = 10))").alias("pred"))
    spans = spark.range(5).select(F.lit("t").alias("task"), F.col("id").alias("idx"), F.lit(2).alias("span_start"), F.lit(5).alias("span_end"))
    out = metrics.lm_correct(scored, spans)
    assert "Broadcast" not in _plan(out)
    assert {r.idx: r.correct for r in out.collect()} == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_mc_correct_broadcasts_no_token_rows(spark):
    scored = spark.range(48).select(F.lit("t").alias("task"), F.expr("id div 16").alias("idx"), F.expr("int(id div 8 % 2)").alias("opt"),
                                    F.expr("int(id % 8)").alias("pos"), F.expr("double(id % 3)").alias("loss"))
    spans = spark.range(6).select(F.lit("t").alias("task"), F.expr("id div 2").alias("idx"), F.expr("int(id % 2)").alias("opt"),
                                  F.lit(3).alias("span_start"), F.lit(8).alias("span_end"), F.lit(1).alias("gold"))
    out = metrics.mc_correct(scored, spans)
    assert "Broadcast" not in _plan(out)
    # window [2, 7): five losses of each option
    mean = {(i, o): sum((16 * i + 8 * o + p) % 3 for p in range(2, 7)) / 5 for i in range(3) for o in range(2)}
    assert {r.idx: r.pred_opt for r in out.collect()} == {i: min(range(2), key=lambda o: (mean[i, o], o)) for i in range(3)}


def test_throughput_of_a_step_without_time_is_null(spark):
    cols = throughput_cols(F.col("step"), F.lit(100), F.col("dt"), F.lit(1000), F.lit(6.0), F.lit(1e6))
    rows = spark.createDataFrame([(0, 0.0), (1, 0.3)], "step int, dt double").select("step", *[c.alias(k) for k, c in cols.items()])
    assert [(r.tok_per_sec, r.flops_per_sec, r.mfu) for r in rows.orderBy("step").collect()] == [
        (None, None, None), (3333, pytest.approx(20000.0), pytest.approx(2.0))]


def test_streamed_tables_may_be_folders_of_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(11).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = ({(r.lang, r.docs, r.chars) for r in files.stream_documents(spark, d).collect()} for d in (str(tmp_path), SMALL))
    assert got == want and len(got) > 1


def test_prompts_are_encoded_once(spark):
    items = spark.range(3).select(F.lit("t").alias("task"), F.col("id").alias("item_id"), F.array(F.lit("a b"), F.concat(F.lit("a b c"), F.col("id"))).alias("prompts"))
    out = mixture.spans(items, "language_modeling", ["task", "item_id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert [(r.opt, r.span_start, r.span_end) for r in out.collect()] == [(0, 4, 7)] * 3


def test_shared_lengths_are_computed_once_a_row(spark):
    df = spark.createDataFrame([([[1, 2, 3], [1, 9, 8, 3]],), ([[4], [4]],)], "s array<array<int>>")
    out = df.select(S.common_suffix_len(F.col("s")).alias("n"), S.answer_spans(F.col("s"), "multiple_choice")[0].alias("mc"),
                    S.answer_spans(F.col("s"), "schema")[0].alias("schema"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "forall(transform(" not in plan and plan.count("forall(") == 3  # none over arrays reversed inside the lambda
    assert [(r.n, r.mc, r.schema) for r in out.collect()] == [(1, [1, 1], [2, 3]), (1, [1, 1], [0, 0])]


def test_sampled_mask_finds_its_spans_once(spark):
    ids = [7, 1, 8, 8, 2] * 800
    df = spark.createDataFrame([(ids,)], "ids array<int>").select(toolcalls.sampled_mask(F.col("ids"), 1, 2).alias("m"))
    start = time.time()
    assert df.first().m == [1, 0, 0, 0, 0] * 800 and time.time() - start < 10


def test_corruption_is_drawn_once(spark):
    row = spark.createDataFrame([(1, list(range(100, 200)))], "id int, ids array<int>")
    pair = row.select("ids", S.corrupted(F.col("ids"), F.col("id"), 0.3, 6, 50, 3).alias("c"))
    out = pair.select("ids", "c.ids", "c.labels")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2  # whether, and by what
    old, new, labels = out.first()
    assert all((a != b) == bool(hit) for a, b, hit in zip(old, new, labels)) and 0 < sum(labels) < 100


def _events(spark, path):
    rows = [(i, i % 40 if i % 41 else None, "view", i / 4) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")


def test_run_logs_share_files(spark, tmp_path, written):
    _events(spark, tmp_path)
    got = {r.run: r.n_steps for r in files.run_log_steps(spark, str(tmp_path)).collect()}
    want = {}
    for i in range(400):
        run = str(i % 40) if i % 41 else None
        want[run] = want.get(run, 0) + 1
    want[None] -= 1  # no user, no parameter line: the text of that first step is null
    assert got == want and len(got) == 41
    assert not glob.glob(f"{written}/logs/*/") and len(glob.glob(f"{written}/logs/part-*")) <= 8  # not a folder per run


def test_a_language_is_written_by_several_tasks(spark, written):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.split_by_last_shard(spark, SMALL).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len(glob.glob(f"{written}/shards/*/part-*")) >= 8 > len(glob.glob(f"{written}/shards/shard*/"))


def test_shards_of_the_packing_stream_are_written_by_many_tasks(spark, written):
    assert files.stream_pack(spark, SMALL).count() > 0
    assert len(glob.glob(f"{written}/shards/part-*")) > 8


def test_a_batch_of_epochs_opens_each_footer_once(spark, tmp_path, monkeypatch):
    for i in range(3):
        spark.range(640).selectExpr("string(id) text").coalesce(1).write.option("parquet.block.row.count.limit", 4).parquet(f"{tmp_path}/w{i}")
        (tmp_path / f"{i}.parquet").write_bytes(open(glob.glob(f"{tmp_path}/w{i}/part-*")[0], "rb").read())
    opened = []
    first = epochs._Shards.open
    monkeypatch.setattr(epochs._Shards, "open", lambda self, file: opened.append(file) or first(self, file))
    reader = epochs._EpochStream(epochs._Shards(None, {"path": str(tmp_path), "world": "3", "epochs": "2", "stepspertrigger": "200"}))
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert sorted(opened) == ["0.parquet", "1.parquet"] and len(parts) <= 40
    assert sum(p.high - p.low for p in parts) == 160 * 3 + 38 * 3  # 54 + 54 + 54 + 38 steps


def test_long_batches_are_encoded_in_pieces():
    words = pa.array([f"w{i}" for i in range(50)]).take(pa.array(np.arange(2_000_000) % 50))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 1000), pa.int32()), words)
    tracemalloc.start()
    ids = bpe._gather(rows, lambda t: [int(t[1:]), 7])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6 and ids.flatten().to_numpy().tolist() == [x for i in range(2_000_000) for x in (i % 50, 7)]
    assert ids.value_lengths().unique().to_pylist() == [2000]
    odd = pa.array([["a", "b"], None, [], ["c"]], pa.list_(pa.string()))
    for size in (1, 2, 100):
        assert bpe._gather(odd, lambda t: [ord(t)], size).to_pylist() == [[97, 98], [], [], [99]]
    assert bpe._gather(odd.slice(0, 0), lambda t: [1]).to_pylist() == []


def test_letters_of_a_word_are_split_once(spark):
    out = spark.createDataFrame([("abca", "a")], "w string, l string").select(counting_lines(F.col("w"), F.col("l")).alias("x"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1
    assert out.first().x == "1:a hit! count=1\n2:b\n3:c\n4:a hit! count=2\n"


def test_packing_documents_are_split_once_behind_spread(spark, tmp_path):
    rows = [(i, "one two three" if i % 5 else None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = tokens._pack_docs(spark, str(tmp_path))
    packed = packing.pack_greedy_crop(docs, 3, "idx")
    assert "regexp_extract_all" not in _plan(packed)  # else a filter on the ids splits the texts of a file in one task
    report = packing.packing_report(docs, packed, 3).first()
    assert report.tokens_in == report.tokens_used == 32 * 4


def test_word_ids_and_digests_of_runs_of_rows(spark):
    rows = [(0, ["a", "bc", "a", "é"]), (1, None), (2, []), (3, ["bc"] * 3)]
    made = spark.createDataFrame(rows, "k int, w array<string>").select("k", word_ids(F.col("w"), 4096).alias("ids"))
    assert "md5(" not in _plan(made)  # hashed once a distinct word, not once a word
    got = {r.k: (r.ids, r.d) for r in made.withColumn("d", S.ids_digest(F.col("ids"))).collect()}
    for k, words in rows:
        ids = None if words is None else [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 4090 + 6 for w in words]
        assert got[k] == (ids, None if ids is None else hashlib.md5(",".join(map(str, ids)).encode()).hexdigest())
    odd = spark.createDataFrame([([1, None, 3],)], "ids array<int>").select(S.ids_digest(F.col("ids")), F.md5(S.ids_text(F.col("ids"))))
    assert odd.first()[0] == odd.first()[1]


def test_bridge_pairs_equal_the_triples(spark):
    rows = [([],), ([1],), ([1, 2],), ([1, 2, 3],), (list(range(9)),), (None,)]
    t, (inputs, labels) = S.bridge(F.col("t")), S.bridge_io(F.col("t"))
    out = spark.createDataFrame(rows, "t array<int>").select(
        inputs.alias("i"), labels.alias("l"), F.flatten(F.transform(t, lambda x: F.array(x["left"], x["right"]))).alias("i0"),
        F.transform(t, lambda x: x["target"]).alias("l0"))
    assert all(r.i == r.i0 and r.l == r.l0 for r in out.collect())


def test_packers_take_and_give_whole_batches(spark):
    docs = spark.createDataFrame([(0, i, list(range(i % 7))) for i in range(90)], "stream_id int, idx long, ids array<int>")
    packed = packing.pack_greedy_crop(docs, 8, "idx")
    assert "MapInArrow" in _plan(packed)
    flat = [t for r in packed.orderBy("row_id").collect() for t in r.tokens]
    assert sum(packed.select(F.size("tokens")).toPandas().iloc[:, 0]) == len(flat) and flat[:9] == [0, 0, 1, 0, 1, 2, 0, 1, 2]


def test_distinct_pretokens_are_encoded_behind_the_counting(spark):
    docs = spark.createDataFrame([(i, "to be or not to be") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string")
    counts = bpe.encode_counts(bpe.pretoken_counts(docs), bpe.Vocabulary([]))
    tokens = counts.select("freq", F.explode("ids").alias("tok"))
    plan = _plan(tokens)
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("HashAggregate")
    assert tokens.agg(F.sum("freq")).first()[0] == 50 * len("to be or not to be")


def test_pairs_of_both_splits_are_one_row_and_shuffled_once_more(spark, monkeypatch):
    kept = []
    cut = language_model.cut_lineage
    monkeypatch.setattr(language_model, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    rows = [(i, "xy"[i % 2], t) for i, t in enumerate(["a b", "a b a", "b a b", "c", "a b", "b a", None, "a b c"])]
    docs = spark.createDataFrame([*rows, (None, None, "a b")], "id long, lang string, text string")
    out = language_model.bpb_by_direction(docs, ["lang"], F.col("id") >= 4)
    plan = _plan(out)
    got = {(r.lang, r.direction): (r.nats, r.bytes) for r in out.collect()}
    assert kept[0].groupBy("lang", "a", "b").count().where("count > 1").isEmpty()  # before: a row for each split
    assert len(set(re.findall(r"Exchange hashpartitioning\(a#\d+, b#\d+", plan))) <= 2  # before: also for contexts, words and totals
    both = {True: {}, False: {}}
    for i, lang, text in rows:
        w = (text or "").split()
        for a, b in zip(["", *w], [*w, ""]) if w else ():
            for d, c, t in (("forward", a, b), ("reverse", b, a)):
                key = (lang if i >= 4 else None, d, c, t)
                if t:
                    both[i >= 4][key] = both[i >= 4].get(key, 0) + 1
    train = {k[1:]: n for k, n in both[False].items()}
    words = {w: sum(n for (d, _, t), n in train.items() if d == "forward" and t == w) for w in {k[2] for k in train}}
    want = {}
    for (lang, d, c, t), n in both[True].items():
        p0 = (words.get(t, 0) + 1) / (sum(words.values()) + len(words) + 1)
        ctx = sum(m for (e, x, _), m in train.items() if (e, x) == (d, c))
        nats, size = want.get((lang, d), (0, 0))
        want[lang, d] = nats - n * np.log((train.get((d, c, t), 0) + 10 * p0) / (ctx + 10)), size + n * len(t)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_shingles_of_a_batch_take_little_memory_at_once(monkeypatch):
    monkeypatch.setattr(segments, "_powers", [])
    texts = [" ".join(f"w{(i * j) % 9973}" for j in range(2000)) for i in range(1, 200)]  # about 1 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])

    class Taken:
        def mapInArrow(self, run, schema):
            return run

    tracemalloc.start()
    assert sum(part.num_rows for part in ngram_join._sets(Taken(), 5)(iter([batch]))) == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # before: 39 MB
    segments._pow_tables((1 << 20) + 1)
    assert sum(t.nbytes for t in segments._powers) < 20e6


def test_a_worker_that_encodes_holds_little_memory():
    words = [f"w{i * 7919 % 1000003}" for i in range(150_000)]
    texts = [" " + " ".join(words[i:i + 1500]) for i in range(0, len(words), 1500)]
    memo = segments.ChunkMemo(lambda raw: [np.array([len(x), x[-1]], np.int32) for x in raw])

    def encoded():
        for part in segments.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text"):
            data, offsets = segments.text_bytes(part.column("text"))
            starts, ends, _ = segments.chunks(data, offsets)
            yield memo.ids_of(data, starts, ends)

    segments._pow_tables(1 << 19)
    tracemalloc.start()
    ids = np.concatenate([x for x, _ in encoded()])
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40e6 and kept - ids.nbytes < 8e6
    assert (ids.reshape(-1, 2) == [(len(w) + 1, ord(w[-1])) for w in words]).all()
    assert (np.concatenate([x for x, _ in encoded()]) == ids).all()  # known by now


def test_pairs_looked_up_one_by_one_are_those_looked_up_together():
    pairs = {(a, b): 7 * a + b for a in range(50) for b in range(0, 90, 1 + a % 3)}
    table = byte_bpe.PairTable(pairs)
    asked = [(a, b) for a in range(52) for b in range(92)]
    together = table.merged(*np.array(asked, np.int32).T).tolist()
    assert [table.of(a, b) for a, b in asked] == [None if x == byte_bpe._NONE else x for x in together] == [pairs.get(p) for p in asked]


def test_components_found_before_take_no_further_round(spark, monkeypatch):
    written, plain = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or plain(df, name))
    found = [(u, u // 10 * 10) for u in range(100)]  # as components gives them, roots with themselves

    def of(edges):
        written.clear()
        rows = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert len({r.id for r in rows}) == len(rows)
        return {r.id: r.component for r in rows}

    assert of(found) == dict(found) and written == ["edges"]
    assert of([]) == {} == of([(3, 3), (3, None)]) and written == ["edges"]
    assert of(found + [(95, 47), (47, 95), (95, 47)]) == {u: 40 if u >= 90 else r for u, r in found}
    assert of([(i, i + 1) for i in range(40)]) == dict.fromkeys(range(41), 0)  # a path takes the most rounds
