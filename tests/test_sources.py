"""Readers and sinks on small files."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palinode.operators import store
from palinode.sources import corpus, runs


def test_shard_split_prunes_and_guards(spark, tmp_path):
    for i in range(3):
        (tmp_path / "shards").mkdir(exist_ok=True)
        spark.createDataFrame([(f"doc {i} {j}", j) for j in range(4)], "text string, other int").toPandas().to_parquet(tmp_path / "shards" / f"shard_{i:05d}.parquet")
    (tmp_path / "shards" / "shard_00009.parquet.tmp").write_text("partial")
    path = str(tmp_path / "shards")
    val = corpus.read_split(spark, path, "val", ["text"])
    assert {r.file for r in val.collect()} == {"shard_00002.parquet"} and val.count() == 4
    assert corpus.read_split(spark, path, "train", ["text"]).count() == 8
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    with pytest.raises(ValueError):
        corpus.read_split(spark, path + "/shard_00000.parquet", "train")


def test_text_fallback_and_skip(spark):
    df = spark.createDataFrame([(0, None, "first"), (1, "own", "x"), (2, "  ", "y"), (3, "later", "z")], "id long, text string, alt string")
    assert [r.text for r in corpus.read_text(df, "text", order="id").orderBy("id").collect()] == ["first", "own", "later"]
    assert [r.text for r in corpus.read_text(df.drop("text"), "text", skip_rows=2, order="id").orderBy("id").collect()] == ["y", "z"]


def test_repackaged_layout(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 10, 10) for i in range(3000)], "doc_id long, text string, n_chars long")
    plan = store.repackage_plan(docs, "doc_id", "n_chars", 10_240, 1024)
    corpus.write_shards(docs.coalesce(1), plan, "doc_id", str(tmp_path / "out"))
    assert {r.shard_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("shard_id").count().collect()} == {0: 1024, 1: 1024, 2: 952}
    for f in (tmp_path / "out").glob("shard_id=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        col = meta.row_group(0).column(0)
        assert meta.row_group(0).num_rows <= 1024 and col.compression == "ZSTD" and not any("DICTIONARY" in e for e in col.encodings)


def test_raw_token_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, [i, i + 1, 300]) for i in range(20)], "idx long, ids array<int>")
    blocks = store.store_blocks(docs, "idx", 0, 16)
    path = str(tmp_path / "t.bin")
    corpus.write_raw_tokens(blocks, path, 4096, 80)
    assert (tmp_path / "t.bin").stat().st_size == 160
    stream = [t for i in range(20) for t in (i, i + 1, 300, 0)]
    back = corpus.read_raw_tokens(spark, path, 7).orderBy("block_id").collect()
    assert [t for b in back for t in b.tokens] == stream and back[1].pos0 == 7


LOG = """wte                     : 25,165,824
value_embeds            : 0
lm_head                 : 1,000
transformer_matrices    : 2,000
scalars                 : 10
total                   : 25,168,834
Number of parameters: 25,168,834 (scaling: 3,000)
Calculated number of iterations from target FLOPs: 1,200
Total batch size 524,288 => gradient accumulation steps: 1
Step 00000 | Validation bpb: 3.167509
step 00000/01200 (0.00%) | loss: 10.100000 | lrm: 1.00 | dt: 100.00ms | tok/sec: 5,242,880 | bf16_mfu: 40.00 | epoch: 1 pq: 0 rg: 0 | total time: 0.00m
noise
Step 01200 | Validation bpb: 0.912300
CORE metric: 0.1250
"""


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "b.log").write_text("total : 5\nCalculated number of iterations: 2\nTotal batch size 10\n")
    lines = runs.read_logs(spark, str(tmp_path))
    s = {r.run: r.asDict() for r in runs.run_summary(lines).collect()}
    assert s["a"]["params_wte"] == 25165824 and s["a"]["num_scaling_params"] == 3000 and s["a"]["val_bpb"] == 0.9123
    assert s["a"]["tokens_trained"] == 1200 * 524288 and s["a"]["core_score"] == 0.125
    assert s["b"]["core_score"] == 0.0 and s["b"]["tokens_trained"] == 20 and s["b"]["val_bpb"] is None
    step = runs.train_steps(lines).first()
    assert (step.run, step.step, step.loss, step.tok_sec) == ("a", 0, 10.1, 5242880)


def test_log_stream(spark, tmp_path):
    from palinode.streaming import streams

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text(LOG)
    out = streams.run_to_table(streams.log_stream(spark, str(tmp_path / "logs")), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.count() == 4 and out.where("loss is not null").first().loss == 10.1


def test_benchmark_bundle(spark, tmp_path):
    (tmp_path / "eval_data").mkdir()
    (tmp_path / "eval_data" / "mc.jsonl").write_text(json.dumps({"query": "q", "choices": ["a", "b"], "gold": 1}) + "\n")
    (tmp_path / "eval_data" / "lm.jsonl").write_text(json.dumps({"context": "c", "continuation": "d"}) + "\n")
    (tmp_path / "core.json").write_text(json.dumps({"icl_tasks": [
        {"label": "m", "icl_task_type": "multiple_choice", "dataset_uri": "mc.jsonl", "num_fewshot": [10], "continuation_delimiter": "\nA: "},
        {"label": "l", "icl_task_type": "language_modeling", "dataset_uri": "lm.jsonl", "num_fewshot": [0]}]}))
    (tmp_path / "eval_meta_data.csv").write_text("Eval Task,Random baseline\nm,25\nl,0\n")
    tasks, items, base = runs.read_benchmark(spark, str(tmp_path))
    assert [(t["label"], t["num_fewshot"], t["continuation_delimiter"]) for t in tasks] == [("m", 10, "\nA: "), ("l", 0, " ")]
    assert items["multiple_choice"].first().task == "m" and base.where("task = 'm'").first().random_baseline == 25.0


def test_core_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Task     , Accuracy , Centered\nhella    , 0.5      , 0.25\nbad\nblank    ,          , 0.1\nCORE     ,          , 0.2\n")
    rows = {r.task: (r.accuracy, r.centered) for r in runs.read_core_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert rows == {"hella": (0.5, 0.25), "blank": (None, 0.1), "CORE": (None, 0.2)}


def test_result_record(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({
        "validation_bpb": [{"step": 0, "bpb": 3.0, "source": "log"}, {"step": 250, "bpb": 1.0, "source": "log"}],
        "manual_probe_scores": [{"label": "x", "checkpoint_step": 5, "temperature": 0.25, "top_k": 20, "anchor_adherence": 5.0,
                                 "topic_stability": 3.0, "factuality": 1.0, "repetition_control": 1.0, "verdict": "v"}]}))
    rec = runs.read_result_record(spark, str(tmp_path / "r.json"))
    assert rec["val_curve"].agg(F.min("bpb")).first()[0] == 1.0 and rec["probe_scores"].first().temperature == "0.25"
