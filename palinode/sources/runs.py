"""Benchmark bundles, run tables, logs and result records, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions.text import LOG_FIELDS, log_field

SCALING_RUNS = ("flops_budget double, depth int, model_dim int, params_wte long, params_value_embeds long, "
                "params_lm_head long, params_transformer long, params_scalars long, params_total long, "
                "num_iterations long, tokens_trained long, val_bpb double, core_score double, train_time_sec long")
MINI_RUNS = ("depth int, model_dim int, num_params long, num_scaling_params long, num_iterations long, "
             "tokens_trained long, param_data_ratio double, val_bpb double, core_score double, train_time_sec long")
SWEEP_RESULTS = ("experiment string, best_val_loss double, final_val_loss double, final_ppl double, params long, "
                 "eval_direction string, notes string")
_ITEM_FIELDS = {
    "multiple_choice": "query string, choices array<string>, gold int",
    "schema": "context_options array<string>, continuation string, gold int",
    "language_modeling": "context string, continuation string",
}


def read_benchmark(spark: SparkSession, path: str) -> tuple[list[dict], dict[str, DataFrame], DataFrame]:
    """(task configs, items by task type, baselines) of a bundle: `core.json` with the task list, one
    JSONL per task under `eval_data`, `eval_meta_data.csv` with random baselines in percent."""
    config = spark.read.option("multiLine", True).json(f"{path}/core.json").select(F.inline("icl_tasks"))
    tasks = [{**r.asDict(), "num_fewshot": r["num_fewshot"][0],
              "continuation_delimiter": r.asDict().get("continuation_delimiter") or " "} for r in config.collect()]
    items: dict[str, DataFrame] = {}
    for t in tasks:
        kind = t["icl_task_type"]
        rows = spark.read.schema(_ITEM_FIELDS[kind]).json(f"{path}/eval_data/{t['dataset_uri']}").withColumn(
            "task", F.lit(t["label"]))
        items[kind] = items[kind].unionByName(rows) if kind in items else rows
    baselines = spark.read.option("header", True).csv(f"{path}/eval_meta_data.csv").select(
        F.col("Eval Task").alias("task"), F.col("Random baseline").cast("double").alias("random_baseline"))
    return tasks, items, baselines


def read_runs(spark: SparkSession, path: str, schema: str = SCALING_RUNS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_runs(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def read_core_csv(spark: SparkSession, path: str) -> DataFrame:
    """(task, accuracy, centered) from a space-padded CSV; blanks are null, short rows and the header go."""
    cells = spark.read.text(path).select(F.transform(F.split("value", ",", -1), lambda c: F.trim(c)).alias("c"))
    rows = cells.where((F.size("c") >= 3) & (F.get("c", F.lit(0)) != "") & (F.get("c", F.lit(0)) != "Task"))
    return rows.select(F.get("c", F.lit(0)).alias("task"), F.get("c", F.lit(1)).try_cast("double").alias("accuracy"),
                       F.get("c", F.lit(2)).try_cast("double").alias("centered"))


def write_core_csv(acc: DataFrame, core: DataFrame, path: str) -> None:
    """Task, Accuracy, Centered rows and a closing CORE row."""
    body = acc.select(F.col("task").alias("Task"), F.format_string("%.6f", "accuracy").alias("Accuracy"),
                      F.format_string("%.6f", "centered").alias("Centered"), F.lit(0).alias("o"))
    tail = core.select(F.lit("CORE").alias("Task"), F.lit("").alias("Accuracy"),
                       F.format_string("%.6f", "core").alias("Centered"), F.lit(1).alias("o"))
    body.unionByName(tail).orderBy("o", "Task").drop("o").coalesce(1).write.mode("overwrite").option(
        "header", True).csv(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, line_no, line): run is the file name without `.log`. `line_no` is a (block start, row) pair
    that grows along each file, so long logs stay splittable."""
    lines = spark.read.option("pathGlobFilter", "*.log").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.log$", "").alias("run"),
                        at.alias("line_no"), F.col("value").alias("line"))


def train_steps(lines: DataFrame) -> DataFrame:
    """Typed step lines."""
    fields = ["step", "loss", "lrm", "dt_ms", "tok_sec", "mfu", "epoch", "pq", "rg"]
    kinds = {"step": "int", "tok_sec": "long", "epoch": "int", "pq": "int", "rg": "int"}
    rows = lines.where(F.col("line").rlike(LOG_FIELDS["step"]))
    return rows.select("run", *[log_field(F.col("line"), f).cast(kinds.get(f, "double")).alias(f) for f in fields])


def run_summary(lines: DataFrame) -> DataFrame:
    """One row per run: the last match of every summary field, tokens trained, CORE 0 if never logged."""
    fields = ["params_wte", "params_value_embeds", "params_lm_head", "params_transformer", "params_scalars",
              "params_total", "num_params", "num_scaling_params", "num_iterations", "batch_size", "val_bpb", "core_score"]
    marked = lines.select("run", "line_no", *[log_field(F.col("line"), f).alias(f) for f in fields])
    last = marked.groupBy("run").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("line_no"))).alias(f) for f in fields])
    return last.select("run", *[
        F.col(f) if f in ("val_bpb", "core_score") else F.col(f).cast("long").alias(f) for f in fields]).withColumns({
            "core_score": F.coalesce("core_score", F.lit(0.0)),
            "tokens_trained": F.col("num_iterations") * F.col("batch_size")})


def read_result_record(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The arrays of a nested result record as tables: validation curve and probe scores."""
    raw = spark.read.text(path, wholetext=True)
    record = raw.select(F.from_json("value", (
        "validation_bpb array<struct<step:int,bpb:double,source:string>>, "
        "manual_probe_scores array<struct<label:string,checkpoint_step:int,temperature:string,top_k:string,"
        "anchor_adherence:double,topic_stability:double,factuality:double,repetition_control:double,verdict:string>>"))
        .alias("r")).select("r.*")
    return {"val_curve": record.select(F.inline("validation_bpb")),
            "probe_scores": record.select(F.inline("manual_probe_scores"))}


def report_markdown(rows: DataFrame, stages: tuple[str, ...] = ("base", "sft", "rl")) -> str:
    """The printed metric table, every row of it."""
    lines = ["| " + "Metric".ljust(15) + " |" + "".join(f" {s.upper().ljust(8)} |" for s in stages)]
    lines.append("|" + "-" * 17 + "|" + ("-" * 10 + "|") * len(stages))
    for r in rows.toLocalIterator():
        lines.append("| " + r["metric"].ljust(15) + " |" + "".join(f" {r[s].ljust(8)} |" for s in stages))
    return "\n".join(lines)

