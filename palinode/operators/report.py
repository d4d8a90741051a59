"""Report cards: metric by stage, number text, probe scores, checkpoint listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.math import report_number
from palinode.operators.ranking import metric_order


def metric_names(df: DataFrame, metric: str = "metric") -> DataFrame:
    return df.select(metric).distinct()


def report_pivot(df: DataFrame, stages: Sequence[str] = ("base", "sft", "rl")) -> DataFrame:
    """(metric, one column per stage) in report order; absent values are `-`."""
    wide = df.groupBy("metric").pivot("stage", list(stages)).agg(F.max("value"))
    cells = [F.coalesce(F.replace(F.format_number(F.col(s), 4), F.lit(","), F.lit("")), F.lit("-")).alias(s) for s in stages]
    return wide.orderBy(*metric_order(F.col("metric"))).select("metric", *cells)


def section_lines(df: DataFrame, key: str, value: Column, is_int: Column) -> DataFrame:
    """(line) of a report section: `- key: value`."""
    return df.select(F.concat(F.lit("- "), F.col(key), F.lit(": "), report_number(value, is_int)).alias("line"))


def scorecard(df: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Long (label, metric, score) of a wide probe table."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return df.select(label, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, score)"))


def scorecard_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("metric").agg(F.avg("score").alias("mean"), F.min("score").alias("min"),
                                      F.max("score").alias("max"), F.count("score").alias("n"))


def anchor_adherence(df: DataFrame, text: str, anchor: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of generated texts that land their anchor."""
    return df.groupBy(*keys).agg(
        F.avg(F.rtrim(F.col(text)).endswith(F.rtrim(F.col(anchor))).cast("double")).alias("adherence"), F.count("*").alias("n"))


def checkpoint_catalogue(listing: DataFrame, path: str = "path", modified: str = "modificationTime") -> DataFrame:
    """(tag, depth, last_step, last_modified) from a file listing of .../<tag>/model_<step>.pt."""
    tag = F.regexp_extract(F.col(path), r"([^/]+)/model_\d+\.pt$", 1)
    step = F.regexp_extract(F.col(path), r"model_(\d+)\.pt$", 1)
    rows = listing.where(step != "").select(
        tag.alias("tag"), step.cast("long").alias("step"), F.col(modified).alias("m"))
    return rows.groupBy("tag").agg(F.max("step").alias("last_step"), F.max("m").alias("last_modified")).withColumn(
        "depth", F.regexp_extract("tag", r"^d(\d+)", 1).try_cast("int"))


def largest_model(catalogue: DataFrame) -> DataFrame:
    """The deepest d<N> tag, or the most recently written tag if none is named that way."""
    return catalogue.orderBy(F.col("depth").desc_nulls_last(), F.col("last_modified").desc(), "tag").limit(1)
