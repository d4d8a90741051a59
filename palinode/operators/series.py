"""Run curves: smoothing, deltas, running bests, timing, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.operators.ordered import median, neighbour, scan


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, **kw) -> DataFrame:
    """Drop from the previous evaluation: previous - current."""
    return neighbour(df, order, {"__prev": value}, keys, **kw).withColumn(
        "drop", F.col("__prev") - F.col(value)).drop("__prev")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Last non-null value of each column per key."""
    return df.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def running_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, **kw) -> DataFrame:
    """best_before and whether this row is a new best."""
    seen = scan(df, order, {"best_before": ("min", F.col(value))}, keys, exclusive=True, **kw)
    return seen.withColumn("new_best", F.col("best_before").isNull() | (F.col(value) < F.col("best_before")))


def eta(df: DataFrame, run: Sequence[str], step: str, dt: str, total: Column, warm: int = 10, **kw) -> DataFrame:
    """train_time (warm-up steps free) and eta = remaining steps * mean step time."""
    timed = scan(df, [step], {"train_time": ("sum", F.when(F.col(step) > warm, F.col(dt)).otherwise(0.0))}, run, **kw)
    done = F.col(step) - warm
    return timed.withColumn("eta", F.when(done > 0, (total - F.col(step)) * F.col("train_time") / done))


def minmax(df: DataFrame, keys: Sequence[str], value: str, out: str = "scaled") -> DataFrame:
    if keys:
        joined = df.join(df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")), list(keys))
    else:
        joined = df.withColumns({"__lo": df.agg(F.min(value)).scalar(), "__hi": df.agg(F.max(value)).scalar()})
    span = F.col("__hi") - F.col("__lo")
    return joined.withColumn(out, F.when(span != 0, (F.col(value) - F.col("__lo")) / span)).drop("__lo", "__hi")


def min_val(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min_val"), F.min_by(step, F.struct(value, step)).alias("min_step"))


def run_time(df: DataFrame, keys: Sequence[str], step: str, dt: str, batch: str, warm: int = 10) -> DataFrame:
    """Training time after warm-up and overall tokens per second."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col(step) > warm, F.col(dt))), F.lit(0.0)).alias("train_time"),
        (F.sum(batch) / F.sum(dt)).alias("tok_per_sec"))


def throughput(df: DataFrame, keys: Sequence[str], step: str, rate: str, after: int = 20) -> DataFrame:
    """Median, minimum and maximum rate after the first steps."""
    late = df.where(F.col(step) > after)
    ends = late.groupBy(*keys).agg(F.min(rate).alias("rate_min"), F.max(rate).alias("rate_max"))
    return ends.join(median(late, keys, rate, "rate_median"), list(keys))


def meters(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    return df.groupBy(*keys, name).agg(F.avg(value).alias("mean"))


def job_counts(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


def parse_schedule(spec: str, total_steps: int, max_len: int) -> list[tuple[int, int]]:
    """`512:0,1024:0.25` to sorted (start_step, seq_len); a start with a point is a share of the run."""
    entries = []
    for item in filter(None, (s.strip() for s in (spec or "").split(","))):
        length, _, start = item.replace("@", ":").partition(":")
        start = start.strip()
        at = 0 if not start else int(float(start) * total_steps) if "." in start else int(start)
        if not 0 < int(length) <= max_len:
            raise ValueError(f"sequence length out of range in {item!r}")
        entries.append((max(0, at), int(length)))
    return sorted(entries, key=lambda e: e[0]) or [(0, max_len)]


def schedule_asof(steps: DataFrame, schedule: Sequence[tuple[int, int]], step: str = "step") -> DataFrame:
    """Sequence length in force at each step: the last entry that has started, the first one before
    any has. A schedule is a handful of literals, so the as-of join is one CASE expression."""
    expr = F.lit(schedule[0][1])
    for start, length in schedule:
        expr = F.when(F.col(step) >= start, F.lit(length)).otherwise(expr)
    return steps.withColumn("seq_len", expr)
