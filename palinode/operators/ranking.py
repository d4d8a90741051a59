"""Seeded order, top-k, nucleus, softmax and the orders reports are printed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palinode.functions.seeded import seed_key
from palinode.operators.ordered import scan


def seeded_order(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Globally shuffled: a range-partitioned sort on md5(seed, id)."""
    return df.withColumn("shuffle_key", seed_key(seed, id_col)).orderBy("shuffle_key", id_col)


def top_k(df: DataFrame, group: Sequence[str], score: str, k: int, tie: str) -> DataFrame:
    """Exactly k per group. Spark cuts every input partition to k per group before the shuffle."""
    rn = F.row_number().over(W.partitionBy(*group).orderBy(F.col(score).desc(), tie))
    return df.withColumn("rank", rn).where(F.col("rank") <= k)


def top_k_ties(df: DataFrame, group: Sequence[str], score: str, k: int) -> DataFrame:
    """The k best and everything tied with the k-th.

    The k-th score comes from at most k distinct scores per group, and a join on the cut-off keeps the
    ties, however many there are, spread over the cluster.
    """
    counted = df.groupBy(*group, score).agg(F.count("*").alias("__n"))
    best = counted.withColumn("__r", F.row_number().over(
        W.partitionBy(*group).orderBy(F.col(score).desc()))).where(F.col("__r") <= k)
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__r").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    cut = best.withColumn("__before", before).where(F.col("__before") < k).groupBy(*group).agg(
        F.min(score).alias("__cut"))
    return df.join(cut, list(group)).where(F.col(score) >= F.col("__cut")).drop("__cut")


def softmax(df: DataFrame, group: Sequence[str], score: str, temperature: float = 1.0, out: str = "prob") -> DataFrame:
    """exp((x - max) / t) / sum within a group; temperature 0 puts all mass on the maximum."""
    top = df.groupBy(*group).agg(F.max(score).alias("__max"))
    joined = df.join(top, list(group))
    if temperature == 0:
        energy = (F.col(score) == F.col("__max")).cast("double")
    else:
        energy = F.exp((F.col(score) - F.col("__max")) / F.lit(float(temperature)))
    lifted = joined.withColumn("__e", energy)
    total = lifted.groupBy(*group).agg(F.sum("__e").alias("__z"))
    return lifted.join(total, list(group)).withColumn(out, F.col("__e") / F.col("__z")).drop("__max", "__e", "__z")


def greedy(df: DataFrame, group: Sequence[str], item: str, score: str) -> DataFrame:
    """Best item per group, lowest item on ties."""
    return df.groupBy(*group).agg(F.max_by(item, F.struct(F.col(score), -F.col(item))).alias("best"))


def cumulative_prob(df: DataFrame, group: Sequence[str], item: str, prob: str, out: str = "cum") -> DataFrame:
    """Cumulative probability, most likely first."""
    led = df.withColumn("__neg", -F.col(prob))
    return scan(led, ["__neg", item], {out: ("sum", F.col(prob))}, group).drop("__neg")


def nucleus(df: DataFrame, group: Sequence[str], item: str, prob: str, p: float) -> DataFrame:
    """Keep an item while the probability before it is at most p; the first always stays."""
    led = df.withColumn("__neg", -F.col(prob))
    ranked = scan(led, ["__neg", item], {"cum_before": ("sum", F.col(prob))}, group, exclusive=True).drop("__neg")
    return ranked.where(F.col("cum_before") <= p)


def rank_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First n per key in `order`, numbered from 1."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rn).where(F.col("rank") <= n)


def metric_order(metric: Column) -> list[Column]:
    """Sort keys of a report: CORE first, ChatCORE last, the rest by name."""
    return [(metric != "CORE").cast("int"), (metric == "ChatCORE").cast("int"), metric]
