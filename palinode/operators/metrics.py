"""Scores to metrics. Every metric is a partial/final aggregate; group sizes never matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.math import LN2
from palinode.functions.text import letter_correct
from palinode.operators.ordered import scan

# The chat tasks and their random baselines (fractions).
CHAT_BASELINES = {
    "ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "HumanEval": 0.0, "SpellingBee": 0.0,
}
CATEGORICAL_TASKS = ("ARC-Easy", "ARC-Challenge", "MMLU")


def with_token_bytes(tokens: DataFrame, vocab: DataFrame, token: str = "token_id") -> DataFrame:
    """Byte length of each token. The vocabulary is at most a few hundred thousand rows, so Spark's own
    size check picks the broadcast; a larger side falls back to a shuffle join."""
    lengths = vocab.select(F.col("token_id").alias("__tid"), "n_bytes")
    return tokens.join(lengths, F.col(token) == F.col("__tid"), "left").drop("__tid")


def bits_per_byte(scored: DataFrame, keys: Sequence[str] = (), loss: str = "loss", target: str = "target",
                  n_bytes: str = "n_bytes", weight: Column | None = None) -> DataFrame:
    """Sum of nats over counted tokens / (ln 2 * their bytes). Ignored: targets below 0 and tokens of 0
    bytes. No counted byte at all gives +inf. `weight` counts pre-aggregated rows."""
    w = F.lit(1) if weight is None else weight
    counted = (F.col(target) >= 0) & (F.col(n_bytes) > 0)
    agg = scored.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(counted, F.col(loss) * w)), F.lit(0.0)).alias("nats"),
        F.coalesce(F.sum(F.when(counted, F.col(n_bytes) * w)), F.lit(0)).cast("long").alias("bytes"))
    return agg.withColumn("bpb", F.when(F.col("bytes") == 0, F.lit(float("inf"))).otherwise(
        F.col("nats") / (F.lit(LN2) * F.col("bytes"))))


def perplexity(scored: DataFrame, batch: str, keys: Sequence[str] = (), loss: str = "loss",
               token_weighted: bool = False) -> DataFrame:
    """(keys, loss, ppl). The default averages batch means, so a short last batch weighs as much as a
    full one; `token_weighted` averages tokens. ppl = exp(min(20, loss))."""
    if token_weighted:
        out = scored.groupBy(*keys).agg(F.avg(loss).alias("loss"))
    else:
        out = scored.groupBy(*keys, batch).agg(F.avg(loss).alias("__m")).groupBy(*keys).agg(
            F.avg("__m").alias("loss"))
    return out.withColumn("ppl", F.exp(F.least(F.lit(20.0), F.col("loss"))))


def cross_entropy(scores: DataFrame, group: Sequence[str], item: str, score: str, target: str) -> DataFrame:
    """(group, ce) = logsumexp(scores) - score of the target; ignored targets (< 0) drop out."""
    kept = scores.where(F.col(target) >= 0)
    top = kept.groupBy(*group).agg(F.max(score).alias("__max"))
    centred = kept.join(top, list(group))
    return centred.groupBy(*group).agg(
        (F.max("__max") + F.log(F.sum(F.exp(F.col(score) - F.col("__max"))))
         - F.max(F.when(F.col(item) == F.col(target), F.col(score)))).alias("ce"))


def accuracy(df: DataFrame, keys: Sequence[str], correct: str = "correct") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"),
        F.sum(F.col(correct).cast("long")).alias("passed"))


def with_baseline(acc: DataFrame, baselines: DataFrame, key: str = "task") -> DataFrame:
    """Baselines of the tasks; a task without one keeps its row."""
    return acc.join(baselines, key, "left")


def centered(acc: Column, baseline: Column, percent: bool = True) -> Column:
    base = baseline * 0.01 if percent else baseline
    return (acc - base) / (1.0 - base)


def core_metric(acc: DataFrame, baselines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean centered accuracy over tasks; baselines in percent. Null where a task has no baseline: a mean over the
    others would not be the metric."""
    joined = with_baseline(acc, baselines)
    mean = F.avg(centered(F.col("accuracy"), F.col("random_baseline")))
    return joined.groupBy(*keys).agg(
        F.when(F.count("random_baseline") == F.count("*"), mean).alias("core"),
        F.count("*").alias("n_tasks"))


def chatcore(acc: DataFrame, keys: Sequence[str] = (), baselines: dict[str, float] = CHAT_BASELINES,
             categorical: Sequence[str] = CATEGORICAL_TASKS) -> DataFrame:
    """(keys, chatcore, chatcore_cat): mean centered accuracy, null unless every task is present."""
    base = F.lit(None).cast("double")
    for name, value in baselines.items():
        base = F.when(F.col("task") == name, F.lit(value)).otherwise(base)
    c = centered(F.col("accuracy"), base, percent=False)
    is_cat = F.col("task").isin(*categorical)
    known = acc.where(F.col("task").isin(*baselines))

    def guarded(value: Column, cond: Column, n: int) -> Column:
        return F.when(F.count_distinct(F.when(cond, F.col("task"))) == n, value)

    return known.groupBy(*keys).agg(
        guarded(F.avg(c), F.lit(True), len(baselines)).alias("chatcore"),
        guarded(F.avg(F.when(is_cat, c)), is_cat, len(categorical)).alias("chatcore_cat"))


def categorical_predict(logits: DataFrame, letter_logits: Sequence[str] = ("letter", "letter_pos", "logit"),
                        keys: Sequence[str] = ("task", "idx")) -> DataFrame:
    """Best allowed letter per item; the earliest letter wins ties. Input rows are allowed letters only."""
    letter, pos, logit = letter_logits
    return logits.groupBy(*keys).agg(
        F.max_by(letter, F.struct(F.col(logit), -F.col(pos))).alias("predicted"),
        F.array_sort(F.collect_set(letter)).alias("letters"))


def categorical_correct(predicted: DataFrame, gold: DataFrame, keys: Sequence[str] = ("task", "idx")) -> DataFrame:
    joined = predicted.join(gold, list(keys))
    return joined.withColumn("correct", letter_correct(F.col("predicted"), F.col("gold"), F.col("letters")))


def mc_correct(scored: DataFrame, spans: DataFrame, keys: Sequence[str] = ("task", "idx")) -> DataFrame:
    """(keys, pred_opt, correct) from per-token losses (keys, opt, pos, loss) and spans (keys, opt,
    span_start, span_end, gold). The loss at pos predicts pos+1, so the window is [start-1, end-1).
    An empty window scores +inf; the first option wins ties. Both sides are shuffled: rows made by an explode look
    no larger to Spark than the table they come from, and would be broadcast."""
    on = [*keys, "opt"]
    inside = (F.col("pos") >= F.col("span_start") - 1) & (F.col("pos") < F.col("span_end") - 1)
    joined = spans.join(scored.hint("merge"), on, "left")
    per_opt = joined.groupBy(*on, "gold").agg(
        F.coalesce(F.avg(F.when(inside, F.col("loss"))), F.lit(float("inf"))).alias("mean_loss"))
    best = per_opt.groupBy(*keys, "gold").agg(F.min_by("opt", F.struct("mean_loss", "opt")).alias("pred_opt"))
    return best.withColumn("correct", F.col("pred_opt") == F.col("gold"))


def lm_correct(scored: DataFrame, spans: DataFrame, keys: Sequence[str] = ("task", "idx")) -> DataFrame:
    """(keys, correct): every predicted token over the span equals the token that follows. `scored` has
    (keys, pos, tok, pred); pred at pos is for pos+1. All sides are shuffled, as in `mc_correct`."""
    preds = scored.select(*keys, (F.col("pos") + 1).alias("pos"), "pred")
    toks = scored.select(*keys, "pos", "tok")
    both = toks.join(preds.hint("merge"), [*keys, "pos"], "left").join(spans.hint("merge"), list(keys))
    inside = (F.col("pos") >= F.col("span_start")) & (F.col("pos") < F.col("span_end"))
    return both.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.when(inside, F.col("pred").eqNullSafe(F.col("tok")))), F.lit(True)).alias("correct"))


def pass_at_k(outcomes: DataFrame, n: int, keys: Sequence[str] = (), problem: str = "problem",
              sample: str = "sample", correct: str = "correct") -> DataFrame:
    """(keys, k, pass_at_k): share of problems with a correct answer among their first k samples. Each
    problem shrinks to its first correct sample, problems shrink to a histogram, and only that is
    expanded over k."""
    first = outcomes.groupBy(*keys, problem).agg(
        F.coalesce(F.min(F.when(F.col(correct), F.col(sample))), F.lit(2**31 - 1)).alias("__first"))
    hist = first.groupBy(*keys, F.least(F.col("__first"), F.lit(n)).alias("__first")).agg(F.count("*").alias("__n"))
    grid = hist.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return grid.groupBy(*keys, "k").agg(
        (F.sum(F.when(F.col("__first") < F.col("k"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias("pass_at_k"))


def any_pass(outcomes: DataFrame, problem: Sequence[str] = ("problem",), correct: str = "correct") -> DataFrame:
    return outcomes.groupBy(*problem).agg(F.bool_or(correct).alias("passed"))


def prefix_any(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, out: str = "any_so_far",
               **kw) -> DataFrame:
    """True once any row up to here was true."""
    return scan(df, order, {"__any": ("max", F.col(flag).cast("int"))}, keys, **kw).withColumn(
        out, F.col("__any") == 1).drop("__any")


def advantages(rollouts: DataFrame, prompt: str = "prompt", reward: str = "reward") -> DataFrame:
    """reward - mean reward of its prompt. Means are joined back, so a hot prompt stays spread out."""
    means = rollouts.groupBy(prompt).agg(F.avg(reward).alias("__mean"))
    return rollouts.join(means, prompt).withColumn("advantage", F.col(reward) - F.col("__mean")).drop("__mean")


def rollout_stats(rollouts: DataFrame, keys: Sequence[str] = (), prompt: str = "prompt", reward: str = "reward",
                  length: str = "n_tokens") -> DataFrame:
    """Mean of per-prompt mean rewards, and mean sequence length over all samples."""
    per = rollouts.groupBy(*keys, prompt).agg(
        F.avg(reward).alias("__r"), F.sum(length).alias("__l"), F.count("*").alias("__n"))
    return per.groupBy(*keys).agg(
        F.avg("__r").alias("mean_reward"), (F.sum("__l") / F.sum("__n")).alias("mean_length"))


def pg_weights(tokens: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Normaliser of one policy-gradient pass: its count of supervised targets, at least 1."""
    return tokens.groupBy(*keys).agg(F.greatest(F.count_if(F.col(target) >= 0), F.lit(1)).alias("n_valid"))


def by_subject(df: DataFrame, task: str = "task", subject: str = "subject", correct: str = "correct") -> DataFrame:
    """Accuracy per (task, subject), with task totals where subject is null."""
    return df.rollup(task, subject).agg(
        F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n")).where(F.col(task).isNotNull())


def metric_map(df: DataFrame, keys: Sequence[str], name: Column, value: str) -> DataFrame:
    """One MAP<name, value> per key; names are metric names, a handful per run."""
    return df.groupBy(*keys).agg(F.map_from_entries(
        F.array_sort(F.collect_set(F.struct(name.alias("k"), F.col(value).alias("v"))))).alias("metrics"))
