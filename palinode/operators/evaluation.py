"""Task plug-ins: how a table becomes conversations and how a response is judged, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.text import answer_correct, extract_answer, letter_correct
from palinode.operators import metrics
from palinode.sources import tasks


def _last_text(messages: Column) -> Column:
    """Text of the last part of the last message, where the answer stands."""
    return F.element_at(F.element_at(messages, -1)["parts"], -1)["text"]


def _by_answer(df: DataFrame) -> Column:
    return answer_correct(extract_answer(F.col("response")), extract_answer(_last_text(F.col("messages"))))


def _by_letter(df: DataFrame) -> Column:
    return letter_correct(F.col("response"), _last_text(F.col("messages")), F.col("letters"))


def _by_flag(df: DataFrame) -> Column:
    """Programs run outside: their outcome arrives as a column."""
    return F.col("passed")


@dataclass(frozen=True)
class Task:
    to_conversations: Callable[..., DataFrame]
    correct: Callable[[DataFrame], Column]
    eval_type: str


REGISTRY: dict[str, Task] = {
    "ARC-Easy": Task(tasks.arc_conversations, _by_letter, "categorical"),
    "ARC-Challenge": Task(tasks.arc_conversations, _by_letter, "categorical"),
    "MMLU": Task(tasks.mmlu_conversations, _by_letter, "categorical"),
    "GSM8K": Task(tasks.gsm8k_conversations, _by_answer, "generative"),
    "SpellingBee": Task(tasks.generated_conversations, _by_answer, "generative"),
    "HumanEval": Task(tasks.humaneval_conversations, _by_flag, "generative"),
}


def register(name: str, task: Task) -> None:
    REGISTRY[name] = task


def evaluate(name: str, convs: DataFrame, responses: DataFrame) -> DataFrame:
    """(task, conv_id, sample, correct) of one task's responses (conv_id, sample, response [, passed])."""
    task = REGISTRY[name]
    joined = convs.join(responses, "conv_id")
    return joined.select(F.lit(name).alias("task"), "conv_id", "sample", task.correct(joined).alias("correct"))


def reward(name: str, convs: DataFrame, responses: DataFrame) -> DataFrame:
    """The outcome as 0.0 / 1.0."""
    return evaluate(name, convs, responses).withColumn("reward", F.col("correct").cast("double")).drop("correct")


def evaluate_all(results: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(task, accuracy, n, passed): a problem passes if any of its samples does."""
    judged = reduce(lambda a, b: a.unionByName(b), [evaluate(n, c, r) for n, (c, r) in results.items()])
    return metrics.accuracy(metrics.any_pass(judged, ["task", "conv_id"]), ["task"], "passed")


def letter_logits(item_logits: DataFrame, items: DataFrame, letter_tokens: DataFrame) -> DataFrame:
    """(task, idx, letter, letter_pos, logit): each item's allowed letters with the logit of the letter's
    token at the answer position. `item_logits` is (task, idx, token_id, logit), `items` carries `letters`,
    `letter_tokens` is (letter, token_id). Both sides of the lookup are keyed by (item, token)."""
    asked = items.select("task", "idx", F.posexplode("letters").alias("letter_pos", "letter")).join(letter_tokens, "letter")
    return asked.join(item_logits, ["task", "idx", "token_id"]).select("task", "idx", "letter", "letter_pos", "logit")
