"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Each rule is a reject condition on a document and the work that asking it takes: characters read and numbers compared.
On a bounded sample (default 1,000 rows, those of the least hashes of their row numbers) one job counts the rejections and
sums the work of every rule, so equal tables give equal orders. The cascade asks the rules by rejections per unit of work, each only of documents that passed the ones before (a CASE stops at the first
branch that holds). The order decides the cost and which rule is named first, never what is kept.

All features are expressions inside the row: nothing is shuffled. Windows of words are compared as 64-bit hashes;
repeated ones are found by sorting (hash, position) of documents that have any.

Defined results: null, empty and white-space texts have no words and fail the base rule; a text of fewer than five
words has no window; lines without a word are no lines; repeated rows are judged alike; texts are taken whole, in
memory of one row; an empty table gives an empty result; other columns pass through, and one named like
an output or a working column gets `_in` appended to its name.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.llm.names import set_aside
from palinode.llm.scratch import stored

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*FEATURES, "base_failed", "kept", "rejected_by")


def with_features(df: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """The table with the columns of FEATURES, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = [F.col(f"`{c}`") for c in df.columns]
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    staged = df.select(*names, F.array_remove(F.split(body, SPACES, -1), "").alias("__w"), lines.alias("__l"))
    staged = staged.select(*names, "__w", "__l", F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))

    def gram(x: Column, i: Column) -> Column:
        return F.xxhash64(x, *[F.get("__h", i + k) for k in range(1, window)])

    heads = F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (window - 1), F.lit(0)))
    staged = staged.select(*names, "__w", "__l", F.transform(heads, gram).alias("__g"))
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    runs = F.when(some, F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    staged = staged.select(*names, "__w", "__l", runs.alias("__r"))
    twin = F.filter("__r", lambda r, k: F.coalesce(
        (r["g"] == F.get("__r", k - 1)["g"]) | (r["g"] == F.get("__r", k + 1)["g"]),
        r["g"] == F.get("__r", k - 1)["g"], r["g"] == F.get("__r", k + 1)["g"]))
    staged = staged.select(*names, "__w", "__l", F.sort_array(F.transform(twin, lambda r: r["i"])).alias("__p"))
    cover = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(window), F.coalesce(
        F.get("__p", k + 1) - p, F.lit(window)))), F.lit(0), lambda s, x: s + x)
    return staged.select(
        *names, F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


class Rule(NamedTuple):
    """A reject condition and what asking it of a row takes, in characters read and numbers compared."""

    fails: Column
    work: Column


def default_rules(text: str = "text") -> dict[str, Rule]:
    """Reject conditions over the features and, for the dearer ones, the text itself."""
    body = F.coalesce(F.col(text), F.lit(""))
    signs = F.regexp_count(body, F.lit(r"[!-@\[-`{-~]"))  # digits and ASCII signs
    two, whole = F.lit(2), F.char_length(body)
    return {
        "symbols": Rule(10 * F.col("n_symbols") > F.col("n_words") * 3, two),
        "short_words": Rule(F.col("word_chars") < 2 * F.col("n_words"), two),
        "long_words": Rule(F.col("word_chars") > 20 * F.col("n_words"), two),
        "dup_lines": Rule((F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")), 2 * two),
        "few_letters": Rule(3 * signs > 2 * F.col("word_chars"), whole + two),
        "capitals": Rule(2 * F.regexp_count(body, F.lit("[A-Z]")) > F.col("word_chars"), whole + two),
        "shouting": Rule(5 * F.regexp_count(body, F.lit("!!")) > F.col("n_words"), whole + two),
    }


def order_rules(sample: DataFrame, rules: Mapping[str, Rule]) -> list[str]:
    """Names of the rules by rejections per unit of work on the sample, best first; equal ones as they are given."""
    if not rules:
        return []
    sums = [F.struct(F.count_if(r.fails).alias("hits"), F.sum(r.work.cast("long")).alias("work")).alias(n) for n, r in rules.items()]
    seen = sample.agg(*sums).first()
    gain = {n: (seen[n]["hits"] + 0.5) / ((seen[n]["work"] or 0) + 1) for n in rules}
    return sorted(rules, key=lambda n: -gain[n])


def judge(df: DataFrame, text: str = "text", rules: Mapping[str, Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """The table with the features, base_failed, rejected_by (the rule that stopped the cascade, `base` for the base
    rule, else null) and kept."""
    df, text = set_aside(df, [*OUTPUTS, *(f"__{x}" for x in "wlhgrp")], text)
    rules = default_rules(text) if rules is None else dict(rules)
    every = max(1, df.count() // sample_rows)
    numbered = df.select(F.col(text), F.xxhash64(F.monotonically_increasing_id()).alias("__n"))
    picked = numbered.where(F.pmod("__n", F.lit(every)) == 0).orderBy("__n").limit(sample_rows).select(F.col(text))
    order = order_rules(stored(with_features(picked, text), "quality-sample"), rules)
    cascade = F.when(base_failed(), "base")
    for name in order:
        cascade = cascade.when(rules[name].fails, name)
    rows = with_features(df, text)
    return rows.select("*", base_failed().alias("base_failed"), cascade.alias("rejected_by")).withColumn(
        "kept", F.col("rejected_by").isNull())
