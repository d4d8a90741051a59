"""Task sets: mixing, sequencing, few-shot exemplars, prompts and their answer spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.seeded import seed_key, seed_place
from palinode.functions.sequences import answer_spans, left_crop, lm_prefix_ok
from palinode.functions.text import lm_prompts, mc_prompts, schema_prompts
from palinode.functions.tokens import BOS, byte_ids
from palinode.operators.ordered import dense_index


def union_tagged(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Bag union with the origin in a column."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(tag, F.lit(k)) for k, df in tables.items()])


def _numbered(tasks: Sequence[DataFrame], local: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [
        t.withColumns({"task_idx": F.lit(i), "local_idx": F.col(local)}) for i, t in enumerate(tasks)])


def task_mixture(tasks: Sequence[DataFrame], local: str = "idx", seed: int = 42) -> DataFrame:
    """All (task_idx, local_idx) in one seeded order, `idx` dense over the whole. A task listed twice
    counts as two epochs."""
    bag = _numbered(tasks, local).withColumn("__key", seed_key(seed, "task_idx", "local_idx"))
    return dense_index(bag.drop(local), ["__key", "task_idx", "local_idx"], "idx", uniform_hex=True).drop("__key")


def task_sequence(tasks: Sequence[DataFrame], local: str = "idx") -> DataFrame:
    """Tasks one after the other; `idx` is dense. Lengths are counted once, offsets are literals per task."""
    bag = _numbered(tasks, local)
    sizes = {r["task_idx"]: r["n"] for r in bag.groupBy("task_idx").agg(F.count("*").alias("n")).collect()}
    offset, at = F.lit(0).cast("long"), 0
    for i in range(len(tasks)):
        offset = F.when(F.col("task_idx") == i, F.lit(at).cast("long")).otherwise(offset)
        at += sizes.get(i, 0)
    return bag.drop(local).withColumn("idx", offset + F.col("local_idx"))


def fewshot(items: DataFrame, k: int, task: str = "task", item: str = "item_id", payload: Sequence[str] = (),
            seed: int = 1234) -> DataFrame:
    """(task, item, shots): k distinct other items of the task, seeded per item. A task of k items or fewer is an error.

    Items sit on a seeded ring per task and look at k distinct offsets of 1..n-1, which rules out the item itself. The offsets
    are drawn by Floyd's sampling: for i = n-k .. n-1 a seeded draw of 1..i is taken, or i itself if that is
    taken already, so every set of k items is alike likely whatever n is; they are shown in seeded order. The lookup joins on (task, place),
    unique on one side, so no task is paired with itself and a hot task spreads over its places.
    """
    ring = dense_index(items.withColumn("__key", seed_key(seed, task, item)), ["__key", item], "__place", [task],
                       uniform_hex=True)
    sizes = items.groupBy(F.col(task).alias("__task")).agg(F.count("*").alias("__n"))
    enough = F.when(F.col("__n") > k, F.col("__n")).otherwise(
        F.raise_error(F.concat(F.lit(f"{k} shots need more than {k} items in task "), F.col(task).cast("string"))).cast("long"))
    placed = ring.join(sizes, F.col(task) == F.col("__task")).withColumn("__n", enough)
    def taken(chosen: Column, i: Column) -> Column:
        draw = seed_place(i, f"{seed}o", task, item, i) + 1
        return F.array_append(chosen, F.when(F.array_contains(chosen, draw), i).otherwise(draw))

    offsets = F.aggregate(F.sequence(F.col("__n") - k, F.col("__n") - 1), F.array().cast("array<bigint>"), taken)
    asks = placed.select(task, item, "__place", "__n", F.explode(offsets).alias("__o")).select(
        task, item, seed_key(f"{seed}p", task, item, F.col("__o")).alias("__j"),
        F.pmod(F.col("__place") + F.col("__o"), F.col("__n")).alias("__place"))
    shown = ring.select(F.col(task).alias("__t"), F.col("__place").alias("__p"),
                        F.struct(F.col(item).alias("shot_id"), *payload).alias("__shot"))
    hit = asks.join(shown, (F.col(task) == F.col("__t")) & (F.col("__place") == F.col("__p")))
    return hit.groupBy(task, item).agg(F.array_sort(F.collect_list(F.struct("__j", "__shot"))).alias("g")).select(
        task, item, F.col("g.__shot").alias("shots"))


def prompts(items: DataFrame, task_type: str, delim: str = " ") -> Column:
    """Prompt array of an item row with the columns of its task type and, for few-shot, `shots`."""
    shots = F.col("shots") if "shots" in items.columns else None
    if task_type == "multiple_choice":
        return mc_prompts(F.col("query"), F.col("choices"), shots, delim)
    if task_type == "schema":
        return schema_prompts(F.col("context_options"), F.col("continuation"), shots, delim)
    if task_type == "language_modeling":
        return lm_prompts(F.col("context"), F.col("continuation"), shots, delim)
    raise ValueError(f"unsupported task type: {task_type}")


def spans(df: DataFrame, task_type: str, keys: Sequence[str], prompt_col: str = "prompts",
          encode: Callable[[Column], Column] = byte_ids, bos: int = BOS, max_len: int | None = None) -> DataFrame:
    """(keys, opt, ids, span_start, span_end) per scored sequence: BOS-led tokens and the answer span,
    left-cropped to `max_len`. LM items whose short prompt is not a prefix of the long one are dropped."""
    toks = df.select(*keys, F.transform(prompt_col, lambda p: F.array_prepend(encode(p), bos)).alias("seqs"))
    starts, ends = answer_spans(F.col("seqs"), task_type)
    scored = F.col("seqs")
    if task_type == "language_modeling":
        scored = F.slice("seqs", F.lit(2), F.lit(1))
    found = F.arrays_zip(scored.alias("ids"), starts.alias("s"), ends.alias("e"))
    if task_type == "language_modeling":
        # a filter would be pushed below the encoding and encode every prompt again for each of its terms
        found = F.when(lm_prefix_ok(F.get("seqs", F.lit(0)), F.get("seqs", F.lit(1))), found)
    rows = toks.select(*keys, F.posexplode(found).alias("opt", "z"))
    ids, start, end = F.col("z.ids"), F.col("z.s"), F.col("z.e")
    if max_len is not None:
        ids, start, end = left_crop(ids, start, end, max_len)
    return rows.select(*keys, "opt", ids.alias("ids"), start.alias("span_start"), end.alias("span_end"))


def compare_tokenizers(base: DataFrame, ours: DataFrame, key: str = "name") -> DataFrame:
    """Per text class: tokens and bytes-per-token of both, relative difference in tokens, the better one."""
    b = base.select(key, F.col("bytes"), F.col("tokens").alias("base_tokens"), (F.col("bytes") / F.col("tokens")).alias("base_ratio"))
    o = ours.select(key, F.col("tokens").alias("our_tokens"), (F.col("bytes") / F.col("tokens")).alias("our_ratio"))
    return b.join(o, key).withColumns({
        "relative_diff_pct": (F.col("base_tokens") - F.col("our_tokens")) / F.col("base_tokens") * 100.0,
        "better": F.when(F.col("base_ratio") > F.col("our_ratio"), "base").when(
            F.col("our_ratio") > F.col("base_ratio"), "ours").otherwise("tie")})
