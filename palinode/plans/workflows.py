"""The reference workflows end to end, as plans over the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.seeded import seed_key, seed_pick, seed_uniform
from palinode.functions.sequences import mask_targets, shift, tail
from palinode.operators import bpe, conversations, language_model, metrics, mixture, packing
from palinode.operators.ordered import order_columns
from palinode.operators.selection import assign_stream_by_file, cap_per_task, char_budget, crop_chars, drop_blank


def direction_bpb(docs: DataFrame, keys: list[str], val_frac: float = 0.2, seed: int = 42, alpha: float = 10.0,
                  id_col: str = "doc_id") -> DataFrame:
    """Is text easier to predict forwards or backwards, per key? A count model trained on a seeded split,
    scored in bits per byte on the rest."""
    is_val = seed_uniform(seed, id_col) < F.lit(val_frac)
    return language_model.bpb_by_direction(drop_blank(docs), keys, is_val, alpha=alpha)


def train_tokenizer(docs: DataFrame, vocab_size: int, order: str | Sequence[str] = "doc_id",
                    max_chars: int | None = None, doc_cap: int | None = None) -> bpe.Vocabulary:
    """Tokenizer training: pre-tokens of all text counted and merged. On request documents are cropped to `doc_cap`
    characters, and taken in order up to a budget of `max_chars`."""
    kept = docs.select(*order_columns(order), "text")
    if doc_cap is not None:
        kept = crop_chars(kept, doc_cap)
    if max_chars is not None:
        kept = char_budget(kept.withColumn("n_chars", F.length("text").cast("long")), max_chars, order)
    return bpe.train_bpe(bpe.pretoken_counts(kept), vocab_size)


def corpus_rows(docs: DataFrame, vocab: bpe.Vocabulary, seq_len: int, world: int, reverse: bool = False,
                group: int = 1024, **kw) -> DataFrame:
    """Documents (text, file, row_index) to (inputs, targets): encode with BOS where the text lies, deal
    row groups to streams, best-fit pack. The one shuffle moves cropped token arrays, never text."""
    dealt = assign_stream_by_file(drop_blank(docs), world, group)
    encoded = bpe.encode(dealt, vocab, prepend="<|bos|>").drop("text")
    packed = packing.pack_bestfit_crop(encoded, seq_len, ["file", "row_index"], reverse=reverse,
                                       bos=vocab.special_ids["<|bos|>"], **kw)
    return packing.train_rows(packed)


def chat_rows(turns: DataFrame, vocab: bpe.Vocabulary, seq_len: int, world: int, seed: int = 42, **kw) -> DataFrame:
    """Turns to supervised rows: validate, render, deal to streams in a seeded order, pad-pack, mask targets.
    Stream and order are draws on the conversation id, so rendering happens once and is moved once."""
    specials = vocab.special_ids
    rendered = conversations.render_turns(
        turns, specials=specials, encode=lambda df, text, out: bpe.encode(df, vocab, text, out))
    dealt = rendered.withColumns({"shuffle_key": seed_key(seed, "conv_id"),
                                  "stream_id": seed_pick(world, f"{seed}s", "conv_id").cast("int")})
    packed = packing.pack_bestfit_pad(dealt, seq_len, ["shuffle_key", "conv_id"], specials["<|bos|>"], **kw)
    return packing.train_rows(packed)


def benchmark_spans(items: DataFrame, task_type: str, shots: int, delim: str = " ", max_per_task: int = 0,
                    payload: tuple[str, ...] = (), **kw) -> DataFrame:
    """Items to scored sequences: cap, few-shot, prompts, tokens, spans."""
    kept = cap_per_task(items, "task", "item_id", max_per_task)
    ready = kept
    if shots:
        ready = kept.join(mixture.fewshot(kept, shots, payload=payload), ["task", "item_id"])
    prompted = ready.withColumn("prompts", mixture.prompts(ready, task_type, delim))
    return mixture.spans(prompted, task_type, ["task", "item_id"], **kw)


def core_report(correct: DataFrame, baselines: DataFrame) -> DataFrame:
    """(task, accuracy, centered) from per-item outcomes."""
    acc = metrics.with_baseline(metrics.accuracy(correct, ["task"]), baselines)
    return acc.withColumn("centered", metrics.centered(F.col("accuracy"), F.col("random_baseline")))


def supervised(ids: Column, mask: Column) -> tuple[Column, Column]:
    """(inputs, targets) of one rendered conversation."""
    inputs, targets = shift(ids)
    return inputs, mask_targets(targets, tail(mask))

