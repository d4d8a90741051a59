"""Filters, splits, slices and budgets over documents, tasks and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.seeded import seed_key, seed_uniform
from palinode.operators.ordered import dense_index, order_columns, scan


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull() & F.regexp_like(F.col(text), F.lit(r"(?U)\S")))


def drop_empty_tokens(df: DataFrame, ids: str = "ids") -> DataFrame:
    return df.where(F.size(ids) > 0)


def crop_chars(df: DataFrame, cap: int = 10_000, text: str = "text") -> DataFrame:
    """Document crop to `cap` characters: the tokenizer-training option, off everywhere else."""
    return df.withColumn(text, F.substring(text, 1, cap))


def split_by_hash(df: DataFrame, id_col: str, val_frac: float, seed: int = 42) -> DataFrame:
    """Add `split` = train / val by a seeded draw per id."""
    return df.withColumn(
        "split", F.when(seed_uniform(seed, id_col) < F.lit(val_frac), "val").otherwise("train"))


def assign_stream(df: DataFrame, world: int, idx: str = "idx", group: int = 1024) -> DataFrame:
    """Stream of a document: row groups of `group` documents dealt round-robin to `world` streams."""
    row_group = F.floor(F.col(idx) / group).cast("long")
    return df.withColumns({"row_group": row_group, "stream_id": F.pmod(row_group, F.lit(world)).cast("int")})


def assign_stream_by_file(df: DataFrame, world: int, group: int = 1024) -> DataFrame:
    """The same dealing from where a document lies: (file, row_index) of `read_corpus`, every file's row
    groups starting at stream 0. Needs no order, no join and no shuffle."""
    row_group = F.floor(F.col("row_index") / group).cast("long")
    return df.withColumns({"row_group": row_group, "stream_id": F.pmod(row_group, F.lit(world)).cast("int")})


def rank_share(df: DataFrame, rank: int, world: int, idx: str = "idx") -> DataFrame:
    """Items one rank of a strided job would see."""
    return df.where(F.pmod(F.col(idx), F.lit(world)) == rank)


def skip(df: DataFrame, n: int, order: str | Sequence[str]) -> DataFrame:
    """Drop the first n rows in `order`."""
    return dense_index(df, order_columns(order), "__idx").where(F.col("__idx") >= n).drop("__idx")


def char_budget(df: DataFrame, max_chars: int, order: str | Sequence[str], n_chars: str = "n_chars") -> DataFrame:
    """Keep documents while the characters before them are at most `max_chars`: the document that
    crosses the budget is still kept. Adds `chars_before`."""
    return scan(df, order_columns(order), {"chars_before": ("sum", F.col(n_chars))}, exclusive=True).where(
        F.col("chars_before") <= max_chars)


def task_slice(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1,
               idx: str = "idx") -> DataFrame:
    """Logical view [start:stop:step] over a dense index, re-indexed from 0."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError(f"bad slice {start}:{stop}:{step}")
    kept = (F.col(idx) >= start) & (F.pmod(F.col(idx) - start, F.lit(step)) == 0)
    if stop is not None:
        kept = kept & (F.col(idx) < stop)
    return df.where(kept).withColumn(idx, F.floor((F.col(idx) - start) / step).cast("long"))


def slice_length(n: int, start: int = 0, stop: int | None = None, step: int = 1) -> int:
    end = n if stop is None else stop
    return -((start - end) // step)


def cap_per_task(df: DataFrame, task: str, item: str, n: int, seed: int = 1337) -> DataFrame:
    """A seeded sample of n items per task (the evaluation cap); n <= 0 keeps all.

    The rank filter is a group limit Spark already applies before the shuffle.
    """
    if n <= 0:
        return df
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(task).orderBy(seed_key(seed, task, item), item))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def comparable_tasks(df: DataFrame, k_a: str, k_b: str) -> DataFrame:
    """Tasks both protocols ran zero-shot, or both ran with shots."""
    return df.where((F.col(k_a) == 0) == (F.col(k_b) == 0))


def clean_runs(df: DataFrame, exclude: dict[str, list] | None = None) -> DataFrame:
    """Finished runs: a positive validation score; optionally without listed budgets or depths."""
    kept = df.where(F.col("val_bpb").isNotNull() & (F.col("val_bpb") > 0))
    for name, values in (exclude or {}).items():
        kept = kept.where(~F.col(name).isin(values))
    return kept


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Grid points without a finished run."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def filter_log_lines(df: DataFrame, pattern: str, line: str = "line") -> DataFrame:
    return df.where(F.col(line).rlike(pattern))


def first_blocks(df: DataFrame, n: int, block: str = "block_id") -> DataFrame:
    return df.where(F.col(block) < n)


def resume_after(df: DataFrame, file: Column, row_group: Column, state: tuple[str, int] | None) -> DataFrame:
    """Rows behind a saved (file, row group) position; the saved group itself is not repeated."""
    if state is None:
        return df
    at_file, at_group = state
    return df.where((file > F.lit(at_file)) | ((file == F.lit(at_file)) & (row_group > F.lit(at_group))))


def epochs(df: DataFrame, n: int) -> DataFrame:
    """Every row once per epoch, epochs numbered from 1."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))


def epoch_no(idx: Column, n: int) -> Column:
    return (F.floor(idx / n) + 1).cast("long")


def batch_no(idx: Column, size: int) -> Column:
    return F.floor(idx / size).cast("long")
