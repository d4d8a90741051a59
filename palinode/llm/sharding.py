"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows of the input partitions are n_1 .. n_P; the shards get the row total divided evenly, at most one row
apart. How many rows go from each partition to each shard is drawn first, for the whole matrix, from the
multivariate hypergeometric law of a uniform permutation (driver: one number per partition and shard). Each
partition then permutes its own rows and deals them by its row of the matrix, the rows are exchanged once, and
every shard permutes what it got. Partition sizes and shard sizes are kept exactly, and every assignment that
keeps them is equally likely.

No shard is held by one task: a place in a shard is the rank of a seeded hash, found with the bucketed scan of
`operators.ordered`. Rows are numbered once and written to the checkpoint folder, so both passes and every
retry see the same partitions.

Defined results: null texts count as no bytes (their size is 1); equal rows, repeated and null keys are rows like
any other and are dealt one by one; an empty table gives an empty result; fewer rows than shards leave shards
empty; other columns pass through, and one named like an output (`shard`, `slot`) or a
working column gets `_in` appended to its name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palinode.llm.names import set_aside
from palinode.llm.scratch import stored
from palinode.operators.ordered import dense_index

_PART, _ROW, _KEY = "__part", "__row", "__key"


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """counts[p, s] of a uniform permutation, given the rows of each partition and the size of each shard."""
    if sum(rows) != sum(shards):
        raise ValueError("partitions and shards must hold the same number of rows")
    rng = np.random.default_rng(seed)
    left = np.array(shards, np.int64)
    out = np.zeros((len(rows), len(shards)), np.int64)
    for p, n in enumerate(rows):
        todo, rest = n, int(left.sum())
        for s in range(len(shards)):  # one hypergeometric draw per cell, in 64-bit integers
            rest -= int(left[s])
            take = _hypergeometric(rng, int(left[s]), rest, todo)
            out[p, s], todo = take, todo - take
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if good < 1_000_000_000 and bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # beyond the generator's range: the normal law the count then follows to many digits; sizes stay exact
    mean = draws * good / (good + bad)
    var = mean * bad / (good + bad) * (good + bad - draws) / max(1, good + bad - 1)
    return int(min(max(round(rng.normal(mean, var**0.5)), draws - bad, 0), good, draws))


def shuffle_shards(df: DataFrame, n_shards: int = 16, seed: int = 42) -> DataFrame:
    """All rows with `shard` (int, 0 .. n_shards - 1) and `slot` (long, the place in the shard, gapless from 0)."""
    df, _ = set_aside(df, ["shard", "slot", _PART, _ROW, _KEY, "__p", "__ends", "__rank"])
    number = F.monotonically_increasing_id()
    rows = stored(df.withColumn(_ROW, number).withColumn(_PART, F.shiftright(_ROW, 33)), "shard-rows")
    sizes = {r[_PART]: r["n"] for r in rows.groupBy(_PART).agg(F.count("*").alias("n")).collect()}
    parts, total = sorted(sizes), sum(sizes.values())
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    ends = df.sparkSession.createDataFrame(
        [(p, np.cumsum(matrix[i]).tolist()) for i, p in enumerate(parts)], "__p long, __ends array<long>")

    # permute locally: rank of a seeded hash inside the partition, dealt by the partition's row of the matrix
    local = W.partitionBy(_PART).orderBy(F.xxhash64(F.lit(seed), F.col(_ROW)), _ROW)
    ranked = rows.withColumn("__rank", F.row_number().over(local) - 1)
    dealt = ranked.join(ends, F.col(_PART) == F.col("__p")).withColumn(
        "shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).cast("int"))
    # permute again inside the shard
    keyed = dealt.drop("__p", "__ends", "__rank", _PART).withColumn(
        _KEY, F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.col(_ROW).cast("string"))))
    placed = dense_index(keyed, [_KEY, _ROW], "slot", ["shard"], uniform_hex=True)
    return placed.drop(_KEY, _ROW)
