"""Token stores, sampling windows and corpus repackaging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.seeded import seed_key, seed_place
from palinode.operators.ordered import dense_index, prefix_sum, scan
from palinode.operators.packing import pack_chop, to_blocks, token_offsets
from palinode.session import cut_lineage


def token_dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 65_535 else "uint32"


def store_blocks(docs: DataFrame, order: str | Sequence[str], eos: int, block_len: int, target_tokens: int = 0,
                 ids: str = "ids") -> DataFrame:
    """(block_id, pos0, tokens): documents plus EOS as one stream, cut to exactly `target_tokens` (0: all),
    in blocks of `block_len` (the last may be short)."""
    ended = docs.where(F.size(ids) > 0).withColumn(ids, F.array_append(ids, eos))
    placed = token_offsets(ended, order, ids, sep=0)
    if target_tokens:
        room = F.least(F.size(ids).cast("long"), F.lit(target_tokens) - F.col("offset")).cast("int")
        placed = placed.where(F.col("offset") < target_tokens).withColumn(ids, F.slice(ids, F.lit(1), room))
    return to_blocks(placed, block_len, ids).select(
        "block_id", (F.col("block_id") * block_len).alias("pos0"), "tokens")


def val_region(num_tokens: int, block_len: int, val_blocks: int) -> dict[str, int]:
    """Start ranges [lo, hi) of training and validation windows over a store. Validation is the tail:
    at least val_blocks windows or 0.2 percent."""
    val = max(block_len * max(1, val_blocks), int(num_tokens * 0.002))
    val = min(val, max(0, num_tokens - block_len - 1))
    return {
        "val_tokens": val,
        "val_lo": max(0, num_tokens - val - block_len), "val_hi": num_tokens - block_len,
        "train_lo": 0, "train_hi": max(1, num_tokens - val - block_len),
    }


def val_blocks(docs: DataFrame, order: str | Sequence[str], eos: int, seq_len: int, n: int, path: str, vocab_size: int,
               ids: str = "ids", rebuild: bool = False) -> DataFrame:
    """The first n full blocks of seq_len + 1 tokens, kept in a folder named by what they depend on and
    read back when it is already complete."""
    spark = docs.sparkSession
    folder = f"{path}/val_blocks_vocab{vocab_size}_seq{seq_len}_n{n}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    exists = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if rebuild or not exists:
        blocks = pack_chop(docs, order, seq_len + 1, eos, ids).where(F.col("block_id") < n)
        blocks.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def sample_windows(store: DataFrame, draws: DataFrame, draw_id: str, lo: int | Column, hi: int | Column,
                   length: int, block_len: int, seed: int = 0) -> DataFrame:
    """(draw_id, start, tokens): one window of `length` tokens per draw at a seeded start in [lo, hi).
    A window lies in at most two neighbouring blocks (length <= block_len), found by equi-join on the
    block number."""
    if length > block_len:
        raise ValueError("a window must fit two neighbouring blocks")
    lo = F.lit(lo) if isinstance(lo, int) else lo
    hi = F.lit(hi) if isinstance(hi, int) else hi
    start = (lo + seed_place(hi - lo, seed, draw_id)).cast("long")
    wanted = draws.select(draw_id, start.alias("start")).withColumn(
        "block_id", F.explode(F.sequence(F.expr(f"start div {block_len}"),
                                         F.expr(f"(start + {length} - 1) div {block_len}"))))
    hit = wanted.join(store, "block_id")
    off = F.greatest(F.col("start") - F.col("pos0"), F.lit(0)).cast("int")
    take = F.least(F.col("start") + length - F.col("pos0"), F.size("tokens").cast("long")).cast("int") - off
    cut = hit.select(draw_id, "start", "block_id", F.slice("tokens", off + 1, F.greatest(take, F.lit(0))).alias("t"))
    return cut.groupBy(draw_id, "start").agg(F.array_sort(F.collect_list(F.struct("block_id", "t"))).alias("g")).select(
        draw_id, "start", F.flatten(F.col("g.t")).alias("tokens"))


def repackage_plan(docs: DataFrame, id_col: str, n_chars: str, chars_per_shard: int, docs_multiple: int = 1024,
                   seed: int = 42, drop_tail: bool = False) -> DataFrame:
    """(id, position, shard_id) of a seeded reshuffle: a shard closes at the first multiple of
    `docs_multiple` documents at which it holds `chars_per_shard` characters.

    Documents shrink to groups of `docs_multiple`. Every group learns where a shard that starts with it
    would end (an as-of lookup over the running sums), and the chain of real shard starts is found by
    pointer doubling: after r rounds of two equi-joins all starts within 2^r shards are marked.
    """
    keyed = docs.select(id_col, F.col(n_chars).cast("long").alias("__chars"), seed_key(seed, id_col).alias("__key"))
    placed = cut_lineage(dense_index(keyed, ["__key", id_col], "position", uniform_hex=True).withColumn(
        "grp", F.expr(f"position div {docs_multiple}")))
    full = placed.groupBy("grp").agg(F.sum("__chars").alias("chars"), F.count("*").alias("n"))
    groups = prefix_sum(full.where(F.col("n") == docs_multiple), ["grp"], "chars", "cum")
    # next start of a shard opening at g: 1 + first group whose running sum reaches cum before g + budget
    ends = groups.select(F.col("cum").alias("at"), F.lit(1).alias("kind"), F.col("grp").alias("end"), F.lit(None).cast("long").alias("g"))
    asks = groups.select((F.col("cum") - F.col("chars") + chars_per_shard).alias("at"), F.lit(0).alias("kind"),
                         F.lit(None).cast("long").alias("end"), F.col("grp").alias("g"))
    both = ends.unionByName(asks).withColumns({
        "__down": -F.col("at"), "__kind": -F.col("kind"), "__tie": -F.coalesce("end", "g")})
    found = scan(both, ["__down", "__kind", "__tie"], {"first_end": ("min", F.col("end"))})
    jump = cut_lineage(found.where((F.col("kind") == 0) & F.col("first_end").isNotNull()).select(
        "g", (F.col("first_end") + 1).alias("nxt")))
    starts = cut_lineage(docs.sparkSession.range(1).select(F.col("id").alias("g")))
    while True:
        reached = starts.join(jump, "g").select(F.col("nxt").alias("g")).join(starts, "g", "left_anti")
        grown = cut_lineage(starts.unionByName(reached))
        if grown.count() == starts.count():
            break
        starts = grown
        far = jump.select(F.col("g").alias("nxt"), F.col("nxt").alias("far"))
        jump = cut_lineage(jump.join(far, "nxt").select("g", F.col("far").alias("nxt")))
    marks = placed.join(starts.withColumnRenamed("g", "grp").withColumn("opens", F.lit(1)), "grp", "left")
    first = F.pmod("position", F.lit(docs_multiple)) == 0
    numbered = prefix_sum(marks, ["position"], F.when(first, F.coalesce("opens", F.lit(0))).otherwise(0), "__shard")
    out = numbered.select(id_col, "position", (F.col("__shard") - 1).cast("long").alias("shard_id"))
    if drop_tail:
        out = out.where(F.col("shard_id") < starts.agg(F.count("*") - 1).scalar())
    return out


def shard_stats(df: DataFrame, shard: str, n_chars: str = "n_chars") -> DataFrame:
    return df.groupBy(shard).agg(F.count("*").alias("docs"), F.sum(n_chars).alias("chars"))
