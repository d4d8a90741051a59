"""Document shards, token stores and their sinks."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palinode.operators.selection import drop_blank, skip
from palinode.operators.store import token_dtype


def read_corpus(spark: SparkSession, path: str, columns: list[str] | None = None, position: bool = False) -> DataFrame:
    """Parquet shards with their file name (and `row_index` in the file, with `position`); temporary files
    are not shards. Columns prune to the scan."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    where = [F.col("_metadata.file_name").alias("file")]
    if position:
        where.append(F.col("_metadata.row_index").alias("row_index"))
    return df.select(*(columns or df.columns), *where)


def shard_names(spark: SparkSession, path: str) -> DataFrame:
    """(file), from the listing alone: no document is read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listing.select(F.element_at(F.split("path", "/"), -1).alias("file"))


def split_by_shard(df: DataFrame, last_file: str, split: str) -> DataFrame:
    """Validation is the last shard by name, training all others. Files of the other split are skipped
    by the scan."""
    if split not in ("train", "val"):
        raise ValueError("split must be train or val")
    return df.where(F.col("file") == last_file) if split == "val" else df.where(F.col("file") < last_file)


def read_split(spark: SparkSession, path: str, split: str, columns: list[str] | None = None) -> DataFrame:
    names = shard_names(spark, path).agg(F.max("file").alias("last"), F.count_distinct("file").alias("n")).first()
    if names["n"] == 0:
        raise FileNotFoundError(f"no parquet shards in {path}")
    if names["n"] == 1 and split == "train":
        raise ValueError("a single shard leaves no training split; use split_by_hash")
    return split_by_shard(read_corpus(spark, path, columns), names["last"], split)


def text_column(df: DataFrame, field: str = "text") -> Column:
    """The named field, else the first string column with a value in it."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    ordered = ([field] if field in df.columns else []) + [s for s in strings if s != field]
    if not ordered:
        raise ValueError("no text column")
    return F.coalesce(*[F.col(c).cast("string") for c in ordered])


def read_text(df: DataFrame, field: str = "text", skip_rows: int = 0, order: str | None = None) -> DataFrame:
    """(order?, text): the text stream without blanks, the first rows in `order` skipped."""
    picked = df.select(*([order] if order else []), text_column(df, field).alias("text"))
    if skip_rows:
        picked = skip(picked, skip_rows, order)
    return drop_blank(picked)


def write_shards(docs: DataFrame, plan: DataFrame, id_col: str, path: str, text: str = "text") -> None:
    """Write a repackaging plan: one folder per shard, zstd level 3, no dictionary, row groups of 1,024."""
    placed = docs.select(id_col, text).join(plan, id_col)
    (placed.repartitionByRange("shard_id", "position").sortWithinPartitions("shard_id", "position")
     .select("shard_id", text).write.mode("overwrite").partitionBy("shard_id")
     .option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3")
     .option("parquet.enable.dictionary", "false").option("parquet.block.row.count.limit", "1024").parquet(path))


def write_token_store(blocks: DataFrame, path: str, vocab_size: int, **provenance: str) -> None:
    """Blocks as Parquet in stream order, and a one-row JSON of what they are."""
    blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").write.mode("overwrite").parquet(f"{path}/blocks")
    meta = blocks.sparkSession.read.parquet(f"{path}/blocks").agg(
        F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0).cast("long")).alias("num_tokens"),
        F.max(F.size("tokens")).alias("block_len"))
    meta.select(F.lit(token_dtype(vocab_size)).alias("dtype"), "num_tokens", "block_len",
                F.lit(vocab_size).alias("vocab_size"),
                *[F.lit(v).alias(k) for k, v in provenance.items()]).write.mode("overwrite").json(f"{path}/meta")


def read_token_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = spark.read.json(f"{path}/meta").first().asDict()
    return spark.read.parquet(f"{path}/blocks"), meta


def write_raw_tokens(blocks: DataFrame, path: str, vocab_size: int, num_tokens: int) -> None:
    """Flat little-endian file plus JSON sidecar on a shared POSIX folder. Every task writes its blocks at
    their final offsets, so a retried task rewrites the same bytes."""
    dtype = token_dtype(vocab_size)
    width = np.dtype(dtype).itemsize
    with open(path, "wb") as f:
        f.truncate(num_tokens * width)

    def write(batches):
        with open(path, "r+b") as f:
            for batch in batches:
                for pos, tokens in zip(batch["pos0"], batch["tokens"]):
                    f.seek(int(pos) * width)
                    f.write(np.asarray(tokens).astype(dtype).tobytes())
                yield pd.DataFrame({"n": [len(batch)]})

    blocks.select("pos0", "tokens").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    with open(f"{path}.json", "w", encoding="utf-8") as f:
        json.dump({"dtype": dtype, "num_tokens": num_tokens, "vocab_size": vocab_size}, f)


def read_raw_tokens(spark: SparkSession, path: str, block_len: int = 65_536) -> DataFrame:
    """(block_id, pos0, tokens) of a flat uint16 / uint32 file: each task reads its own byte ranges."""
    with open(f"{path}.json", encoding="utf-8") as f:
        meta = json.load(f)
    dtype, total = np.dtype(meta["dtype"]), int(meta["num_tokens"])

    def read(batches):
        for batch in batches:
            rows = []
            for block in batch["id"]:
                n = min(block_len, total - int(block) * block_len)
                data = np.fromfile(path, dtype, count=n, offset=int(block) * block_len * dtype.itemsize)
                rows.append((block, int(block) * block_len, data.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["block_id", "pos0", "tokens"])

    ranges = spark.range(-(-total // block_len))
    return ranges.mapInPandas(read, "block_id long, pos0 long, tokens array<int>")
