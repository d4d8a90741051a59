"""Training corpus from documents: language, near duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and, but for the last, returns
the columns of documents. Its result is written as Parquet and read again as the input of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.llm.byte_bpe import encode
from palinode.llm.decontaminate import decontaminate
from palinode.llm.language_id import UNKNOWN, identify, train
from palinode.llm.ngram_join import jaccard_components
from palinode.llm.scratch import stored
from palinode.llm.secret_scan import redact


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter (or null) go. Ties, repeated rows and nulls in other
    columns change nothing; an empty table stays empty; columns are judged under names of their own, so none can clash."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    judged = identify(plain, train(docs), text=f"c{docs.columns.index('text')}")
    return judged.where(F.col("lang_pred") != UNKNOWN).select(*plain.columns).toDF(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = 2_000_000) -> DataFrame:
    """One document of every group linked by near copies: the one with the smallest id, null ids last, then the one with the
    smallest hash. A node is a 64-bit hash of id and text, so documents that only share an id are apart; rows alike in
    both are copies, of which the least in the other columns stays. Rows with no text or words are linked with nothing. No
    text moves while at most `most` nodes go or are repeated (16 MB of ids)."""
    node = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("no id")), F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), node.alias("node"))
    linked = jaccard_components(docs.select(node.alias("node"), "text"), "node").select("node", "component_id")
    named = docs.select(node.alias("node"), "doc_id").groupBy("node").agg(F.first("doc_id").alias("id"), F.count("*").alias("n"))
    groups = stored(linked.distinct().join(named, "node"), "near-copy-groups")
    place = F.struct(F.col("id").isNull(), "id", "node")
    kept = groups.groupBy("component_id").agg(F.min_by("node", place).alias("kept"))
    gone = groups.join(kept, "component_id").where("node <> kept").select("node")
    repeated = groups.where("n > 1").select("node")

    def sendable(nodes: DataFrame) -> DataFrame:
        nodes = stored(nodes, "near-copy-nodes")
        return F.broadcast(nodes) if nodes.count() <= most else nodes

    stay, repeated = rows.join(sendable(gone), "node", "left_anti"), sendable(repeated)
    others = F.to_json(F.struct(*[F.col("doc")[c] for c in docs.columns if c != "text"]))
    one = stay.join(repeated, "node", "left_semi").groupBy("node").agg(F.min_by("doc", others).alias("doc"))
    return stay.join(repeated, "node", "left_anti").select("doc.*").union(one.select("doc.*"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of what they decode to."""
    return encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                  public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("secret_scan", redact_secrets),
    ("byte_bpe", to_token_ids),
]

# The language model and the token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
