"""Byte-pair vocabularies: counting, training, encoding, decoding, token sizes.

Training works on the table of distinct pre-tokens, in epochs (see `bpe_training`). Encoding needs no shuffle: each
Arrow batch is reduced to its distinct pre-tokens, those are merged once, and the ids are gathered back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions.batches import parts
from palinode.functions.tokens import SPECIAL_TOKENS, pretokens
from palinode.operators.bpe_training import train_merges


@dataclass
class Vocabulary:
    """Merges and special tokens; small by construction (the vocabulary size is a parameter)."""

    merges: list[tuple[int, int]]
    specials: Sequence[str] = SPECIAL_TOKENS
    specials_first: bool = False
    symbols: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.symbols = [bytes([i]) for i in range(256)]
        for a, b in self.merges:
            self.symbols.append(self.symbols[a] + self.symbols[b])

    @property
    def shift(self) -> int:
        return len(self.specials) if self.specials_first else 0

    @property
    def special_ids(self) -> dict[str, int]:
        base = 0 if self.specials_first else len(self.symbols)
        return {name: base + i for i, name in enumerate(self.specials)}

    def __len__(self) -> int:
        return len(self.symbols) + len(self.specials)

    def ranks(self) -> dict[bytes, int]:
        """bytes -> id; a byte string reachable by two merges keeps its first id."""
        out: dict[bytes, int] = {}
        for i, b in enumerate(self.symbols):
            out.setdefault(b, i + self.shift)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i + self.shift, bytearray(b), False, len(b)) for i, b in enumerate(self.symbols)]
        rows += [(i, bytearray(name.encode()), True, 0) for name, i in self.special_ids.items()]
        return spark.createDataFrame(rows, "token_id int, bytes binary, is_special boolean, n_bytes int")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, a + self.shift, b + self.shift, 256 + r + self.shift) for r, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, new_id int")


def save_vocab(vocab: Vocabulary, spark: SparkSession, path: str) -> None:
    vocab.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    vocab.merge_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")


def load_vocab(spark: SparkSession, path: str) -> Vocabulary:
    specials = [bytes(r["bytes"]).decode() for r in
                spark.read.parquet(f"{path}/vocab").where("is_special").orderBy("token_id").collect()]
    first = spark.read.parquet(f"{path}/vocab").where("is_special").agg(F.min("token_id")).first()[0]
    shift = len(specials) if first == 0 else 0
    merges = [(r["left"] - shift, r["right"] - shift) for r in
              spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return Vocabulary(merges, tuple(specials), specials_first=first == 0)


def pretoken_counts(df: DataFrame, text: str = "text", split=pretokens) -> DataFrame:
    """(pretoken, freq): partial counts are combined before the shuffle."""
    return df.select(F.explode(split(F.col(text))).alias("pretoken")).groupBy("pretoken").agg(
        F.count("*").alias("freq"))


# ---- training --------------------------------------------------------------------------------------

def train_bpe(counts: DataFrame, vocab_size: int, min_freq: int = 1, specials: Sequence[str] = SPECIAL_TOKENS,
              specials_first: bool = False, **bounds: int) -> Vocabulary:
    """Learn merges from (pretoken, freq): always the most frequent adjacent pair, ties to the lower ids. `bounds` are
    the memory bounds of `train_merges`; they change no merge."""
    n_merges = vocab_size - 256 - len(specials)
    if n_merges < 0:
        raise ValueError("vocabulary must hold 256 bytes and the special tokens")
    return Vocabulary(train_merges(counts, n_merges, min_freq, **bounds), tuple(specials), specials_first)


# ---- encoding --------------------------------------------------------------------------------------

class PieceEncoder:
    """Ids of pre-tokens by ranks of byte strings. A piece is a linked list of parts and a heap of the joins that are
    known, so a long piece costs n log n; short ones met before come from a memo of bounded size, kept by the worker."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 1 << 16, memo_bytes: int = 64) -> None:
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.memo: dict[bytes, list[int]] = {}
        self.memo_size, self.memo_bytes = memo, memo_bytes

    def __call__(self, piece: bytes) -> list[int]:
        found = self.memo.get(piece)
        if found is None:
            found = self.merged(piece)
            if len(piece) <= self.memo_bytes:
                if len(self.memo) >= self.memo_size:
                    self.memo.clear()
                self.memo[piece] = found
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Join the neighbours of the lowest rank, the leftmost of equals, until no join is known."""
        n, ranks = len(piece), self.ranks
        ends = list(range(1, n + 1))  # end of the part that starts at each place; 0 once it is joined to one before
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(start: int) -> None:
            middle = ends[start]
            if middle < n and ends[middle] - start <= self.longest:
                rank = ranks.get(piece[start:ends[middle]])
                if rank is not None:
                    heappush(heap, (rank, start, ends[middle]))

        for start in range(n - 1):
            offer(start)
        while heap:
            _, start, end = heappop(heap)
            middle = ends[start]
            if not middle or middle >= end or ends[middle] != end:
                continue  # one of the two parts has changed
            ends[start], ends[middle] = end, 0
            if end < n:
                before[end] = start
                offer(start)
            if before[start] >= 0:
                offer(before[start])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at:ends[at]]])
            at = ends[at]
        return out


def _gather(tokens: pa.ListArray, encode_one, size: int = 1 << 18) -> pa.ListArray:
    """Ids of the entries of each row; what is held beside input and output is bounded by `size` entries."""
    done = [_gather_part(part, encode_one) for part in parts(tokens, size)]
    return pa.concat_arrays(done) if done else _gather_part(tokens, encode_one)


def _gather_part(tokens: pa.ListArray, encode_one) -> pa.ListArray:
    """Encode each distinct entry once and lay the ids out per row."""
    coded = tokens.flatten().dictionary_encode()
    entries = [encode_one(e) for e in coded.dictionary.to_pylist()]
    sizes = np.array([len(e) for e in entries], np.int64)
    flat = np.array([i for e in entries for i in e], np.int32)
    starts = np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lens = sizes[which] if len(which) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lens)])
    ids = flat[np.repeat(starts[which] - ends[:-1], lens) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.int32)
    per_row = np.array([n or 0 for n in tokens.value_lengths().to_pylist()], np.int64)
    offsets = ends[np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _encoder(spark: SparkSession, vocab: Vocabulary):
    shared = spark.sparkContext.broadcast(PieceEncoder(vocab.ranks()))

    @F.arrow_udf("array<int>")
    def encode_tokens(tokens: pa.Array) -> pa.Array:
        encoder = shared.value  # one per worker, with its memo
        return _gather(tokens, lambda t: encoder(t.encode()))

    return encode_tokens


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", out: str = "ids", prepend: str | None = None,
           append: str | None = None) -> DataFrame:
    """Add token ids of a text column. Text is ordinary: special tokens never come out of it."""
    ids = _encoder(df.sparkSession, vocab)(pretokens(F.coalesce(F.col(text), F.lit(""))))
    specials = vocab.special_ids
    encoded = df.withColumn(out, ids)
    if prepend:
        encoded = encoded.withColumn(out, F.array_prepend(out, specials[prepend]))
    if append:
        encoded = encoded.withColumn(out, F.array_append(out, specials[append]))
    return encoded


def encode_list(df: DataFrame, vocab: Vocabulary, texts: str, out: str) -> DataFrame:
    """Add ARRAY<ARRAY<INT>> ids of an array of texts, row by row."""
    shared = df.sparkSession.sparkContext.broadcast(PieceEncoder(vocab.ranks()))

    @F.arrow_udf("array<array<int>>")
    def encode_texts(rows: pa.Array) -> pa.Array:
        encoder = shared.value
        inner = _gather(rows.flatten(), lambda t: encoder(t.encode()))
        sizes = [n or 0 for n in rows.value_lengths().to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), inner)

    return df.withColumn(out, encode_texts(F.transform(texts, pretokens)))


def encode_counts(counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Ids of each distinct pre-token of a count table. The encoder counts as not deterministic, as a filter on the ids (an
    explosion brings one) would else move in front of the counting and encode every occurrence."""
    ids = _encoder(counts.sparkSession, vocab).asNondeterministic()(F.array("pretoken"))
    return counts.withColumn("ids", ids)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """Token ids back to text; broken UTF-8 becomes U+FFFD."""
    symbols = {i + vocab.shift: b for i, b in enumerate(vocab.symbols)}
    symbols.update({i: name.encode() for name, i in vocab.special_ids.items()})
    shared = df.sparkSession.sparkContext.broadcast(symbols)

    @F.arrow_udf("string")
    def decode_ids(rows: pa.Array) -> pa.Array:
        table = shared.value
        return pa.array([None if r is None else b"".join(table[i] for i in r).decode("utf-8", "replace")
                         for part in parts(rows, 1 << 18) for r in part.to_pylist()], pa.string())

    return df.withColumn(out, decode_ids(F.col(ids)))


def token_bytes(vocab_table: DataFrame, mode: str = "true") -> DataFrame:
    """Bytes a token counts for: its own length, or (`reference`) the length after a round trip through
    text, in which a broken byte counts as the three bytes of U+FFFD. Special tokens count 0."""
    if mode == "true":
        size = F.octet_length("bytes")
    elif mode == "reference":
        size = F.octet_length(F.make_valid_utf8(F.col("bytes").cast("string")))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return vocab_table.withColumn("n_bytes", F.when(F.col("is_special"), F.lit(0)).otherwise(size))


def is_special(df: DataFrame, vocab_table: DataFrame, token: str = "token_id") -> DataFrame:
    """Adds whether each token is one of the special tokens: a handful of ids, joined by semi-check."""
    specials = vocab_table.where("is_special").select(F.col("token_id").alias("__sid"), F.lit(True).alias("__s"))
    joined = df.join(specials, F.col(token) == F.col("__sid"), "left")
    return joined.withColumn("special", F.coalesce("__s", F.lit(False))).drop("__sid", "__s")


def token_byte_stats(table: DataFrame) -> DataFrame:
    kept = table.where(~F.col("is_special"))
    return kept.agg(F.min("n_bytes").alias("min"), F.max("n_bytes").alias("max"), F.avg("n_bytes").alias("mean"),
                    F.stddev_samp("n_bytes").alias("std"))


def compression(df: DataFrame, by: Sequence[str], ids: str = "ids", text: str = "text") -> DataFrame:
    """(by, bytes, tokens, ratio): bytes per token."""
    return df.groupBy(*by).agg(
        F.sum(F.octet_length(text).cast("long")).alias("bytes"), F.sum(F.size(ids).cast("long")).alias("tokens")).withColumn(
        "ratio", F.col("bytes") / F.col("tokens"))
