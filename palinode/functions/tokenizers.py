"""One interface over the three tokenizations: a column in, an ARRAY<INT> column added."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palinode.functions.tokens import BYTE_SPECIALS, LAB_SPECIALS, byte_ids, bytes_text, word_ids, word_tokens
from palinode.operators import bpe


class Tokenizer(Protocol):
    specials: dict[str, int]
    vocab_size: int

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame: ...


@dataclass
class ByteTokenizer:
    """Ids are UTF-8 bytes; the special tokens follow."""

    specials: dict[str, int] = None
    vocab_size: int = 256 + len(BYTE_SPECIALS)

    def __post_init__(self) -> None:
        self.specials = self.specials or dict(BYTE_SPECIALS)

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        return df.withColumn(out, byte_ids(F.col(text)))

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
        return df.withColumn(out, bytes_text(F.col(ids)))


@dataclass
class WordTokenizer:
    """Hashed words; one way, so it has no decode."""

    vocab_size: int = 4096
    specials: dict[str, int] = None

    def __post_init__(self) -> None:
        self.specials = self.specials or dict(LAB_SPECIALS)

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        return df.withColumn(out, word_ids(word_tokens(F.col(text)), self.vocab_size, len(self.specials)))


@dataclass
class BpeTokenizer:
    """A trained byte-pair vocabulary."""

    vocab: bpe.Vocabulary

    @property
    def specials(self) -> dict[str, int]:
        return self.vocab.special_ids

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        return bpe.encode(df, self.vocab, text, out)

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
        return bpe.decode(df, self.vocab, ids, out)
