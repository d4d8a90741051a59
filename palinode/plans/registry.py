"""Named queries, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# ---- SQL fragments shared by the counterparts ------------------------------------------------------

WORD_RE = r"\p{L}+|\p{N}{1,2}|[^ \t\r\n\p{L}\p{N}]+"


def u32(seed: object, *keys: str) -> str:
    """Seeded 32-bit draw."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT"


def u60(seed: object, *keys: str) -> str:
    """Seeded 60-bit draw."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 15))::BIGINT"


def uniform(seed: object, *keys: str) -> str:
    return f"({u32(seed, *keys)} / 4294967296.0::DOUBLE)"


def words(text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{WORD_RE}')"


def word_ids(words_list: str, vocab: int = 4096, n_special: int = 6) -> str:
    return (f"list_transform({words_list}, lambda w: "
            f"(('0x' || substr(md5(w), 1, 8))::BIGINT % {vocab - n_special} + {n_special})::INT)")


def byte_list(text: str) -> str:
    return (f"list_transform(range(1, strlen({text}) + 1), lambda i: "
            f"('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::INT)")


def digest(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"
