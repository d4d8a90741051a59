"""Text to token ids as columns: bytes, words, and the split used ahead of byte-pair merging."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from palinode.functions.batches import byte_parts, parts, with_entries

# The pre-token split pattern (digits in runs of one or two).
SPLIT_PATTERN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}"
    r"| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
)
# The part of that pattern every SQL engine's regex can express.
WORD_PATTERN = r"\p{L}+|\p{N}{1,2}|[^ \t\r\n\p{L}\p{N}]+"

# Special token names, in id order.
SPECIAL_TOKENS = (
    "<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>",
    "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>",
)
# Special tokens of the experiment half, first in its vocabulary.
LAB_SPECIAL_TOKENS = ("<pad>", "<unk>", "<bos>", "<eos>", "<fwd>", "<rev>")

BYTE_SPECIALS = {name: 256 + i for i, name in enumerate(SPECIAL_TOKENS)}
LAB_SPECIALS = {name: i for i, name in enumerate(LAB_SPECIAL_TOKENS)}
BOS = BYTE_SPECIALS["<|bos|>"]


def pretokens(text: Column) -> Column:
    """ARRAY<STRING> of pre-tokens; `(?U)` makes `\\s` cover Unicode spaces."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text)


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as ARRAY<INT>; hex pairs are cut in one pass so long texts stay linear."""
    pairs = F.regexp_extract_all(F.hex(text), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def bytes_text(ids: Column) -> Column:
    """Inverse of `byte_ids`; ids of 256 and above are dropped, broken UTF-8 becomes U+FFFD."""
    plain = F.filter(ids, lambda i: (i >= 0) & (i < 256))
    digits = F.array_join(F.transform(plain, lambda i: F.lpad(F.hex(i.cast("long")), 2, "0")), "")
    return F.make_valid_utf8(F.unhex(digits).cast("string"))


def _word_ids(words: pa.Array, vocab_size: int, n_special: int) -> pa.Array:
    """Ids of words; every distinct word is hashed once."""
    coded = words.dictionary_encode()
    known = coded.dictionary.cast(pa.binary())
    _, ends, raw = known.buffers()
    ends, raw = np.frombuffer(ends or b"\0\0\0\0", np.int32)[known.offset:known.offset + len(known) + 1].tolist(), memoryview(raw or b"")
    digests = b"".join([md5(raw[a:z]).digest() for a, z in pairwise(ends)])
    ids = np.frombuffer(digests, ">u4")[::4] % np.uint32(vocab_size - n_special) + np.uint32(n_special)
    return pa.array(ids.astype(np.int32)).take(coded.indices)


def word_ids(words: Column, vocab_size: int, n_special: int = len(LAB_SPECIAL_TOKENS)) -> Column:
    """Hashed word ids in [n_special, vocab_size): a vocabulary that needs no table. The id is the first 32 bits of the
    word's md5 modulo the ids there are; a word is hashed once for every run of rows."""
    @F.arrow_udf("array<int>")
    def hashed(rows: pa.Array) -> pa.Array:
        done = [with_entries(part, _word_ids(part.flatten(), vocab_size, n_special)) for part in parts(rows)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return hashed(words)


@lru_cache
def _class_changes() -> tuple[np.ndarray, np.ndarray]:
    """Code points from which on characters are of another class of WORD_PATTERN, and these classes (0: between words, 1: letter,
    2: number, 3: other), as the JVM's patterns have them; asked once a process."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kinds = F.col("c")
    for pattern, kind in ((r"[ \t\r\n]", " "), (r"\p{L}", "a"), (r"\p{N}", "1"), (r"[^ a1]", ".")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    text = pa.table({"c": ["".join(map(chr, points))]})
    classes = SparkSession.active().createDataFrame(text).select(kinds).collect()[0][0]
    codes = np.array([" a1.".index(k) for k in classes], np.uint8)
    at = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
    return np.array(points, np.int32)[at], codes[at]


def _words(texts: pa.StringArray, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts as WORD_PATTERN finds them, and how many there are before each text and in all. Classes of characters
    are told for all bytes at once: a word is a run of one class, and numbers are cut in twos."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int32)
    kind = np.frombuffer(bytearray(raw).translate(classes[:256].tobytes()), np.uint8)
    head = np.flatnonzero(raw >= 0xC0)
    if len(head):
        first, follow = raw[head].astype(np.int32), [raw[np.minimum(head + k, len(raw) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        two, four = first < 0xE0, first >= 0xF0
        point = np.where(two, (first & 0x1F) << 6 | follow[0], (first & 0x0F) << 12 | follow[0] << 6 | follow[1])
        point = np.where(four, (first & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2], point)
        kinds = classes[point]
        for k, some in ((0, slice(None)), (1, slice(None)), (2, ~two), (3, four)):
            kind[head[some] + k] = kinds[some]
    start = np.empty(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends[:-1][ends[:-1] < len(raw)]] = True
    numbers = np.flatnonzero((kind == 2) & ((raw & 0xC0) != 0x80))
    place = np.arange(len(numbers))
    place -= np.maximum.accumulate(np.where(start[numbers], place, 0))
    start[numbers[place % 2 == 0]] = True
    begin = np.flatnonzero(start).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, np.int32(len(raw)))), pa.py_buffer(raw)])
    known = kind[begin] != 0
    return runs.filter(pa.array(known)), np.searchsorted(begin[known], ends).astype(np.int32)


def text_word_ids(text: Column, vocab_size: int, n_special: int = len(LAB_SPECIAL_TOKENS), size: int = 1 << 22) -> Column:
    """`word_ids(word_tokens(text))`, found and hashed in about `size` bytes of text at once."""
    changes, kinds = _class_changes()

    @F.arrow_udf("array<int>")
    def hashed(rows: pa.Array) -> pa.Array:
        classes = np.repeat(kinds, np.diff(np.append(changes, 0x110000)))
        done = []
        for part in byte_parts(rows.cast(pa.string()), size):
            words, counts = _words(part, classes)
            ids = _word_ids(words, vocab_size, n_special)
            done.append(pa.ListArray.from_arrays(pa.array(counts), ids, mask=part.is_null() if part.null_count else None))
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return hashed(F.make_valid_utf8(text))


def special_id(name: str, specials: dict[str, int] = BYTE_SPECIALS) -> int:
    """Id of a special token; BOS falls back to the end-of-text name other vocabularies use."""
    if name == "<|bos|>" and name not in specials:
        return specials["<|endoftext|>"]
    return specials[name]
