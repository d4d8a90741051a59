"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pieces of a split pattern are put into buckets of like length, one padded matrix of ids per bucket. In every
round each row merges its leftmost pair of least rank: ranks of pairs come from a hashed pair table, the merged
row is closed up, and rows without a mergeable pair leave the matrix. Ranks are those of a tiktoken file; as
in that library a piece that is a token is that token, whatever the merges would give.

Text is encoded where it lies (no shuffle). A worker keeps the ids of the chunks it has met (bounded, see
`ChunkMemo`); texts are worked off in slices of about 256 KB, so memory follows the longest single text only.

Defined results: a null text is an empty text; an empty text has no ids and decodes to the empty string; a
piece of over `LONG_PIECE` bytes takes a heap over a linked list instead of a matrix row (the same merges in
the same order, n log n); repeated rows are encoded alike; an empty table gives an empty result; other columns
pass through, and one named like an output gets `_in` appended to its name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palinode.llm.names import set_aside
from palinode.llm.segments import ChunkMemo, chunks, slices, spread_ranges, text_bytes

LONG_PIECE = 256
_NONE = np.int32(2**31 - 1)
_TYPES = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType(),
          "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
OUTPUTS = tuple(_TYPES)


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing in numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, 2**64 - 1, np.uint64)
        self.vals = np.full(size, _NONE, np.int32)
        key = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        val = np.array(list(pairs.values()), np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]] = key[free]  # of several for one slot the last stays
            done = self.keys[at] == key
            self.vals[at[done]] = val[done]
            key, val, at = key[~done], val[~done], (at[~done] + np.uint64(1)) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(31)) & self.mask

    def of(self, left: int, right: int) -> int | None:
        """Id of one merged pair; None where there is no such token."""
        key = left << 32 | right
        at = (key * 0x9E3779B97F4A7C15 >> 31) & int(self.mask)
        while (seen := int(self.keys[at])) != key:
            if seen == 2**64 - 1:
                return None
            at = (at + 1) & int(self.mask)
        return int(self.vals[at])

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs; `_NONE` where there is no such token."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            seen = self.keys[at]
            hit = seen == key[todo]
            out[todo[hit]] = self.vals[at[hit]]
            go = ~hit & (seen != np.uint64(2**64 - 1))
            todo, at = todo[go], (at[go] + np.uint64(1)) & self.mask
        return out


class ByteBpe:
    """A rank file and a split pattern: bytes of chunks to ids and back."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.table = PairTable(pairs)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.token_len = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            self.token_len[rank] = len(token)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.zeros(int(self.token_len.sum()), np.uint8)
        for token, rank in self.ranks.items():
            at = self.token_at[rank]
            self.token_bytes[at:at + len(token)] = np.frombuffer(token, np.uint8)
        self.memo = ChunkMemo(self.encode_chunks)

    def _merge_bucket(self, ids: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Ids of every row of a padded matrix (rows, width) with `size` ids each."""
        out: list[np.ndarray] = [None] * len(ids)
        row, cols = np.arange(len(ids)), np.arange(ids.shape[1])
        inside = cols[1:] < size[:, None]
        rank = np.full((len(ids), ids.shape[1] - 1), _NONE, np.int32)
        rank[inside] = self.table.merged(ids[:, :-1][inside], ids[:, 1:][inside])
        while True:
            best = rank.argmin(1)
            value = rank[np.arange(len(row)), best]
            going = value != _NONE
            if not going.all():
                for i in np.flatnonzero(~going):
                    out[row[i]] = ids[i, :size[i]].copy()
                ids, rank, size, row = ids[going], rank[going], size[going], row[going]
                best, value = best[going], value[going]
            if not len(row):
                return out
            width = int(size.max())  # compaction: columns no row uses any more go
            ids, rank = ids[:, :width], rank[:, :width - 1]
            every = np.arange(len(row))
            ids[every, best] = value
            size = size - 1
            take = np.minimum(np.arange(width) + (np.arange(width) > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            take = np.minimum(np.arange(width - 1) + (np.arange(width - 1) >= best[:, None]), width - 2)
            rank = np.take_along_axis(rank, take, 1)
            rank[every, size - 1] = _NONE  # what closing up has left behind the last pair
            for shift in (-1, 0):  # the two pairs the merged id is part of
                at = best + shift
                ok = (at >= 0) & (at + 1 < size)
                rank[every[ok], at[ok]] = self.table.merged(ids[every[ok], at[ok]], ids[every[ok], at[ok] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        first = self.single[np.frombuffer(piece, np.uint8)]
        ids = first.tolist()
        n, pair = len(ids), self.table.of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.table.merged(first[:-1], first[1:]).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pair(r, ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (q := pair(ids[h], r)) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of pieces, each merged by itself."""
        out: list[np.ndarray] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            known = self.ranks.get(piece)
            if known is not None:
                out[i] = np.array([known], np.int32)
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(piece)
            else:
                n = len(piece)  # widths 2..8 exactly, then steps of about a quarter
                buckets.setdefault(n if n <= 8 else -(-n // (w := max(2, n // 4))) * w, []).append(i)
        for members in buckets.values():
            for at in range(0, len(members), 16384):
                part = members[at:at + 16384]
                size = np.fromiter((len(pieces[i]) for i in part), np.int64, len(part))
                ids = np.zeros((len(part), int(size.max())), np.int32)
                ids[np.arange(ids.shape[1]) < size[:, None]] = self.single[
                    np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for i, found in zip(part, self._merge_bucket(ids, size)):
                    out[i] = found
        return out

    def encode_chunks(self, raw: Sequence[bytes]) -> list[np.ndarray]:
        pieces, count = [], []
        for chunk in raw:
            found = self.split(chunk.decode())
            count.append(len(found))
            pieces += found
        at: dict[str, int] = {}
        order = [at.setdefault(p, len(at)) for p in pieces]
        merged = self.merge([p.encode() for p in at])
        out, i = [], 0
        for n in count:
            out.append(merged[order[i]] if n == 1 else np.concatenate([merged[k] for k in order[i:i + n]]))
            i += n
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        data, offsets = text_bytes(column)
        starts, ends, doc = chunks(data, offsets)
        ids, sizes = self.memo.ids_of(data, starts, ends)
        return ids, np.bincount(doc, sizes, len(column)).astype(np.int64)

    def decode_ids(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, number of bytes of each text)."""
        lengths = self.token_len[ids]
        data = self.token_bytes[spread_ranges(self.token_at[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        return data, np.diff(ends, prepend=0)


@functools.lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _digests(raw: bytes, ends: np.ndarray) -> list[str]:
    view, at = memoryview(raw), ends.tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text",
           outputs: Iterable[str] = ("n_tokens", "ids")) -> DataFrame:
    """The other columns and the wanted of: n_tokens, ids, decoded (the text the ids stand for), ids_sha256 (of the
    ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes)."""
    outputs = tuple(outputs)
    df, text = set_aside(df, outputs, text)
    others = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(c, _TYPES[c]) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                ids, sizes = bpe.encode_column(part.column(text))
                ends, made = _ends(sizes), {}
                if "n_tokens" in outputs:
                    made["n_tokens"] = pa.array(sizes)
                if "ids" in outputs:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = pa.array(_digests(ids.astype("<u4").tobytes(), 4 * ends), pa.string())
                if {"decoded", "decoded_sha256"} & set(outputs):
                    data, counts = bpe.decode_ids(ids, sizes)
                    raw, at = data.tobytes(), _ends(counts)
                    if "decoded" in outputs:
                        made["decoded"] = pa.array([raw[a:b].decode() for a, b in zip(at, at[1:])], pa.string())
                    if "decoded_sha256" in outputs:
                        made["decoded_sha256"] = pa.array(_digests(raw, at), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in others] + [made[c] for c in outputs], [*others, *outputs])

    return df.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Texts of the token ids of `df`; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(out, T.StringType())])
    others = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            column = batch.column(ids)
            sizes = np.asarray([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            data, counts = bpe.decode_ids(np.asarray(column.flatten(), np.int64), sizes)
            raw, at = data.tobytes(), _ends(counts)
            texts = pa.array([raw[a:b].decode(errors="replace") for a, b in zip(at, at[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [texts], [*others, out])

    return df.select(*[F.col(f"`{c}`") for c in [*others, ids]]).mapInArrow(run, schema)
