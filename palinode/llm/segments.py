"""Words and chunks of a batch of texts as numpy positions and 64-bit hashes, without one Python object per word.

A slice of an Arrow string column is one byte array with document offsets. A hash of any byte range comes from
one running sum over the slice: sum of TABLE[byte] * P**position, wrapped to 64 bits, so a range costs one
subtraction. Equal ranges always hash alike; different ones meet with a chance of about 2**-58 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # a worker's arrays take tens of times that
_P = 0x9E3779B97F4A7C15 | 3
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
# A-Z hash like a-z
_FOLDED = _RANDOM.copy()
_FOLDED[65:91] = _RANDOM[97:123]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n at least; kept per worker, with a sixteenth to spare."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, n + (n >> 4))
        out = []
        for base in (_P, pow(_P, -1, 2**64)):
            table = np.full(size, base & (2**64 - 1), np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts make up about `limit` bytes; one longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or raw[-1] == raw[0]:
        return np.zeros(0, np.uint8), np.zeros(len(raw), np.int64)
    return np.frombuffer(data, np.uint8)[raw[0]:raw[-1]], raw - raw[0]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of data[start:end] for every pair; with `fold`, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _pow_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _RANDOM)[data] * up[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the runs of other than \\x20 and \\x09-\\x0D inside each document."""
    solid = ~SPACE[data]
    if not solid.any():
        return (np.zeros(0, np.int64),) * 3
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    at, end = offsets[:-1][full], offsets[1:][full] - 1
    first[at], last[end] = solid[at], solid[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


# lead bytes of the characters among which Unicode has white space
_RISKY_LEAD = np.zeros(256, bool)
_RISKY_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of chunks that cover every document: white space, then other characters.

    A chunk begins where an ASCII white-space character follows one that is certainly no white space. Split
    patterns that never match across such a place treat each chunk as they treat it inside its document.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    begin = np.zeros(n, bool)
    ascii_solid = (data > 32) & (data < 127)
    tail = (data & 0xC0) == 0x80
    solid = ascii_solid.copy()
    # a two-byte character with a harmless lead byte; longer ones only end a chunk if the byte before is a tail
    solid[1:] |= tail[1:] & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    solid[2:] |= tail[2:] & tail[1:-1] & (data[:-2] >= 0xE0) & (data[:-2] < 0xF0) & ~_RISKY_LEAD[data[:-2]]
    begin[1:] = SPACE[data[1:]] & solid[:-1]
    begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n), np.searchsorted(offsets, starts, "right") - 1


# kinds of bytes between which split patterns of letters, digits and signs always cut: letters 1, digits 2, signs 3,
# white space 4; 0 (the apostrophe, which may lead letters, and what is not classified) is never cut off
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[SPACE] = 4
_KIND[39] = 0


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of finer parts than `chunks`: runs of one kind, single digits, without white space.

    For patterns that keep letters, digits and signs apart (but for contractions such as 's) and drop white
    space. Letters are A-Z, a-z and U+00C0 to U+00FF without its two signs; whatever is next to other
    characters stays with them.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    latin = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = 1
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    kept = np.logical_or.reduceat(kind != 4, starts)
    starts, ends = starts[kept], ends[kept]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


class ChunkMemo:
    """Token ids of distinct chunks, kept per worker and emptied when full.

    `encode_new(list of bytes) -> list of id arrays` is asked once for every chunk not kept. `ids_of` gives the
    ids of all chunks in order and the number of ids of each chunk.
    """

    def __init__(self, encode_new, most: int = 200_000):
        self.encode_new, self.most = encode_new, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending hashes of the chunks kept, and the place of each in `start` and `size`
        self.slots = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int32)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _add(self, keys: np.ndarray, at: np.ndarray, encoded: list[np.ndarray]) -> None:
        """Keep new chunks; `at` are the places of their hashes among those kept."""
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        n, total = len(self.keys), int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 4, total), np.int32)])
        if n + len(keys) > len(self.start):
            more = np.zeros(max(len(self.start) // 4, len(keys)), np.int32)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        if total:
            self.ids[self.used:self.used + total] = np.concatenate(encoded)
        self.size[n:n + len(keys)] = sizes
        self.start[n:n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, np.arange(n, n + len(keys), dtype=np.int32))
        self.used += total

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > self.most or self.used > 8 * self.most:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes, first, back = np.unique(
            range_hashes(data, starts, ends, fold), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        kept = np.flatnonzero(at < len(self.keys))
        new[kept] = self.keys[at[kept]] != hashes[kept]
        if new.any():
            raw, place = data.tobytes(), first[new]
            pieces = [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())]
            self._add(hashes[new], at[new], self.encode_new(pieces))
            at = np.searchsorted(self.keys, hashes)
        slot = self.slots[at][back]
        sizes = self.size[slot].astype(np.int64)
        return self.ids[spread_ranges(self.start[slot].astype(np.int64), sizes)], sizes
