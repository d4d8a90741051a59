"""Byte-pair training by epochs: counting and cutting on Spark, merges on a bounded table of hot segments.

An epoch takes the most frequent pairs as hot. A pair made by merges spans an older pair and never fires more often than that did, so
while the best pair is more frequent than every pair that is not hot, merges happen between hot neighbours only: inside the
longest runs of hot neighbours of a word, its hot segments. The distinct segments with their frequencies therefore
decide the next merges exactly. There are few of them, as segments are short where few pairs are hot; the number of hot pairs is
halved until they fit `most_symbols`. On that table every merge touches only the places that hold its pair: pair counts
are kept by deltas, an index leads from a pair to its places. Then the epoch's merges are applied to all words on
the executors by the same structure, and the next epoch counts pairs anew.

Pairs of one symbol fire left to right without overlap: a run of k equal symbols counts k // 2.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palinode.session import cut_lineage

_END = -1  # between sequences
_GONE = -2
_WORDS = "w array<int>, freq long"


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


class MergeTable:
    """Weighted symbol sequences as one linked list of places; merging a pair touches the places that hold it."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> None:
        n = len(sizes)
        ends = np.cumsum(sizes + 1)  # an end mark behind every sequence, and one in front of all
        self.sym = np.full(int(ends[-1]) + 1 if n else 1, _END, np.int64)
        self.owner = np.repeat(np.arange(n), sizes + 1)
        self.owner = np.append(np.zeros(1, np.int64), self.owner) if n else np.zeros(1, np.int64)
        body = np.ones(len(self.sym), bool)
        body[0] = False
        body[ends] = False
        self.sym[body] = values
        self.starts = np.append(0, ends[:-1]) + 1 if n else np.zeros(0, np.int64)
        self.weights = weights.astype(np.int64)
        places = np.arange(len(self.sym))
        self.next, self.prev = places + 1, places - 1
        at = np.flatnonzero((self.sym[:-1] != _END) & (self.sym[1:] != _END))
        codes = _code(self.sym[at], self.sym[at + 1])
        order = np.argsort(codes, kind="stable")
        pairs, first = np.unique(codes[order], return_index=True)
        self.index: dict[int, list[np.ndarray]] = {
            int(p): [x] for p, x in zip(pairs, np.split(at[order], first[1:]))} if len(at) else {}

    def places(self, code: int) -> np.ndarray:
        """First places of the pair where it fires, ascending."""
        a, b = code >> 32, code & 0xFFFFFFFF
        found = self.index.get(code)
        if not found:
            return np.zeros(0, np.int64)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[(self.sym[at] == a) & (self.sym[self.next[at]] == b)]
        self.index[code] = [at]
        if a == b and len(at):  # every second place of a run
            order = np.arange(len(at))
            opens = np.append(True, self.next[at[:-1]] != at[1:])
            at = at[(order - np.maximum.accumulate(np.where(opens, order, 0))) % 2 == 0]
        return at

    def count(self, code: int) -> int:
        return int(self.weights[self.owner[self.places(code)]].sum())

    def counts(self) -> dict[int, int]:
        return {code: self.count(code) for code in self.index}

    def merge(self, code: int, new: int) -> tuple[dict[int, int], set[int]]:
        """Merge a pair everywhere. ({pair: change of its count}, pairs of equal symbols to be counted again)."""
        a, b = code >> 32, code & 0xFFFFFFFF
        left = self.places(code)
        if not len(left):
            return {}, set()
        right = self.next[left]
        before, after = self.prev[left], self.next[right]
        weight = self.weights[self.owner[left]]
        joined = np.zeros(len(left), bool)  # the next match begins where this one ends
        joined[:-1] = after[:-1] == left[1:]
        changes: list[tuple[np.ndarray, np.ndarray]] = []

        def note(first: np.ndarray, second: np.ndarray, kept: np.ndarray, sign: int) -> None:
            kept = kept & (first >= 0) & (second >= 0)
            changes.append((_code(first[kept], second[kept]), sign * weight[kept]))

        every = np.ones(len(left), bool)
        note(self.sym[before], self.sym[left], every, -1)
        note(self.sym[right], self.sym[after], ~joined, -1)
        self.sym[left], self.sym[right] = new, _GONE
        self.next[left] = after
        self.prev[after] = left
        before = self.prev[left]
        note(self.sym[before], self.sym[left], every, 1)
        note(self.sym[left], self.sym[after], ~joined, 1)
        for first, place, kept in ((self.sym[before], before, every), (self.sym[left], left, ~joined)):
            other = self.sym[self.next[place]]
            kept = kept & (first >= 0) & (other >= 0)
            codes = _code(first[kept], other[kept])
            order = np.argsort(codes, kind="stable")
            pairs, start = np.unique(codes[order], return_index=True)
            for p, x in zip(pairs.tolist(), np.split(place[kept][order], start[1:])):
                self.index.setdefault(p, []).append(x)
        self.index.pop(code, None)
        if a == b:  # what is left of odd runs fires nowhere
            self.index[code] = [np.zeros(0, np.int64)]
        codes = np.concatenate([c for c, _ in changes])
        order = np.argsort(codes, kind="stable")
        pairs, start = np.unique(codes[order], return_index=True)
        sums = np.add.reduceat(np.concatenate([w for _, w in changes])[order], start) if len(pairs) else []
        delta = {p: int(s) for p, s in zip(pairs.tolist(), sums) if p >> 32 != p & 0xFFFFFFFF and p != code}
        again = {x << 32 | x for x in (a, b, new)} - ({code} if a == b else set())
        return delta, {p for p in again if p in self.index}

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sizes) of all sequences as they are now."""
        kept = self.sym >= 0
        return self.sym[kept], np.bincount(self.owner[kept], minlength=len(self.weights))


def merge_order(table: MergeTable, floor: int, most: int, first_id: int) -> list[tuple[int, int]]:
    """Merges in turn, always the most frequent pair (ties to the lower ids), while it is more frequent than `floor`."""
    counts = table.counts()
    heap = [(-n, code) for code, n in counts.items() if n > floor]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap and len(merges) < most:
        n, code = heapq.heappop(heap)
        if counts.get(code) != -n:
            continue
        merges.append((code >> 32, code & 0xFFFFFFFF))
        delta, again = table.merge(code, first_id + len(merges) - 1)
        counts.pop(code)
        for pair, change in delta.items():
            counts[pair] = counts.get(pair, 0) + change
        for pair in again:
            counts[pair] = table.count(pair)
        for pair in {*delta, *again}:
            if counts[pair] > floor:
                heapq.heappush(heap, (-counts[pair], pair))
    return merges


# ---- words on the executors ----------------------------------------------------------------------------

def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = batch.column("w")
    return np.asarray(w.flatten()), np.diff(np.asarray(w.offsets, np.int64)), np.asarray(batch.column("freq"), np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))


def byte_words(counts: DataFrame) -> DataFrame:
    """(w, freq): bytes of every pre-token of two bytes or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            yield pa.RecordBatch.from_arrays([_lists(data.astype(np.int32), np.diff(offsets)), batch.column("freq")], ["w", "freq"])

    raw = counts.select(F.col("pretoken").cast("binary").alias("raw"), F.col("freq").cast("long").alias("freq"))
    return raw.where(F.octet_length("raw") >= 2).mapInArrow(run, _WORDS)


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    pairs, start = np.unique(codes[order], return_index=True)
    return pairs, np.add.reduceat(weights[order], start) if len(pairs) else np.zeros(0, np.int64)


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, n): how often merging the pair (left id << 32 | right id) would fire."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, freq = _flat(batch)
            if len(values) < 2:
                continue
            owner = np.repeat(np.arange(len(sizes)), sizes)
            inside = owner[1:] == owner[:-1]
            same = inside & (values[1:] == values[:-1])
            place = np.arange(len(same))
            opens = same & ~np.append(False, same[:-1])
            fires = inside & ~(same & ((place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 1))
            pairs, n = _summed(_code(values[:-1], values[1:])[fires], freq[owner[:-1]][fires])
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return words.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def hot_segments(words: DataFrame, hot: np.ndarray) -> DataFrame:
    """(w, freq): distinct longest runs whose neighbours are all hot pairs (sorted codes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, freq = _flat(batch)
            if len(values) < 2:
                continue
            owner = np.repeat(np.arange(len(sizes)), sizes)
            codes = _code(values[:-1], values[1:])
            at = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
            warm = (owner[1:] == owner[:-1]) & (hot[at] == codes)
            edge = np.diff(np.concatenate([[0], warm.astype(np.int8), [0]]))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            total: dict[bytes, int] = {}
            raw = values.astype("<i4").tobytes()
            for a, b, n in zip((4 * start).tolist(), (4 * stop).tolist(), freq[owner[start]].tolist()):
                total[raw[a:b]] = total.get(raw[a:b], 0) + n
            if total:
                yield pa.RecordBatch.from_arrays(
                    [_lists(np.frombuffer(b"".join(total), "<i4"), np.array([len(s) // 4 for s in total])),
                     pa.array(list(total.values()), pa.int64())], ["w", "freq"])

    return words.mapInArrow(run, _WORDS).groupBy("w").agg(F.sum("freq").alias("freq"))


def apply_merges(words: DataFrame, merges: list[tuple[int, int]], first_id: int) -> DataFrame:
    """Words after the merges, in order; those of one symbol go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, freq = _flat(batch)
            table = MergeTable(values, sizes, freq)
            for i, (a, b) in enumerate(merges):
                table.merge(a << 32 | b, first_id + i)
            values, sizes = table.sequences()
            kept = sizes > 1
            yield pa.RecordBatch.from_arrays([_lists(values[np.repeat(kept, sizes)], sizes[kept]), pa.array(freq[kept])], ["w", "freq"])

    return words.mapInArrow(run, _WORDS)


def train_merges(counts: DataFrame, n_merges: int, min_freq: int = 1, hot_pairs: int = 1 << 14,
                 most_symbols: int = 1 << 22) -> list[tuple[int, int]]:
    """Merges learned from (pretoken, freq). The driver holds one epoch's segments: `most_symbols` symbols at most."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # distinct words spread evenly whatever their frequency
    words = cut_lineage(byte_words(counts).repartition(parts))
    merges: list[tuple[int, int]] = []
    wanted = hot_pairs
    while len(merges) < n_merges:
        top = pair_counts(words).where(F.col("n") >= max(1, min_freq)).orderBy(F.desc("n"), "pair").limit(wanted + 1).collect()
        if not top:
            break
        codes, counted = [r["pair"] for r in top], [r["n"] for r in top]
        took = wanted
        while True:
            floor = counted[took] if took < len(counted) else max(1, min_freq) - 1
            hot = [c for c, n in zip(codes, counted) if n > floor]
            most = n_merges - len(merges)
            if not hot:  # ties throughout: the first of them is next, nothing more is certain
                hot, floor, most = codes[:1], counted[0] - 1, 1
            found = hot_segments(words, np.sort(np.array(hot, np.int64)))
            size = F.size("w").cast("long")
            # stored once: its size is checked before anything is collected
            found = cut_lineage(found)
            if len(hot) == 1 or (found.agg(F.sum(size)).first()[0] or 0) <= most_symbols:
                break
            took = max(1, min(took, len(codes)) // 2)
        rows = found.toArrow().combine_chunks()
        segments = rows.column("w").combine_chunks()
        table = MergeTable(np.asarray(segments.flatten()), np.diff(np.asarray(segments.offsets, np.int64)),
                           np.asarray(rows.column("freq"), np.int64))
        new = merge_order(table, floor, most, 256 + len(merges))
        if len(merges) + len(new) < n_merges:
            words = cut_lineage(apply_merges(words, new, 256 + len(merges)))
        merges += new
        # one more step up where everything fitted easily, so that epochs stay few
        wanted = max(16, min(hot_pairs, 2 * took))
    return merges
