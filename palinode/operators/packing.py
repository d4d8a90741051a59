"""Fixed-length training rows from token documents.

Concat-and-chop is pure column work. The order-dependent packers run one stream per task in a single
pass over sorted Arrow batches: a packer holds its look-ahead buffer and one row, never its stream.
`assign_stream` decides the streams, so their number (and so the size of a task) is a choice.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.sequences import mask_targets, reverse_rows, shift, tail
from palinode.operators.ordered import order_columns, prefix_sum

_PACKED = ("stream_id int, row_id long, tokens array<int>, mask array<int>, n_docs int, content_len int, "
           "complete boolean")


# ---- concat and chop -------------------------------------------------------------------------------

def token_offsets(docs: DataFrame, order: str | Sequence[str], ids: str = "ids", sep: int = 1, **kw) -> DataFrame:
    """Adds `offset`: tokens in front of each document, `sep` separator tokens per document included."""
    return prefix_sum(docs, order_columns(order), (F.size(ids) + sep).cast("long"), "offset", exclusive=True, **kw)


def to_blocks(placed: DataFrame, length: int, ids: str = "ids", offset: str = "offset") -> DataFrame:
    """(block_id, tokens) of `length` from documents with stream offsets. A document is sliced once per
    block it touches; a block gathers at most `length` tokens. The unfilled last block comes out short."""
    def piece(block: Column) -> Column:
        start = F.greatest(block * length - F.col(offset), F.lit(0)).cast("int")
        stop = F.least(block * length + length - F.col(offset), F.size(ids).cast("long")).cast("int")
        return F.struct(block.alias("block_id"), (F.col(offset) + start).alias("p"),
                        F.slice(ids, start + 1, stop - start).alias("t"))

    # sliced inside the row: the document is copied once, not once per block
    touched = F.sequence(F.expr(f"{offset} div {length}"), F.expr(f"({offset} + size({ids}) - 1) div {length}"))
    cut = placed.where(F.size(ids) > 0).select(F.inline(F.transform(touched, piece)))
    grouped = cut.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("p", "t"))).alias("g"))
    return grouped.select("block_id", F.flatten(F.col("g.t")).alias("tokens"))


def pack_chop(docs: DataFrame, order: str | Sequence[str], length: int, eos: int, ids: str = "ids") -> DataFrame:
    """Documents plus EOS, concatenated and cut every `length` tokens; the remainder is dropped. Empty
    documents contribute nothing."""
    ended = docs.where(F.size(ids) > 0).withColumn(ids, F.array_append(ids, eos))
    blocks = to_blocks(token_offsets(ended, order, ids, sep=0), length, ids)
    return blocks.where(F.size("tokens") == length)


# ---- stream packers --------------------------------------------------------------------------------

class _Row:
    """The row being filled. A document is (ids, mask, size): ids may already be cut to a row's length,
    size is always its true length, which is what packers decide by."""

    def __init__(self, cap: int) -> None:
        self.cap, self.parts, self.used = cap, [], 0

    def room(self) -> int:
        return self.cap - self.used

    def put(self, doc: tuple[np.ndarray, np.ndarray, int], take: int | None = None) -> None:
        ids, mask = doc[:2] if take is None else (doc[0][:take], doc[1][:take])
        self.parts.append((ids, mask))
        self.used += len(ids)

    def close(self, pad: int | None) -> tuple:
        ids = [p[0] for p in self.parts]
        mask = [p[1] for p in self.parts]
        if pad is not None and self.room():
            ids.append(np.full(self.room(), pad, np.int32))
            mask.append(np.zeros(self.room(), np.int32))
        tokens = np.concatenate(ids).astype(np.int32)
        return tokens, np.concatenate(mask).astype(np.int32), len(self.parts), self.used, len(tokens) == self.cap


class _BestFit:
    """Largest buffered document that fits; when none does, crop the shortest (or pad). Equal lengths
    leave in arrival order. Lengths are kept sorted, so a pick costs a binary search."""

    def __init__(self, cap: int, buffer: int, refill: int, pad: int | None) -> None:
        self.cap, self.buffer, self.refill, self.pad = cap, buffer, refill, pad
        self.arriving, self.lengths, self.by_len, self.n = [], [], {}, 0
        self.row = _Row(cap)

    def _admit(self) -> None:
        for doc in self.arriving:
            size = doc[2]
            if size not in self.by_len:
                self.by_len[size] = deque()
                insort(self.lengths, size)
            self.by_len[size].append(doc)
        self.n += len(self.arriving)
        self.arriving = []

    def _take(self, at: int) -> tuple:
        size = self.lengths[at]
        doc = self.by_len[size].popleft()
        if not self.by_len[size]:
            del self.by_len[size], self.lengths[at]
        self.n -= 1
        return doc

    def _place(self) -> Iterator[tuple]:
        at = bisect_right(self.lengths, self.row.room()) - 1
        if at >= 0:
            self.row.put(self._take(at))
        elif self.pad is None:
            self.row.put(self._take(0), self.row.room())
        else:
            yield self._close()
            return
        if not self.row.room():
            yield self._close()

    def _close(self) -> tuple:
        done, self.row = self.row.close(self.pad), _Row(self.cap)
        return done

    def add(self, doc: tuple) -> Iterator[tuple]:
        self.arriving.append(doc)
        if len(self.arriving) >= self.refill:
            self._admit()
            while self.n >= self.buffer:
                yield from self._place()

    def finish(self) -> Iterator[tuple]:
        self._admit()
        while self.n:
            yield from self._place()
        if self.row.used:
            yield self._close()


class _Greedy:
    """Documents in order; one that does not fit is cropped to the room left, or opens a padded-off
    new row (cropped to a full row only if longer than that)."""

    def __init__(self, cap: int, pad: int | None) -> None:
        self.cap, self.pad, self.row = cap, pad, _Row(cap)

    def _close(self) -> tuple:
        done, self.row = self.row.close(self.pad), _Row(self.cap)
        return done

    def add(self, doc: tuple) -> Iterator[tuple]:
        size = doc[2]
        if self.pad is not None and self.row.used and size > self.row.room():
            yield self._close()
        self.row.put(doc, min(size, self.row.room()))
        if not self.row.room():
            yield self._close()

    def finish(self) -> Iterator[tuple]:
        if self.row.used:
            yield self._close()


class _FirstFitDecreasing:
    """Buffer by buffer: longest first, each into the first row with room, rows padded at the end."""

    def __init__(self, cap: int, buffer: int, pad: int) -> None:
        self.cap, self.buffer, self.pad, self.docs = cap, buffer, pad, []

    def add(self, doc: tuple) -> Iterator[tuple]:
        self.docs.append(doc)
        if len(self.docs) >= self.buffer:
            yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        rows: list[_Row] = []
        for doc in sorted(self.docs, key=lambda d: -d[2]):
            size = min(doc[2], self.cap)
            row = next((r for r in rows if r.room() >= size), None)
            if row is None:
                row = _Row(self.cap)
                rows.append(row)
            row.put(doc, size)
        self.docs = []
        for row in rows:
            yield row.close(self.pad)


def _arrays(rows: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The rows as arrays of their own, so that a buffered document does not hold the batch it came in."""
    values = rows.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([n or 0 for n in rows.value_lengths().to_pylist()], dtype=np.int64).tolist()
    for start, end, known in zip([0, *ends], ends, rows.is_valid().to_pylist()):
        yield values[start:end].copy() if known else None


def _run(docs: DataFrame, make, cap: int, stream: str, order: str | Sequence[str], ids: str, mask: str | None,
         chunk: int = 256) -> DataFrame:
    """Sort each stream into one task's input and feed it to a packer batch by batch. Tokens no row could
    take (past `cap`) stay behind before the shuffle. Documents without ids are left out by the packing task: a filter on the
    ids would have them computed twice."""
    ranks = F.struct(*([order] if isinstance(order, str) else order))
    picked = docs.select(
        F.col(stream).alias("stream_id"), ranks.alias("__order"), F.slice(ids, 1, cap).alias("ids"),
        F.coalesce(F.size(ids), F.lit(0)).alias("size"), *([F.slice(mask, 1, cap).alias("mask")] if mask else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer, row_id, out = None, None, 0, []

        def emit(rows):
            nonlocal row_id
            for row in rows:
                out.append((current, row_id, *row))
                row_id += 1

        def flush() -> pa.RecordBatch:
            sids, row_ids, tokens, masks, *counts = zip(*out)
            out.clear()
            ends = pa.array(np.append(0, np.cumsum([len(t) for t in tokens])), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (tokens, masks)]
            kinds = (pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(sids, pa.int32()), pa.array(row_ids, pa.int64()), *lists, *map(pa.array, counts, kinds)],
                ["stream_id", "row_id", "tokens", "mask", "n_docs", "content_len", "complete"])

        for batch in batches:
            docs = _arrays(batch.column("ids"))
            masks = _arrays(batch.column("mask")) if mask else repeat(None)
            for sid, size, doc, m in zip(batch.column("stream_id").to_pylist(), batch.column("size").to_pylist(), docs, masks):
                if size < 1:
                    continue
                if packer is None or sid != current:
                    if packer is not None:
                        emit(packer.finish())
                    current, packer, row_id = sid, make(), 0
                emit(packer.add((doc, np.ones(len(doc), np.int32) if m is None else m, size)))
                if len(out) >= chunk:
                    yield flush()
        if packer is not None:
            emit(packer.finish())
        if out:
            yield flush()

    ordered = picked.repartition("stream_id").sortWithinPartitions("stream_id", "__order").drop("__order")
    return ordered.mapInArrow(pack, _PACKED)


def pack_bestfit_crop(docs: DataFrame, seq_len: int, order: str | Sequence[str], stream: str = "stream_id", ids: str = "ids",
                      buffer: int = 1000, refill: int = 128, reverse: bool = False, bos: int | None = None,
                      keep_tail: bool = False) -> DataFrame:
    """Full rows of seq_len + 1 tokens from BOS-led documents. `reverse` flips each row behind its BOS.
    The unfinished row at the end of a stream is left out unless `keep_tail`."""
    cap = seq_len + 1
    packed = _run(docs, lambda: _BestFit(cap, buffer, refill, None), cap, stream, order, ids, None)
    if not keep_tail:
        packed = packed.where("complete")
    if reverse:
        packed = packed.withColumn("tokens", reverse_rows(F.col("tokens"), bos))
    return packed.drop("mask")


def pack_bestfit_pad(convs: DataFrame, seq_len: int, order: str | Sequence[str], bos: int, stream: str = "stream_id",
                     ids: str = "ids", mask: str = "mask", buffer: int = 100) -> DataFrame:
    """Rows of seq_len + 1 from rendered conversations, padded with BOS where nothing fits; nothing is
    discarded. Conversations longer than a row never fit: see `pack_rejects`."""
    cap = seq_len + 1
    fits = convs.where(F.size(ids) <= cap)
    return _run(fits, lambda: _BestFit(cap, buffer, 1, bos), cap, stream, order, ids, mask)


def pack_rejects(convs: DataFrame, seq_len: int, ids: str = "ids") -> DataFrame:
    return convs.where(F.size(ids) > seq_len + 1)


def pack_greedy_crop(docs: DataFrame, seq_len: int, order: str | Sequence[str], stream: str = "stream_id", ids: str = "ids") -> DataFrame:
    cap = seq_len + 1
    return _run(docs, lambda: _Greedy(cap, None), cap, stream, order, ids, None)


def pack_greedy_pad(docs: DataFrame, seq_len: int, order: str | Sequence[str], pad: int, stream: str = "stream_id",
                    ids: str = "ids") -> DataFrame:
    cap = seq_len + 1
    return _run(docs, lambda: _Greedy(cap, pad), cap, stream, order, ids, None)


def pack_ffd(docs: DataFrame, seq_len: int, order: str | Sequence[str], pad: int, stream: str = "stream_id", ids: str = "ids",
             buffer: int = 1000) -> DataFrame:
    cap = seq_len + 1
    return _run(docs, lambda: _FirstFitDecreasing(cap, buffer, pad), cap, stream, order, ids, None)


def train_rows(packed: DataFrame) -> DataFrame:
    """(stream_id, row_id, inputs, targets) by the one-step shift; padded and unsupervised targets -1."""
    inputs, targets = shift(F.col("tokens"))
    if "mask" in packed.columns:
        targets = mask_targets(targets, tail(F.col("mask")), F.col("content_len"))
    return packed.select("stream_id", "row_id", inputs.alias("inputs"), targets.alias("targets"))


def packing_report(docs: DataFrame, packed: DataFrame, seq_len: int, ids: str = "ids") -> DataFrame:
    """One row: tokens in, used and cropped, rows, utilisation, crop and pad share, and the floor no
    packer can beat (tokens past the end of a row-long document). Two aggregates, one row each."""
    cap = seq_len + 1
    size = F.size(ids).cast("long")
    ins = docs.agg(F.sum(size).alias("tokens_in"), F.sum(F.greatest(size - cap, F.lit(0))).alias("over"))
    outs = packed.agg(F.count("*").alias("n_rows"), F.sum(F.col("content_len").cast("long")).alias("tokens_used"),
                      F.sum(F.size("tokens").cast("long")).alias("tokens_out"))
    one = ins.withColumn("__out", outs.select(F.struct("*")).scalar()).select("*", "__out.*")
    return one.select(
        "tokens_in", "tokens_used", (F.col("tokens_in") - F.col("tokens_used")).alias("tokens_cropped"), "n_rows",
        (F.col("tokens_used") / F.col("tokens_out")).alias("utilisation"),
        ((F.col("tokens_in") - F.col("tokens_used")) / F.col("tokens_in")).alias("crop_share"),
        (1 - F.col("tokens_used") / F.col("tokens_out")).alias("pad_share"),
        (F.col("over") / F.col("tokens_in")).alias("crop_floor"))
