"""Token ids as Parquet list columns: written in key order, read selectively.

File format: one row per document with `ids` (list of int), `n_tokens`, the key, `part` and `start_in_part`. Ids
are dictionary encoded (a vocabulary fits one dictionary page); key, counts and starts are delta encoded.
Row groups have a target size and pages a row limit, both parameters; the writer adds page indexes, so a
reader that filters on the key skips pages and one that wants metadata only never touches the ids.

Documents are range partitioned by key before they are encoded, so that each partition is one run of the
order and encodes, numbers and writes its run by itself. The start of a document in the whole order is the sum
of the parts before its own plus `start_in_part`; parts are as many as files.

Defined results: a null text is an empty text and has the end id alone; null keys come first; rows of one
key are ordered by a hash of their text, equal rows are kept and interchangeable, a frequent key is spread over
several parts; a very long text is encoded as a slice of its own; an empty table gives a store without rows;
further columns are not stored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palinode.llm.segments import ChunkMemo, pieces, slices, spread_ranges, text_bytes

_HASH = "__text_hash"


# what `segments.pieces` cuts off as a run of one kind
_ONE_KIND = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable and
    Latin-1, else the next unused one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


@functools.lru_cache(2)
def _memo(path: str) -> ChunkMemo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    tokenize, letter = tokenizer.model.tokenize, _byte_letters()

    def encode(raw: list[bytes]) -> list[list[int]]:
        """Ids of each part. A run of one kind is one pre-token: lower-cased, it goes to the library's merges at
        once; any other part goes through the whole tokenizer."""
        out = []
        for x in raw:
            text = x.decode()
            if _ONE_KIND.fullmatch(text):
                word = text.lower()
                word = word if word.isascii() else "".join([letter[b] for b in word.encode()])
                out.append([t.id for t in tokenize(word)])
            else:
                out.append(tokenizer.encode(text, add_special_tokens=False).ids)
        return out

    return ChunkMemo(encode)


@functools.lru_cache(2)
def _added(path: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """Pattern of the added tokens of the file, longest first, and their ids by content."""
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(path).get_added_tokens_decoder()
    if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
        raise ValueError("added tokens are matched as they stand; normalized, single_word, lstrip and rstrip are not known here")
    ids = {t.content.encode(): i for i, t in added.items()}
    return re.compile(b"|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None, ids


def _find_added(data: np.ndarray, offsets: np.ndarray, tokenizer: str) -> list[tuple[int, int, int]]:
    """(start, end, id) of every added token inside a document."""
    (pattern, ids), raw = _added(tokenizer), data.tobytes()
    if pattern is None or not pattern.search(raw):
        return []
    return [(m.start(), m.end(), ids[m[0]]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            for m in pattern.finditer(raw, a, b)]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                 end_id: int | None = 1, row_group_bytes: int = 32 << 20, page_rows: int = 1000,
                 added_tokens: bool = False) -> None:
    """Encode whole texts and write the store to the folder `out`.

    `tokenizer` is a file of the tokenizers library that lower-cases, drops white space and splits letters, digits
    and signs from each other, so that the parts of `segments.pieces` are encoded as in their document; each worker
    asks the library once for every distinct part it keeps. `end_id` closes every document. With `added_tokens` the
    strings of the file's added tokens get their ids, as by the library's default; else they are ordinary text.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    placed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias(_HASH))
    placed = placed.repartitionByRange("key", _HASH).sortWithinPartitions("key", _HASH, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, at, part = _memo(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, "text"):
                n = piece.num_rows
                data, offsets = text_bytes(piece.column("text"))
                added = _find_added(data, offsets, tokenizer) if added_tokens else []
                if added:  # blanks in a stretch of their own, which `pieces` drops; what is around them is cut there
                    at_added, end_added, added_ids = np.array(added, np.int64).T
                    data = data.copy()
                    data[spread_ranges(at_added, end_added - at_added)] = 32
                    starts, ends, _ = pieces(data, np.unique(np.concatenate([offsets, at_added, end_added])))
                    doc = np.searchsorted(offsets, starts, "right") - 1
                else:
                    starts, ends, doc = pieces(data, offsets)
                ids, sizes = memo.ids_of(data, starts, ends, fold=True)
                counts = np.bincount(doc, sizes, n).astype(np.int64)
                if added:
                    before = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, at_added)]
                    ids = np.insert(ids, before, added_ids)
                    counts += np.bincount(np.searchsorted(offsets, at_added, "right") - 1, minlength=n)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts += 1
                before = np.cumsum(counts) - counts
                lists = pa.ListArray.from_arrays(pa.array(np.append(before, counts.sum()).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), pa.array(np.full(n, part, np.int32)), pa.array(before + at), pa.array(counts), lists],
                    ["key", "part", "start_in_part", "n_tokens", "ids"])
                at += int(counts.sum())

    rows = placed.select("key", "text").mapInArrow(
        run, f"key {kind}, part int, start_in_part long, n_tokens long, ids array<int>")
    writer = rows.withColumnRenamed("key", key).write.mode("errorifexists")
    for name, value in {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in (key, "part", "start_in_part", "n_tokens")},
    }.items():
        writer = writer.option(name, value)
    writer.parquet(out)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids): `start` counts the ids of all documents before in key order. Without `ids` only
    the metadata columns are read."""
    stored = spark.read.parquet(path)
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    # one row per file: sent to every task while that is small, so that the ids stay where they are
    if sums.count() <= 1_000_000:
        bases = F.broadcast(bases)
    rows = stored.join(bases, F.col("part") == F.col("__part"))
    return rows.select(key, (F.col("__base") + F.col("start_in_part")).alias("start"), "n_tokens",
                       *(["ids"] if ids else []))


def id_checksums(rows: DataFrame, out: str = "ids_crc32") -> DataFrame:
    """`ids` replaced by the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    others = [f for f in rows.schema.fields if f.name != "ids"]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            raw = memoryview(np.asarray(column.flatten(), "<u4").tobytes())
            ends = np.asarray(column.offsets, np.int64)
            at = (4 * (ends - ends[0])).tolist()
            sums = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [sums], [*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"{out} long"])
    return rows.select(*names, "ids").mapInArrow(run, schema)
