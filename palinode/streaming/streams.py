"""Structured Streaming jobs: document source, stateful packing, log following, meters, ingestion."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palinode.functions.text import LOG_FIELDS, LOG_FILTER, log_field, strip
from palinode.operators.packing import _BestFit

_MESSAGES = "array<struct<role:string,content:string>>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "stream_id int, row_id long, tokens array<int>, n_docs int"


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Unbounded document source: shards in arrival order, position kept by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option(
        "pathGlobFilter", "*.parquet").parquet(path)


class _StatePacker(_BestFit):
    """Best fit over documents whose ids are elsewhere: the buffer holds (order, where, size), ids are fetched when placed."""

    fetch: Callable[[object], np.ndarray]

    def _take(self, at: int) -> tuple:
        _, where, size = super()._take(at)
        ids = self.fetch(where)
        return ids, np.ones(len(ids), np.int32), size


class _Arrived:
    """Documents of a micro-batch as their frames come: ids go to an unnamed file, orders, sizes and places stay. Places of
    documents that were buffered before are their ids themselves."""

    def __init__(self) -> None:
        self.file, self.ids = tempfile.TemporaryFile(), np.empty(0, np.int32)
        self.orders, self.sizes, self.ends = [], [], [0]

    def add(self, frame: pd.DataFrame) -> None:
        known = frame[frame["size"] > 0]  # nothing is packed of a document without ids
        if len(known):
            self.file.write(np.concatenate(known["ids"].tolist()).astype(np.int32).data)
            self.orders += known["doc"].tolist()
            self.sizes += known["size"].tolist()
            self.ends += (np.cumsum([len(x) for x in known["ids"]]) + self.ends[-1]).tolist()

    def in_order(self) -> Iterator[tuple]:
        self.file.flush()
        if self.orders:
            self.ids = np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), np.int32)
        for i in sorted(range(len(self.orders)), key=lambda i: (self.orders[i], self.sizes[i])):
            yield self.orders[i], i, self.sizes[i]

    def fetch(self, where) -> np.ndarray:
        return self.ids[self.ends[where]:self.ends[where + 1]] if isinstance(where, int) else where


class _PackingProcessor(StatefulProcessor):
    """State of a stream: `held`, one entry per buffered document in the order in which equal sizes leave; `row`, the parts of the
    open row; `place`, the next row number and how many buffered entries have not been admitted yet. The state is read and
    written once a micro-batch. The documents that come in lie in a file of the task and are read back in document order, so
    the worker holds order numbers, the buffer and one row, never the batch's ids."""

    def __init__(self, cap: int, buffer: int, refill: int, order: str, chunk: int = 256) -> None:
        self.cap, self.buffer, self.refill, self.order, self.chunk = cap, buffer, refill, order, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", f"doc {self.order}, size int, ids array<int>")
        self.row = handle.getListState("row", "ids array<int>")
        self.place = handle.getValueState("place", "next_row long, arriving int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packer, arrived = _StatePacker(self.cap, self.buffer, self.refill, None), _Arrived()
        packer.fetch = arrived.fetch
        next_row, arriving = self.place.get() if self.place.exists() else (0, 0)
        held = [(doc, np.asarray(ids, np.int32), size) for doc, size, ids in self.held.get()] if self.held.exists() else []
        packer.arriving = held[:len(held) - arriving]
        packer._admit()
        packer.arriving = held[len(held) - arriving:]
        for part, in self.row.get() if self.row.exists() else ():
            packer.row.put((np.asarray(part, np.int32), np.ones(len(part), np.int32), len(part)))

        for frame in rows:
            arrived.add(frame)
        out = []
        for doc in arrived.in_order():
            for tokens, _, n_docs, _, _ in packer.add(doc):
                out.append((key[0], next_row, tokens, n_docs))
                next_row += 1
            if len(out) >= self.chunk:
                yield pd.DataFrame(out, columns=["stream_id", "row_id", "tokens", "n_docs"])
                out = []
        admitted = [d for size in packer.lengths for d in packer.by_len[size]]
        lists = ((self.held, [(doc, size, arrived.fetch(where).tolist()) for doc, where, size in [*admitted, *packer.arriving]]),
                 (self.row, [(p[0].tolist(),) for p in packer.row.parts]))
        for state, values in lists:  # a list state holds one value at least
            if values:
                state.put(values)
            else:
                state.clear()
        self.place.update((next_row, len(packer.arriving)))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "row_id", "tokens", "n_docs"])

    def close(self) -> None:
        pass


def pack_stream(docs: DataFrame, seq_len: int, stream: str = "stream_id", order: str = "doc_id", ids: str = "ids",
                buffer: int = 1000, refill: int = 128) -> DataFrame:
    """Best-fit-crop rows over an unbounded token stream, as `pack_bestfit_crop` gives them where documents arrive in
    order. Documents of a micro-batch that share their order go by size. State per stream is the look-ahead buffer (less than
    buffer + refill documents) and the open row, in a RocksDB state store, which is set for the session. Documents are kept cut to a row's length together
    with their true size, which loses nothing a row could use."""
    docs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cap = seq_len + 1
    # documents without ids are left out behind the select: a filter on the ids would have them computed twice
    picked = docs.select(
        F.col(stream).cast("int").alias("stream_id"), F.col(order).alias("doc"), F.slice(ids, 1, cap).alias("ids"),
        F.coalesce(F.size(ids), F.lit(0)).alias("size"))
    kind = picked.schema["doc"].dataType.simpleString()
    return picked.groupBy("stream_id").transformWithStateInPandas(
        _PackingProcessor(cap, buffer, refill, kind), _ROWS, "append", "none")


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Kept log lines of a folder of rotated logs, with their typed fields."""
    lines = spark.readStream.option("pathGlobFilter", "*.log").text(path).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.log$", "").alias("run"), F.col("value").alias("line"))
    fields = ("step", "loss", "dt_ms", "tok_sec", "val_bpb")
    return lines.where(F.col("line").rlike(LOG_FILTER)).select(
        "run", "line", *[log_field(F.col("line"), f).alias(f) for f in fields if f in LOG_FIELDS])


def meter_stream(steps: DataFrame, run: str, step: str, loss: str, dt: str, bpb: str, warm: int = 10) -> DataFrame:
    """Running minimum bpb, training time after warm-up and mean loss per run (update / complete mode)."""
    return steps.groupBy(run).agg(
        F.min(bpb).alias("min_bpb"),
        F.coalesce(F.sum(F.when(F.col(step) > warm, F.col(dt))), F.lit(0.0)).alias("train_time"),
        F.avg(loss).alias("mean_loss"), F.count("*").alias("n_steps"))


def messages_valid(messages: Column) -> Column:
    """At least two messages, user and assistant in turn from the start, no blank content."""
    in_order = F.forall(F.transform(messages, lambda m, i: (
        m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & (strip(m["content"]) != "")), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.coalesce(messages.isNotNull() & (F.size(messages) >= 2) & in_order, F.lit(False))


def conversation_stream(spark: SparkSession, path: str) -> DataFrame:
    """(value, messages, valid) of JSONL conversations as files arrive."""
    lines = spark.readStream.option("pathGlobFilter", "*.jsonl").text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", _MESSAGES).alias("messages"))
    return parsed.withColumn("valid", messages_valid(F.col("messages")))


def append_valid_conversations(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the valid conversations of arriving files to a text sink, exactly once."""
    return (conversation_stream(spark, source).where("valid").select("value").writeStream.format("text")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_to_table(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Process everything available and return the sink as a table. Complete-mode results replace the
    sink at every trigger. `settings` hold for this query alone."""
    conf = stream.sparkSession.conf
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    kept = {k: conf.get(k) for k in settings or {}}
    try:  # a query takes the session's settings as they are when it starts
        for k, v in (settings or {}).items():
            conf.set(k, v)
        if mode == "append":
            query = writer.format("parquet").option("path", sink).start()
        else:
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(sink)).start()
    finally:
        for k, v in kept.items():
            conf.set(k, v)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
