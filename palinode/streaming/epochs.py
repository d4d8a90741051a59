"""Document shards read over and over by a group of ranks, as a data source with offsets of its own.

A step is `world` row groups that follow one another in a shard; rank r reads the r-th of them, and a rank finds nothing
in a step that has fewer groups. Steps go through a shard, then to the next by name, then to the next epoch. Every row
carries (epoch, file, row_group), so what was read last is a state to resume from, and (rank, epoch, file, row_group,
row_index) is the order in which a rank sees its documents.

The stream's offset is the next step, by the shard's name, so a shard that comes in later moves no other. The driver lists
names and reads the footers of the shards of the batch at hand once, never a document. A task reads row groups of one shard
that follow one another, batch by batch, the wanted columns only; a micro-batch is dealt to `tasksPerTrigger` tasks or a few
more, one row group at least each, so that a footer is not read once per row group. The batch reader plans one partition per
shard and epoch, without footers.

Defined results: temporary files are no shards; the training split is all but the last shard by name, the validation split
is the last; a folder without shards of the split is an error; a shard without rows has no steps, and a split of such shards
gives no row; columns named like the five position columns give way to them; nulls and long texts pass as they are.
Paths are local or of a file system that pyarrow opens by its address (hdfs, s3, gs, abfs).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

POSITION = "rank int, epoch int, file string, row_group int, row_index long"
_PLACES = POSITION.replace(" int", "").replace(" string", "").replace(" long", "").split(", ")
FORMAT = "epoch_documents"


@dataclass
class _Groups(InputPartition):
    """Row groups of one shard in one epoch: those from `low` on, up to `high` (not included) if given."""

    epoch: int
    file: str
    low: int = 0
    high: int | None = None


class _Shards:
    """Shards of a split and the order of their steps."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.path = options["path"]
        self.world, self.epochs = int(options.get("world", 1)), int(options.get("epochs", 0))
        self.per_batch, self.tasks = int(options.get("stepspertrigger", 64)), int(options.get("taskspertrigger", 32))
        self.split = options.get("split", "train")
        if min(self.world, self.per_batch, self.tasks) < 1 or self.split not in ("train", "val"):
            raise ValueError("world, stepsPerTrigger and tasksPerTrigger are positive, split is train or val")
        self.resume = (int(options["epoch"]), options["file"], int(options["rowgroup"])) if "file" in options else None
        self.counts: dict[str, int] = {}

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def names(self) -> list[str]:
        system, root = self.place()
        found = system.get_file_info(fs.FileSelector(root))
        names = sorted(i.base_name for i in found if i.is_file and i.base_name.endswith(".parquet") and i.base_name[0] not in "._")
        names = names[:-1] if self.split == "train" else names[-1:]
        if not names:
            raise FileNotFoundError(f"no shards of the {self.split} split in {self.path}")
        return names

    def open(self, file: str) -> pq.ParquetFile:
        system, root = self.place()
        return pq.ParquetFile(f"{root}/{file}", filesystem=system, pre_buffer=False)

    def groups(self, file: str) -> int:
        """Row groups of a shard, none if it has no rows."""
        if file not in self.counts:
            with self.open(file) as f:
                self.counts[file] = f.num_row_groups if f.metadata.num_rows else 0
        return self.counts[file]

    def steps(self, file: str) -> int:
        return -(-self.groups(file) // self.world)

    def start(self) -> dict:
        """The first step, or the one after a rank's state (its other groups of that step are taken as read)."""
        if self.resume is None:
            return {"epoch": 1, "file": "", "base": 0}
        epoch, file, group = self.resume
        return {"epoch": epoch, "file": file, "base": group // self.world + 1}

    def walk(self, at: dict) -> Iterator[tuple[int, str, int]]:
        """Steps from `at` on, forever or to the end of the last epoch."""
        epoch, file, base = at["epoch"], at["file"], at["base"]
        names = self.names()
        while not self.epochs or epoch <= self.epochs:
            any_step = False
            for name in names[bisect_left(names, file):]:
                for step in range(base if name == file else 0, self.steps(name)):
                    any_step = True
                    yield epoch, name, step
            if not any_step and not file and not self.epochs:
                return  # shards without rows: no epoch has a step
            epoch, file, base = epoch + 1, "", 0

    def read(self, part: _Groups) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        columns = [f.name for f in wanted if f.name not in _PLACES]
        with self.open(part.file) as f:
            first = 0
            for group in range(f.num_row_groups):
                n = f.metadata.row_group(group).num_rows
                if part.low <= group and (part.high is None or group < part.high):
                    at = first
                    for batch in f.iter_batches(1024, row_groups=[group], columns=columns):
                        k = batch.num_rows
                        held = {"rank": group % self.world, "epoch": part.epoch, "file": part.file, "row_group": group}
                        data = {**{c: batch.column(c) for c in columns},
                                **{c: pa.repeat(pa.scalar(v, wanted.field(c).type), k) for c, v in held.items()},
                                "row_index": pa.array(range(at, at + k), pa.int64())}
                        yield pa.RecordBatch.from_arrays(
                            [data[x.name] if data[x.name].type == x.type else data[x.name].cast(x.type) for x in wanted], schema=wanted)
                        at += k
                first += n


class _EpochStream(DataSourceStreamReader):
    def __init__(self, shards: _Shards) -> None:
        self.shards, self.seen = shards, None

    def initialOffset(self) -> dict:
        return self.shards.start()

    def latestOffset(self) -> dict:
        """The step after the next `stepsPerTrigger` ones; the same offset again when no epoch is left."""
        at = self.seen or self.shards.start()
        last = None
        for n, last in enumerate(self.shards.walk(at), 1):
            if n == self.shards.per_batch:
                break
        self.seen = at if last is None else {"epoch": last[0], "file": last[1], "base": last[2] + 1}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[_Groups]:
        # also called with the last offsets of a checkpoint, after which the stream goes on
        self.seen = end
        stop = (end["epoch"], end["file"], end["base"])
        runs: dict[tuple[int, str], list[int]] = {}  # (first, last + 1) row group of each shard and epoch
        if start == end:
            return []
        for epoch, file, base in self.shards.walk(start):
            if (epoch, file, base) >= stop:
                break
            low = base * self.shards.world
            run = runs.setdefault((epoch, file), [low, low])
            run[1] = min(low + self.shards.world, self.shards.groups(file))
        size = -(-sum(high - low for low, high in runs.values()) // self.shards.tasks)
        return [_Groups(epoch, file, at, min(at + size, high))
                for (epoch, file), (low, high) in runs.items() for at in range(low, high, size)]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        return self.shards.read(partition)


class _EpochBatch(DataSourceReader):
    def __init__(self, shards: _Shards) -> None:
        if not shards.epochs:
            raise ValueError("a batch needs a number of epochs")
        self.shards = shards

    def partitions(self) -> list[_Groups]:
        at, names = self.shards.start(), self.shards.names()
        out = []
        for epoch in range(at["epoch"], self.shards.epochs + 1):
            first = epoch == at["epoch"]
            for file in names[bisect_left(names, at["file"]) if first else 0:]:
                out.append(_Groups(epoch, file, at["base"] * self.shards.world if first and file == at["file"] else 0))
        return out or [_Groups(0, names[0], 0, 0)]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        return self.shards.read(partition)


class EpochDocuments(DataSource):
    """Options: path, world, epochs (0: without end), split, stepsPerTrigger, tasksPerTrigger, and a state (epoch, file,
    rowGroup)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"text string, {POSITION}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _EpochBatch(_Shards(schema, self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _EpochStream(_Shards(schema, self.options))


def _source(reader, spark: SparkSession, path: str, columns: str, world: int, epochs: int, split: str, state) -> DataFrame:
    spark.dataSource.register(EpochDocuments)
    reader = reader.format(FORMAT).schema(f"{columns}, {POSITION}").options(world=world, epochs=epochs, split=split)
    if state is not None:
        file, row_group, epoch = state
        reader = reader.options(file=file, rowGroup=row_group, epoch=epoch)
    return reader.load(path)


def epoch_stream(spark: SparkSession, path: str, columns: str = "text string", world: int = 1, epochs: int = 0, split: str = "train",
                 state: tuple[str, int, int] | None = None, steps_per_trigger: int = 64) -> DataFrame:
    """`columns` (as a schema) and the position columns, `steps_per_trigger` steps a micro-batch. A query's checkpoint holds
    its offset; `state` (file, row group, epoch), as the rows carry it, starts a new query behind what a rank read last."""
    reader = spark.readStream.option("stepsPerTrigger", steps_per_trigger)
    return _source(reader, spark, path, columns, world, epochs, split, state)


def read_epochs(spark: SparkSession, path: str, epochs: int, columns: str = "text string", world: int = 1, split: str = "train",
                state: tuple[str, int, int] | None = None) -> DataFrame:
    """The rows that `epoch_stream` gives in so many epochs, as a table."""
    return _source(spark.read, spark, path, columns, world, epochs, split, state)
