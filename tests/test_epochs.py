"""The resumable stream over epochs against a plain recomputation of what each rank reads."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palinode.streaming.epochs import epoch_stream, read_epochs

SIZES = {"a.parquet": 70, "b.parquet": 5, "c.parquet": 0, "d.parquet": 43, "e.parquet": 30}
GROUP = 10


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    root = tmp_path_factory.mktemp("shards")
    for file, n in SIZES.items():
        rows = {"doc": pa.array([f"{file}{i}" if i % 7 else None for i in range(n)], pa.string()), "file": pa.array(["own"] * n, pa.string()),
                "unread": pa.array(range(n), pa.int64())}
        pq.write_table(pa.table(rows), root / file, row_group_size=GROUP)
    (root / "_part.parquet.tmp").write_bytes(b"no shard")
    return str(root)


def rank_rows(world, epochs, state=None):
    """Per rank, in order: (epoch, file, row group, row index), each rank walking its shards by itself."""
    files, out = sorted(SIZES)[:-1], {}
    for rank in range(world):
        seen = out.setdefault(rank, [])
        for epoch in range(state[2] if state else 1, epochs + 1):
            for file in files:
                group = rank
                if state and epoch == state[2]:
                    if file < state[0]:
                        continue
                    if file == state[0]:
                        group = (state[1] // world + 1) * world + rank
                while group * GROUP < SIZES[file]:
                    seen += [(epoch, file, group, i) for i in range(group * GROUP, min((group + 1) * GROUP, SIZES[file]))]
                    group += world
    return out


def by_rank(df, world):
    out = {rank: [] for rank in range(world)}
    for r in df.orderBy("rank", "epoch", "file", "row_group", "row_index").collect():
        assert r.doc == (f"{r.file}{r.row_index}" if r.row_index % 7 else None)
        out[r.rank].append((r.epoch, r.file, r.row_group, r.row_index))
    return out


@pytest.mark.parametrize("world", [1, 3, 20])
@pytest.mark.parametrize("state", [None, ("a.parquet", 4, 1), ("a.parquet", 6, 2), ("d.parquet", 4, 2)])
def test_batch_reads_what_each_rank_reads(spark, shards, world, state):
    got = read_epochs(spark, shards, 2, "doc string", world, state=state)
    assert by_rank(got, world) == rank_rows(world, 2, state)


def test_validation_is_the_last_shard_and_columns_prune(spark, shards):
    got = read_epochs(spark, shards, 1, "doc string", split="val")
    assert {r.file for r in got.select("file").distinct().collect()} == {"e.parquet"} and got.count() == 30
    assert "unread" not in got.columns


def run_once(spark, shards, sink, checkpoint, steps, world=3, trigger=None, **kw):
    stream = epoch_stream(spark, shards, "doc string", world, 2, steps_per_trigger=steps, **kw)
    query = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
    if trigger:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()


@pytest.mark.parametrize("steps", [1, 4])
def test_stop_and_resume_at_any_batch_is_the_unbroken_run(spark, shards, tmp_path, steps):
    sink, checkpoint, want = str(tmp_path / "sink"), str(tmp_path / "ckpt"), rank_rows(3, 2)
    for n in range(1, 4):  # stopped after each batch
        run_once(spark, shards, sink, checkpoint, steps)
        seen = spark.read.parquet(sink)
        got = by_rank(seen, 3)
        assert all(got[r] == want[r][:len(got[r])] for r in want) and 0 < seen.count() <= n * steps * 3 * GROUP
    run_once(spark, shards, sink, checkpoint, 5, trigger={"processingTime": "0 seconds"})
    assert by_rank(spark.read.parquet(sink), 3) == want
    before = spark.read.parquet(sink).count()
    run_once(spark, shards, sink, checkpoint, 5)  # no epoch is left
    assert spark.read.parquet(sink).count() == before


def test_a_state_carried_by_rows_starts_a_new_query_behind_them(spark, shards, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    run_once(spark, shards, first, str(tmp_path / "c1"), 2)
    last = spark.read.parquet(first).orderBy("epoch", "file", "row_group", ascending=False).first()
    run_once(spark, shards, second, str(tmp_path / "c2"), 3, trigger={"processingTime": "0 seconds"},
             state=(last.file, last.row_group, last.epoch))
    assert by_rank(spark.read.parquet(first, second), 3) == rank_rows(3, 2)


def test_a_folder_without_a_training_shard_is_an_error_and_empty_shards_give_no_row(spark, shards, tmp_path):
    with pytest.raises(Exception, match="no shards of the train split"):
        read_epochs(spark, str(tmp_path), 1, "doc string").count()
    for file in ("a.parquet", "b.parquet"):
        pq.write_table(pa.table({"doc": pa.array([], pa.string())}), tmp_path / file)
    assert read_epochs(spark, str(tmp_path), 2, "doc string").count() == 0
