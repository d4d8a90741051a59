"""Packers against a plain list model of the same rules, and row invariants."""

import random

import pytest
from pyspark.sql import functions as F

from palinode.functions import sequences as S
from palinode.operators import packing, store


def _docs(spark, lens, streams=1, bos=9):
    rows = [(i, i % streams, [bos] + [100 + i] * (n - 1)) for i, n in enumerate(lens)]
    return spark.createDataFrame(rows, "idx long, stream_id int, ids array<int>"), [r[2] for r in rows]


def _model(docs, cap, buffer, refill, pad=None):
    """List-scanning best fit: returns full rows and the unfinished one."""
    queue, buf, rows, row = list(docs), [], [], []

    def top_up():
        while len(buf) < buffer and queue:
            buf.extend(queue[:refill])
            del queue[:refill]

    while True:
        top_up()
        if not buf:
            break
        room = cap - len(row)
        fits = [d for d in buf if len(d) <= room]
        if fits:
            best = max(len(d) for d in fits)
            at = next(i for i, d in enumerate(buf) if len(d) == best)
            row = row + buf.pop(at)
        elif pad is None:
            at = min(range(len(buf)), key=lambda i: len(buf[i]))
            row = row + buf.pop(at)[:room]
        else:
            rows.append(row + [pad] * room)
            row = []
        if len(row) == cap:
            rows.append(row)
            row = []
    return rows, row


def _rows(df):
    return [list(r.tokens) for r in df.orderBy("stream_id", "row_id").collect()]


def test_bestfit_crop_fixture(spark):
    df, docs = _docs(spark, [5, 3, 3, 2, 8])
    rows = _rows(packing.pack_bestfit_crop(df, 5, "idx"))
    a, b, c, d, e = docs
    assert rows == [a + d[:1], b + c, e[:6]]


@pytest.mark.parametrize("seed", range(4))
def test_bestfit_crop_matches_model(spark, seed):
    rng = random.Random(seed)
    df, docs = _docs(spark, [rng.randrange(1, 60) for _ in range(400)], streams=3)
    got = packing.pack_bestfit_crop(df.repartition(5), 32, "idx", buffer=20, refill=7, keep_tail=True)
    for s in range(3):
        full, tail = _model(docs[s::3], 33, 20, 7)
        mine = _rows(got.where(F.col("stream_id") == s))
        assert mine == full + ([tail] if tail else [])
    assert got.where(~F.col("complete")).count() <= 3


def test_bestfit_pad_fixture_and_model(spark):
    df, docs = _docs(spark, [4, 3, 3])
    df = df.withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    packed = packing.pack_bestfit_pad(df, 5, "idx", 9)
    assert _rows(packed) == [docs[0] + [9, 9], docs[1] + docs[2]]
    targets = [list(r.targets) for r in packing.train_rows(packed).orderBy("row_id").collect()]
    assert targets[0] == [100, 100, 100, -1, -1] and targets[1] == [101, 101, 9, 102, 102]
    rng = random.Random(5)
    df, docs = _docs(spark, [rng.randrange(1, 34) for _ in range(300)])
    df = df.withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    got = packing.pack_bestfit_pad(df, 32, "idx", 9, buffer=15)
    full, tail = _model(docs, 33, 15, 1, pad=9)
    want = full + ([tail + [9] * (33 - len(tail))] if tail else [])
    assert _rows(got) == want
    assert got.agg(F.sum("content_len")).first()[0] == sum(map(len, docs))
    assert packing.pack_rejects(df, 20).count() == sum(1 for d in docs if len(d) > 21)


def test_greedy_and_ffd_invariants(spark):
    rng = random.Random(3)
    df, docs = _docs(spark, [rng.randrange(1, 80) for _ in range(200)])
    crop = packing.packing_report(df, packing.pack_greedy_crop(df, 32, "idx"), 32).first()
    pad = packing.packing_report(df, packing.pack_greedy_pad(df, 32, "idx", 0), 32).first()
    ffd = packing.packing_report(df, packing.pack_ffd(df, 32, "idx", 0), 32).first()
    assert crop.utilisation == 1.0 and crop.crop_share >= crop.crop_floor
    assert pad.crop_share == pytest.approx(pad.crop_floor) and ffd.crop_share == pytest.approx(ffd.crop_floor)
    assert ffd.n_rows <= pad.n_rows


def test_row_invariants_and_reverse(spark):
    df, docs = _docs(spark, [random.Random(1).randrange(1, 50) for _ in range(200)])
    plain = _rows(packing.pack_bestfit_crop(df, 16, "idx"))
    flipped = _rows(packing.pack_bestfit_crop(df, 16, "idx", reverse=True, bos=9))
    assert all(len(r) == 17 and r[0] == 9 for r in plain)
    assert [[9] + r[:0:-1] for r in plain] == flipped


def test_chop_fixture_and_offsets(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, []), (3, [4, 5])], "idx long, ids array<int>")
    blocks = packing.pack_chop(df, "idx", 4, 0).orderBy("block_id").collect()
    assert [list(b.tokens) for b in blocks] == [[1, 2, 0, 3], [0, 4, 5, 0]]
    stored = store.store_blocks(df, "idx", 0, 4, 6).orderBy("block_id").collect()
    assert [list(b.tokens) for b in stored] == [[1, 2, 0, 3], [0, 4]]


def test_windows_read_back_the_stream(spark):
    rng = random.Random(2)
    docs = [(i, [rng.randrange(100) for _ in range(rng.randrange(1, 30))]) for i in range(60)]
    df = spark.createDataFrame(docs, "idx long, ids array<int>")
    stream = [t for _, ids in docs for t in [*ids, 0]]
    blocks = store.store_blocks(df, "idx", 0, 16)
    draws = spark.range(50).withColumnRenamed("id", "draw")
    region = store.val_region(len(stream), 12, 3)
    assert region["val_lo"] < region["val_hi"] <= len(stream) - 12
    for r in store.sample_windows(blocks, draws, "draw", 0, len(stream) - 12, 12, 16).collect():
        assert list(r.tokens) == stream[r.start:r.start + 12]


def test_sequence_fixtures(spark):
    df = spark.createDataFrame([([9, 1, 2, 9, 3],)], "row array<int>")
    rev = S.reverse_rows(F.col("row"), 9)
    inputs, targets = S.shift(rev)
    r = df.select(rev.alias("r"), inputs.alias("i"), targets.alias("t"),
                  S.reverse_rows(F.col("row"), 9, per_document=True).alias("d")).first()
    assert list(r.r) == [9, 3, 9, 2, 1] and list(r.i) == [9, 3, 9, 2] and list(r.t) == [3, 9, 2, 1]
    assert list(r.d) == [9, 2, 1, 9, 3]
    seqs = spark.createDataFrame([([[1, 2, 3], [1, 2, 4, 3]],), ([[1], [1, 2]],), ([[2], [1]],)], "s array<array<int>>")
    got = [(x.p, x.q) for x in seqs.select(S.common_prefix_len(F.col("s")).alias("p"), S.common_suffix_len(F.col("s")).alias("q")).collect()]
    assert got == [(2, 1), (1, 0), (0, 0)]
    crop = spark.createDataFrame([([1, 2, 3, 4, 5], 3, 5)], "ids array<int>, s int, e int")
    ids, s, e = S.left_crop(F.col("ids"), F.col("s"), F.col("e"), 3)
    c = crop.select(ids.alias("i"), s.alias("s"), e.alias("e")).first()
    assert (list(c.i), c.s, c.e) == ([3, 4, 5], 1, 3)
    means = spark.createDataFrame([([1.0, 3.0, 9.0],)], "l array<double>").select(
        S.span_mean(F.col("l"), F.lit(0), F.lit(2)).alias("m"), S.span_mean(F.col("l"), F.lit(1), F.lit(1)).alias("e")).first()
    assert means.m == 2.0 and means.e == float("inf")


def test_streaming_packer_equals_batch(spark, tmp_path):
    from palinode.streaming import streams

    rng = random.Random(8)
    df, docs = _docs(spark, [rng.randrange(1, 60) for _ in range(300)], streams=2)
    for i in range(3):  # three files arrive one after the other
        df.where((F.col("idx") >= i * 100) & (F.col("idx") < (i + 1) * 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.document_stream(spark, str(tmp_path / "in"), "idx long, stream_id int, ids array<int>")
    out = streams.run_to_table(streams.pack_stream(source, 32, order="idx", buffer=20, refill=7), str(tmp_path / "out"), str(tmp_path / "ck"))
    for s in range(2):
        full, _ = _model(docs[s::2], 33, 20, 7)
        mine = _rows(out.where(F.col("stream_id") == s))
        assert mine == full[:len(mine)] and len(mine) > len(full) / 2
