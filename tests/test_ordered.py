"""Running computations against plain Python, under skew, ties and different partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from palinode.operators import ordered, ranking, series, store


def _skewed(n=3000, seed=1):
    """A third of all rows in one key; order values unique."""
    rng = random.Random(seed)
    order = list(range(n))
    rng.shuffle(order)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", o, round(rng.uniform(-5, 5), 3)) for i, o in enumerate(order)]


def _by_key(rows):
    out = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((o, v))
    return out


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_scan_matches_python_on_skewed_keys(spark, parts):
    rows = _skewed()
    df = spark.createDataFrame(rows, "k string, o long, v double").repartition(parts)
    got = {(r.k, r.o): r for r in ordered.scan(
        df, ["o"], {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "n": ("count", F.lit(1))}, ["k"]).collect()}
    assert len(got) == len(rows)
    for k, seq in _by_key(rows).items():
        total = 0.0
        for i, (o, v) in enumerate(seq):
            total += v
            r = got[k, o]
            assert r.n == i + 1 and abs(r.s - total) < 1e-9 and r.lo == min(x for _, x in seq[:i + 1])


def test_hot_key_is_spread_over_buckets(spark):
    df = spark.createDataFrame(_skewed(), "k string, o long, v double")
    largest = ordered.with_buckets(df, ["o"]).groupBy("k", ordered.BUCKET).count().agg(F.max("count")).first()[0]
    assert largest < 3000 / 3 / 8


def test_tied_leading_value_is_cut_along_the_second(spark):
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "a long, b long")
    b = ordered.with_buckets(df, ["a", "b"])
    assert b.groupBy(ordered.BUCKET).count().agg(F.max("count")).first()[0] < 200
    got = [r.idx for r in ordered.dense_index(df, ["a", "b"]).orderBy("a", "b").collect()]
    assert got == list(range(3000))


def test_neighbour_crosses_buckets_and_keeps_nulls_apart(spark):
    rows = [(None if i % 5 == 0 else "x", i, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    for forward in (False, True):
        got = {(r.k, r.o): r.p for r in ordered.neighbour(df, ["o"], {"p": "v"}, ["k"], forward=forward).collect()}
        assert len(got) == 400
        for k, seq in _by_key([r for r in rows if r[0]] ).items():
            for i, (o, _) in enumerate(seq):
                j = i + 1 if forward else i - 1
                assert got[k, o] == (seq[j][1] if 0 <= j < len(seq) else None)
        step = 5.0 if forward else -5.0
        assert got[None, 100] == 100 + step


def test_ema_fixture_and_long_series(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 2.0])] + [("b", i, float((i * 7919) % 101)) for i in range(1500)]
    df = spark.createDataFrame(rows, "run string, step long, x double").repartition(5)
    got = {(r.run, r.step): r.ema for r in ordered.ema(df, ["run"], ["step"], "x").collect()}
    assert got["a", 0] == pytest.approx(1.0) and got["a", 1] == pytest.approx(1.526316, abs=1e-6)
    s = 0.0
    for _, i, x in rows[2:]:
        s = 0.9 * s + 0.1 * x
        assert got["b", i] == pytest.approx(s / (1 - 0.9 ** (i + 1)), rel=1e-9)


def test_median_even_odd_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 9.0)], "k string, v double")
    assert {r.k: r.m for r in ordered.median(df, ["k"], "v", "m").collect()} == {"a": 1.0, "b": 3.0}
    assert ordered.median(df, [], "v", "m").first().m == 2.0
    scaled = series.minmax(df, [], "v").select(F.min("scaled"), F.max("scaled")).first()
    assert tuple(scaled) == (0.0, 1.0)


def test_top_k_ties_and_nucleus_fixtures(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5.0, 4.0, 4.0, 1.0])], "g string, i long, s double")
    assert sorted(r.s for r in ranking.top_k_ties(df, ["g"], "s", 2).collect()) == [4.0, 4.0, 5.0]
    assert [r.i for r in ranking.top_k(df, ["g"], "s", 2, "i").orderBy("rank").collect()] == [0, 1]
    p = spark.createDataFrame([("g", i, x) for i, x in enumerate([0.5, 0.3, 0.15, 0.05])], "g string, i long, p double")
    assert sorted(r.i for r in ranking.nucleus(p, ["g"], "i", "p", 0.7).collect()) == [0, 1]
    assert [r.i for r in ranking.nucleus(p, ["g"], "i", "p", 0.1).collect()] == [0]
    assert ranking.greedy(df.withColumn("s", F.lit(1.0)), ["g"], "i", "s").first().best == 0


def test_schedule(spark):
    sched = series.parse_schedule("512:0,1024:0.25,2048:0.60", 100, 2048)
    steps = spark.createDataFrame([(s,) for s in (0, 24, 25, 60)], "step int")
    assert [r.seq_len for r in series.schedule_asof(steps, sched).orderBy("step").collect()] == [512, 512, 1024, 2048]
    assert series.parse_schedule("64:10", 100, 64) == [(10, 64)]
    assert series.schedule_asof(steps, [(10, 64)]).where("step = 0").first().seq_len == 64
    assert series.schedule_asof(steps, [(0, 1), (0, 2)]).first().seq_len == 2
    with pytest.raises(ValueError):
        series.parse_schedule("4096:0", 100, 2048)


@pytest.mark.parametrize("multiple,budget", [(4, 300), (8, 5000), (3, 1)])
def test_repackage_plan_matches_sequential_cut(spark, multiple, budget):
    rng = random.Random(multiple)
    docs = spark.createDataFrame([(i, rng.randrange(1, 120)) for i in range(131)], "doc_id long, n_chars long")
    chars = {r.doc_id: r.n_chars for r in docs.collect()}
    plan = sorted(store.repackage_plan(docs, "doc_id", "n_chars", budget, multiple).collect(), key=lambda r: r.position)
    assert [r.position for r in plan] == list(range(131))
    shard, held, n, want = 0, 0, 0, []
    for r in plan:
        want.append(shard)
        held, n = held + chars[r.doc_id], n + 1
        if held >= budget and n % multiple == 0:
            shard, held, n = shard + 1, 0, 0
    assert [r.shard_id for r in plan] == want
    kept = store.repackage_plan(docs, "doc_id", "n_chars", budget, multiple, drop_tail=True).count()
    assert kept == sum(1 for s in want if s < shard)


def test_deltas_and_running_best(spark):
    df = spark.createDataFrame([("r", 0, 3.0), ("r", 1, 2.0), ("r", 2, 2.5), ("r", 3, 1.0)], "run string, step long, v double")
    assert [r.drop for r in series.deltas(df, ["run"], ["step"], "v").orderBy("step").collect()] == [None, 1.0, -0.5, 1.5]
    best = series.running_best(df, ["run"], ["step"], "v").orderBy("step").collect()
    assert [r.new_best for r in best] == [True, True, False, True]


@pytest.mark.parametrize("values", [
    [f"shards/part-{i:05d}.parquet" for i in range(60)],
    ["a" * (i % 7) + chr(97 + i % 26) + "é" * (i % 3) + str(i) for i in range(60)],
    ["same-long-prefix-" + "x" * 8 + f"{i:02d}" for i in range(59)] + ["zz"],
    [None, "", "a", "aa", "same"],
])
def test_string_orders_keep_their_positions(spark, values):
    rows = [(v, r) for v in values for r in range(40)] + [(values[3], r) for r in range(40, 1500)]
    df = spark.createDataFrame(rows, "file string, row_index long").repartition(5)
    got = [(r.file, r.row_index) for r in ordered.dense_index(df, ["file", "row_index"]).orderBy("idx").collect()]
    assert got == sorted(rows, key=lambda r: ((r[0] is not None), (r[0] or "").encode(), r[1]))
    buckets = ordered.with_buckets(df, ["file", "row_index"])
    assert buckets.groupBy(ordered.BUCKET).count().agg(F.max("count")).first()[0] < len(rows) / 4
    single = df.dropDuplicates(["file"])
    names = [r.file for r in ordered.dense_index(single, ["file"]).orderBy("idx").collect()]
    assert names == sorted(set(values), key=lambda v: (v is not None, (v or "").encode()))


def test_long_values_that_share_a_double_stay_in_order(spark):
    rows = [(2**60 + i // 3, i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    got = [(r.a, r.b) for r in ordered.dense_index(df, ["a", "b"]).orderBy("idx").collect()]
    assert got == rows


def test_window_starts_reach_beyond_32_bits(spark):
    from palinode.functions.seeded import seed_place

    top = spark.range(200).select(seed_place(10**13, 1, "id").alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= top[0] and 9 * 10**12 < top[1] < 10**13


def test_missing_baseline_and_small_tasks_are_not_passed_over(spark):
    from palinode.operators import metrics, mixture

    acc = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "task string, accuracy double")
    one = spark.createDataFrame([("a", 25.0)], "task string, random_baseline double")
    row = metrics.core_metric(acc, one).first()
    assert row.core is None and row.n_tasks == 2
    items = spark.createDataFrame([("t", i) for i in range(3)], "task string, item_id long")
    assert mixture.fewshot(items, 2).count() == 3
    with pytest.raises(Exception, match="3 shots need more than 3 items"):
        mixture.fewshot(items, 3).collect()
