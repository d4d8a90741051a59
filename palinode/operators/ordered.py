"""Running computations over an order, with no single-task window and no group bound to one task.

Plain `Window.partitionBy(key).orderBy(...)` sends a whole key to one task, and an unpartitioned window
sends the whole table there. Here the order is first cut into buckets at approximate quantiles, so that
(key, bucket) is the unit of work: even a key that holds a third of all rows is spread over the buckets.
Each bucket is reduced to one carry row, the carry rows are accumulated (at most one per bucket and
key), and the window then runs inside (key, bucket) only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
_LEAD = "__lead"


def _bucket_count(df: DataFrame, wanted: int | None) -> int:
    if wanted:
        return wanted
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32, 2 * parts)


def _hex_double(name: str) -> Column:
    """Leading 32 bits of a lower-case hex digest, which sort like the text."""
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("double")


def _string_place(df: DataFrame, name: str, n: int = 1024, seed: int = 17) -> Column:
    """Place of a string among at most `n` sampled values: even for one of them, odd between two. Which values are
    sampled decides how even buckets are, not the order."""
    known = df.where(F.col(name).isNotNull()).select(name)
    share = min(1.0, 20.0 * n / max(1, known.count()))
    sample = known if share == 1.0 else known.sample(share, seed)
    values = sorted((r[0] for r in sample.collect()), key=str.encode)  # 20 a split on average
    cuts = sorted({values[i * len(values) // n] for i in range(n)}, key=str.encode) if values else []
    if not cuts:
        return F.when(F.col(name).isNotNull(), 0.0)
    run = math.isqrt(len(cuts) - 1) + 1  # two levels: about two square roots of comparisons a row
    groups = [cuts[i:i + run] for i in range(0, len(cuts), run)]
    group = F.size(F.filter(F.lit([g[0] for g in groups]), lambda c: c <= F.col(name)))
    inside = F.get(F.array(*[F.lit(g) for g in groups]), group - 1)
    last = (group - 1) * run + F.size(F.filter(inside, lambda c: c <= F.col(name))) - 1
    place = F.when(group == 0, -1).otherwise(2 * last + (F.element_at(
        F.filter(inside, lambda c: c <= F.col(name)), -1) != F.col(name)).cast("int"))
    return F.when(F.col(name).isNotNull(), place).cast("double")


def _as_double(df: DataFrame, name: str) -> Column:
    """A double that never decreases where the column increases (equal doubles for unequal values are fine)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, T.StringType):
        return _string_place(df, name)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double")
    raise TypeError(f"cannot order by {name}: {kind.simpleString()}")


def _quantiles(df: DataFrame, value: Column, n: int) -> list[float]:
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(value, probs, max(10_000, 20 * n)).alias("q")).first()
    return [float(x) for x in (row["q"] or [])]


def _assign(df: DataFrame, source: str, splits: Sequence[float], out: str) -> DataFrame:
    inner = [s for s in sorted(set(splits)) if math.isfinite(s)]
    if not inner:
        return df.withColumn(out, F.lit(0))
    bucketizer = Bucketizer(
        splits=[-math.inf, *inner, math.inf], inputCol=source, outputCol=out, handleInvalid="keep"
    )
    return bucketizer.transform(df).withColumn(out, F.col(out).cast("int"))


def with_buckets(df: DataFrame, order: Sequence[str], n_buckets: int | None = None,
                 uniform_hex: bool = False, width: int | None = None) -> DataFrame:
    """Add BUCKET, non-decreasing along `order` (ascending; numbers, strings, dates or timestamps).

    A leading value that fills several quantiles by itself gets as many buckets of its own, cut along the second
    order column; in all there are at most a few times `n_buckets`. `uniform_hex` skips the quantile pass for md5
    orders, whose quantiles are known; `width` skips it where the leading column numbers the rows of a key (turns,
    steps): a bucket is then a run of `width` numbers.
    """
    if width:
        return df.withColumn(BUCKET, F.floor(F.col(order[0]) / width).cast("long"))
    n = _bucket_count(df, n_buckets)
    if uniform_hex:
        led = df.withColumn(_LEAD, F.coalesce(_hex_double(order[0]), F.lit(-math.inf)))
        return _assign(led, _LEAD, [i * 2**32 / n for i in range(1, n)], BUCKET).drop(_LEAD)
    led = df.withColumn(_LEAD, F.coalesce(_as_double(df, order[0]), F.lit(-math.inf)))
    qs = _quantiles(led, F.col(_LEAD), n)
    fills: dict[float, int] = {}
    for x in qs:
        fills[x] = fills.get(x, 0) + 1
    heavy = {x: k for x, k in fills.items() if k > 1}
    if heavy and len(order) > 1:
        # only a double that stands for one value may be cut along the next column
        first = F.col(order[0])
        single = led.where(F.col(_LEAD).isin(list(heavy))).groupBy(_LEAD).agg(
            (F.min(first).eqNullSafe(F.max(first)) & F.count(first).isin(0, F.count("*"))).alias("one"))
        heavy = {r[_LEAD]: heavy[r[_LEAD]] for r in single.where("one").collect()}  # at most one row per quantile
    led = _assign(led, _LEAD, {*qs, *[math.nextafter(h, math.inf) for h in heavy]}, BUCKET)
    if heavy and len(order) > 1:
        tied = F.col(_LEAD).isin(list(heavy))
        second = F.coalesce(_as_double(led, order[1]), F.lit(-math.inf))
        inner = _quantiles(led.where(tied), second, n)
        led = _assign(led.withColumn("__second", F.when(tied, second).otherwise(F.lit(-math.inf))), "__second", inner, "__sub")
        share = F.create_map(*[F.lit(v) for pair in heavy.items() for v in pair])[F.col(_LEAD)]
        sub = F.when(tied, F.floor(F.col("__sub") * share / n)).otherwise(0)
        led = led.withColumn(BUCKET, F.col(BUCKET).cast("long") * (n + 2) + sub).drop("__second", "__sub")
    return led.drop(_LEAD)


def order_columns(order: str | Sequence[str]) -> list[str]:
    """One name or several as a list."""
    return [order] if isinstance(order, str) else list(order)


_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _combine(op: str, base: Column, own: Column) -> Column:
    if op in ("sum", "count"):
        return F.coalesce(base, F.lit(0)) + F.coalesce(own, F.lit(0))
    return F.least(base, own) if op == "min" else F.greatest(base, own)


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    """Attach one carry row per (keys, bucket); keys compare null-safe."""
    names = [*keys, BUCKET]
    renamed = carry.withColumnsRenamed({k: f"__c_{k}" for k in names})
    if not keys and bounded:
        renamed = F.broadcast(renamed)  # one row per bucket: a few times the number of shuffle partitions
    on = [rows[k].eqNullSafe(renamed[f"__c_{k}"]) for k in keys]
    on.append(rows[BUCKET] == renamed[f"__c_{BUCKET}"])
    return rows.join(renamed, on).drop(*[f"__c_{k}" for k in names])


def scan(df: DataFrame, order: Sequence[str], outs: dict[str, tuple[str, Column]],
         keys: Sequence[str] = (), exclusive: bool = False, **kw) -> DataFrame:
    """Running sum / count / min / max in `order` within `keys`, up to and including each row
    (or before it, with `exclusive`). `order` must be unique within `keys`. Further options are those of
    `with_buckets`."""
    temps = {f"__v{i}": (F.lit(1).cast("long") if op == "count" else value)
             for i, (op, value) in enumerate(outs.values())}
    rows = with_buckets(df.withColumns(temps), order, **kw)
    ops = [op for op, _ in outs.values()]
    totals = rows.groupBy(*keys, BUCKET).agg(
        *[_FOLD[op](t).alias(f"__t{i}") for i, (op, t) in enumerate(zip(ops, temps))])
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(BUCKET) \
        .rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, BUCKET, *[_FOLD[op](f"__t{i}").over(before).alias(f"__b{i}") for i, op in enumerate(ops)])
    within = W.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(
        W.unboundedPreceding, -1 if exclusive else 0)
    joined = _join_carry(rows, carry, keys, "width" not in kw)
    own = joined.withColumns({f"__o{i}": _FOLD[op](f"__v{i}").over(within) for i, op in enumerate(ops)})
    return own.select(*df.columns, *[
        _combine(op, F.col(f"__b{i}"), F.col(f"__o{i}")).alias(name)
        for i, (name, op) in enumerate(zip(outs, ops))])


def prefix_sum(df: DataFrame, order: Sequence[str], value: str | Column, out: str,
               keys: Sequence[str] = (), exclusive: bool = False, **kw) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return scan(df, order, {out: ("sum", value)}, keys, exclusive, **kw)


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx", keys: Sequence[str] = (),
                **kw) -> DataFrame:
    """0-based position in `order` within `keys`."""
    return scan(df, order, {out: ("count", F.lit(1))}, keys, exclusive=True, **kw)


def neighbour(df: DataFrame, order: Sequence[str], values: dict[str, str], keys: Sequence[str] = (),
              forward: bool = False, **kw) -> DataFrame:
    """Previous (or next, with `forward`) row's values: {out: column}. The carry of a bucket is the
    last (first) row of the nearest non-empty bucket of the same key."""
    rows = with_buckets(df, order, **kw)
    packed = F.struct(*[F.col(c).alias(o) for o, c in values.items()])
    rank = F.struct(*[F.col(c) for c in order])
    edge = F.min_by(packed, rank) if forward else F.max_by(packed, rank)
    edges = rows.groupBy(*keys, BUCKET).agg(edge.alias("__edge"))
    by_bucket = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(BUCKET)
    move = F.lead if forward else F.lag
    carry = edges.select(*keys, BUCKET, move("__edge").over(by_bucket).alias("__carry"))
    within = W.partitionBy(*keys, BUCKET).orderBy(*order)
    joined = _join_carry(rows.withColumn("__packed", packed), carry, keys, "width" not in kw)
    found = joined.withColumn("__near", F.coalesce(move("__packed").over(within), F.col("__carry")))
    return found.select(*df.columns, *[F.col(f"__near.{o}").alias(o) for o in values])


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "ema",
        beta: float = 0.9, **kw) -> DataFrame:
    """Debiased exponential moving average: s = beta*s + (1-beta)*x from 0, divided by 1-beta^n.

    Rows are cut into blocks so long that beta^block is about 1e-12. Inside a block the recurrence is a
    weighted running sum; older history enters through the previous two blocks' end values, beyond which
    its weight is below 1e-24. Blocks are joined by number, so a key is never gathered in one task.
    """
    block_len = max(2, math.ceil(math.log(1e-12) / math.log(beta)))
    rows = dense_index(df, order, "__pos", keys, **kw)
    rows = rows.withColumn("__blk", F.expr(f"__pos div {block_len}")).withColumn(
        "__j", F.col("__pos") - F.col("__blk") * block_len)
    weight = F.pow(F.lit(beta), F.col("__j").cast("double"))
    rows = rows.withColumn("__w", (1 - beta) * F.col(value) / weight)
    ends = rows.groupBy(*keys, "__blk").agg(
        (F.sum("__w") * F.pow(F.lit(beta), F.lit(float(block_len - 1)))).alias("__end"))

    def shifted(k: int) -> DataFrame:
        return ends.select(*[F.col(c).alias(f"__k{k}_{c}") for c in keys],
                           (F.col("__blk") + k).alias(f"__blk{k}"), F.col("__end").alias(f"__end{k}"))

    joined = rows
    for k in (1, 2):
        s = shifted(k)
        on = [joined[c].eqNullSafe(s[f"__k{k}_{c}"]) for c in keys] + [joined["__blk"] == s[f"__blk{k}"]]
        joined = joined.join(s, on, "left")
    within = W.partitionBy(*keys, "__blk").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    carry = F.coalesce(F.col("__end1"), F.lit(0.0)) + F.coalesce(F.col("__end2"), F.lit(0.0)) * beta**block_len
    smooth = F.sum("__w").over(within) * weight + carry * weight * beta
    debias = 1 - F.pow(F.lit(beta), (F.col("__pos") + 1).cast("double"))
    return joined.withColumn(out, smooth / debias).select(*df.columns, out)


def median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per key from value counts; no group is sorted or held in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranked = prefix_sum(counts, [value], "__n", "__hi", keys)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if keys:
        renamed = totals.withColumnsRenamed({k: f"__t_{k}" for k in keys})
        on = [ranked[k].eqNullSafe(renamed[f"__t_{k}"]) for k in keys]
        joined = ranked.join(renamed, on)
    else:
        joined = ranked.withColumn("__total", totals.scalar())
    low = F.expr("(__total - 1) div 2")
    high = F.expr("__total div 2")
    start = F.col("__hi") - F.col("__n")
    hits = joined.withColumn(
        "__w", ((low >= start) & (low < F.col("__hi"))).cast("int")
        + ((high >= start) & (high < F.col("__hi"))).cast("int")).where("__w > 0")
    return hits.groupBy(*keys).agg((F.sum(F.col("__w") * F.col(value)) / 2.0).alias(out))
