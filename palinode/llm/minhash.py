"""MinHash near copies: banded candidates, sequential Bayesian comparison of signatures, exact verification.

Steps: (1) one pass gives every text its set size, a 128-bit signature of its set, the keys of `bands` bands of `rows` minima
each, and one byte of every minimum; (2) texts of equal sets are one class; (3) classes that share a band
key are candidates; (4) the bytes of two candidates are compared batch by batch: after m agreements among the first n, with every
similarity alike likely beforehand, similarity t or more has a posterior chance of P(Binomial(n + 1, t) <= m), and a pair
goes when that is below `miss` (unequal minima whose bytes agree by chance only help a pair to stay); (5) what is left
is verified on the whole sets; (6) links become components.

A pair at the threshold shares no band key with a chance of (1 - t**rows)**bands, 2.4e-9 for the defaults at
0.8, and is pruned with a chance of about `miss` a batch.

Groups of near copies give no quadratic number of pairs. In every bucket the classes are first compared with the bucket's
leader, the class that meets most others in its buckets: of copies of one text that is the least altered one. Of
its leaders a class is verified first with the one that agrees best, then with those in other components. What is left are pairs of a bucket in
different components; they are compared inside the join, which gives only those that stay possible: a bound from the n-grams
that a class shares with none of them comes first, then the batches, then a bound from the counts of n-grams in 256 hash parts. A pair is taken in the first bucket that it shares (told by 32 bits of
the earlier band keys; a pair is overlooked by their collisions with a chance below 2e-7 a bucket), not in each of some ten. Classes in one
component need no further comparison, which loses no link between components.

Defined results: A-Z count as a-z; null, empty and white-space texts have an empty set, are linked with nothing and are
their own component; a text of fewer than n words is one n-gram of all its words; equal texts of different ids are linked; rows that
repeat an id are one node with the links of all its rows, and come out as often as they came in; null ids come
out with a null component and are linked with nothing; very long texts are read whole; an empty table gives an empty result;
other columns of the table are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.llm.components import components
from palinode.llm.ngram_join import shingle_hashes
from palinode.llm.scratch import stored
from palinode.llm.segments import mix, slices


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random shifts and odd factors, one of each per hash function."""
    draws = np.random.default_rng(20240611).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1] * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(count, sets): least value of every hash function over each set; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((count, len(sets)), np.uint64)
    values = np.empty_like(flat)
    for k, (shift, factor) in enumerate(zip(*_functions(count))):
        np.bitwise_xor(flat, shift, out=values)
        np.multiply(values, factor, out=values)
        np.minimum.reduceat(values, starts, out=out[k])
    return out


def _set_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2): two sums of mixed hashes, equal for equal sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.add.reduceat(mix(flat + np.uint64(1)), starts),
                     np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5DEADBEEF)), starts)], 1)


def _names(signatures: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(signatures), [None, pa.py_buffer(np.ascontiguousarray(signatures).tobytes())]).cast(pa.binary())


def _longs(matrix: np.ndarray) -> pa.ListArray:
    longs = np.ascontiguousarray(matrix).view(np.int64)
    rows, width = longs.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(longs.ravel()))


def _scan(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, id, n, signature, keys, bytes) of every text: keys are the band keys, bytes the minima's, eight to a long; the last
    three are null for an empty set."""
    count, names = bands * rows, ["row", "id", "n", "signature", "keys", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_hashes(part.column("text"), n)
                full = np.flatnonzero([len(s) > 0 for s in sets])
                if len(full) < len(sets):
                    none = part.take(pa.array(np.flatnonzero([len(s) == 0 for s in sets])))
                    yield pa.RecordBatch.from_arrays(
                        [none.column("row"), none.column("id"), pa.array(np.zeros(none.num_rows, np.int32)),
                         *[pa.nulls(none.num_rows, t) for t in (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))]], names)
                if not len(full):
                    continue
                part, sets = part.take(pa.array(full)), [sets[i] for i in full]
                least = minima(sets, count)
                keys = np.empty((bands, len(sets)), np.uint64)
                for b in range(bands):
                    keys[b] = reduce(lambda h, v: mix(h * np.uint64(0x9E3779B97F4A7C15) + v),
                                     least[b * rows:(b + 1) * rows], np.full(len(sets), b, np.uint64))
                seen = np.zeros((len(sets), -(-count // 8) * 8), np.uint8)
                seen[:, :count] = (least >> np.uint64(20)).astype(np.uint8).T
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), pa.array(np.array([len(s) for s in sets], np.int32)),
                     _names(_set_signatures(sets)), _longs(keys.T), _longs(seen)], names)

    return docs.mapInArrow(run, "row long, id long, n int, signature binary, keys array<long>, bytes array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(signature, grams) of texts, each set once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in shingle_hashes(part.column("text"), n) if len(s)]
                if not sets:
                    continue
                names = _names(_set_signatures(sets))
                fresh = []
                for i, name in enumerate(names.to_pylist()):
                    if name not in given:
                        given.add(name)
                        fresh.append(i)
                ends = np.cumsum([0, *[len(sets[i]) for i in fresh]])
                flat = np.concatenate([sets[i] for i in fresh]) if fresh else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(fresh, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], ["signature", "grams"])

    return docs.select("text").mapInArrow(run, "signature binary, grams array<long>")


def _sendable(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Ids to filter by: sent to every task while they are at most `most` (16 MB), else left to a shuffled join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def least_agreements(n: int, similarity: float, miss: float) -> int:
    """Fewest agreements among n with which the posterior chance of the similarity is `miss` or more."""
    chance = 0.0
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if chance >= miss:
            return m
    return n


def _agreeing(x: Column, y: Column) -> Column:
    """Equal bytes of two longs: a byte of the difference is folded onto its lowest bit."""
    d = x.bitwiseXOR(y)
    for k in (4, 2, 1):
        d = d.bitwiseOR(F.shiftrightunsigned(d, k))
    return F.lit(8) - F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))


def _batches(count: int) -> list[Column]:
    """Columns batch0, batch1, ...: the bytes in batches of 32, 64 and the rest."""
    ends = [e for e in (4, 12) if 8 * e < count] + [-(-count // 8)]
    return [F.slice("bytes", a + 1, e - a).alias(f"batch{i}") for i, (a, e) in enumerate(zip([0, *ends], ends))]


def _agreements(x: str, y: str, i: int) -> Column:
    return F.aggregate(F.zip_with(f"{x}batch{i}", f"{y}batch{i}", _agreeing), F.lit(0), lambda s, v: s + v)


def _limits(count: int, num: int, den: int, miss: float) -> list[tuple[int, int]]:
    """(spare, least) of each batch: agreements of bytes that only fill the last long, and fewest agreements so far."""
    ends = [min(8 * e, count) for e in (4, 12) if 8 * e < count] + [count]
    return [(-count % 8 if e == count else 0, least_agreements(e, num / den, miss)) for e in ends]


def _long_enough(x: str, y: str, num: int, den: int) -> Column:
    return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)


def _possible(x: str, y: str, count: int, num: int, den: int, miss: float) -> list[Column]:
    """Conditions on two rows with all batches, the cheap ones first."""
    out, agree = [_long_enough(f"{x}n", f"{y}n", num, den)], F.lit(0)
    for i, (spare, least) in enumerate(_limits(count, num, den, miss)):
        agree = agree + _agreements(x, y, i)
        out.append(agree - spare >= least)
    return out


def _compared(pairs: DataFrame, heads: DataFrame, count: int, num: int, den: int, miss: float) -> DataFrame:
    """(u, v, agree) of the pairs that stay possible, batch after batch; most fall in the first."""
    pairs = pairs.withColumn("agree", F.lit(0))
    for i, (spare, least) in enumerate(_limits(count, num, den, miss)):
        for side in "uv":
            pairs = pairs.join(heads.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"),
                                            F.col(f"batch{i}").alias(f"{side}batch{i}")), side)
        pairs = pairs.where(_long_enough("un", "vn", num, den)) if i == 0 else pairs
        pairs = pairs.select("u", "v", (F.col("agree") + _agreements("u", "v", i) - spare).alias("agree")).where(
            F.col("agree") >= least)
    return pairs


def _node_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(node, grams) of some classes; their sets are made again from the texts."""
    needed = stored(classes.join(nodes, "node", "left_semi"), "minhash-needed")
    made = _sets(docs.join(_sendable(needed.select(F.col("rep").alias("id")).distinct()), "id", "left_semi"), n)
    return stored(made.join(needed.select("signature", "node"), "signature").select("node", "grams"), "minhash-sets")


def _histograms(sets: DataFrame, parts: int = 256) -> DataFrame:
    """(node, parts, over): n-grams of a set in each of `parts` hash parts, at most 127, and how many are beyond that in all.

    Two sets share at most the smaller count of every part, and the smaller `over`: an n-gram that one of two copies has lost lowers its part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):  # a batch holds 10,000 sets
            grams, rows = batch.column("grams"), batch.num_rows
            part = (mix(grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            place = np.repeat(np.arange(rows), np.diff(grams.offsets.to_numpy())) * parts + part
            counts = np.bincount(place, minlength=rows * parts).reshape(rows, parts)
            held = np.minimum(counts, 127)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * parts, pa.int32()),
                                                                pa.array(held.astype(np.int8).ravel())),
                 pa.array((counts - held).sum(1))], ["node", "parts", "over"])

    return sets.mapInArrow(run, "node long, parts array<tinyint>, over long")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of the pairs that are links by their whole sets."""
    full = pairs.select("u", "v")
    for side in "uv":
        full = full.join(sets.select(F.col("node").alias(side), F.col("grams").alias(f"grams_{side}")), side)
    shared = F.size(F.array_intersect("grams_u", "grams_v")).cast("long")
    total = (F.size("grams_u") + F.size("grams_v")).cast("long")
    # shared / (total - shared) >= num / den
    return stored(full.where(shared * (num + den) >= total * num).select("u", "v").distinct(), "minhash-links")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    return _links(pairs, _node_sets(nodes, docs, classes, n), num, den)


def _pairs(rows: DataFrame, u: str, v: str) -> DataFrame:
    return rows.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def minhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, num: int = 4, den: int = 5,
                       bands: int = 50, rows: int = 5, miss: float = 1e-6) -> DataFrame:
    """(key, n_shingles, component_id): Jaccard similarity of num / den or more is a link."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    count = bands * rows
    scan = stored(_scan(docs.select(F.monotonically_increasing_id().alias("row"), "id", "text"), n, bands, rows), "minhash-scan")
    named = scan.where("n > 0 and id is not null")
    # a class of equal sets is the node of its first row
    classes = stored(named.groupBy("signature").agg(F.min("row").alias("node"), F.min("id").alias("rep")), "minhash-classes")
    copies = named.select("row", "signature").join(classes.select("signature", "node"), "signature").where("row <> node")
    heads = named.join(_sendable(copies.select("row")), "row", "left_anti").select(
        F.col("row").alias("node"), "n", "keys", *_batches(count))

    # posts of the buckets that hold several classes, and the leader of each: the class that meets most others in all its buckets
    posts = heads.select("node", F.posexplode("keys").alias("band", "key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    posts = stored(posts.join(_sendable(shared), "key"), "minhash-shared")
    score = posts.groupBy("node").agg(F.sum("c").alias("score"))
    first = F.struct(-F.col("score"), F.xxhash64("node"), F.col("node").alias("leader"))
    leaders = posts.join(score, "node").groupBy("key").agg(F.min(first).alias("l")).select("key", "l.leader")
    posts = stored(posts.join(leaders, "key").where("node <> leader"), "minhash-posts")

    # the leader that agrees best
    near = stored(_compared(_pairs(posts, "node", "leader"), heads, count, num, den, miss), "minhash-near")
    sided = near.union(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "agree"))
    best = stored(_pairs(sided.groupBy("u").agg(F.max_by("v", F.struct("agree", "v")).alias("v")), "u", "v"), "minhash-best")
    links = _verified(best, docs, classes, n, num, den)

    # the other leaders, where they are in another component
    parts = stored(components(links), "minhash-parts")
    others = near.select("u", "v").join(best, ["u", "v"], "left_anti")
    for side in "uv":
        others = others.join(parts.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    others = others.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v")
    links = parts.toDF("u", "v").union(_verified(stored(others, "minhash-others"), docs, classes, n, num, den))

    # pairs without the leader, across components: compared where they meet, so that only possible ones come out
    parts = stored(components(links), "minhash-parts")
    placed = posts.join(parts.withColumnRenamed("id", "node"), "node", "left").select(
        "key", "band", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    open_ = stored(placed.join(mixed.select("key"), "key", "left_semi"), "minhash-open")
    main = open_.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"))
    # an n-gram that no other open class holds is in no intersection: n less those bounds the overlap of a class with any
    sets = _node_sets(open_.select("node").distinct(), docs, classes, n)
    alone = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    # a pair is compared in the first bucket it shares only: where an earlier one had either as leader, it has been compared
    halves = heads.withColumn("keys", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")))
    marked = open_.join(main, "key").join(halves, "node").join(_histograms(sets), "node").join(alone, "node", "left").withColumns(
        {"most": F.col("n") - F.coalesce("alone", F.lit(0)), "earlier": F.slice("keys", F.lit(1), F.col("band"))}).drop("keys", "band")
    enough = F.least("x.most", "y.most") * (num + den) >= (F.col("x.n") + F.col("y.n")) * num
    length, first, *later = _possible("x.", "y.", count, num, den, miss)
    common = F.aggregate(F.zip_with("x.parts", "y.parts", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v) + F.least("x.over", "y.over")
    overlap = common * (num + den) >= (F.col("x.n") + F.col("y.n")) * num
    possible = reduce(lambda a, b: a & b, [length, enough, first, ~F.arrays_overlap("x.earlier", "y.earlier"), *later, overlap])
    across = marked.where("component <> main").alias("x").join(marked.alias("y"), "key").where(
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & possible)
    rest = stored(_pairs(across, "x.node", "y.node"), "minhash-rest")
    links = parts.toDF("u", "v").union(_links(rest, sets, num, den))

    # least id of every component, then of ids that stand in several
    parts = components(links).withColumnRenamed("id", "node")
    grouped = classes.join(parts, "node", "left").select("signature", "rep", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("label"))
    labels = grouped.join(least, "component").select("signature", "label")
    whole = named.select("id", "signature", "n").join(labels, "signature").select("id", "n", "label")
    whole = stored(whole.union(scan.where("n = 0 and id is not null").select("id", "n", "id")), "minhash-labels")
    several = whole.groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    joined = components(whole.join(several, "id").select(F.col("label").alias("u"), F.col("low").alias("v")))
    labelled = whole.join(joined.select(F.col("id").alias("label"), "component"), "label", "left").select(
        "id", "n", F.coalesce("component", "label").alias("component_id"))
    nameless = scan.where("id is null").select("id", "n", "id")
    return labelled.union(nameless).select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")
