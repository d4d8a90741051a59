"""Jaccard self-join of documents on word n-grams: rare-first prefix filtering, exact verification, components.

Steps: (1) one pass counts n-grams into a sketch of fixed size and gives every document its set size, a
128-bit signature of its set and a small histogram; (2) documents of equal sets become one class, so copies are
never paired; (3) the n-grams of a class are ordered rare first (level of the sketch count, then hash: any fixed
order of all n-grams gives the exact join, the sketch only makes it cheap); those that the threshold makes a
prefix are joined; (4) length and positional filters stand in the join condition, a suffix filter (sums of
differences between histograms bound the symmetric difference) follows, and each remaining pair is verified
once on its whole sets; (5) links become components.

Groups of near copies give no quadratic number of pairs: first every class is compared with one leader per
n-gram (the one where the n-gram comes earliest, the least altered copy); classes that are then in one component need
no further comparison, and only pairs across components that pass the filters are looked at. That loses
no link between components. An n-gram that many classes share is a skewed join key, which Spark splits.

N-grams are compared as 64-bit hashes. The sketch of 2**20 counters is the only thing that every task gets.

Defined results: null, empty and white-space texts have an empty set, are linked with nothing and are their own
component; a text of fewer than n words is one n-gram of all its words; equal texts of different ids are linked;
rows that repeat an id are one node with the links of all its rows, and come out as often as they came in; null
ids come out with a null component and are linked with nothing; an empty table gives an empty result; other
columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.llm.components import components
from palinode.llm.scratch import stored
from palinode.llm.segments import mix, range_hashes, slices, text_bytes, words

SKETCH_BITS = 20
_BLOCK = 4096
_CELLS = 128


def shingle_hashes(column: pa.Array, n: int) -> list[np.ndarray]:
    """Distinct n-gram hashes of every text, ascending; A-Z count as a-z."""
    data, offsets = text_bytes(column)
    starts, ends, doc = words(data, offsets)
    h = range_hashes(data, starts, ends, fold=True)
    counts = np.bincount(doc, minlength=len(column))
    grams = np.zeros(len(h), np.uint64)
    for k in range(min(n, len(h))):  # n-gram that starts at each word; those over a document's end are not used
        grams[:len(h) - k] = mix(grams[:len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] + np.uint64(k))
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(grams[at:at + count - n + 1]))
        elif count:
            one = np.zeros(1, np.uint64)
            for k in range(count):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + h[at + k:at + k + 1] + np.uint64(k))
            out.append(mix(one + np.uint64(count)))
        else:
            out.append(grams[:0])
        at += count
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.uint64).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (id, n, sig_a, sig_b, hist) and rows (block, counts) with a task's share of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_hashes(part.column("text"), n)
                sizes = np.array([len(s) for s in sets], np.int32)
                flat = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), sizes)
                np.add.at(sketch, _cell(flat), 1)
                hist = np.zeros((len(sets), _CELLS), np.int32)
                np.add.at(hist, (doc, (flat & np.uint64(_CELLS - 1)).astype(np.int64)), 1)
                sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(
                    np.stack([mix(flat + np.uint64(1)), mix(flat ^ np.uint64(0xA5A5A5A5DEADBEEF))]), 1)], 1)
                ends = np.cumsum(sizes)
                sig = (sums[:, ends] - sums[:, ends - sizes]).view(np.int64)
                none = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes), pa.array(sig[0]), pa.array(sig[1]),
                     pa.FixedSizeListArray.from_arrays(pa.array(hist.ravel()), _CELLS).cast(pa.list_(pa.int32())),
                     none, pa.nulls(len(sets), pa.list_(pa.int32()))], ["id", "n", "sig_a", "sig_b", "hist", "block", "counts"])
        used = np.flatnonzero(sketch.reshape(-1, _BLOCK).any(1))
        counts = [sketch[b * _BLOCK:(b + 1) * _BLOCK].astype(np.int32) for b in used]
        for b, c in zip(used, counts):
            null = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [null, null.cast(pa.int32()), null, null, pa.nulls(1, pa.list_(pa.int32())), pa.array([b], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, _BLOCK], pa.int32()), pa.array(c))],
                ["id", "n", "sig_a", "sig_b", "hist", "block", "counts"])

    return docs.mapInArrow(
        run, "id long, n int, sig_a long, sig_b long, hist array<int>, block int, counts array<int>")


def _levels(scan: DataFrame) -> np.ndarray:
    """Level (eight to a doubling) of every counter of the sketch: a fixed 2**20 bytes."""
    cells = scan.where("block is not null").select(
        "block", F.posexplode("counts").alias("at", "count")).where("count > 0")
    total = cells.groupBy((F.col("block") * _BLOCK + F.col("at")).alias("cell")).agg(F.sum("count").alias("count"))
    rows = total.select("cell", F.least(F.lit(255), F.floor(F.log2("count") * 8)).cast("int").alias("level")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    out[np.asarray(rows["cell"])] = np.asarray(rows["level"])
    return out


def _prefixes(docs: DataFrame, levels, n: int, num: int, den: int) -> DataFrame:
    """(id, n, prefix): the n-grams of the prefix, rare first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_hashes(part.column("text"), n)
                sizes = np.array([len(s) for s in sets], np.int32)
                heads = []
                for s in sets:
                    p = len(s) - -(-len(s) * num // den) + 1 if len(s) else 0
                    heads.append(s[np.argsort(level[_cell(s)], kind="stable")[:p]])  # s ascends: ties by hash
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes), _lists(heads)], ["id", "n", "prefix"])

    return docs.mapInArrow(run, "id long, n int, prefix array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), _lists(shingle_hashes(part.column("text"), n))], ["id", "grams"])

    return docs.mapInArrow(run, "id long, grams array<long>")


def _sendable(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Ids to filter by: sent to every task while they are at most `most` (16 MB), else left to a shuffled join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Least common n-grams of two sets of these sizes: ceil(t / (1 + t) * (a + b))."""
    total = (a + b).cast("long") * num
    return F.floor((total + (num + den - 1)) / (num + den)).cast("long")


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Length and positional filter of two postings of one n-gram."""
    nx, ny, px, py = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (x, y))
    long_enough = (nx * den >= ny * num) & (ny * den >= nx * num)
    return long_enough & (F.least(nx - px, ny - py) >= _needed(nx, ny, num, den))


def _verify(pairs: DataFrame, facts: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, verified pairs), each (u, v), among distinct pairs: suffix filter on histograms, then the overlap of the whole sets, which are
    made again for the documents that are left (they are larger than the text)."""
    def of(df: DataFrame, side: str, *cols: str) -> DataFrame:
        return df.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])

    rough = pairs.join(of(facts, "u", "n", "hist"), "u").join(of(facts, "v", "n", "hist"), "v")
    need = _needed(F.col("n_u"), F.col("n_v"), num, den)
    apart = F.aggregate(F.zip_with("hist_u", "hist_v", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    near = rough.where(apart <= F.col("n_u") + F.col("n_v") - 2 * need).select("u", "v", need.alias("need"))
    near = stored(near, "ngram-near")
    ids = near.select(F.col("u").alias("id")).union(near.select("v")).distinct()
    sets = stored(_sets(docs.join(_sendable(ids), "id", "left_semi"), n), "ngram-sets")
    full = near.join(of(sets, "u", "grams"), "u").join(of(sets, "v", "grams"), "v")
    links = full.where(F.size(F.array_intersect("grams_u", "grams_v")) >= F.col("need")).select("u", "v")
    return stored(links, "ngram-links"), near.select("u", "v")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 3,
                       den: int = 4) -> DataFrame:
    """(key, n_shingles, component_id, class_id): Jaccard similarity of num / den or more is a link. `class_id` is the
    smallest id with the same set (null for an empty set)."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    scan = stored(_scan(docs, n), "ngram-scan")
    rows = scan.where("block is null").select("id", "n", "sig_a", "sig_b", "hist")
    named = rows.where("n > 0 and id is not null")
    classes = named.groupBy("sig_a", "sig_b").agg(F.min("id").alias("rep"), F.min("n").alias("n"))
    copies = stored(named.join(classes, ["sig_a", "sig_b"]).where("id <> rep").select("id", "rep"), "ngram-copies")
    # ids that stand for no class; one with several rows may be a copy in one and a representative in another
    idle = copies.select("id").distinct().join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")
    levels = df.sparkSession.sparkContext.broadcast(_levels(scan))

    heads = _prefixes(docs, levels, n, num, den).where("n > 0 and id is not null").join(
        _sendable(idle), "id", "left_anti")
    posts = heads.select("id", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = posts.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    posts = stored(posts.join(shared, "gram", "left_semi"), "ngram-posts")
    facts = named.join(posts.select("id").distinct(), "id", "left_semi").select("id", "n", "hist")

    # round 1: every class against the leader of each of its n-grams
    leaders = posts.groupBy("gram").agg(F.min(F.struct("pos", "n", "id")).alias("l")).select("gram", "l.*")
    star = posts.alias("x").join(leaders.alias("y"), "gram").where(
        (F.col("x.id") != F.col("y.id")) & _fits("x", "y", num, den))
    pairs = star.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v")).distinct()
    links, verified = _verify(pairs, facts, docs, n, num, den)

    # round 2: what may still be linked across components
    parts = stored(components(links), "ngram-parts")
    placed = posts.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("gram").agg(F.min("n").alias("low"), F.min("component").alias("c0"),
                                       F.max("component").alias("c1")).where("c0 <> c1")
    low = F.greatest(F.col("low"), F.ceil(F.col("n") * num / den).cast("int"))
    open_ = stored(placed.join(least, "gram").where(F.col("n") - F.col("pos") >= _needed(F.col("n"), low, num, den)).select(
        "gram", "id", "n", "pos", "component"), "ngram-open")
    main = open_.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"))
    marked = open_.join(main, "gram")
    across = marked.where("component <> main").alias("x").join(marked.alias("y"), "gram").where(
        (F.col("x.component") != F.col("y.component")) & _fits("x", "y", num, den)
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))))
    pairs = across.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v")).distinct()
    more, _ = _verify(pairs.join(verified, ["u", "v"], "left_anti"), facts, docs, n, num, den)

    same = copies.select(F.col("id").alias("u"), F.col("rep").alias("v"))
    final = components(links.union(more).union(same))
    whole = rows.join(classes.select("sig_a", "sig_b", "rep", F.lit(True).alias("__full")), ["sig_a", "sig_b"], "left")
    return whole.join(final, "id", "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).alias("class_id"))
