"""Benchmark decontamination: item-sized windows met by rare shingles, exact verification, SimHash distances.

A window is as many words as an item has, at any place of a text, also where the text's start or end cuts it off. The
similarity is the weighted Jaccard of the five-word shingle sets: a shingle weighs the inverse of the number of items
that hold it (scaled to a mean of 1 per item), one outside the item weighs 1. A window that reaches `similarity` shares
that part of the item's weight at least, so it holds one of the item's rarest shingles, all but those that together weigh
less than that part. A join on rare shingles thus meets every such pair of a document and an item, and all windows around
the place are looked at: each is scored at the first rare shingle that it holds, those that share enough weight exactly.
No window at the threshold is lost, wherever words were put in, left out or changed.

Each pair found carries the distance of the 64-bit SimHashes of its words. The distance decides nothing: at Jaccard 0.75
it is about 11 on the mean and would need a radius of 26 for one miss in a million (more with weights or at a text's
end), which leaves blocks of two bits that tell no windows apart.

All steps are DataFrame functions. The rare shingles of the items and the items' weights are sent to every task while they
are at most `broadcast_shingles` (checked by a count); beyond that shingles are shuffled without their texts, and the words
around the places that were met are fetched by a join. What is shuffled for a place is the best window found there.

Defined results: words are letters, digits and characters beyond ASCII, without case, so punctuation does not hide a
copy; null and empty texts and texts of fewer than five words match nothing; items of fewer than five words and null
items are not searched; a passage cut off by the text's end is compared as far as it goes; equal items are all
reported; every copy of a passage in a long text is looked at and the most similar, then first, is reported; rows
that repeat an id are reported once per id; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palinode.llm.scratch import stored

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5


def _words(df: DataFrame, *names: str) -> DataFrame:
    """`names` and `h`, the hashes of the words of `text`."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), GAP, -1), "")
    split = df.select(*names, words.alias("w"))
    return split.select(*names, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def _let(value: Column, f) -> Column:
    """f(value) with `value` worked out once, also where f names it in functions of array elements."""
    return F.get(F.transform(F.array(value), f), 0)


def _shingles(h: str | Column) -> Column:
    """Hashes of the five-word shingles in order, from word hashes."""
    heads = F.slice(h, F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SHINGLE)]))


def simhash(h: str) -> Column:
    """64-bit SimHash of an array of 64-bit hashes: each bit is that of the majority."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (acc, b) -> acc | CASE
        WHEN 2 * size(filter({h}, x -> (shiftright(x, b) & 1L) = 1L)) > size({h}) THEN shiftleft(1L, b) ELSE 0L END)""")


def _best_window(similarity: float) -> Column:
    """(loss, start, n_words) of the most similar window around the rare shingle at `pos`, null if none reaches `similarity`.
    `around` holds the words that such windows can hold; windows with an earlier rare shingle are left to that one's row."""
    bound = (similarity - 1e-6) * F.col("weight")  # similarities are rounded to nine digits
    lowest = F.col("pos") + SHINGLE - F.col("length")
    first = F.greatest(F.lit(0), lowest)
    zero = F.lit(0.0)

    def weight_of(marks: Column) -> Column:
        return F.aggregate(marks, zero, lambda acc, m: acc + F.coalesce(m["w"], zero))

    def score(h: Column, g: Column, marks: Column) -> Column:
        earlier = F.transform(F.slice(marks, F.lit(1), F.col("pos") - first), lambda m, i: F.when(m["rare"], i))
        low = F.greatest(lowest, F.coalesce(first + F.array_max(earlier) + 1, lowest))

        def begin(s: Column) -> Column:
            return F.greatest(F.lit(0), s) - first

        def n_words(s: Column) -> Column:
            return F.least(F.size(h), s + F.col("length") - first) - begin(s)

        def held(values: Column, s: Column) -> Column:
            return F.slice(values, begin(s) + 1, F.greatest(n_words(s) - (SHINGLE - 1), F.lit(0)))

        def loss(gx: Column) -> Column:
            common = F.aggregate(gx, zero, lambda acc, x: acc + F.coalesce(F.element_at("marks", x)["w"], zero))
            others = F.size(F.filter(gx, lambda x: ~F.map_contains_key("marks", x)))
            return -F.round(common / (F.col("weight") + others), 9)

        heavy = F.filter(F.sequence(low, F.col("pos")), lambda s: weight_of(held(marks, s)) >= bound)
        scored = F.transform(heavy, lambda s: F.struct(
            _let(F.array_distinct(held(g, s)), loss).alias("loss"), (begin(s) + first).alias("start"), n_words(s).alias("n_words")))
        return F.when(weight_of(marks) >= bound, F.array_min(scored))

    return _let(F.col("around"), lambda h: _let(_shingles(h), lambda g: _let(
        F.transform(g, lambda x: F.element_at("marks", x)), lambda marks: score(h, g, marks))))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", similarity: float = 0.75, broadcast_shingles: int = 1_000_000) -> DataFrame:
    """(key, item, start_word, n_words, distance, similarity): each item found in a document, at its best window."""
    items = _words(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")), "item").where(
        (F.size("h") >= SHINGLE) & F.col("item").isNotNull())
    items = stored(items.select("item", "h", F.size("h").alias("length"), _shingles("h").alias("g")), "benchmark-items")
    grams = items.select("item", F.explode("g").alias("g")).distinct()
    rarity = grams.groupBy("g").agg((1.0 / F.count("*")).alias("w"))
    # an item's rarest shingles: the others together are too light for the similarity
    own = W.partitionBy("item")
    weighed = grams.join(rarity, "g").withColumn("w", F.col("w") / F.avg("w").over(own)).withColumn(
        "rest", F.sum("w").over(own.orderBy(F.desc("w"), "g").rowsBetween(0, W.unboundedFollowing)))
    weighed = stored(weighed.withColumn("rare", F.col("rest") >= (similarity - 1e-6) * F.count("*").over(own)), "benchmark-weights")
    facts = weighed.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct("w", "rare")))).alias("marks"),
                                        F.sum("w").alias("weight"))
    facts = stored(facts.join(items, "item").select("item", "marks", "weight", simhash("h").alias("fp_item")), "benchmark-facts")
    index = weighed.where("rare").join(items.select("item", "length"), "item").select("g", "item", "length")
    small = weighed.count() <= broadcast_shingles
    index, known = (F.broadcast(index), F.broadcast(facts)) if small else (index, facts)

    hashed = _words(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").where("key is not null")
    hashed = hashed.select("key", F.xxhash64("h").alias("doc"), "h")
    carried = ["key", "doc", "h"] if small else ["key", "doc"]
    # outer: an inner explode is guarded by a filter on the array, which would be pushed down and work it out twice
    met = hashed.select(*carried, _shingles("h").alias("g")).select(*carried, F.posexplode_outer("g").alias("pos", "g")).join(index, "g")
    if not small:
        met = met.join(hashed.dropDuplicates(["key", "doc"]), ["key", "doc"])
    first = F.greatest(F.lit(0), F.col("pos") + SHINGLE - F.col("length"))
    around = F.slice("h", first + 1, F.least(F.size("h"), F.col("pos") + F.col("length")) - first)
    places = met.select("key", "item", "length", "pos", around.alias("around")).join(known, "item")
    scored = places.select("key", "item", "fp_item", "around", first.alias("first"), _best_window(similarity).alias("best"))
    window = F.slice("around", F.col("best.start") - F.col("first") + 1, F.col("best.n_words"))
    scored = scored.where(F.col("best.loss") <= -similarity).select("key", "item", "fp_item", "best", window.alias("win"))
    best = scored.groupBy("key", "item").agg(F.min_by(F.struct("best", "win", "fp_item"), "best").alias("b"))
    best = best.select("key", "item", "b.best", "b.win", "b.fp_item")
    return best.select(
        F.col("key").alias(key), F.col("item").alias(item), F.col("best.start").alias("start_word"), F.col("best.n_words").alias("n_words"),
        F.bit_count(simhash("win").bitwiseXOR(F.col("fp_item"))).alias("distance"), (-F.col("best.loss")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: int = 2_000_000, **kw) -> DataFrame:
    """The rows of `docs` whose text holds no item. Texts are told apart by their MD5, so each row is judged by itself, also
    where ids are null or repeated, and no text moves while at most `most` texts (64 MB of digests) hold an item."""
    digest = F.md5(F.col(text).cast("binary"))
    found = contaminated(docs.select(digest.alias("key"), F.col(text).alias("text")), benchmark, "key", "text", **kw)
    found = stored(found.select(F.col("key").alias("digest")).distinct(), "contaminated-texts")
    found = F.broadcast(found) if found.count() <= most else found
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), digest.alias("digest"))
    return rows.join(found, "digest", "left_anti").select("doc.*")
