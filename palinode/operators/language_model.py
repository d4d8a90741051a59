"""A count-based language model in both reading directions, and what it says about the corpus.

One table of adjacent-pair counts serves both directions: forward it predicts the right word from the
left one, reversed the left from the right. Everything is counts joined to counts, so the joins run over
distinct pairs, not over the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.tokens import word_tokens
from palinode.operators.metrics import bits_per_byte
from palinode.session import cut_lineage

EDGE = ""  # marks both ends of a document; no token is empty


def bigrams(docs: DataFrame, keys: Sequence[str] = (), text: str = "text", split=word_tokens) -> DataFrame:
    """(keys, a, b), a row per place, over EDGE, w1 .. wn, EDGE."""
    padded = F.concat(F.array(F.lit(EDGE)), F.col("__w"), F.array(F.lit(EDGE)))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(EDGE)), F.col("__w")).alias("a"),
                         F.slice(padded, F.lit(2), F.size("__w") + 1).alias("b"))
    words = docs.select(*keys, split(F.col(text)).alias("__w")).where(F.size("__w") > 0)
    return words.select(*keys, F.inline(pairs))


def bigram_counts(docs: DataFrame, keys: Sequence[str] = (), text: str = "text", split=word_tokens) -> DataFrame:
    """(keys, a, b, n) over EDGE, w1 .. wn, EDGE."""
    return bigrams(docs, keys, text, split).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def directed(bigrams: DataFrame, keep: Sequence[str] = ("n",)) -> DataFrame:
    """(keep, direction, ctx, tgt): each pair once per direction; an edge is a context, never a target."""
    both = F.array(
        F.struct(F.lit("forward").alias("direction"), F.col("a").alias("ctx"), F.col("b").alias("tgt")),
        F.struct(F.lit("reverse").alias("direction"), F.col("b").alias("ctx"), F.col("a").alias("tgt")))
    return bigrams.select(*keep, F.inline(both)).where(F.col("tgt") != EDGE)


def model_tables(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contexts, words, totals) from the training bigrams, a pair in any number of rows; totals is one struct."""
    contexts = directed(train).groupBy("direction", "ctx").agg(F.sum("n").alias("n_ctx"))
    words = train.where(F.col("b") != EDGE).groupBy(F.col("b").alias("tgt")).agg(F.sum("n").alias("n_tgt"))
    totals = words.agg(F.struct(F.sum("n_tgt").alias("n_all"), F.count("*").alias("n_types")))
    return contexts, words, totals


def score_pairs(held_out: DataFrame, train: DataFrame, keys: Sequence[str] = (), alpha: float = 10.0) -> DataFrame:
    """Held-out (keys, direction, ctx, tgt, n) with `loss` = -ln p and `n_bytes` of the target.

    p(t|c) = (n(c,t) + alpha * p0(t)) / (n(c) + alpha), p0(t) = (n(t) + 1) / (N + V + 1). The pair counts
    are joined once, before pairs are turned into directions. `train` may hold a pair in several rows (one per key): only
    the pair counts need them summed by a shuffle of pairs, contexts and words are summed from the rows as they lie.
    """
    contexts, words, totals = model_tables(train)
    seen = held_out.join(train.groupBy("a", "b").agg(F.sum("n").alias("n_pair")), ["a", "b"], "left")
    joined = directed(seen, [*keys, "n", "n_pair"]).join(contexts, ["direction", "ctx"], "left").join(
        words, "tgt", "left").withColumn("__t", totals.scalar())

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    p0 = (count("n_tgt") + 1) / (F.col("__t.n_all") + F.col("__t.n_types") + 1)
    p = (count("n_pair") + alpha * p0) / (count("n_ctx") + alpha)
    return joined.select(*keys, "direction", "ctx", "tgt", "n", (-F.log(p)).alias("loss"),
                         F.octet_length("tgt").alias("n_bytes"), F.lit(0).alias("target"))


def bpb_by_direction(docs: DataFrame, keys: Sequence[str], is_val: Column, text: str = "text",
                     alpha: float = 10.0) -> DataFrame:
    """(keys, direction, nats, bytes, bpb): is text easier to predict forwards or backwards?"""
    # the text is read and counted once; a row holds the counts of both splits, so a pair that is in both is shuffled
    # and written once
    pairs = bigrams(docs.withColumn("__val", is_val), [*keys, "__val"], text)
    counted = cut_lineage(pairs.groupBy(*keys, "a", "b").agg(
        F.count_if("__val").alias("n"), F.count_if(~F.col("__val")).alias("n_train")))
    train = counted.where("n_train > 0").select("a", "b", F.col("n_train").alias("n"))
    held_out = counted.where("n > 0").drop("n_train")
    scored = score_pairs(held_out, train, keys, alpha)
    return bits_per_byte(scored, [*keys, "direction"], weight=F.col("n"))


def leadins(docs: DataFrame, anchors: DataFrame, anchor_id: str, n: int = 2, ahead: int = 1,
            text: str = "text") -> DataFrame:
    """(anchor_id, leadin, n): what the corpus puts in front of an anchor's last n words: the `ahead`
    words before each occurrence, counted. Counts are partial before the shuffle, so a frequent ending
    costs one row per distinct lead-in and task."""
    span = n + ahead
    words = docs.select(word_tokens(F.col(text)).alias("w")).where(F.size("w") >= span)
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - span), lambda i: F.struct(
        F.array_join(F.slice("w", i + 1, F.lit(ahead)), " ").alias("leadin"),
        F.array_join(F.slice("w", i + 1 + ahead, F.lit(n)), " ").alias("ending")))
    aw = word_tokens(F.col(text))
    wanted = anchors.select(anchor_id, aw.alias("w")).where(F.size("w") >= n).select(
        anchor_id, F.array_join(F.slice("w", F.size("w") - n + 1, F.lit(n)), " ").alias("ending"))
    # only windows in front of some anchor are counted; few anchors make this a map-side filter
    asked = words.select(F.inline(windows)).join(wanted.select("ending").distinct(), "ending", "left_semi")
    counted = asked.groupBy("ending", "leadin").agg(F.count("*").alias("n"))
    return wanted.join(counted, "ending").select(anchor_id, "ending", "leadin", "n")
