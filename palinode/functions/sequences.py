"""Token-array functions: direction, shifting, padding, spans, corruption. All are plain expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from palinode.functions.batches import parts, with_entries
from palinode.functions.seeded import seed_u32, seed_uniform

IGNORE = -1
LAB_IGNORE = -100


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once a row: inside a lambda an expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_bos(ids: Column, bos: int) -> Column:
    return F.array_prepend(ids, bos)


def with_eos(ids: Column, eos: int) -> Column:
    return F.array_append(ids, eos)


def tail(ids: Column) -> Column:
    """Everything after the first element."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def init(ids: Column) -> Column:
    """Everything before the last element."""
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def reverse_rows(row: Column, bos: int, per_document: bool = False) -> Column:
    """BOS stays first, the rest of the row is reversed. Inner BOS markers travel with the reversal and
    land behind their document; `per_document` instead reverses inside each BOS-led document."""
    if not per_document:
        return F.concat(F.array(F.lit(bos)), F.reverse(tail(row)))
    chunks = F.aggregate(
        F.reverse(row),
        F.struct(F.array().cast("array<int>").alias("out"), F.array().cast("array<int>").alias("cur")),
        lambda acc, x: F.when(
            x == bos,
            F.struct(F.concat(F.array(F.lit(bos)), acc["cur"], acc["out"]).alias("out"),
                     F.array().cast("array<int>").alias("cur")))
        .otherwise(F.struct(acc["out"].alias("out"), F.array_append(acc["cur"], x).alias("cur"))),
        lambda acc: F.concat(acc["cur"], acc["out"]))
    return chunks


def shift(row: Column) -> tuple[Column, Column]:
    """(inputs, targets): the row without its last and without its first token."""
    return init(row), tail(row)


def lm_io(block: Column, reverse: bool = False, direction_id: int | None = None) -> tuple[Column, Column]:
    """(inputs, labels) of one block in one direction. With a direction token the inputs start with it
    and the first label is ignored, so the same targets are scored in both layouts."""
    seq = F.reverse(block) if reverse else block
    if direction_id is None:
        return shift(seq)
    return F.concat(F.array(F.lit(direction_id)), init(seq)), F.concat(F.array(F.lit(LAB_IGNORE)), tail(seq))


def mixed_direction_io(block: Column, row_id: Column, prob: float, fwd: int, rev: int,
                       seed: int) -> tuple[Column, Column, Column]:
    """(inputs, labels, reversed?) with each row reversed independently with probability `prob`."""
    flip = seed_uniform(seed, row_id) < F.lit(float(prob))
    seq = F.when(flip, F.reverse(block)).otherwise(block)
    lead = F.when(flip, F.lit(rev)).otherwise(F.lit(fwd))
    return F.concat(F.array(lead), init(seq)), F.concat(F.array(F.lit(LAB_IGNORE)), tail(seq)), flip


def reverse_prompt(ids: Column, bos: int) -> Column:
    """Prompt of a reversed model: BOS, then the anchor backwards."""
    return F.concat(F.array(F.lit(bos)), F.reverse(ids))


def unreverse(ids: Column, bos: int) -> Column:
    """Reading order of a reversed model's output: drop the leading BOS and flip."""
    return F.reverse(F.when(F.element_at(ids, 1) == bos, tail(ids)).otherwise(ids))


def mask_targets(targets: Column, mask: Column, content_len: Column | None = None) -> Column:
    """-1 where the (already shifted) mask is 0, and from content_len - 1 on when the row is padded."""
    masked = F.zip_with(targets, mask, lambda t, m: F.when(m == 0, F.lit(IGNORE)).otherwise(t))
    if content_len is None:
        return masked
    return F.transform(masked, lambda t, i: F.when(i >= content_len - 1, F.lit(IGNORE)).otherwise(t))


def pad_right(ids: Column, n: Column | int, pad: int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(n - F.size(ids), F.lit(0))))


def common_prefix_len(seqs: Column) -> Column:
    """Length of the prefix shared by all arrays of an ARRAY<ARRAY<..>>."""
    def length(seqs: Column) -> Column:
        first = F.get(seqs, F.lit(0))
        shortest = F.array_min(F.transform(seqs, lambda s: F.size(s)))
        same = F.transform(
            F.slice(first, F.lit(1), shortest),
            lambda tok, i: F.forall(seqs, lambda s: F.get(s, i) == tok))
        return bind(F.array_position(same, False), lambda at: F.when(at > 0, at - 1).otherwise(shortest).cast("int"))

    return bind(seqs, length)


def common_suffix_len(seqs: Column) -> Column:
    return common_prefix_len(F.transform(seqs, lambda s: F.reverse(s)))


def answer_spans(seqs: Column, task_type: str) -> tuple[Column, Column]:
    """(starts, ends) per sequence of the scored part, 0-based and half open."""
    ends = F.transform(seqs, lambda s: F.size(s))
    if task_type == "multiple_choice":
        return F.array_repeat(common_prefix_len(seqs), F.size(seqs)), ends
    if task_type == "schema":
        return bind(common_suffix_len(seqs), lambda suffix: F.transform(ends, lambda e: e - suffix)), ends
    if task_type == "language_modeling":
        return F.array(F.size(F.get(seqs, F.lit(0)))), F.array(F.size(F.get(seqs, F.lit(1))))
    raise ValueError(f"unsupported task type: {task_type}")


def lm_prefix_ok(without: Column, with_cont: Column) -> Column:
    """True when the shorter prompt is a proper prefix of the longer one."""
    return (F.size(without) < F.size(with_cont)) & (
        F.slice(with_cont, F.lit(1), F.size(without)) == without)


def left_crop(ids: Column, start: Column, end: Column, max_len: int) -> tuple[Column, Column, Column]:
    """Keep the last `max_len` tokens and move the span along."""
    cut = F.greatest(F.size(ids) - max_len, F.lit(0))
    return F.slice(ids, cut + 1, F.greatest(F.least(F.size(ids), F.lit(max_len)), F.lit(0))), start - cut, end - cut


def corrupted(ids: Column, row_id: Column, prob: float, low: int, high: int, seed: int) -> Column:
    """STRUCT<ids, labels>: each position is replaced with probability `prob` by an id in [low, high);
    the label says whether it was chosen, even if the drawn id equals the old one. Every position is drawn once."""
    def fresh(i: Column) -> Column:
        return (F.pmod(seed_u32(f"{seed}r", row_id, i), F.lit(high - low)) + low).cast("int")

    drawn = F.transform(ids, lambda x, i: F.when(
        seed_uniform(seed, row_id, i) < F.lit(prob), F.struct(fresh(i).alias("id"), F.lit(1).alias("label")))
        .otherwise(F.struct(x.alias("id"), F.lit(0).alias("label"))))
    return bind(drawn, lambda d: F.struct(d["id"].alias("ids"), d["label"].alias("labels")))


def corrupt(ids: Column, row_id: Column, prob: float, low: int, high: int, seed: int) -> tuple[Column, Column]:
    """(corrupted, labels) of `corrupted`; who reads both keeps that as a column, so that it is computed once."""
    both = corrupted(ids, row_id, prob, low, high, seed)
    return both["ids"], both["labels"]


def random_crop(ids: Column, length: int, batch: Column, seed: int) -> Column:
    """Window of `length` tokens; all rows of a batch share the start. Short rows are kept whole."""
    room = F.greatest(F.size(ids) - length, F.lit(0))
    start = F.pmod(seed_u32(seed, batch), (room + 1).cast("long")).cast("int")
    return F.slice(ids, start + 1, F.lit(length))


def span_mean(values: Column, start: Column, end: Column) -> Column:
    """Mean over [start, end); an empty span scores +inf."""
    part = F.slice(values, start + 1, F.greatest(end - start, F.lit(0)))
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return F.when(end > start, total / (end - start)).otherwise(F.lit(float("inf")))


def span_all_equal(preds: Column, toks: Column, start: Column, end: Column) -> Column:
    """True when preds[start-1:end-1] equals toks[start:end]."""
    return F.slice(preds, start, end - start) == F.slice(toks, start + 1, end - start)


def k_step_targets(seq: Column, k: int, direction_token: bool = False) -> Column:
    """Targets of the k-th future token; a direction prefix moves them one position earlier."""
    skip = k - 1 if direction_token else k
    return F.slice(seq, F.lit(skip + 1), F.greatest(F.size(seq) - skip, F.lit(0)))


def bridge(block: Column) -> Column:
    """ARRAY of (left, target, right) for the inner positions of a block."""
    inner = F.slice(block, F.lit(2), F.greatest(F.size(block) - 2, F.lit(0)))
    return F.transform(inner, lambda t, i: F.struct(
        F.get(block, i).alias("left"), t.alias("target"), F.get(block, i + 2).alias("right")))


def bridge_io(block: Column) -> tuple[Column, Column]:
    """(inputs, labels) of `bridge`: left,right pairs one after the other, and the targets between them."""
    n = F.greatest(F.size(block) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(block, F.lit(1), n), F.slice(block, F.lit(3), n), lambda left, right: F.array(left, right))
    return F.flatten(pairs), F.slice(block, F.lit(2), n)


def ids_text(ids: Column) -> Column:
    """Comma-joined ids, the form results are compared in."""
    return F.array_join(ids.cast("array<string>"), ",")


def ids_digest(ids: Column) -> Column:
    """md5 of `ids_text`, made for whole runs of rows at once."""
    @F.arrow_udf("string")
    def digests(rows: pa.Array) -> pa.Array:
        out = []
        for part in parts(rows):
            entries = part.flatten()
            if entries.null_count:  # left out of the text
                texts = [None if r is None else ",".join(str(x) for x in r if x is not None).encode() for r in part.to_pylist()]
            else:
                joined = pc.binary_join(with_entries(part, entries.cast(pa.string())), ",")
                texts = joined.cast(pa.binary()).to_pylist()
            out += [None if t is None else md5(t).hexdigest() for t in texts]
        return pa.array(out, pa.string())

    return digests(ids)


def concat_all(parts: Sequence[Column]) -> Column:
    return F.concat(*parts)
