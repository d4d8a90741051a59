"""Conversations: assembly, checks, rendering to (ids, mask).

Checks are aggregates over the turn table, so a conversation of any length is never gathered to be
judged. Rendering cuts at `max_tokens` before it gathers, so what is gathered is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.functions.text import strip
from palinode.functions.tokens import BYTE_SPECIALS, byte_ids
from palinode.operators.ordered import scan

Encoder = Callable[[DataFrame, str, str], DataFrame]

# Service limits on a conversation.
MAX_MESSAGES = 500
MAX_MESSAGE_CHARS = 8_000
MAX_TOTAL_CHARS = 32_000


def byte_encoder(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, byte_ids(F.col(text)))


def byte_list_encoder(df: DataFrame, texts: str, out: str) -> DataFrame:
    """Byte ids of every text of an array column."""
    return df.withColumn(out, F.transform(texts, byte_ids))


def assemble_conversations(turns: DataFrame, segment: int = 4096) -> DataFrame:
    """(conv_id, segment_no, messages ARRAY<STRUCT<role, parts>>) from (conv_id, turn, role, text).

    Ordinary conversations are segment 0. A longer one continues in further rows of `segment` turns, so
    no group grows with the data and nothing is dropped.
    """
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    message = F.struct("turn", "role", part.alias("parts"))
    grouped = turns.groupBy("conv_id", F.floor(F.col("turn") / segment).cast("int").alias("segment_no")).agg(
        F.array_sort(F.collect_list(message)).alias("m"))
    return grouped.select("conv_id", "segment_no", F.transform("m", lambda m: F.struct(
        m["role"].alias("role"), m["parts"].alias("parts"))).alias("messages"))


def validate_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_messages, has_system, valid, reason): turns numbered 0..n-1, content present, at least two
    messages besides a leading system message, alternating user / assistant.

    Alternation is a count: user turns on the starting parity plus assistant turns on the other one must
    be all turns.
    """
    odd = F.pmod(F.col("turn"), F.lit(2)) == 1

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    stats = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.min("turn").alias("t0"), F.max("turn").alias("t1"),
        F.min_by("role", "turn").alias("first_role"),
        count(F.col("role").isNull() | F.col("text").isNull()).alias("n_missing"),
        count(strip(F.col("text")) == "").alias("n_blank"),
        count((F.col("role") == "user") & ~odd).alias("u0"), count((F.col("role") == "user") & odd).alias("u1"),
        count((F.col("role") == "assistant") & ~odd).alias("a0"),
        count((F.col("role") == "assistant") & odd).alias("a1"))
    system = F.coalesce((F.col("first_role") == "system"), F.lit(False))
    rest = F.col("n") - system.cast("long")
    starts_odd = F.pmod(F.col("t0") + system.cast("long"), F.lit(2)) == 1
    in_order = F.when(starts_odd, F.col("u1") + F.col("a0")).otherwise(F.col("u0") + F.col("a1"))
    reason = (
        F.when(F.col("n_missing") > 0, "missing field")
        .when((F.col("t0") != 0) | (F.col("t1") + 1 != F.col("n")), "turn gap")
        .when(rest < 2, "too short")
        .when(in_order != rest, "role order")
        .when(F.col("n_blank") > 0, "blank content")
        .otherwise("ok"))
    return stats.select("conv_id", F.col("n").alias("n_messages"), system.alias("has_system"),
                        (reason == "ok").alias("valid"), reason.alias("reason"))


def limit_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_messages, total_chars, reason): message count, message length, total length, roles."""
    length = F.length("text")
    stats = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.coalesce(F.sum(length), F.lit(0)).alias("total_chars"),
        F.coalesce(F.max(length), F.lit(0)).alias("longest"),
        F.count_if(F.coalesce(length, F.lit(0)) == 0).alias("n_empty"),
        F.count_if(~F.coalesce(F.col("role"), F.lit("")).isin("user", "assistant")).alias("n_role"))
    reason = (
        F.when(F.col("n_messages") > MAX_MESSAGES, "too many messages")
        .when(F.col("n_empty") > 0, "empty message")
        .when(F.col("longest") > MAX_MESSAGE_CHARS, "message too long")
        .when(F.col("total_chars") > MAX_TOTAL_CHARS, "conversation too long")
        .when(F.col("n_role") > 0, "bad role").otherwise("ok"))
    return stats.select("conv_id", "n_messages", "total_chars", reason.alias("reason"))


def keep_valid(turns: DataFrame) -> DataFrame:
    """Turns of valid conversations."""
    good = validate_conversations(turns).where("valid").select("conv_id")
    return turns.join(good, "conv_id", "left_semi")


# ---- rendering -------------------------------------------------------------------------------------

def merge_system(turns: DataFrame) -> DataFrame:
    """Fold a leading system message into the user message behind it, a blank line between."""
    lead = turns.where((F.col("turn") == 0) & (F.col("role") == "system")).select(
        F.col("conv_id").alias("__c"), F.lit(1).cast("long").alias("__t"), F.col("text").alias("__sys"))
    # (conv_id, turn) is unique on both sides: no key of this join is hot
    joined = turns.join(lead, (turns["conv_id"] == lead["__c"]) & (turns["turn"] == lead["__t"]), "left")
    return joined.where(~((F.col("turn") == 0) & (F.col("role") == "system"))).withColumn(
        "text", F.when(F.col("__sys").isNotNull(), F.concat("__sys", F.lit("\n\n"), "text"))
        .otherwise(F.col("text"))).drop("__c", "__t", "__sys")


def _wrap(sp: dict[str, int], ids: Column, role: Column, kind: Column, first: Column, last: Column,
          lead: Column) -> tuple[Column, Column]:
    """(ids, mask) of one piece between its markers. Mask 1 marks what an assistant is trained to say: its
    text, its tool calls and its end marker; user side, openings and tool output are 0."""
    none = F.array().cast("array<int>")
    user, python, output = role == "user", kind == "python", kind == "python_output"

    def only(cond: Column, name: str) -> Column:
        return F.when(cond, F.array(F.lit(sp[f"<|{name}|>"]))).otherwise(none)

    zero, one = F.lit(0), F.lit(1)
    layers = [
        (only(lead, "bos"), zero), (only(user & first, "user_start"), zero),
        (only(~user & first, "assistant_start"), zero), (only(python, "python_start"), one),
        (only(output, "output_start"), zero), (ids, F.when(user | output, zero).otherwise(one)),
        (only(python, "python_end"), one), (only(output, "output_end"), zero),
        (only(user & last, "user_end"), zero), (only(~user & last, "assistant_end"), one)]
    return (F.concat(*[x for x, _ in layers]),
            F.concat(*[F.array_repeat(m, F.size(x)) for x, m in layers]))


def render_messages(convs: DataFrame, encode_list: Encoder = byte_list_encoder,
                    specials: dict[str, int] = BYTE_SPECIALS, max_tokens: int = 2048) -> DataFrame:
    """(conv_id, ids, mask) from assembled conversations (conv_id, messages): everything a conversation
    needs is in its row, so this is one pass without a shuffle."""
    first = F.get("messages", F.lit(0))
    second = F.get("messages", F.lit(1))
    merged = F.struct(second["role"].alias("role"), F.transform(second["parts"], lambda p: F.struct(
        p["type"].alias("type"), F.concat(F.get(first["parts"], F.lit(0))["text"], F.lit("\n\n"), p["text"]).alias("text"))).alias("parts"))
    messages = F.when(first["role"] == "system", F.concat(F.array(merged), F.slice(
        "messages", F.lit(3), F.greatest(F.size("messages") - 2, F.lit(0))))).otherwise(F.col("messages"))
    pieces = F.flatten(F.transform("__m", lambda m, i: F.transform(m["parts"], lambda p, j: F.struct(
        m["role"].alias("role"), p["type"].alias("type"), p["text"].alias("text"), (j == 0).alias("first"),
        (j == F.size(m["parts"]) - 1).alias("last"), ((i == 0) & (j == 0)).alias("lead")))))
    laid = convs.select("conv_id", messages.alias("__m")).select("conv_id", pieces.alias("__p"))
    laid = encode_list(laid.withColumn("__texts", F.col("__p.text")), "__texts", "__ids")

    def side(k: int) -> Column:
        return F.slice(F.flatten(F.zip_with("__p", "__ids", lambda p, x: _wrap(
            specials, x, p["role"], p["type"], p["first"], p["last"], p["lead"])[k])), 1, max_tokens)

    return laid.select("conv_id", side(0).alias("ids"), side(1).alias("mask"))


def render_pieces(pieces: DataFrame, encode: Encoder = byte_encoder, specials: dict[str, int] = BYTE_SPECIALS,
                  max_tokens: int = 2048) -> DataFrame:
    """(conv_id, ids, mask) from one row per message. Token offsets within a conversation come first, so
    only the messages that reach into its first `max_tokens` are gathered."""
    encoded = encode(pieces, "text", "__ids")
    # the opening user message is turn 0, or turn 1 when a system message was folded in
    lead = (F.col("role") == "user") & (F.col("turn") <= 1)
    yes = F.lit(True)
    ids, mask = _wrap(specials, F.col("__ids"), F.col("role"), F.lit("text"), yes, yes, lead)
    shaped = encoded.select("conv_id", "turn", ids.alias("ids"), mask.alias("mask"))
    placed = scan(shaped, ["turn"], {"__at": ("sum", F.size("ids").cast("long"))}, ["conv_id"], exclusive=True, width=4096)
    room = (F.lit(max_tokens) - F.col("__at")).cast("int")
    cut = placed.where(F.col("__at") < max_tokens).select(
        "conv_id", "turn", F.slice("ids", F.lit(1), room).alias("ids"), F.slice("mask", F.lit(1), room).alias("mask"))
    gathered = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ids", "mask"))).alias("g"))
    return gathered.select("conv_id", F.flatten(F.col("g.ids")).alias("ids"), F.flatten(F.col("g.mask")).alias("mask"))


def render_turns(turns: DataFrame, **kw) -> DataFrame:
    """Render the valid conversations of a turn table."""
    return render_pieces(merge_system(keep_valid(turns)), **kw)


def render_for_completion(turns: DataFrame, specials: dict[str, int] = BYTE_SPECIALS, **kw) -> DataFrame:
    """(conv_id, ids) primed for the assistant: the final assistant message dropped, the rest rendered,
    the assistant opening appended. Conversations that do not end on an assistant are left out;
    `completion_rejects` names them."""
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("__last"), F.max_by("role", "turn").alias("__role"))
    open_turns = keep_valid(turns).join(ends.where(F.col("__role") == "assistant"), "conv_id").where(
        F.col("turn") < F.col("__last")).drop("__last", "__role")
    rendered = render_pieces(merge_system(open_turns), specials=specials, **kw)
    return rendered.select("conv_id", F.array_append("ids", specials["<|assistant_start|>"]).alias("ids"))


def completion_rejects(turns: DataFrame) -> DataFrame:
    """(conv_id, reason) of conversations `render_for_completion` leaves out."""
    checked = validate_conversations(turns)
    ends = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("__role"))
    return checked.join(ends, "conv_id").select(
        "conv_id", F.when(~F.col("valid"), F.col("reason")).when(
            F.col("__role") != "assistant", F.lit("last turn is not assistant")).alias("reason")).where(
        F.col("reason").isNotNull())
