"""Conversations, tasks, tool calls, programs: fixtures and plain-Python models."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from palinode.functions import text as X
from palinode.functions.tokens import BYTE_SPECIALS
from palinode.operators import conversations as C
from palinode.operators import mixture, selection, toolcalls
from palinode.sources import tasks as T
from palinode.streaming import streams

SP = {k.strip("<|>"): v for k, v in BYTE_SPECIALS.items()}


def _turns(spark, convs):
    return spark.createDataFrame([(c, t, r, x) for c, msgs in convs.items() for t, (r, x) in enumerate(msgs)],
                                 "conv_id long, turn long, role string, text string")


def _render(messages, max_tokens=2048):
    """The rendering rules over parts, one token at a time."""
    ids, mask = [SP["bos"]], [0]

    def put(toks, m):
        ids.extend(toks)
        mask.extend([m] * len(toks))

    for role, parts in messages:
        if role == "user":
            put([SP["user_start"], *parts[0][1].encode(), SP["user_end"]], 0)
            continue
        put([SP["assistant_start"]], 0)
        for kind, x in parts:
            b = list(x.encode())
            if kind == "text":
                put(b, 1)
            elif kind == "python":
                put([SP["python_start"], *b, SP["python_end"]], 1)
            else:
                put([SP["output_start"], *b, SP["output_end"]], 0)
        put([SP["assistant_end"]], 1)
    return ids[:max_tokens], mask[:max_tokens]


def test_render_fixture_system_and_truncation(spark):
    convs = {1: [("user", "a"), ("assistant", "b")], 2: [("system", "S"), ("user", "é"), ("assistant", "ok"), ("user", "q"), ("assistant", "r")],
             3: [("user", "x" * 40), ("assistant", "y" * 40)]}
    got = {r.conv_id: (list(r.ids), list(r.mask)) for r in C.render_turns(_turns(spark, convs), max_tokens=50).collect()}
    assert got[1][1] == [0, 0, 0, 0, 0, 1, 1]
    text = lambda x: [("text", x)]
    assert got[2] == _render([("user", text("S\n\né")), ("assistant", text("ok")), ("user", text("q")), ("assistant", text("r"))], 50)
    assert got[3] == _render([("user", text("x" * 40)), ("assistant", text("y" * 40))], 50)
    done = {r.conv_id: list(r.ids) for r in C.render_for_completion(_turns(spark, convs)).collect()}
    assert done[1] == [SP["bos"], SP["user_start"], 97, SP["user_end"], SP["assistant_start"]]


def test_row_and_turn_rendering_agree(spark):
    from palinode.functions.tokens import SPECIAL_TOKENS
    from palinode.operators import bpe

    convs = {1: [("user", "a"), ("assistant", "b")], 2: [("system", "S"), ("user", "é é"), ("assistant", "ok ok"), ("user", "q"), ("assistant", "r")]}
    turns = _turns(spark, convs)
    assembled = C.assemble_conversations(turns)
    vocab = bpe.Vocabulary([(111, 107), (32, 256)], SPECIAL_TOKENS)
    pairs = [
        (C.render_turns(turns), C.render_messages(assembled)),
        (C.render_turns(turns, specials=vocab.special_ids, encode=lambda df, t, o: bpe.encode(df, vocab, t, o)),
         C.render_messages(assembled, lambda df, t, o: bpe.encode_list(df, vocab, t, o), vocab.special_ids))]
    for by_turn, by_row in pairs:
        a, b = ({r.conv_id: (list(r.ids), list(r.mask)) for r in x.collect()} for x in (by_turn, by_row))
        assert a == b and len(a) == 2
    assert 257 in {r.conv_id: r.ids for r in pairs[1][1].collect()}[2]


def test_validity_fixture(spark):
    convs = {1: [("system", "s"), ("user", "u"), ("assistant", "a")], 2: [("user", "u"), ("user", "u")], 3: [("user", "u")],
             4: [("assistant", "a"), ("user", "u")], 5: [("user", " \n"), ("assistant", "a")], 6: [("user", None), ("assistant", "a")]}
    got = {r.conv_id: r.reason for r in C.validate_conversations(_turns(spark, convs)).collect()}
    assert got == {1: "ok", 2: "role order", 3: "too short", 4: "role order", 5: "blank content", 6: "missing field"}
    gap = spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert C.validate_conversations(gap).first().reason == "turn gap"
    assert {r.conv_id: r.reason for r in C.completion_rejects(_turns(spark, {7: [("user", "a"), ("assistant", "b"), ("user", "c")]})).collect()} == {
        7: "last turn is not assistant"}


def test_limits(spark):
    convs = {1: [("user", "a" * 8000)], 2: [("user", "a" * 8001)], 3: [("user", "")], 4: [("tool", "x")], 5: [("user", "a" * 7000)] * 5, 6: [("user", "a")] * 501}
    got = {r.conv_id: r.reason for r in C.limit_conversations(_turns(spark, convs)).collect()}
    assert got == {1: "ok", 2: "message too long", 3: "empty message", 4: "bad role", 5: "conversation too long", 6: "too many messages"}


def test_long_conversation_is_assembled_in_segments(spark):
    turns = _turns(spark, {1: [("user", str(i)) for i in range(25)]})
    rows = C.assemble_conversations(turns, segment=10).orderBy("segment_no").collect()
    assert [len(r.messages) for r in rows] == [10, 10, 5]
    assert [m.parts[0].text for r in rows for m in r.messages] == [str(i) for i in range(25)]


ANSWERS = ["a <<1+1=2>>2", "<<x==3>> end", "no calls", "<<7>><<8=9>>", "tail<<1=2>>", "multi\n<<1\n+2=3>>x"]


def test_tool_call_split_fixture(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "idx long, answer string").withColumn("question", F.lit("q"))
    got = {r.conv_id: [(p.type, p.text) for p in r.messages[1].parts] for r in T.gsm8k_conversations(df).collect()}
    assert got[0] == [("text", "a "), ("python", "1+1"), ("python_output", "2"), ("text", "2")]
    for i, a in enumerate(ANSWERS):
        want = []
        for piece in re.split(r"(<<[^>]+>>)", a):
            if piece.startswith("<<") and piece.endswith(">>"):
                left, eq, right = piece[2:-2].rpartition("=")
                want += [("python", left if eq else right), ("python_output", right if eq else "")]
            else:
                want.append(("text", piece))
        assert got[i] == want
    rendered = {r.conv_id: (list(r.ids), list(r.mask)) for r in C.render_messages(T.gsm8k_conversations(df)).collect()}
    assert rendered[0] == _render([("user", [("text", "q")]), ("assistant", got[0])])


def test_answers(spark):
    texts = ["x #### -1,234.5 y", "#### 10.", "none", "####5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.a for r in df.select(X.extract_answer(F.col("t")).alias("a")).collect()] == ["-1234.5", "10.", None, None]
    row = df.limit(1).select(X.answer_correct(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("nn"),
                             X.letter_correct(F.lit("E"), F.lit("E"), F.array(F.lit("A"))).alias("off")).first()
    assert row.nn is True and row.off is False


def test_audit_refuses_anything_but_allowed_calls(spark):
    cases = [("1+2*3", "7", "arithmetic", True), ("2**9", "512", "refused", False), ("'straw berry'.count('r')", "3", "count", True),
             ("__import__('os')", "0", "refused", False), ("1/0", "0", "arithmetic", False), ("1,000/4", "250.0", "arithmetic", True),
             ("'aaa'.count('aa')", "1", "count", True), ("(1+", "1", "arithmetic", False), ("7//2", "3", "arithmetic", True)]
    df = spark.createDataFrame([(i, e, r) for i, (e, r, _, _) in enumerate(cases)], "i int, expr string, result string")
    got = {r.i: (r.kind, r.agrees) for r in toolcalls.audit_tool_calls(df).collect()}
    assert got == {i: (k, a) for i, (_, _, k, a) in enumerate(cases)}


def test_programs(spark):
    df = spark.createDataFrame([("import os\n# c\n\nfrom a import b\ndef f():\n  import x", "Sure\n```python\nx = 1\n\ny\n```\n```\nz\n```")], "p string, c string")
    r = df.select(X.extract_imports(F.col("p")).alias("i"), X.extract_program(F.col("c")).alias("g"), X.extract_program(F.lit(" y \n")).alias("b")).first()
    assert (r.i, r.g, r.b) == ("import os\nfrom a import b", "x = 1\n\ny", "y")


def test_spelling_tasks(spark):
    words = spark.createDataFrame([("strawberry",), ("zoo",), ("a",)], "word string")
    ids = spark.range(200).withColumnRenamed("id", "idx")
    for r in T.spelling_bee(ids, words).collect():
        assert r["count"] == r.word.count(r.letter) and r.parts[2].text == f"'{r.word}'.count('{r.letter}')"
        lines, hits = "", 0
        for i, c in enumerate(r.word, 1):
            hits += c == r.letter
            lines += f"{i}:{c} hit! count={hits}\n" if c == r.letter else f"{i}:{c}\n"
        assert lines in r.parts[0].text and r.parts[-1].text.endswith(f"#### {r['count']}")
        assert "{" not in r.user_text and r.word in r.user_text
    train = {r.idx: r.word for r in T.simple_spelling(ids, words).collect()}
    test = {r.idx: r.word for r in T.simple_spelling(ids, words, split="test").collect()}
    assert len(train) == 200 and train != test
    assert len(T.SPELLING_TEMPLATES) == 51


def test_prompt_grid_picks_distinct_categories(spark):
    grid = T.prompt_grid(spark.range(50).withColumnRenamed("id", "idx"), {"a": ["t1"], "b": ["t2", "t3"]}, ["p"], ["d"],
                         {c: [f"{c}1", f"{c}2"] for c in "wxyz"}, "{topic}|{first_messages}")
    for r in grid.collect():
        cats = [line[2] for line in r.first_messages.split("\n")]
        assert len(set(cats)) == 3 and r.prompt == f"{r.topic}|{r.first_messages}"


def test_fewshot_never_shows_the_item_and_never_repeats(spark):
    items = spark.createDataFrame([("hot" if i % 3 else "t", i) for i in range(60)], "task string, item_id long")
    rows = mixture.fewshot(items, 5).collect()
    assert len(rows) == 60
    task = {i: "hot" if i % 3 else "t" for i in range(60)}
    for r in rows:
        ids = [s.shot_id for s in r.shots]
        assert len(set(ids)) == 5 and r.item_id not in ids and all(task[i] == r.task for i in ids)
    again = {r.item_id: [s.shot_id for s in r.shots] for r in mixture.fewshot(items.repartition(3), 5).collect()}
    assert again == {r.item_id: [s.shot_id for s in r.shots] for r in rows}


def test_slices_and_mixtures(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "idx long, key long")
    assert [(r.idx, r.key) for r in selection.task_slice(df, 1, 8, 3).orderBy("idx").collect()] == [(0, 10), (1, 40), (2, 70)]
    assert selection.slice_length(10, 1, 8, 3) == 3
    mix = mixture.task_mixture([df, df.limit(4)]).collect()
    assert sorted(r.idx for r in mix) == list(range(14)) and len({(r.task_idx, r.local_idx) for r in mix}) == 14
    seq = mixture.task_sequence([df, df]).orderBy("idx").collect()
    assert [r.task_idx for r in seq] == [0] * 10 + [1] * 10 and [r.idx for r in seq] == list(range(20))


def test_lm_prompt_strips_and_prefix_is_checked(spark):
    items = spark.createDataFrame([("t", 1, "ctx  \n", "end"), ("t", 2, "q", "")], "task string, item_id long, context string, continuation string")
    from palinode.plans.workflows import benchmark_spans

    rows = benchmark_spans(items, "language_modeling", 0).collect()
    assert [r.item_id for r in rows] == [1, 2] or [r.item_id for r in rows] == [1]
    one = next(r for r in rows if r.item_id == 1)
    assert bytes(one.ids[1:]).decode() == "ctx end" and (one.span_start, one.span_end) == (4, 8)


def test_jsonl_round_trip_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}]
    bad = [{"role": "assistant", "content": "x"}, {"role": "user", "content": "y"}]
    (src / "a.jsonl").write_text("\n".join(["", json.dumps(good), json.dumps(bad), "not json"]) + "\n")
    convs = T.read_conversations_jsonl(spark, str(src))
    assert convs.count() == 3 and convs.where("messages is null").count() == 1
    turns = T.turns_of(convs.where("messages is not null").withColumn("conv_id", F.monotonically_increasing_id()), ["conv_id"])
    assert C.validate_conversations(turns).where("valid").count() == 1
    for _ in range(2):  # a second run finds nothing new
        streams.append_valid_conversations(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [good]
    T.write_conversations(turns, str(tmp_path / "meta"), metadata=F.struct(F.lit("t").alias("topic")))
    assert json.loads(spark.read.text(str(tmp_path / "meta")).first().value)["metadata"] == {"topic": "t"}


def test_packing_covers_conversations_longer_than_a_row(spark, tmp_path):
    from palinode.plans.catalogue.chat import pack_bestfit_pad

    said = {1: ("hi", "a" * 700), 2: ("long", "b" * 3000), 3: ("q" * 600, "c" * 900)}
    turns = [(i, t, ("user", "assistant")[t], x[t]) for i, x in said.items() for t in (0, 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = {i: [256, 257, *x[0].encode(), 258, 259, *x[1].encode(), 260] for i, x in said.items()}

    def digest(ids):
        return hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()

    got = pack_bestfit_pad(spark, str(tmp_path)).collect()
    assert [r.inputs for r in got if r.row_id is None] == [digest(whole[2][:-1])]
    rows = {digest((whole[i] + [256] * 2049)[:2048]) for i in (1, 3)}
    assert {r.inputs for r in got if r.row_id is not None} == rows and len(got) == 3
