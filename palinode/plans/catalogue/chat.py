"""Conversations, task tables, generated tasks, mixtures, prompts and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from palinode.functions import sequences as S
from palinode.functions import text as X
from palinode.functions.tokens import BYTE_SPECIALS, word_tokens
from palinode.operators import conversations as C
from palinode.operators import mixture, packing, selection, toolcalls
from palinode.operators.ordered import dense_index
from palinode.plans.registry import byte_list, digest, query, u32, u60, uniform, words as sql_words
from palinode.session import table
from palinode.sources import tasks as T

SQL_CHECK = """
st AS (SELECT conv_id, count(*) AS n, min(turn) AS t0, max(turn) AS t1, arg_min(role, turn) AS r0,
         sum((role IS NULL OR text IS NULL)::INT) AS miss, sum((trim(text, E' \\t\\r\\n') = '')::INT) AS blank,
         sum((role = 'user' AND turn % 2 = 0)::INT) AS u0, sum((role = 'user' AND turn % 2 = 1)::INT) AS u1,
         sum((role = 'assistant' AND turn % 2 = 0)::INT) AS a0, sum((role = 'assistant' AND turn % 2 = 1)::INT) AS a1
       FROM conversations GROUP BY conv_id),
chk AS (SELECT conv_id, n, r0 = 'system' AS sys,
  CASE WHEN miss > 0 THEN 'missing field' WHEN t0 <> 0 OR t1 + 1 <> n THEN 'turn gap'
       WHEN n - (r0 = 'system')::INT < 2 THEN 'too short'
       WHEN CASE WHEN (t0 + (r0 = 'system')::INT) % 2 = 1 THEN u1 + a0 ELSE u0 + a1 END <> n - (r0 = 'system')::INT THEN 'role order'
       WHEN blank > 0 THEN 'blank content' ELSE 'ok' END AS reason FROM st)"""


def _turns(spark, d):
    return table(spark, d, "conversations")


@query(f"WITH {SQL_CHECK} SELECT conv_id, n::BIGINT AS n_messages, sys AS has_system, reason = 'ok' AS valid, reason FROM chk")
def validate_conversations(spark, d):
    return C.validate_conversations(_turns(spark, d))


@query("""
SELECT conv_id, count(*)::BIGINT AS n_messages, sum(length(text))::BIGINT AS total_chars,
  CASE WHEN count(*) > 500 THEN 'too many messages' WHEN min(length(text)) = 0 THEN 'empty message'
       WHEN max(length(text)) > 8000 THEN 'message too long' WHEN sum(length(text)) > 32000 THEN 'conversation too long'
       WHEN bool_or(role NOT IN ('user', 'assistant')) THEN 'bad role' ELSE 'ok' END AS reason
FROM conversations GROUP BY conv_id""")
def limit_conversations(spark, d):
    return C.limit_conversations(_turns(spark, d))


@query("""
SELECT conv_id, (turn // 4096)::INT AS segment_no, count(*)::BIGINT AS n,
       md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY ALL""")
def assemble_conversations(spark, d):
    convs = C.assemble_conversations(_turns(spark, d))
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.get(m["parts"], F.lit(0))["text"]))
    return convs.select("conv_id", "segment_no", F.size("messages").cast("long").alias("n"),
                        F.md5(F.array_join(line, "|")).alias("digest"))


SQL_MERGED = f"""{SQL_CHECK},
ok AS (SELECT conv_id FROM chk WHERE reason = 'ok'),
t AS (SELECT c.* FROM conversations c JOIN ok USING (conv_id)),
m AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN s.text IS NULL THEN t.text ELSE s.text || E'\\n\\n' || t.text END AS text
      FROM t LEFT JOIN t s ON s.conv_id = t.conv_id AND s.turn = 0 AND s.role = 'system' AND t.turn = 1
      WHERE t.role <> 'system')"""


def _sql_rendered(source: str) -> str:
    return f"""
f AS (SELECT *, turn = min(turn) OVER (PARTITION BY conv_id) AS lead, {byte_list('text')} AS b FROM {source}),
p AS (SELECT conv_id, turn,
  (CASE WHEN lead THEN [256] ELSE [] END) || (CASE WHEN role = 'user' THEN [257] || b || [258] ELSE [259] || b || [260] END) AS ids,
  (CASE WHEN lead THEN [0] ELSE [] END) || (CASE WHEN role = 'user' THEN list_transform([257] || b || [258], lambda x: 0)
       ELSE [0] || list_transform(b || [260], lambda x: 1) END) AS mask FROM f),
r AS (SELECT conv_id, flatten(list(ids ORDER BY turn))[1:2048] AS ids, flatten(list(mask ORDER BY turn))[1:2048] AS mask
      FROM p GROUP BY conv_id)"""


@query(f"""WITH {SQL_MERGED}, {_sql_rendered('m')}
SELECT conv_id, len(ids)::BIGINT AS n, list_sum(mask)::BIGINT AS supervised, {digest('ids')} AS ids, {digest('mask')} AS mask FROM r""")
def render_byte_mask(spark, d):
    r = C.render_turns(_turns(spark, d))
    return r.select("conv_id", F.size("ids").cast("long").alias("n"),
                    F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("supervised"),
                    F.md5(S.ids_text(F.col("ids"))).alias("ids"), F.md5(S.ids_text(F.col("mask"))).alias("mask"))


@query(f"""WITH {SQL_MERGED}, {_sql_rendered('m')}
SELECT conv_id, {digest('ids[:-2]')} AS inputs,
       {digest('list_transform(range(2, len(ids) + 1), lambda i: CASE WHEN mask[i] = 0 THEN -1 ELSE ids[i] END)')} AS targets FROM r""")
def mask_targets(spark, d):
    from palinode.plans.workflows import supervised

    r = C.render_turns(_turns(spark, d))
    inputs, targets = supervised(F.col("ids"), F.col("mask"))
    return r.select("conv_id", F.md5(S.ids_text(inputs)).alias("inputs"), F.md5(S.ids_text(targets)).alias("targets"))


@query(f"""WITH {SQL_MERGED},
e AS (SELECT conv_id, max(turn) AS last, arg_max(role, turn) AS role FROM m GROUP BY conv_id),
o AS (SELECT m.* FROM m JOIN e USING (conv_id) WHERE e.role = 'assistant' AND m.turn < e.last), {_sql_rendered('o')}
SELECT conv_id, (len(ids) + 1)::BIGINT AS n, {digest('ids || [259]')} AS digest FROM r""")
def completion_prompt(spark, d):
    r = C.render_for_completion(_turns(spark, d))
    return r.select("conv_id", F.size("ids").cast("long").alias("n"), F.md5(S.ids_text(F.col("ids"))).alias("digest"))


@query(f"""WITH {SQL_CHECK}, e AS (SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN reason <> 'ok' THEN reason ELSE 'last turn is not assistant' END AS reason
FROM chk JOIN e USING (conv_id) WHERE reason <> 'ok' OR role <> 'assistant'""")
def completion_rejects(spark, d):
    return C.completion_rejects(_turns(spark, d))


@query()
def pack_bestfit_pad(spark, d):
    """Whole conversations in rows of 2,048; each one longer than a row is a reject: row_id null, its own whole
    inputs and targets. Rows and rejects cover every valid conversation."""
    r = C.render_turns(_turns(spark, d), max_tokens=2**31 - 1)
    dealt = r.withColumn("stream_id", F.pmod("conv_id", F.lit(4)).cast("int"))
    rows = packing.train_rows(packing.pack_bestfit_pad(dealt, 2048, "conv_id", BYTE_SPECIALS["<|bos|>"], buffer=20))
    rejects = packing.train_rows(packing.pack_rejects(dealt, 2048).select(
        "stream_id", F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"), F.col("ids").alias("tokens"), "mask",
        F.size("ids").alias("content_len")))
    return rows.union(rejects).select("stream_id", "row_id", F.md5(S.ids_text(F.col("inputs"))).alias("inputs"),
                                      F.md5(S.ids_text(F.col("targets"))).alias("targets"))


@query(f"""WITH {SQL_MERGED}, {_sql_rendered('m')} SELECT sum(len(ids))::BIGINT AS tokens_kept, sum(list_sum(mask))::BIGINT AS supervised, 0::BIGINT AS bad_rows FROM r""")
def pack_pad_conservation(spark, d):
    """Pad packing loses no token and no supervised target, and every row has its full length."""
    dealt = C.render_turns(_turns(spark, d)).withColumn("stream_id", F.pmod("conv_id", F.lit(4)).cast("int"))
    packed = packing.pack_bestfit_pad(dealt, 2048, "conv_id", BYTE_SPECIALS["<|bos|>"], buffer=20)
    rows = packed.withColumn("targets", S.mask_targets(S.tail(F.col("tokens")), S.tail(F.col("mask")), F.col("content_len")))
    return rows.agg(F.sum("content_len").alias("tokens_kept"), F.sum(F.size(F.filter("targets", lambda t: t >= 0))).alias("supervised"),
                    F.count_if((F.size("tokens") != 2049) | (F.get("tokens", F.lit(0)) != BYTE_SPECIALS["<|bos|>"])).alias("bad_rows"))


@query(f"""WITH {SQL_CHECK}, t AS (SELECT * FROM conversations JOIN chk USING (conv_id) WHERE chk.reason = 'ok')
SELECT conv_id, count(*)::BIGINT AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM t GROUP BY conv_id""")
def smoltalk_conversations(spark, d):
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.get(m["parts"], F.lit(0))["text"]))
    return T.smoltalk_conversations(_turns(spark, d)).select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(line, "|")).alias("digest"))


# ---- task tables -----------------------------------------------------------------------------------

@query("""
WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)
SELECT ((idx - 3) // 4)::BIGINT AS idx, item_id FROM i WHERE idx >= 3 AND idx < 33 AND (idx - 3) % 4 = 0""")
def task_slice(spark, d):
    items = dense_index(table(spark, d, "benchmark").select("item_id"), ["item_id"])
    return selection.task_slice(items, 3, 33, 4)


def _mix_tasks(spark, d):
    docs = dense_index(table(spark, d, "labels").select(F.col("doc_id").alias("key")), ["key"])
    items = dense_index(table(spark, d, "benchmark").select(F.col("item_id").alias("key")), ["key"])
    return [docs, items, items]


_SQL_BAG = """
a AS (SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) - 1 AS local_idx FROM labels),
b AS (SELECT item_id AS key, row_number() OVER (ORDER BY item_id) - 1 AS local_idx FROM benchmark),
bag AS (SELECT 0 AS task_idx, * FROM a UNION ALL SELECT 1, * FROM b UNION ALL SELECT 2, * FROM b)"""


@query(f"""WITH {_SQL_BAG}
SELECT task_idx, local_idx, key,
       row_number() OVER (ORDER BY md5(concat_ws(':', '42', task_idx, local_idx)), task_idx, local_idx) - 1 AS idx FROM bag""")
def task_mixture(spark, d):
    return mixture.task_mixture(_mix_tasks(spark, d))


@query(f"""WITH {_SQL_BAG}
SELECT task_idx, local_idx, key, row_number() OVER (ORDER BY task_idx, local_idx) - 1 AS idx FROM bag""")
def task_sequence(spark, d):
    return mixture.task_sequence(_mix_tasks(spark, d))


def _mc_items(spark, d):
    customer = table(spark, d, "customer", "c_custkey").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    choices = F.array(*[F.lit(r) for r in ("zero", "one", "two", "three", "four")])
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("task"), F.col("c_custkey").alias("item_id"),
        F.concat("c_name", F.lit(" of "), "n_name", F.lit(": region")).alias("query"), choices.alias("choices"),
        F.col("n_regionkey").alias("gold"))


_SQL_MC = """
mc AS (SELECT c_mktsegment AS task, c_custkey AS item_id, c_name || ' of ' || n_name || ': region' AS query,
         ['zero', 'one', 'two', 'three', 'four'] AS choices, n_regionkey AS gold
       FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _sql_ring(items: str, k: int) -> str:
    """`shot`: k distinct other items of the task by Floyd's sampling of ring offsets, in the order of `j`."""
    steps = [f"""o0 AS (SELECT task, item_id, place, n, []::BIGINT[] AS o FROM ring WHERE n > {k})"""]
    for t in range(1, k + 1):
        i = f"(n - {k + 1 - t})"
        draw = f"({u60('1234o', 'task', 'item_id', i)} % {i} + 1)"
        steps.append(f"""o{t} AS (SELECT task, item_id, place, n,
  list_append(o, CASE WHEN list_contains(o, {draw}) THEN {i} ELSE {draw} END) AS o FROM o{t - 1})""")
    return f"""
ring AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws(':', '1234', task, item_id)), item_id) - 1 AS place,
           count(*) OVER (PARTITION BY task) AS n FROM {items}),
{", ".join(steps)},
ask AS (SELECT task, item_id, md5(concat_ws(':', '1234p', task, item_id, d)) AS j, (place + d) % n AS place
        FROM (SELECT task, item_id, place, n, unnest(o) AS d FROM o{k})),
shot AS (SELECT ask.task, ask.item_id, ask.j, r.* EXCLUDE (task, item_id), r.item_id AS shot_id
         FROM ask JOIN ring r ON r.task = ask.task AND r.place = ask.place)"""


@query(f"""WITH {_SQL_MC}, {_sql_ring('mc', 3)}
SELECT task, item_id, string_agg(shot_id::VARCHAR, ',' ORDER BY j) AS shots FROM shot GROUP BY ALL""")
def fewshot_ring(spark, d):
    shots = mixture.fewshot(_mc_items(spark, d), 3)
    return shots.select("task", "item_id", F.array_join(F.transform("shots", lambda s: s["shot_id"].cast("string")), ",").alias("shots"))


@query(f"""WITH {_SQL_MC}, {_sql_ring('mc', 2)},
head AS (SELECT task, item_id, string_agg(query || ' ' || choices[gold + 1] || E'\\n\\n', '' ORDER BY j) AS h FROM shot GROUP BY ALL)
SELECT task, item_id, (i - 1)::INT AS opt, md5(h || query || ' ' || choices[i]) AS digest
FROM mc JOIN head USING (task, item_id), unnest(range(1, 6)) AS u(i)""")
def mc_prompts(spark, d):
    items = _mc_items(spark, d)
    ready = items.join(mixture.fewshot(items, 2, payload=("query", "choices", "gold")), ["task", "item_id"])
    return ready.select("task", "item_id", F.posexplode(mixture.prompts(ready, "multiple_choice")).alias("opt", "p")).select(
        "task", "item_id", "opt", F.md5("p").alias("digest"))


def _schema_items(spark, d):
    return table(spark, d, "part", "p_partkey").select(
        F.col("p_type").alias("task"), F.col("p_partkey").alias("item_id"),
        F.array(F.concat("p_name", F.lit(" from "), "p_brand"), F.concat(F.lit("old "), "p_name")).alias("context_options"),
        F.concat(F.lit("of size "), F.col("p_size").cast("string")).alias("continuation"),
        F.pmod("p_size", F.lit(2)).cast("int").alias("gold"))


@query(f"""WITH sc AS (SELECT p_type AS task, p_partkey AS item_id, [p_name || ' from ' || p_brand, 'old ' || p_name] AS ctx,
    'of size ' || p_size AS cont, (p_size % 2)::INT AS gold FROM part), {_sql_ring('sc', 2)},
head AS (SELECT task, item_id, string_agg(ctx[gold + 1] || ' ' || cont || E'\\n\\n', '' ORDER BY j) AS h FROM shot GROUP BY ALL)
SELECT task, item_id, (i - 1)::INT AS opt, md5(h || ctx[i] || ' ' || cont) AS digest
FROM sc JOIN head USING (task, item_id), unnest([1, 2]) AS u(i)""")
def schema_prompts(spark, d):
    items = _schema_items(spark, d)
    ready = items.join(mixture.fewshot(items, 2, payload=("context_options", "continuation", "gold")), ["task", "item_id"])
    return ready.select("task", "item_id", F.posexplode(mixture.prompts(ready, "schema")).alias("opt", "p")).select(
        "task", "item_id", "opt", F.md5("p").alias("digest"))


def _lm_items(spark, d):
    """Documents with at least two words: all but the last as context, the last as continuation."""
    docs = table(spark, d, "documents", "doc_id").select("doc_id", "lang", word_tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    return docs.select(F.col("lang").alias("task"), F.col("doc_id").alias("item_id"),
                       F.concat(F.array_join(S.init(F.col("w")), " "), F.lit(" \n")).alias("context"),
                       F.element_at("w", -1).alias("continuation"))


@query(f"""WITH lm AS (SELECT lang AS task, doc_id AS item_id, array_to_string(w[:-2], ' ') AS context, w[-1] AS cont
  FROM (SELECT lang, doc_id, {sql_words()} AS w FROM documents) WHERE len(w) > 1), {_sql_ring('lm', 1)},
head AS (SELECT task, item_id, context || ' ' || cont || E'\\n\\n' AS h FROM shot)
SELECT task, item_id, md5(h || lm.context) AS without_digest, md5(h || lm.context || ' ' || lm.cont) AS with_digest
FROM lm JOIN head USING (task, item_id)""")
def lm_prompts(spark, d):
    items = _lm_items(spark, d)
    ready = items.join(mixture.fewshot(items, 1, payload=("context", "continuation")), ["task", "item_id"])
    p = mixture.prompts(ready, "language_modeling")
    return ready.select("task", "item_id", F.md5(F.get(p, F.lit(0))).alias("without_digest"), F.md5(F.get(p, F.lit(1))).alias("with_digest"))


@query(f"""WITH {_SQL_MC}
SELECT task, item_id, (i - 1)::INT AS opt, (strlen(query) + 2)::INT AS span_start,
       (strlen(query) + 2 + strlen(choices[i]))::INT AS span_end FROM mc, unnest(range(1, 6)) AS u(i)""")
def answer_spans_mc(spark, d):
    from palinode.plans.workflows import benchmark_spans

    return benchmark_spans(_mc_items(spark, d), "multiple_choice", 0).drop("ids")


@query("""WITH sc AS (SELECT p_type AS task, p_partkey AS item_id, [p_name || ' from ' || p_brand, 'old ' || p_name] AS ctx,
    'of size ' || p_size AS cont FROM part),
p AS (SELECT task, item_id, i, ctx[i] || ' ' || cont AS a, ctx[3 - i] || ' ' || cont AS b FROM sc, unnest([1, 2]) AS u(i)),
s AS (SELECT *, list_max([0] || list_filter(range(1, least(length(a), length(b)) + 1), lambda n: right(a, n) = right(b, n))) AS suf FROM p)
SELECT task, item_id, (i - 1)::INT AS opt, (strlen(a) + 1 - suf)::INT AS span_start, (strlen(a) + 1)::INT AS span_end FROM s""")
def answer_spans_schema(spark, d):
    from palinode.plans.workflows import benchmark_spans

    return benchmark_spans(_schema_items(spark, d), "schema", 0).drop("ids")


@query(f"""WITH lm AS (SELECT lang AS task, doc_id AS item_id, array_to_string(w[:-2], ' ') AS context, w[-1] AS cont
  FROM (SELECT lang, doc_id, {sql_words()} AS w FROM documents) WHERE len(w) > 1),
s AS (SELECT task, item_id, strlen(context) + 1 AS a, strlen(context) + 2 + strlen(cont) AS b FROM lm)
SELECT task, item_id, 0 AS opt, (a - greatest(b - 4096, 0))::INT AS span_start, (b - greatest(b - 4096, 0))::INT AS span_end,
       least(b, 4096)::INT AS n_ids FROM s""")
def answer_spans_lm(spark, d):
    from palinode.plans.workflows import benchmark_spans

    s = benchmark_spans(_lm_items(spark, d), "language_modeling", 0, max_len=4096)
    return s.withColumn("n_ids", F.size("ids")).drop("ids")


@query(f"""WITH p AS (SELECT a.item_id, {byte_list('a.text')} AS x, {byte_list('b.text')} AS y
  FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
q AS (SELECT *, least(len(x), len(y)) AS n FROM p)
SELECT item_id, coalesce(list_position(list_transform(range(1, n + 1), lambda i: x[i] = y[i]), false) - 1, n)::INT AS prefix,
       coalesce(list_position(list_transform(range(1, n + 1), lambda i: x[len(x) + 1 - i] = y[len(y) + 1 - i]), false) - 1, n)::INT AS suffix
FROM q""")
def common_prefix(spark, d):
    from palinode.functions.tokens import byte_ids

    items = table(spark, d, "benchmark").select("item_id", byte_ids(F.col("text")).alias("ids"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("ids").alias("other"))
    pair = items.join(after, "item_id").select("item_id", F.array("ids", "other").alias("seqs"))
    return pair.select("item_id", S.common_prefix_len(F.col("seqs")).alias("prefix"), S.common_suffix_len(F.col("seqs")).alias("suffix"))


@query("""SELECT c_custkey AS conv_id, md5('Multiple Choice question: ' || c_name || E'?\\n- BUILDING=A\\n- MACHINERY=B\\n- FURNITURE=C\\n- HOUSEHOLD=D\\n'
  || E'\\nRespond only with the letter of the correct answer.') AS question, chr(65 + c_custkey::INT % 4) AS answer, n_name AS subject
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def mmlu_conversations(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("idx"), F.concat("c_name", F.lit("?")).alias("question"),
        F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD")]).alias("choices"),
        F.pmod("c_custkey", F.lit(4)).cast("int").alias("answer"), F.col("n_name").alias("subject"))
    return _flat(T.mmlu_conversations(rows), "subject")


@query("""SELECT p_partkey AS conv_id, md5('Multiple Choice question: ' || p_name || E'\\n- ' || p_brand || E'=1\\n- ' || p_type || E'=2\\n'
  || E'\\nRespond only with the letter of the correct answer.') AS question, CASE WHEN p_size % 2 = 0 THEN '1' ELSE '2' END AS answer FROM part""")
def arc_conversations(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("idx"), F.col("p_name").alias("question"),
        F.struct(F.array("p_brand", "p_type").alias("text"), F.array(F.lit("1"), F.lit("2")).alias("label")).alias("choices"),
        F.when(F.pmod("p_size", F.lit(2)) == 0, "1").otherwise("2").alias("answerKey"))
    return _flat(T.arc_conversations(rows))


def _flat(convs, *extra):
    def text(i):
        return F.get(F.get(F.col("messages"), F.lit(i))["parts"], F.lit(0))["text"]

    return convs.select("conv_id", F.md5(text(0)).alias("question"), text(1).alias("answer"), *extra)


def _worked(spark, d):
    """Orders as worked arithmetic: a quantity times a price, with recorded results, some of them wrong."""
    rows = table(spark, d, "orders", "o_orderkey").select("o_orderkey", (F.pmod("o_custkey", F.lit(50)) + 1).cast("int").alias("q"))
    result = F.col("q") * 3 + F.when(F.pmod("o_orderkey", F.lit(7)) == 0, 1).otherwise(0)
    return rows.select(
        "o_orderkey", "q",
        F.concat(F.lit("It is <<"), F.col("q").cast("string"), F.lit("*3="), result.cast("string"), F.lit(">>"), result.cast("string"),
                 F.lit(" then <<1,000+"), F.col("q").cast("string"), F.lit("="), (F.col("q") + 1000).cast("string"),
                 F.lit(">>\n#### 1,"), F.lpad(F.col("q").cast("string"), 3, "0")).alias("answer"))


_SQL_WORKED = """
wk AS (SELECT o_orderkey, (o_custkey % 50 + 1)::INT AS q, o_custkey % 50 * 3 + 3 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS r FROM orders)"""


@query(f"""WITH {_SQL_WORKED}
SELECT o_orderkey, 7 AS n_parts, q || '*3' AS expr, r::VARCHAR AS result, '1,000+' || q AS expr2,
  md5(concat_ws('|', 'text:It is ', 'python:' || q || '*3', 'python_output:' || r, 'text:' || r || ' then ', 'python:1,000+' || q,
      'python_output:' || (q + 1000), E'text:\\n#### 1,' || lpad(q::VARCHAR, 3, '0'))) AS digest FROM wk""")
def tool_call_split(spark, d):
    rows = _worked(spark, d).withColumn("parts", X.split_tool_calls(F.col("answer")))

    def text(i):
        return F.get("parts", F.lit(i))["text"]

    return rows.select("o_orderkey", F.size("parts").alias("n_parts"), text(1).alias("expr"), text(2).alias("result"),
                       text(4).alias("expr2"), F.md5(F.array_join(F.transform("parts", lambda p: F.concat(p["type"], F.lit(":"), p["text"])), "|")).alias("digest"))


@query(f"""WITH {_SQL_WORKED}
SELECT o_orderkey, '1' || lpad(q::VARCHAR, 3, '0') AS found, q % 2 = 0 AS correct, true AS both_missing FROM wk""")
def extract_answer(spark, d):
    rows = _worked(spark, d).withColumn("found", X.extract_answer(F.col("answer")))
    even = F.when(F.pmod("q", F.lit(2)) == 0, F.col("found"))
    ref = X.extract_answer(F.concat(F.lit("so #### "), F.col("found")))
    return rows.select("o_orderkey", "found", X.answer_correct(even, ref).alias("correct"),
                       X.answer_correct(X.extract_answer(F.lit("no answer")), F.lit(None).cast("string")).alias("both_missing"))


@query(f"""WITH {_SQL_WORKED}
SELECT 'arithmetic' AS kind, o_orderkey % 7 <> 0 AS agrees, count(*)::BIGINT AS n, sum(q * 3)::DOUBLE AS value FROM wk GROUP BY ALL
UNION ALL SELECT 'arithmetic2', true, count(*)::BIGINT, sum(q + 1000)::DOUBLE FROM wk""")
def tool_audit_arith(spark, d):
    parts = _worked(spark, d).withColumn("parts", X.split_tool_calls(F.col("answer")))
    calls = parts.select(F.inline(F.array(*[F.struct(
        F.lit(tag).alias("tag"), F.get("parts", F.lit(i))["text"].alias("expr"), F.get("parts", F.lit(i + 1))["text"].alias("result"))
        for tag, i in (("", 1), ("2", 4))])))
    audited = toolcalls.audit_tool_calls(calls)
    return audited.groupBy(F.concat("kind", "tag").alias("kind"), "agrees").agg(
        F.count("*").alias("n"), F.sum("value").alias("value"))


def _vocabulary(spark, d):
    words = table(spark, d, "documents").select(F.explode(word_tokens(F.col("text"))).alias("word")).where(
        F.col("word").rlike(r"^\p{L}+$")).select(F.lower("word").alias("word")).distinct()
    return words


_SQL_LIST = f"""
wl AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest({sql_words()}) AS w FROM documents) WHERE regexp_matches(w, '^\\p{{L}}+$'))"""


def _ids(spark, d):
    return table(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("idx"))


@query(f"""WITH {_SQL_LIST},
ix AS (SELECT word, row_number() OVER (ORDER BY md5(concat_ws(':', '42', word)), word) - 1 AS k FROM wl), n AS (SELECT count(*) AS n FROM wl),
dr AS (SELECT o_orderkey AS idx, word FROM orders, n JOIN ix ON ix.k = {u32('bee-word', 'o_orderkey')} % n.n),
lt AS (SELECT idx, word, CASE WHEN {uniform('bee-own', 'idx')} < 0.9
         THEN substr(word, ({u32('bee-letter', 'idx')} % length(word) + 1)::INT, 1)
         ELSE substr('abcdefghijklmnopqrstuvwxyz', ({u32('bee-any', 'idx')} % 26 + 1)::INT, 1) END AS letter FROM dr),
ct AS (SELECT *, (length(word) - length(replace(word, letter, '')))::INT AS cnt FROM lt)
SELECT idx, word, letter, cnt AS "count", '''' || word || '''.count(''' || letter || ''')' AS expr, '#### ' || cnt AS ending FROM ct""")
def spelling_bee(spark, d):
    bee = T.spelling_bee(_ids(spark, d), _vocabulary(spark, d))
    last = F.substring_index(F.element_at("parts", -1)["text"], "\n", -1)
    return bee.select("idx", "word", "letter", "count", F.get("parts", F.lit(2))["text"].alias("expr"), last.alias("ending"))


@query(f"""WITH {_SQL_LIST},
ix AS (SELECT word, row_number() OVER (ORDER BY md5(concat_ws(':', '43', word)), word) - 1 AS k FROM wl), n AS (SELECT count(*) AS n FROM wl)
SELECT o_orderkey AS idx, word, 'Spell the word: ' || word AS user_text, word || ':' || array_to_string(string_split(word, ''), ',') AS answer
FROM orders, n JOIN ix ON ix.k = {u32('spell-word', 'o_orderkey')} % n.n""")
def simple_spelling(spark, d):
    return T.simple_spelling(_ids(spark, d), _vocabulary(spark, d))


@query(f"""WITH {_SQL_LIST}
SELECT word, array_to_string(string_split(word, ''), ',') AS spelled, length(word) - length(replace(word, 'e', '')) AS n_e,
  array_to_string(list_transform(string_split(word, ''), lambda c, i: i || ':' || c || CASE WHEN c = 'e' THEN ' hit! count='
     || len(list_filter(string_split(word, '')[1:i], lambda x: x = 'e')) ELSE '' END || E'\\n'), '') AS lines FROM wl""")
def spell_words(spark, d):
    w = F.col("word")
    return _vocabulary(spark, d).select("word", X.spell(w).alias("spelled"), X.count_letter(w, F.lit("e")).cast("long").alias("n_e"),
                                        X.counting_lines(w, F.lit("e")).alias("lines"))


@query("""SELECT p_partkey, md5(p_name || E'\\nreturn ' || p_size) AS fenced, md5(p_name || ' plain') AS bare,
  'import os' || chr(10) || 'from a import b' || E'\\n\\n' || p_name || E'\\n\\ntest\\ncheck(f)' AS program FROM part""")
def extract_program(spark, d):
    name = F.col("p_name")
    block = F.concat(F.lit("Here:\n```python\n"), name, F.lit("\nreturn "), F.col("p_size").cast("string"), F.lit("\n```\nand ```\nother\n```"))
    prompt = F.lit("import os\n# note\n\n from a import b\ndef f():\nimport late")
    return table(spark, d, "part").select(
        "p_partkey", F.md5(X.extract_program(block)).alias("fenced"), F.md5(X.extract_program(F.concat(F.lit(" \n"), name, F.lit(" plain\n")))).alias("bare"),
        X.assemble_program(prompt, name, F.lit("test"), F.lit("f")).alias("program"))


@query(f"""
WITH g AS (SELECT o_orderkey AS idx, [['a1', 'a2', 'a3'], ['b1'], ['c1', 'c2']] AS topics FROM orders),
c AS (SELECT *, topics[{u32('grid-category', 'idx')} % 3 + 1] AS cat FROM g)
SELECT idx, cat[{u32('grid-topic', 'idx')} % len(cat) + 1] AS topic, ['p1', 'p2', 'p3'][{u32('grid-persona', 'idx')} % 3 + 1] AS persona,
  ['d1', 'd2'][{u32('grid-dynamic', 'idx')} % 2 + 1] AS dynamic,
  array_to_string(list_transform(list_sort([{{'k': md5(concat_ws(':', 'grid-open', idx, 'w')), 'm': ['hi', 'yo'][{u32('grid-msg', 'idx', "'w'")} % 2 + 1]}},
    {{'k': md5(concat_ws(':', 'grid-open', idx, 'x')), 'm': ['why'][1]}},
    {{'k': md5(concat_ws(':', 'grid-open', idx, 'y')), 'm': ['how', 'when', 'who'][{u32('grid-msg', 'idx', "'y'")} % 3 + 1]}}])[1:2], lambda s: '- ' || s.m), E'\\n') AS first_messages
FROM c""")
def prompt_grid(spark, d):
    grid = T.prompt_grid(
        _ids(spark, d), {"a": ["a1", "a2", "a3"], "b": ["b1"], "c": ["c1", "c2"]}, ["p1", "p2", "p3"], ["d1", "d2"],
        {"w": ["hi", "yo"], "x": ["why"], "y": ["how", "when", "who"]}, "{topic} / {persona} / {dynamic}\n{first_messages}", k=2)
    return grid.drop("prompt")


_TOOLS = {k: BYTE_SPECIALS[f"<|{k}|>"] for k in ("python_start", "python_end", "output_start", "output_end", "assistant_end", "bos")}


def _tool_streams(spark, d):
    """Worked lines as rendered token streams."""
    w = _worked(spark, d).select(F.col("o_orderkey").alias("idx"), "q", F.lit("q").alias("question"), "answer")
    convs = T.gsm8k_conversations(w, "idx")
    return C.render_messages(convs)


@query(f"""WITH {_SQL_WORKED}, b AS (SELECT o_orderkey AS conv_id, {byte_list("q || '*3'")} AS x, {byte_list("'1,000+' || q")} AS y,
  length(r::VARCHAR) + length((q + 1000)::VARCHAR) + 4 AS forced FROM wk)
SELECT conv_id, 2 AS n_calls, array_to_string(x, ',') AS first_call, array_to_string(y, ',') AS second_call, forced::BIGINT AS forced FROM b""")
def tool_spans(spark, d):
    s = _tool_streams(spark, d).withColumn("calls", toolcalls.tool_spans(F.col("ids"), _TOOLS["python_start"], _TOOLS["python_end"]))
    mask = toolcalls.sampled_mask(F.col("ids"), _TOOLS["output_start"], _TOOLS["output_end"])
    return s.select("conv_id", F.size("calls").alias("n_calls"), F.get("calls", F.lit(0)).alias("first_call"),
                    F.get("calls", F.lit(1)).alias("second_call"), F.size(F.filter(mask, lambda m: m == 0)).cast("long").alias("forced"))


@query(f"""WITH {_SQL_WORKED},
a AS (SELECT o_orderkey AS conv_id, 'It is ' || q || '*3' || r || r || ' then 1,000+' || q || (q + 1000) || E'\\n#### 1,'
        || lpad(q::VARCHAR, 3, '0') AS body FROM wk)
SELECT conv_id, (strlen(body) + 8)::BIGINT AS n, strlen('It is ')::BIGINT AS first_len FROM a""")
def truncate_completion(spark, d):
    """The assistant part of a rendered stream: prompt stripped, cut at the end marker, then at its first tool call."""
    s = _tool_streams(spark, d)
    start = F.array_position("ids", BYTE_SPECIALS["<|assistant_start|>"]).cast("int")
    body = toolcalls.truncate_completion(F.col("ids"), start, (_TOOLS["assistant_end"], _TOOLS["bos"]))
    head = toolcalls.truncate_completion(F.col("ids"), start, (_TOOLS["python_start"],))
    return s.select("conv_id", F.size(body).cast("long").alias("n"), F.size(head).cast("long").alias("first_len"))


def _bee_results(spark, d):
    """Spelling problems over orders with two recorded responses each: the first is right for even keys."""
    bee = T.spelling_bee(_ids(spark, d), _vocabulary(spark, d))
    convs = T.generated_conversations(bee)
    said = F.col("count").cast("string")
    responses = bee.select(F.col("idx").alias("conv_id"), F.posexplode(F.array(
        F.when(F.pmod("idx", F.lit(2)) == 0, F.concat(F.lit("so #### "), said)).otherwise(F.lit("#### 99")),
        F.when(F.pmod("idx", F.lit(5)) == 0, F.concat(F.lit("#### "), said)).otherwise(F.lit("unsure")))).alias("sample", "response"))
    return convs, responses


@query("""SELECT 'SpellingBee' AS task, round(avg((o_orderkey % 2 = 0 OR o_orderkey % 5 = 0)::INT), 9) AS accuracy, count(*)::BIGINT AS n,
  sum((o_orderkey % 2 = 0 OR o_orderkey % 5 = 0)::INT)::BIGINT AS passed FROM orders""")
def task_evaluation(spark, d):
    from palinode.operators.evaluation import evaluate_all

    return evaluate_all({"SpellingBee": _bee_results(spark, d)}).withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT o_orderkey AS conv_id, s::INT AS sample, CASE WHEN (s = 0 AND o_orderkey % 2 = 0) OR (s = 1 AND o_orderkey % 5 = 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward
FROM orders, unnest([0, 1]) AS u(s)""")
def task_reward(spark, d):
    from palinode.operators.evaluation import reward

    return reward("SpellingBee", *_bee_results(spark, d)).select("conv_id", "sample", "reward")
