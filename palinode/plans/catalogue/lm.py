"""The count language model, lead-ins, and top-k / nucleus / softmax over score groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from palinode.functions.seeded import seed_uniform
from palinode.operators import language_model as LM
from palinode.operators import metrics, ranking, report, selection
from palinode.operators.ordered import dense_index
from palinode.plans.registry import query, u32, uniform, words as sql_words
from palinode.plans.workflows import direction_bpb
from palinode.session import table

SQL_BIGRAMS = f"""
w AS (SELECT doc_id, lang, {uniform(42, 'doc_id')} < 0.2 AS val, {sql_words()} AS w FROM documents),
p AS (SELECT lang, val, unnest(list_zip([''] || w, w || [''])) AS z FROM w WHERE len(w) > 0),
bg AS (SELECT lang, val, z[1] AS a, z[2] AS b, count(*) AS n FROM p GROUP BY ALL),
dir AS (SELECT lang, val, 'forward' AS direction, a AS ctx, b AS tgt, n FROM bg WHERE b <> ''
        UNION ALL SELECT lang, val, 'reverse', b, a, n FROM bg WHERE a <> '')"""
SQL_SCORED = f"""{SQL_BIGRAMS},
pr AS (SELECT direction, ctx, tgt, sum(n) AS n FROM dir WHERE NOT val GROUP BY ALL),
cx AS (SELECT direction, ctx, sum(n) AS n FROM pr GROUP BY ALL),
un AS (SELECT tgt, sum(n) AS n FROM pr WHERE direction = 'forward' GROUP BY ALL),
tt AS (SELECT sum(n) AS n_all, count(*) AS n_types FROM un),
hv AS (SELECT lang, direction, ctx, tgt, sum(n) AS n FROM dir WHERE val GROUP BY ALL),
sc AS (SELECT hv.lang, hv.direction, hv.ctx, hv.tgt, hv.n, strlen(hv.tgt) AS bytes,
  -ln((coalesce(pr.n, 0) + 10.0::DOUBLE * (coalesce(un.n, 0) + 1) / (n_all + n_types + 1)) / (coalesce(cx.n, 0) + 10.0::DOUBLE)) AS loss
  FROM hv CROSS JOIN tt LEFT JOIN pr ON pr.direction = hv.direction AND pr.ctx = hv.ctx AND pr.tgt = hv.tgt
  LEFT JOIN cx ON cx.direction = hv.direction AND cx.ctx = hv.ctx LEFT JOIN un ON un.tgt = hv.tgt)"""


@query(f"""WITH {SQL_SCORED}
SELECT lang, direction, round(sum(loss * n), 4) AS nats, sum(bytes * n)::BIGINT AS bytes,
       round(sum(loss * n) / (ln(2) * sum(bytes * n)), 8) AS bpb FROM sc GROUP BY ALL""")
def bpb_forward_reverse(spark, d):
    out = direction_bpb(table(spark, d, "documents", "doc_id"), ["lang"])
    return out.withColumns({"nats": F.round("nats", 4), "bpb": F.round("bpb", 8)})


@query(f"""WITH {SQL_BIGRAMS}
SELECT direction, ctx, count(*)::BIGINT AS n_targets, sum(n)::BIGINT AS n FROM (
  SELECT direction, ctx, tgt, sum(n) AS n FROM dir GROUP BY ALL) GROUP BY ALL""")
def reverse_lm_counts(spark, d):
    counts = LM.directed(LM.bigram_counts(table(spark, d, "documents", "doc_id")))
    return counts.groupBy("direction", "ctx").agg(F.count("*").alias("n_targets"), F.sum("n").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words()} AS w FROM documents),
p AS (SELECT unnest(list_zip([''] || w, w || [''])) AS z FROM w WHERE len(w) > 0)
SELECT z[1] AS a, z[2] AS b, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def next_prev_pairs(spark, d):
    return LM.bigram_counts(table(spark, d, "documents", "doc_id"))


@query(f"""WITH a AS (SELECT item_id, array_to_string(w[-2:], ' ') AS ending FROM (SELECT item_id, {sql_words()} AS w FROM benchmark) WHERE len(w) >= 2),
g AS (SELECT w[i] AS leadin, w[i + 1] || ' ' || w[i + 2] AS ending FROM (SELECT {sql_words()} AS w FROM documents), unnest(range(1, len(w) - 1)) AS u(i)),
c AS (SELECT ending, leadin, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT item_id, ending, leadin, n, rank() OVER (PARTITION BY item_id ORDER BY n DESC) AS rk FROM a JOIN c USING (ending))
SELECT item_id, ending, leadin, n::BIGINT AS n FROM r WHERE rk <= 5""")
def leadin_topk(spark, d):
    found = LM.leadins(table(spark, d, "documents", "doc_id"), table(spark, d, "benchmark"), "item_id")
    return ranking.top_k_ties(found, ["item_id"], "n", 5)


# ---- score groups: documents of a source as candidates, seeded logits --------------------------------

_SQL_SC = f"sc AS (SELECT source AS grp, doc_id AS item, floor({uniform('logit', 'doc_id')} * 64) / 8.0::DOUBLE AS logit FROM documents)"


def _scores(spark, d):
    return table(spark, d, "documents").select(
        F.col("source").alias("grp"), F.col("doc_id").alias("item"), (F.floor(seed_uniform("logit", "doc_id") * 64) / 8.0).alias("logit"))


@query(f"""WITH {_SQL_SC}, r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY logit DESC) AS rk FROM sc)
SELECT grp, item, logit FROM r WHERE rk <= 5""")
def topk_ties(spark, d):
    return ranking.top_k_ties(_scores(spark, d), ["grp"], "logit", 5)


@query(f"""WITH {_SQL_SC}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY logit DESC, item) AS rank FROM sc)
SELECT grp, item, logit, rank::INT AS rank FROM r WHERE rank <= 5""")
def topk_exact(spark, d):
    return ranking.top_k(_scores(spark, d), ["grp"], "logit", 5, "item")


@query(f"""WITH {_SQL_SC}, m AS (SELECT *, max(logit) OVER (PARTITION BY grp) AS mx FROM sc)
SELECT grp, item, round(exp((logit - mx) / 0.7) / sum(exp((logit - mx) / 0.7)) OVER (PARTITION BY grp), 9) AS prob FROM m""")
def softmax_temperature(spark, d):
    return ranking.softmax(_scores(spark, d), ["grp"], "logit", 0.7).select("grp", "item", F.round("prob", 9).alias("prob"))


@query(f"""WITH {_SQL_SC} SELECT grp, arg_max(item, {{'l': logit, 'i': -item}}) AS best FROM sc GROUP BY grp""")
def greedy_argmax(spark, d):
    return ranking.greedy(_scores(spark, d), ["grp"], "item", "logit")


@query(f"""WITH {_SQL_SC}, z AS (SELECT grp, item, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY grp), 9) AS prob FROM sc),
c AS (SELECT *, sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, item) - prob AS before FROM z)
SELECT grp, item, prob FROM c WHERE before <= 0.7""")
def nucleus_filter(spark, d):
    probs = ranking.softmax(_scores(spark, d), ["grp"], "logit").withColumn("prob", F.round("prob", 9))
    return ranking.nucleus(probs, ["grp"], "item", "prob", 0.7).select("grp", "item", "prob")


@query(f"""WITH {_SQL_SC}, z AS (SELECT grp, item, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY grp), 9) AS prob FROM sc)
SELECT grp, item, round(sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, item), 9) AS cum FROM z""")
def cumulative_prob(spark, d):
    probs = ranking.softmax(_scores(spark, d), ["grp"], "logit").withColumn("prob", F.round("prob", 9))
    return ranking.cumulative_prob(probs, ["grp"], "item", "prob").select("grp", "item", F.round("cum", 9).alias("cum"))


@query(f"""WITH {_SQL_SC}, t AS (SELECT *, min(item) OVER (PARTITION BY grp) AS tgt, max(logit) OVER (PARTITION BY grp) AS mx FROM sc)
SELECT grp, round(max(mx) + ln(sum(exp(logit - mx))) - max(CASE WHEN item = tgt THEN logit END), 8) AS ce FROM t GROUP BY grp""")
def cross_entropy(spark, d):
    s = _scores(spark, d)
    target = s.groupBy("grp").agg(F.min("item").alias("target"))
    return metrics.cross_entropy(s.join(target, "grp"), ["grp"], "item", "logit", "target").withColumn("ce", F.round("ce", 8))


# ---- losses in batches -----------------------------------------------------------------------------

@query(f"""WITH i AS (SELECT source, {uniform('loss', 'doc_id')} * 4 AS loss, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
b AS (SELECT idx // 24 AS batch, avg(loss) AS m FROM i GROUP BY 1)
SELECT round((SELECT avg(m) FROM b), 9) AS loss, round(exp(least(20.0, (SELECT avg(m) FROM b))), 7) AS ppl,
       round(avg(loss), 9) AS token_loss FROM i""")
def perplexity_batched(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (seed_uniform("loss", "doc_id") * 4).alias("loss"))
    rows = dense_index(docs, ["doc_id"]).withColumn("batch", selection.batch_no(F.col("idx"), 24))
    token = metrics.perplexity(rows, "batch", token_weighted=True).select(F.round("loss", 9).alias("token_loss"))
    return metrics.perplexity(rows, "batch").select(F.round("loss", 9).alias("loss"), F.round("ppl", 7).alias("ppl")).withColumn("token_loss", token.scalar())


@query(f"""WITH t AS (SELECT lang, unnest({sql_words()}) AS w FROM documents),
s AS (SELECT lang, strlen(w) AS len, CASE WHEN ('0x' || substr(md5(w), 1, 8))::BIGINT % 10 = 0 THEN -1 ELSE 1 END AS target,
  CASE WHEN ('0x' || substr(md5(w), 1, 8))::BIGINT % 7 = 0 THEN 0 ELSE strlen(w) END AS n_bytes, length(w) * 0.5::DOUBLE AS loss FROM t)
SELECT lang, sum(CASE WHEN target >= 0 AND n_bytes > 0 THEN loss ELSE 0 END) AS nats,
  sum(CASE WHEN target >= 0 AND n_bytes > 0 THEN n_bytes ELSE 0 END)::BIGINT AS bytes,
  round(sum(CASE WHEN target >= 0 AND n_bytes > 0 THEN loss ELSE 0 END) / (ln(2) * sum(CASE WHEN target >= 0 AND n_bytes > 0 THEN n_bytes ELSE 0 END)), 9) AS bpb
FROM s GROUP BY lang""")
def bits_per_byte_ignored(spark, d):
    from palinode.functions.seeded import hex_u32
    from palinode.functions.tokens import word_tokens

    toks = table(spark, d, "documents").select("lang", F.explode(word_tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    h = hex_u32(F.md5("w"))
    scored = toks.select("lang", "n", F.when(h % 10 == 0, -1).otherwise(1).alias("target"),
                         F.when(h % 7 == 0, 0).otherwise(F.octet_length("w")).alias("n_bytes"), (F.length("w") * 0.5).alias("loss"))
    return metrics.bits_per_byte(scored, ["lang"], weight=F.col("n")).withColumn("bpb", F.round("bpb", 9))


@query(f"""WITH a AS (SELECT item_id, text, right(text, 12) AS anchor FROM benchmark),
g AS (SELECT item_id, anchor, CASE WHEN {u32('land', 'item_id')} % 3 = 0 THEN text || ' more' ELSE text || '  ' END AS gen FROM a)
SELECT (item_id % 5)::BIGINT AS bucket, round(avg(ends_with(rtrim(gen), rtrim(anchor))::INT), 9) AS adherence, count(*)::BIGINT AS n FROM g GROUP BY 1""")
def anchor_adherence(spark, d):
    from palinode.functions.seeded import seed_pick

    a = table(spark, d, "benchmark").withColumn("anchor", F.right("text", F.lit(12)))
    gen = a.withColumn("gen", F.when(seed_pick(3, "land", "item_id") == 0, F.concat("text", F.lit(" more"))).otherwise(F.concat("text", F.lit("  "))))
    return report.anchor_adherence(gen.withColumn("bucket", F.pmod("item_id", F.lit(5))), "gen", "anchor", ["bucket"]).withColumn("adherence", F.round("adherence", 9))
