"""Benchmark and chat scoring, rollouts, reports. Losses, logits and rewards are seeded stand-ins for a
model's output, drawn per row of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palinode.functions.seeded import seed_pick, seed_uniform
from palinode.operators import metrics, report
from palinode.operators.ordered import dense_index
from palinode.plans.registry import query, u32, uniform
from palinode.session import table

# ---- option scoring over parts: four options of eight tokens, answer span [3, 8) -----------------------

_SQL_OPT = f"""
it AS (SELECT p_brand AS task, p_partkey AS idx, ({u32('gold', 'p_partkey')} % 4)::INT AS gold FROM part),
tok AS (SELECT task, idx, gold, o AS opt, p AS pos, {uniform('loss', 'idx', 'o', 'p')} AS loss,
          ({u32('tok', 'idx', 'p')} % 5)::INT AS tok, ({u32('pred', 'idx', 'p')} % 2 + {u32('tok', 'idx', 'p + 1')} % 5 * 1)::INT AS pred
        FROM it, unnest(range(0, 4)) AS u(o), unnest(range(0, 8)) AS v(p))"""


def _items(spark, d):
    return table(spark, d, "part", "p_partkey").select(F.col("p_brand").alias("task"), F.col("p_partkey").alias("idx"),
                                          seed_pick(4, "gold", "p_partkey").cast("int").alias("gold"))


def _losses(spark, d):
    grid = _items(spark, d).select("task", "idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("opt")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    return grid.withColumn("loss", seed_uniform("loss", "idx", "opt", "pos"))


def _spans(spark, d):
    return _items(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("opt"), F.lit(3).alias("span_start"), F.lit(8).alias("span_end"))


@query(f"""WITH {_SQL_OPT}, m AS (SELECT task, idx, gold, opt, avg(loss) AS m FROM tok WHERE pos >= 2 AND pos < 7 GROUP BY ALL),
b AS (SELECT task, idx, gold, arg_min(opt, {{'m': m, 'o': opt}})::INT AS pred_opt FROM m GROUP BY ALL)
SELECT task, idx, gold, pred_opt, pred_opt = gold AS correct FROM b""")
def mc_correct(spark, d):
    return metrics.mc_correct(_losses(spark, d), _spans(spark, d))


def _lm_scored(spark, d):
    grid = _items(spark, d).select("task", "idx", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    pred = (seed_pick(2, "pred", "idx", "pos") + seed_pick(5, "tok", F.col("idx"), F.col("pos") + 1)).cast("int")
    return grid.withColumns({"tok": seed_pick(5, "tok", "idx", "pos").cast("int"), "pred": pred})


@query(f"""WITH g AS (SELECT p_brand AS task, p_partkey AS idx, p AS pos, {u32('tok', 'p_partkey', 'p')} % 5 AS tok,
  {u32('pred', 'p_partkey', 'p - 1')} % 2 + {u32('tok', 'p_partkey', 'p')} % 5 AS pred FROM part, unnest(range(6, 8)) AS u(p))
SELECT task, idx, bool_and(tok = pred) AS correct FROM g GROUP BY ALL""")
def lm_correct(spark, d):
    spans = _items(spark, d).select("task", "idx", F.lit(6).alias("span_start"), F.lit(8).alias("span_end"))
    return metrics.lm_correct(_lm_scored(spark, d), spans)


# ---- categorical: logits over letters ----------------------------------------------------------------

def _letter_logits(spark, d):
    it = _items(spark, d).select("task", "idx", F.posexplode(F.array(*[F.lit(c) for c in "ABCD"])).alias("letter_pos", "letter"))
    return it.withColumn("logit", F.floor(seed_uniform("letter", "idx", "letter") * 8) / 4.0)


_SQL_CAT = f"""
lt AS (SELECT p_brand AS task, p_partkey AS idx, l AS letter, ord(l) - 65 AS pos, floor({uniform('letter', 'p_partkey', 'l')} * 8) / 4.0 AS logit
       FROM part, unnest(['A', 'B', 'C', 'D']) AS u(l)),
pr AS (SELECT task, idx, arg_max(letter, {{'l': logit, 'p': -pos}}) AS predicted FROM lt GROUP BY ALL),
cat AS (SELECT task, idx, predicted, chr((65 + {u32('gold', 'idx')} % 4)::INT) AS gold FROM pr)"""


def _categorical(spark, d):
    gold = _items(spark, d).select("task", "idx", F.get(F.array(*[F.lit(c) for c in "ABCD"]), F.col("gold")).alias("gold"))
    return metrics.categorical_correct(metrics.categorical_predict(_letter_logits(spark, d)), gold)


@query(f"WITH {_SQL_CAT} SELECT task, idx, predicted, gold, predicted = gold AS correct FROM cat")
def categorical_predict(spark, d):
    return _categorical(spark, d).drop("letters")


@query(f"""WITH {_SQL_CAT} SELECT task, round(avg((predicted = gold)::INT), 9) AS accuracy, count(*)::BIGINT AS n, sum((predicted = gold)::INT)::BIGINT AS passed
FROM cat GROUP BY task""")
def accuracy_by_task(spark, d):
    return metrics.accuracy(_categorical(spark, d), ["task"]).withColumn("accuracy", F.round("accuracy", 9))


def _baselines(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("task")).distinct().withColumn(
        "random_baseline", (seed_pick(3, "base", "task") * 25).cast("double"))


_SQL_ACC = f"""{_SQL_CAT}, acc AS (SELECT task, avg((predicted = gold)::INT) AS acc FROM cat GROUP BY task),
cen AS (SELECT task, acc, ({u32('base', 'task')} % 3 * 25)::DOUBLE AS base FROM acc)"""


@query(f"""WITH {_SQL_ACC} SELECT task, round(acc, 9) AS accuracy, base AS random_baseline, round((acc - 0.01 * base) / (1.0 - 0.01 * base), 9) AS centered FROM cen""")
def centered_accuracy(spark, d):
    from palinode.plans.workflows import core_report

    r = core_report(_categorical(spark, d), _baselines(spark, d))
    return r.select("task", F.round("accuracy", 9).alias("accuracy"), "random_baseline", F.round("centered", 9).alias("centered"))


@query(f"""WITH {_SQL_ACC} SELECT round(avg((acc - 0.01 * base) / (1.0 - 0.01 * base)), 9) AS core, count(*)::BIGINT AS n_tasks FROM cen""")
def core_metric(spark, d):
    acc = metrics.accuracy(_categorical(spark, d), ["task"])
    return metrics.core_metric(acc, _baselines(spark, d)).withColumn("core", F.round("core", 9))


_CHAT = ("ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "SpellingBee")


def _chat_outcomes(spark, d):
    """Orders as evaluated problems: a source per priority, a chat task per key."""
    names = F.array(*[F.lit(t) for t in _CHAT])
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("source"), F.get(names, seed_pick(6, "ct", "o_orderkey").cast("int")).alias("task"),
        F.col("o_orderstatus").alias("subject"), (seed_uniform("ok", "o_orderkey") < 0.4).alias("correct"))


_SQL_CHAT = f"""
ev AS (SELECT o_orderpriority AS source, o_orderstatus AS subject, {list(_CHAT)}[{u32('ct', 'o_orderkey')} % 6 + 1] AS task,
         {uniform('ok', 'o_orderkey')} < 0.4 AS correct FROM orders)"""


@query(f"""WITH {_SQL_CHAT}, a AS (SELECT source, task, avg(correct::INT) AS acc, CASE WHEN task IN ('ARC-Easy', 'ARC-Challenge', 'MMLU') THEN 0.25 ELSE 0 END AS base FROM ev GROUP BY ALL)
SELECT source, round(avg((acc - base) / (1 - base)), 9) AS chatcore, round(avg(CASE WHEN base > 0 THEN (acc - base) / (1 - base) END), 9) AS chatcore_cat FROM a GROUP BY source""")
def chatcore(spark, d):
    acc = metrics.accuracy(_chat_outcomes(spark, d), ["source", "task"])
    out = metrics.chatcore(acc, ["source"])
    return out.select("source", F.round("chatcore", 9).alias("chatcore"), F.round("chatcore_cat", 9).alias("chatcore_cat"))


@query(f"""WITH {_SQL_CHAT} SELECT task, subject, round(avg(correct::INT), 9) AS accuracy, count(*)::BIGINT AS n FROM ev GROUP BY ROLLUP (task, subject) HAVING task IS NOT NULL""")
def accuracy_by_subject(spark, d):
    return metrics.by_subject(_chat_outcomes(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {_SQL_CHAT}, a AS (SELECT source, task, round(avg(correct::INT), 6) AS acc FROM ev GROUP BY ALL)
SELECT source, string_agg('chatcore/' || task || '=' || printf('%.6f', acc), ';' ORDER BY task) AS metrics FROM a GROUP BY source""")
def metric_map(spark, d):
    acc = metrics.accuracy(_chat_outcomes(spark, d), ["source", "task"]).withColumn("accuracy", F.round("accuracy", 6))
    m = metrics.metric_map(acc, ["source"], F.concat(F.lit("chatcore/"), "task"), "accuracy")
    entries = F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])))
    return m.select("source", F.array_join(F.array_sort(entries), ";").alias("metrics"))


# ---- rollouts: a user's events are the samples of a problem ------------------------------------------

def _outcomes(spark, d):
    ev = dense_index(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"], "sample", ["user_id"])
    return ev.select(F.col("user_id").alias("problem"), "sample", "event_type", (F.col("value") < 5).alias("correct"),
                     F.when(F.col("value") < 20, 1.0).otherwise(0.0).alias("reward"), F.floor(F.col("value")).cast("long").alias("n_tokens"), "event_id")


_SQL_OUT = """
oc AS (SELECT user_id AS problem, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample, event_type, value < 5 AS correct,
         CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0 END AS reward, floor(value)::BIGINT AS n_tokens, event_id FROM events)"""


@query(f"""WITH {_SQL_OUT}, f AS (SELECT problem, coalesce(min(CASE WHEN correct THEN sample END), 1000000) AS first FROM oc GROUP BY 1)
SELECT k::INT AS k, round(avg((first < k)::INT), 9) AS pass_at_k FROM f, unnest(range(1, 17)) AS u(k) GROUP BY k""")
def pass_at_k(spark, d):
    return metrics.pass_at_k(_outcomes(spark, d), 16).withColumn("pass_at_k", F.round("pass_at_k", 9))


@query(f"WITH {_SQL_OUT} SELECT problem, bool_or(correct) AS passed FROM oc GROUP BY problem")
def any_pass(spark, d):
    return metrics.any_pass(_outcomes(spark, d))


@query(f"WITH {_SQL_OUT} SELECT problem, sample, bool_or(correct) OVER (PARTITION BY problem ORDER BY sample) AS any_so_far FROM oc")
def prefix_any(spark, d):
    return metrics.prefix_any(_outcomes(spark, d), ["problem"], ["sample"], "correct", width=65_536).select("problem", "sample", "any_so_far")


@query(f"WITH {_SQL_OUT} SELECT problem, sample, reward, round(reward - avg(reward) OVER (PARTITION BY problem), 9) AS advantage FROM oc")
def advantages(spark, d):
    out = metrics.advantages(_outcomes(spark, d), "problem")
    return out.select("problem", "sample", "reward", F.round("advantage", 9).alias("advantage"))


@query(f"""WITH {_SQL_OUT}, p AS (SELECT event_type, problem, avg(reward) AS r, sum(n_tokens) AS l, count(*) AS n FROM oc GROUP BY ALL)
SELECT event_type, round(avg(r), 9) AS mean_reward, round(sum(l) / sum(n), 9) AS mean_length FROM p GROUP BY event_type""")
def rollout_stats(spark, d):
    out = metrics.rollout_stats(_outcomes(spark, d), ["event_type"], "problem")
    return out.select("event_type", F.round("mean_reward", 9).alias("mean_reward"), F.round("mean_length", 9).alias("mean_length"))


@query(f"WITH {_SQL_OUT} SELECT problem, greatest(sum((n_tokens % 10 - 3 >= 0)::INT), 1)::BIGINT AS n_valid FROM oc GROUP BY problem")
def pg_weights(spark, d):
    toks = _outcomes(spark, d).withColumn("target", F.pmod("n_tokens", F.lit(10)) - 3)
    return metrics.pg_weights(toks, ["problem"])


# ---- reports -----------------------------------------------------------------------------------------

def _stage_metrics(spark, d):
    stage = F.get(F.array(F.lit("base"), F.lit("sft"), F.lit("rl")), F.pmod("o_custkey", F.lit(3)).cast("int"))
    names = F.array(*[F.lit(n) for n in ("MMLU", "CORE", "GSM8K", "ChatCORE", "ARC-Easy")])
    rows = table(spark, d, "orders").select(stage.alias("stage"), F.get(names, F.pmod("o_orderkey", F.lit(5)).cast("int")).alias("metric"), "o_totalprice")
    return rows.where(~((F.col("stage") == "rl") & (F.col("metric") == "CORE"))).groupBy("stage", "metric").agg((F.max("o_totalprice") / 1000).alias("value"))


_SQL_STAGE = """
sm AS (SELECT stage, metric, max(o_totalprice) / 1000 AS value FROM (
  SELECT ['base', 'sft', 'rl'][o_custkey % 3 + 1] AS stage, ['MMLU', 'CORE', 'GSM8K', 'ChatCORE', 'ARC-Easy'][o_orderkey % 5 + 1] AS metric, o_totalprice FROM orders)
  WHERE NOT (stage = 'rl' AND metric = 'CORE') GROUP BY ALL)"""


@query(f"""WITH {_SQL_STAGE}
SELECT metric, coalesce(printf('%.4f', max(CASE WHEN stage = 'base' THEN value END)), '-') AS base,
  coalesce(printf('%.4f', max(CASE WHEN stage = 'sft' THEN value END)), '-') AS sft,
  coalesce(printf('%.4f', max(CASE WHEN stage = 'rl' THEN value END)), '-') AS rl FROM sm GROUP BY metric""")
def report_pivot(spark, d):
    return report.report_pivot(_stage_metrics(spark, d))


@query(f"""WITH {_SQL_STAGE}, m AS (SELECT DISTINCT metric FROM sm)
SELECT metric, row_number() OVER (ORDER BY metric <> 'CORE', metric = 'ChatCORE', metric)::INT AS rank FROM m""")
def metric_order(spark, d):
    from palinode.operators.ordered import dense_index
    from palinode.operators.ranking import metric_order as order

    first, last, _ = order(F.col("metric"))
    names = report.metric_names(_stage_metrics(spark, d)).withColumns({"first": first, "last": last})
    return dense_index(names, ["first", "last", "metric"], "rank").select("metric", (F.col("rank") + 1).cast("int").alias("rank"))


@query("""
SELECT '- ' || o_orderkey || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN printf('%.4f', o_totalprice)
  WHEN o_custkey * 100 >= 10000 THEN format('{:,}', o_custkey * 100) ELSE (o_custkey * 100)::VARCHAR END AS line FROM orders""")
def section_lines(spark, d):
    even = F.pmod("o_orderkey", F.lit(2)) == 0
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), even.alias("even"),
                                            F.when(even, F.col("o_totalprice")).otherwise(F.col("o_custkey") * 100.0).alias("v"))
    return report.section_lines(rows, "k", F.col("v"), ~F.col("even"))


@query("""
WITH l AS (SELECT c_mktsegment AS label, unnest(['acct', 'key']) AS metric, unnest([c_acctbal, c_custkey::DOUBLE]) AS score FROM customer)
SELECT metric, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max, count(score)::BIGINT AS n FROM l GROUP BY metric""")
def probe_scorecard(spark, d):
    wide = table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("acct"), F.col("c_custkey").cast("double").alias("key"))
    return report.scorecard_summary(report.scorecard(wide, "label", ["acct", "key"])).withColumn("mean", F.round("mean", 6))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN printf('%.2f', o_totalprice) END AS core, o_orderpriority AS tail FROM orders""")
def section_value(spark, d):
    from palinode.functions.text import section_value as value

    head = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("- CORE: 1\n- CORE metric: "), F.format_string("%.2f", "o_totalprice"), F.lit(": x"))).otherwise("nothing")
    rows = table(spark, d, "orders").withColumn("s", F.concat(head, F.lit("\n- prio: "), "o_orderpriority"))
    return rows.select("o_orderkey", value(F.col("s"), "CORE").alias("core"), value(F.col("s"), "prio").alias("tail"))


@query("""SELECT o_orderkey, epoch_us(o_orderdate)::BIGINT AS started,
  CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE ((o_orderkey * 7) // 3600) || 'h' || ((o_orderkey * 7) % 3600 // 60) || 'm' END AS wall FROM orders""")
def wall_clock(spark, d):
    from palinode.functions.text import ts_after, wall_clock as clock

    start = F.concat(F.lit("# head\nRun started: nope\nRun started: "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("\n"))
    rows = table(spark, d, "orders").withColumn("a", ts_after(start, "Run started:"))
    end = F.timestamp_micros(F.unix_micros("a") + F.col("o_orderkey") * 7_000_000)
    stamp = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("timestamp: broken")).otherwise(F.concat(F.lit("timestamp: "), F.date_format(end, "yyyy-MM-dd HH:mm:ss")))
    return rows.select("o_orderkey", F.unix_micros("a").alias("started"), clock(F.col("a"), ts_after(stamp, "timestamp:")).alias("wall"))
