"""Run curves, schedules, scaling fits. A user's events are a run: step by event, value as loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from palinode.functions import math as M
from palinode.functions.seeded import seed_uniform
from palinode.operators import fits, mixture, selection, series
from palinode.operators.ordered import dense_index, ema
from palinode.plans.registry import query, uniform
from palinode.session import table


STEPS = 65_536  # steps number the rows of a run: fixed-width buckets need no quantiles


def _curve(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("user_id").alias("run"), "event_type", "value")
    return dense_index(ev, ["event_id"], "step", ["run"])


_SQL_CURVE = """
cv AS (SELECT event_id, user_id AS run, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)"""


@query(f"""WITH RECURSIVE {_SQL_CURVE},
s AS (SELECT run, step, 0.1 * value AS s FROM cv WHERE step = 0
      UNION ALL SELECT cv.run, cv.step, 0.9 * s.s + 0.1 * cv.value FROM s JOIN cv ON cv.run = s.run AND cv.step = s.step + 1)
SELECT run, step, round(s / (1 - pow(0.9::DOUBLE, step + 1)), 7) AS ema FROM s""")
def ema_debiased(spark, d):
    return ema(_curve(spark, d), ["run"], ["step"], "value", width=STEPS).select("run", "step", F.round("ema", 7).alias("ema"))


@query(f"WITH {_SQL_CURVE} SELECT run, step, round(lag(value) OVER (PARTITION BY run ORDER BY step) - value, 6) AS \"drop\" FROM cv")
def curve_deltas(spark, d):
    return series.deltas(_curve(spark, d), ["run"], ["step"], "value", width=STEPS).select("run", "step", F.round("drop", 6).alias("drop"))


@query(f"""WITH {_SQL_CURVE}, b AS (SELECT run, step, value, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM cv)
SELECT run, step, best_before, coalesce(value < best_before, true) AS new_best FROM b""")
def running_min(spark, d):
    return series.running_best(_curve(spark, d), ["run"], ["step"], "value", width=STEPS).select("run", "step", "best_before", "new_best")


@query(f"WITH {_SQL_CURVE} SELECT run, arg_max(value, step) AS value, arg_max(event_type, step) AS event_type FROM cv GROUP BY run")
def last_per_key(spark, d):
    return series.last_per_key(_curve(spark, d), ["run"], "step", ["value", "event_type"])


@query(f"""WITH {_SQL_CURVE}, t AS (SELECT run, step, sum(CASE WHEN step > 10 THEN value ELSE 0 END) OVER (PARTITION BY run ORDER BY step) AS train_time,
  max(step) OVER (PARTITION BY run) AS total FROM cv)
SELECT run, step, round(train_time, 6) AS train_time, CASE WHEN step > 10 THEN round((total - step) * train_time / (step - 10), 9) END AS eta FROM t""")
def eta(spark, d):
    cv = _curve(spark, d)
    total = cv.groupBy("run").agg(F.max("step").alias("total"))
    out = series.eta(cv.join(total, "run"), ["run"], "step", "value", F.col("total"), width=STEPS)
    return out.select("run", "step", F.round("train_time", 6).alias("train_time"), F.round("eta", 9).alias("eta"))


@query(f"""WITH {_SQL_CURVE} SELECT run, step, round((value - min(value) OVER (PARTITION BY run)) / (max(value) OVER (PARTITION BY run) - min(value) OVER (PARTITION BY run)), 9) AS scaled FROM cv""")
def minmax(spark, d):
    return series.minmax(_curve(spark, d), ["run"], "value").select("run", "step", F.round("scaled", 9).alias("scaled"))


@query(f"WITH {_SQL_CURVE} SELECT run, min(value) AS min_val, arg_min(step, {{'v': value, 's': step}}) AS min_step FROM cv GROUP BY run")
def min_val(spark, d):
    return series.min_val(_curve(spark, d), ["run"], "step", "value")


@query(f"""WITH {_SQL_CURVE}, a AS (SELECT run, coalesce(sum(CASE WHEN step > 10 THEN value END), 0) AS t, count(*) * 1000 / sum(value) AS r FROM cv GROUP BY run)
SELECT run, round(t, 6) AS train_time, round(r, 6) AS tok_per_sec FROM a""")
def run_time(spark, d):
    out = series.run_time(_curve(spark, d).withColumn("batch", F.lit(1000)), ["run"], "step", "value", "batch")
    return out.select("run", F.round("train_time", 6).alias("train_time"), F.round("tok_per_sec", 6).alias("tok_per_sec"))


@query(f"""WITH {_SQL_CURVE} SELECT event_type, min(value) AS rate_min, max(value) AS rate_max, round(quantile_cont(value, 0.5), 6) AS rate_median
FROM cv WHERE step > 20 GROUP BY event_type""")
def throughput_summary(spark, d):
    return series.throughput(_curve(spark, d), ["event_type"], "step", "value").withColumn("rate_median", F.round("rate_median", 6))


@query(f"""WITH {_SQL_CURVE} SELECT run, step, round(100.0::DOUBLE * step / 100, 6) AS pct_done, floor(524288 / value)::BIGINT AS tok_per_sec,
  round(100.0 * (6e6 * 524288 / value) / 1e12, 6) AS mfu FROM cv""")
def throughput_cols(spark, d):
    cols = M.throughput_cols(F.col("step"), F.lit(100), F.col("value"), F.lit(524288), F.lit(6e6), F.lit(1e12))
    return _curve(spark, d).select("run", "step", F.round(cols["pct_done"], 6).alias("pct_done"), cols["tok_per_sec"].alias("tok_per_sec"),
                                   F.round(cols["mfu"], 6).alias("mfu"))


@query(f"""WITH {_SQL_CURVE} SELECT (step // 10)::BIGINT AS step_group, event_type, round(avg(value), 9) AS mean FROM cv GROUP BY ALL""")
def meters(spark, d):
    cv = _curve(spark, d).withColumn("step_group", F.expr("step div 10"))
    return series.meters(cv, ["step_group"], "event_type", "value").withColumn("mean", F.round("mean", 9))


@query("""SELECT user_id AS run, sum((event_type <> 'error')::INT)::BIGINT AS n_ok, sum((event_type = 'error')::INT)::BIGINT AS n_failed FROM events GROUP BY 1""")
def job_counts(spark, d):
    return series.job_counts(table(spark, d, "events").select(F.col("user_id").alias("run"), "event_type"), ["run"], F.col("event_type") != "error")


@query(f"""WITH {_SQL_CURVE} SELECT run, step, CASE WHEN step >= 60 THEN 2048 WHEN step >= 25 THEN 1024 ELSE 512 END AS seq_len FROM cv""")
def schedule_asof(spark, d):
    schedule = series.parse_schedule("512:0,1024:0.25,2048:0.60", 100, 4096)
    return series.schedule_asof(_curve(spark, d), schedule).select("run", "step", "seq_len")


@query(f"""WITH {_SQL_CURVE}, p AS (SELECT run, step, least(1.0::DOUBLE, step / 60.0::DOUBLE) AS p FROM cv)
SELECT run, step, round(0.35 * (0.15 + 0.85 * 0.5 * (1 + cos(pi() * p))), 9) AS reverse_weight,
  CASE WHEN p <= 0.2 THEN 0.0::DOUBLE ELSE round(0.08 * (p - 0.2) / 0.8, 9) END AS mtp_weight, 0.1::DOUBLE AS bridge_weight FROM p""")
def objective_weights(spark, d):
    step = F.col("step")
    return _curve(spark, d).select(
        "run", "step", F.round(M.objective_weight(0.35, step, 60, "reverse_anneal"), 9).alias("reverse_weight"),
        F.round(M.objective_weight(0.08, step, 60, "mtp_ramp"), 9).alias("mtp_weight"),
        M.objective_weight(0.1, step, 60, "constant").alias("bridge_weight"))


@query("""WITH g AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem), dn AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)
SELECT g.l_suppkey, g.l_linenumber FROM g ANTI JOIN dn USING (l_suppkey, l_linenumber)""")
def pending_grid(spark, d):
    line = table(spark, d, "lineitem")
    done = line.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45))
    return selection.pending(line.select("l_suppkey", "l_linenumber").distinct(), done, ["l_suppkey", "l_linenumber"])


# ---- scaling runs: a run per (line number as budget, supplier as size) -------------------------------

def _runs(spark, d):
    line = table(spark, d, "lineitem")
    r = line.groupBy(F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("depth")).agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    size = F.pow(F.lit(10.0), 7 + F.col("k") * 0.2 + F.pmod("depth", F.lit(40)) * 0.03)
    x = F.pmod("depth", F.lit(40)) * 0.03 - 0.6
    return r.select(
        F.pow(F.lit(10.0), 17.0 + F.col("k") * 0.3).alias("flops_budget"), "depth", F.floor(size).cast("long").alias("params_transformer"),
        F.floor(size / 10).cast("long").alias("params_lm_head"), F.floor(size * 1.5).cast("long").alias("params_total"),
        F.floor(F.pow(F.lit(10.0), 8.5 + F.col("k") * 0.15 - F.pmod("depth", F.lit(40)) * 0.01)).cast("long").alias("tokens_trained"),
        F.when(F.pmod(F.col("q"), F.lit(11)) == 0, F.lit(None)).otherwise(0.9 - 0.02 * F.col("k") + 0.05 * x * x + F.col("q") * 1e-6).alias("val_bpb"))


_SQL_RUNS = """
rn AS (SELECT l_linenumber AS k, l_suppkey AS depth, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
rz AS (SELECT *, pow(10.0::DOUBLE, 7 + k * 0.2::DOUBLE + (depth % 40) * 0.03::DOUBLE) AS size, (depth % 40) * 0.03::DOUBLE - 0.6::DOUBLE AS x FROM rn),
ru AS (SELECT pow(10.0::DOUBLE, 17.0 + k * 0.3::DOUBLE) AS flops_budget, depth, floor(size)::BIGINT AS params_transformer, floor(size / 10)::BIGINT AS params_lm_head,
  floor(size * 1.5)::BIGINT AS params_total, floor(pow(10.0::DOUBLE, 8.5 + k * 0.15::DOUBLE - (depth % 40) * 0.01::DOUBLE))::BIGINT AS tokens_trained,
  CASE WHEN q % 11 = 0 THEN NULL ELSE 0.9::DOUBLE - 0.02::DOUBLE * k + 0.05::DOUBLE * x * x + q * 1e-6 END AS val_bpb FROM rz),
cr AS (SELECT *, params_transformer + params_lm_head AS effective_params FROM ru WHERE val_bpb > 0)"""


def _clean(spark, d):
    return selection.clean_runs(_runs(spark, d)).withColumn("effective_params", M.effective_params("no_embedding"))


@query(f"WITH {_SQL_RUNS} SELECT round(log10(flops_budget), 6) AS log_budget, count(*)::BIGINT AS n FROM cr GROUP BY 1")
def clean_runs(spark, d):
    return _clean(spark, d).groupBy(F.round(F.log10("flops_budget"), 6).alias("log_budget")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SQL_RUNS} SELECT round(log10(flops_budget), 6) AS log_budget, depth, params_total AS p_all, effective_params AS p_no_embedding, params_transformer AS p_transformer,
  round(tokens_trained / effective_params, 6) AS ratio FROM cr""")
def param_conventions(spark, d):
    return _clean(spark, d).select(
        F.round(F.log10("flops_budget"), 6).alias("log_budget"), "depth", M.effective_params("all").alias("p_all"), M.effective_params("no_embedding").alias("p_no_embedding"),
        M.effective_params("transformer").alias("p_transformer"), F.round(F.col("tokens_trained") / F.col("effective_params"), 6).alias("ratio"))


@query(f"WITH {_SQL_RUNS} SELECT round(log10(flops_budget), 6) AS log_budget, arg_min(depth, {{'v': val_bpb, 'd': depth}}) AS depth, round(min(val_bpb), 9) AS val_bpb FROM cr GROUP BY 1")
def best_per_group(spark, d):
    best = fits.best_by(_clean(spark, d), ["flops_budget"], "val_bpb", ["depth", "val_bpb"], "depth")
    return best.select(F.round(F.log10("flops_budget"), 6).alias("log_budget"), "depth", F.round("val_bpb", 9).alias("val_bpb"))


_SQL_ISO = f"""{_SQL_RUNS},
pt AS (SELECT flops_budget AS b, log10(effective_params) AS lx, val_bpb AS y, tokens_trained::DOUBLE AS tok, tokens_trained / effective_params AS ratio FROM cr),
ce AS (SELECT *, avg(lx) OVER (PARTITION BY b) AS mx, lx - avg(lx) OVER (PARTITION BY b) AS x FROM pt),
mo AS (SELECT b, mx, count(*)::DOUBLE AS n, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS sy, sum(x*y) AS sxy, sum(x*x*y) AS sxxy FROM ce GROUP BY ALL),
co AS (SELECT *, (sxxy*s2*n - s3*sxy*n - s2*s2*sy) / (n*s4*s2 - n*s3*s3 - s2*s2*s2) AS a, (s4*sxy*n - sxxy*s3*n + s2*(s3*sy - sxy*s2)) / (n*s4*s2 - n*s3*s3 - s2*s2*s2) AS bb FROM mo),
op AS (SELECT b, -bb / (2*a) + mx AS lo, (sy - s2*a) / n - bb*bb / (4*a) AS bpb FROM co),
br AS (SELECT op.b, lo, bpb, arg_max({{'x': lx, 't': tok, 'r': ratio}}, lx) FILTER (lx <= lo) AS l, arg_min({{'x': lx, 't': tok, 'r': ratio}}, lx) FILTER (lx >= lo) AS h FROM op JOIN pt USING (b) GROUP BY ALL),
iso AS (SELECT b AS flops_budget, pow(10, lo) AS opt_params, bpb AS opt_bpb,
  CASE WHEN h.x > l.x THEN l.t + (lo - l.x) / (h.x - l.x) * (h.t - l.t) ELSE l.t END AS opt_tokens,
  CASE WHEN h.x > l.x THEN l.r + (lo - l.x) / (h.x - l.x) * (h.r - l.r) ELSE l.r END AS opt_ratio FROM br)"""


@query(f"WITH {_SQL_ISO} SELECT round(log10(flops_budget), 6) AS log_budget, round(log10(opt_params), 6) AS log_params, round(opt_bpb, 6) AS opt_bpb, round(log10(opt_tokens), 5) AS log_tokens, round(opt_ratio, 4) AS opt_ratio FROM iso")
def isoflop_optimum(spark, d):
    iso = fits.isoflop_optimum(_clean(spark, d))
    return iso.select(F.round(F.log10("flops_budget"), 6).alias("log_budget"), F.round(F.log10("opt_params"), 6).alias("log_params"), F.round("opt_bpb", 6).alias("opt_bpb"),
                      F.round(F.log10("opt_tokens"), 5).alias("log_tokens"), F.round("opt_ratio", 4).alias("opt_ratio"))


@query(f"""WITH {_SQL_ISO}, f AS (SELECT regr_slope(log10(opt_params), log10(flops_budget)) AS sn, regr_intercept(log10(opt_params), log10(flops_budget)) AS i_n,
  regr_slope(log10(opt_tokens), log10(flops_budget)) AS sd, regr_intercept(log10(opt_tokens), log10(flops_budget)) AS i_d, sqrt(min(flops_budget) * max(flops_budget)) AS ref,
  avg(opt_ratio) AS mean_ratio, stddev_samp(opt_ratio) AS std_ratio FROM iso)
SELECT round(sn, 5) AS slope_n, round(sd, 5) AS slope_d, round(sd - sn, 5) AS exponent_gap, round(log10(ref), 6) AS log_ref, round(pow(10, i_d + sd * log10(ref) - i_n - sn * log10(ref)), 4) AS ratio_at_ref,
  round(mean_ratio, 4) AS mean_ratio, round(std_ratio, 4) AS std_ratio FROM f""")
def power_law(spark, d):
    s = fits.scaling_summary(fits.isoflop_optimum(_clean(spark, d)))
    return s.select(F.round("slope_n", 5).alias("slope_n"), F.round("slope_d", 5).alias("slope_d"), F.round("exponent_gap", 5).alias("exponent_gap"),
                    F.round(F.log10("ref_budget"), 6).alias("log_ref"), F.round("ratio_at_ref", 4).alias("ratio_at_ref"),
                    F.round("mean_ratio", 4).alias("mean_ratio"), F.round("std_ratio", 4).alias("std_ratio"))


@query(f"""WITH {_SQL_RUNS}, p AS (SELECT l_linenumber::DOUBLE AS key, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL), q AS (SELECT DISTINCT key, 3.3 + key * 9.1 AS q_at FROM p),
b AS (SELECT key, q_at, arg_max({{'x': x, 'y': y}}, x) FILTER (x <= q_at) AS l, arg_min({{'x': x, 'y': y}}, x) FILTER (x >= q_at) AS h FROM p JOIN q USING (key) GROUP BY ALL)
SELECT key, round(CASE WHEN l IS NULL THEN h.y WHEN h IS NULL THEN l.y WHEN h.x > l.x THEN l.y + (q_at - l.x) / (h.x - l.x) * (h.y - l.y) ELSE l.y END, 4) AS y FROM b""")
def interp_at(spark, d):
    pts = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("key"), F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    asks = pts.select("key", (F.col("key") * 9.1 + 3.3).alias("at")).distinct()
    return fits.interp_at(pts, asks, ["key"], "x", "at", ["y"]).select("key", F.round("y", 4).alias("y"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def ols_fit(spark, d):
    fit = fits.ols(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), ["l_returnflag"])
    return fit.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 8).alias("r2"), "n")


@query("""WITH l AS (SELECT l_extendedprice AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)
SELECT feature, round(regr_r2(y, v), 8) AS r2, count(*)::BIGINT AS n FROM l GROUP BY feature""")
def rank_predictors(spark, d):
    ranked = fits.rank_predictors(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return ranked.select("feature", F.round("r2", 8).alias("r2"), "n")


@query()
def ridge(spark, d):
    return fits.ridge(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [0.0, 0.001, 0.01, 0.1, 1.0])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity * 2 + l_discount * 100 + l_tax) / 3.0::DOUBLE, 6) AS estimate FROM lineitem""")
def ensemble(spark, d):
    est = table(spark, d, "lineitem").withColumns({"a": F.col("l_quantity") * 2, "b": F.col("l_discount") * 100, "c": F.col("l_tax")})
    return fits.ensemble(est, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("estimate", 6).alias("estimate"))


@query("""WITH m AS (SELECT c_nationkey AS size, avg(c_acctbal) AS v FROM customer GROUP BY 1), e AS (SELECT s_nationkey AS size, avg(s_acctbal) AS v FROM supplier GROUP BY 1)
SELECT size, round(m.v, 6) AS base, round(e.v, 6) AS other, round(e.v - m.v, 6) AS diff, round(100.0 * (e.v - m.v) / m.v, 6) AS improvement_pct FROM m JOIN e USING (size)""")
def head_to_head(spark, d):
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("size")).agg(F.avg("c_acctbal").alias("v"))
    e = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("size")).agg(F.avg("s_acctbal").alias("v"))
    out = fits.head_to_head(m, e, "size", "v")
    return out.select("size", *[F.round(c, 6).alias(c) for c in ("base", "other", "diff", "improvement_pct")])


@query("""SELECT 'measured' AS source, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'estimated', count(*)::BIGINT, round(sum(s_acctbal), 2) FROM supplier""")
def union_tagged(spark, d):
    both = mixture.union_tagged({"measured": table(spark, d, "customer").select(F.col("c_acctbal").alias("v")),
                                 "estimated": table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"))})
    return both.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("""SELECT l_linenumber, round(avg(l_discount), 9) AS mean, round(max(l_discount) - min(l_discount), 9) AS spread, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def run_spread(spark, d):
    out = fits.run_spread(table(spark, d, "lineitem"), ["l_linenumber"], "l_discount")
    return out.select("l_linenumber", F.round("mean", 9).alias("mean"), F.round("spread", 9).alias("spread"), "n")


@query("""SELECT p_partkey, p_size FROM part WHERE (p_partkey % 3 = 0) = (p_size % 4 = 0)""")
def comparable_tasks(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.pmod("p_partkey", F.lit(3)).alias("ka"), F.pmod("p_size", F.lit(4)).alias("kb"))
    return selection.comparable_tasks(p, "ka", "kb").select("p_partkey", "p_size")


@query("""SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
  round(2 * (1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / len(a.embedding), 8) AS nmse
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_align(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return e.join(nxt, "vec_id").select("vec_id", F.round(M.cosine_distance(a, b), 6).alias("distance"), F.round(M.nmse(a, b), 8).alias("nmse"))


@query(f"""SELECT o_orderkey, round((o_totalprice - {uniform('ours', 'o_orderkey')} * 1000) / o_totalprice * 100, 6) AS pct FROM orders""")
def rel_diff(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(M.rel_diff(F.col("o_totalprice"), seed_uniform("ours", "o_orderkey") * 1000), 6).alias("pct"))
