"""Metrics, fits and reports: fixtures and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palinode.functions import math as M
from palinode.functions import text as X
from palinode.functions.seeded import name_seed
from palinode.operators import fits, metrics, mixture, report, selection
from palinode.plans import experiments


def test_bits_per_byte_fixture(spark):
    df = spark.createDataFrame([(math.log(2), 1, 5), (math.log(2), 3, 6), (5.0, 0, 7), (9.0, 4, -1)], "loss double, n_bytes int, target int")
    assert metrics.bits_per_byte(df).first().bpb == pytest.approx(0.5)
    assert metrics.bits_per_byte(df.where("n_bytes = 0")).first().bpb == float("inf")


def test_centered_and_core(spark):
    acc = spark.createDataFrame([("a", 0.625), ("b", 0.5)], "task string, accuracy double")
    base = spark.createDataFrame([("a", 25.0), ("b", 0.0)], "task string, random_baseline double")
    assert metrics.core_metric(acc, base).first().core == pytest.approx(0.5)
    assert metrics.chatcore(acc).first().chatcore is None
    full = spark.createDataFrame([(t, 0.625) for t in metrics.CHAT_BASELINES], "task string, accuracy double")
    row = metrics.chatcore(full).first()
    assert row.chatcore_cat == pytest.approx(0.5) and row.chatcore == pytest.approx((3 * 0.5 + 3 * 0.625) / 6)


def test_pass_at_k_advantage_and_perplexity_fixtures(spark):
    o = spark.createDataFrame([(p, s, p == 0 and s == 1) for p in range(2) for s in range(3)], "problem long, sample int, correct boolean")
    assert [r.pass_at_k for r in metrics.pass_at_k(o, 3).orderBy("k").collect()] == [0.0, 0.5, 0.5]
    r = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 0.0, 0.0, 1.0])], "prompt long, i int, reward double")
    assert [a.advantage for a in metrics.advantages(r).orderBy("i").collect()] == [0.5, -0.5, -0.5, 0.5]
    p = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 3.0)], "batch int, loss double")
    row = metrics.perplexity(p, "batch").first()
    assert row.loss == 2.0 and row.ppl == pytest.approx(math.exp(2))
    assert metrics.perplexity(p, "batch", token_weighted=True).first().loss == pytest.approx(5 / 3)


def test_option_scoring_window_ties_and_empty_span(spark):
    losses = [(0, 0, p, x) for p, x in enumerate([9.0, 9.0, 1.0, 3.0])] + [(0, 1, p, x) for p, x in enumerate([9.0, 9.0, 2.0, 2.0, 2.0])] + [
        (1, o, p, 1.0) for o in range(2) for p in range(4)]
    scored = spark.createDataFrame([("t", *r) for r in losses], "task string, idx int, opt int, pos int, loss double")
    spans = spark.createDataFrame([("t", 0, 0, 3, 5, 1), ("t", 0, 1, 3, 6, 1), ("t", 1, 0, 2, 2, 1), ("t", 1, 1, 2, 4, 1)],
                                  "task string, idx int, opt int, span_start int, span_end int, gold int")
    got = {r.idx: (r.pred_opt, r.correct) for r in metrics.mc_correct(scored, spans).collect()}
    assert got == {0: (0, False), 1: (1, True)}  # a tie goes to the first option; an empty span never wins


def test_lm_match_needs_every_token(spark):
    toks = [("t", 0, p, t, q) for p, (t, q) in enumerate(zip([7, 1, 2, 3], [1, 2, 3, 0]))] + [("t", 1, p, t, q) for p, (t, q) in enumerate(zip([7, 1, 2, 3], [1, 2, 9, 0]))]
    scored = spark.createDataFrame(toks, "task string, idx int, pos int, tok int, pred int")
    spans = spark.createDataFrame([("t", 0, 2, 4), ("t", 1, 2, 4)], "task string, idx int, span_start int, span_end int")
    assert {r.idx: r.correct for r in metrics.lm_correct(scored, spans).collect()} == {0: True, 1: False}


def test_categorical_ties_go_to_the_first_letter(spark):
    df = spark.createDataFrame([("t", 0, c, i, 1.0) for i, c in enumerate("ABC")], "task string, idx int, letter string, letter_pos int, logit double")
    assert metrics.categorical_predict(df).first().predicted == "A"


def test_ols_fixture_ridge_and_predictors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.9), (3.0, 6.2)], "x double, y double")
    r = fits.ols(df, F.col("x"), F.col("y")).first()
    assert r.slope == pytest.approx(2.1) and r.r2 == pytest.approx(0.996986, abs=1e-6)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=20) * 0.1
    data = spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y)], "a double, b double, c double, y double")
    for row in fits.ridge(data, ["a", "b", "c"], "y", [0.0, 0.1, 10.0]).collect():
        aug = np.column_stack([np.ones(20), x])
        w = np.linalg.solve(aug.T @ aug + row.alpha * np.diag([0, 1, 1, 1]), aug.T @ y)
        pred = aug @ w
        assert np.allclose([row.intercept, *row.weights], w) and row.r2 == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert fits.rank_predictors(data, ["a", "b", "c"], "y").first().feature == "b"


def test_isoflop_matches_polyfit_and_falls_back(spark):
    rows = []
    for budget, shift in ((1e18, 8.0), (1e19, 8.3)):
        for k in range(7):
            lx = shift - 0.6 + 0.2 * k + 0.01 * k * k
            rows.append((budget, 10 ** lx, 0.8 + 0.1 * (lx - shift) ** 2 + 0.003 * math.sin(k), 1e9 * (1 + k)))
    rows += [(1e20, 10.0 ** (8 + 0.1 * k), 1 - 0.01 * k * k, 5e9 + k) for k in range(5)]  # opens downward
    df = spark.createDataFrame(rows, "flops_budget double, effective_params double, val_bpb double, tokens_trained double")
    got = {r.flops_budget: r for r in fits.isoflop_optimum(df).collect()}
    for budget in (1e18, 1e19):
        sub = sorted([r for r in rows if r[0] == budget], key=lambda r: r[1])
        lx = np.log10([r[1] for r in sub])
        a, b, c = np.polyfit(lx, [r[2] for r in sub], 2)
        v = -b / (2 * a)
        assert math.log10(got[budget].opt_params) == pytest.approx(v, rel=1e-6)
        assert got[budget].opt_bpb == pytest.approx(a * v * v + b * v + c, rel=1e-6)
        assert got[budget].opt_tokens == pytest.approx(np.interp(v, lx, [r[3] for r in sub]), rel=1e-6)
    assert not got[1e20].fitted and got[1e20].opt_params == pytest.approx(10 ** 8.4) and got[1e20].opt_tokens == 5e9 + 4


def test_schedules_and_vectors(spark):
    r = spark.range(1).select(
        M.objective_weight(0.4, F.lit(0), 100, "reverse_anneal").alias("start"), M.objective_weight(0.4, F.lit(100), 100, "reverse_anneal").alias("end"),
        M.objective_weight(0.1, F.lit(20), 100, "mtp_ramp").alias("held"), M.objective_weight(0.1, F.lit(60), 100, "mtp_ramp").alias("half"),
        M.objective_weight(0.0, F.lit(60), 100, "constant").alias("off"),
        M.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("cos"),
        M.nmse(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("nmse")).first()
    assert r.start == pytest.approx(0.4) and r.end == pytest.approx(0.06) and r.held == 0 and r.half == pytest.approx(0.05) and r.off == 0
    assert r.cos == pytest.approx(1.0) and r.nmse == pytest.approx(1.0)


def test_names_sections_and_report(spark):
    assert spark.range(1).select(name_seed(F.lit("reverse_only")).alias("s")).first().s == 2173746818
    df = spark.createDataFrame([("base", "CORE", 0.25), ("sft", "MMLU", 0.5), ("sft", "ChatCORE", 0.1), ("rl", "GSM8K", 0.75)], "stage string, metric string, value double")
    rows = report.report_pivot(df).collect()
    assert [r.metric for r in rows] == ["CORE", "GSM8K", "MMLU", "ChatCORE"] and rows[0].base == "0.2500" and rows[0].sft == "-"
    nums = spark.createDataFrame([("a", 12345.0, True), ("b", 9999.0, True), ("c", 1.5, False)], "k string, v double, i boolean")
    assert [r.line for r in report.section_lines(nums, "k", F.col("v"), F.col("i")).collect()] == ["- a: 12,345", "- b: 9999", "- c: 1.5000"]
    listing = spark.createDataFrame([("x/d12/model_000010.pt", 5), ("x/d12/model_000200.pt", 6), ("x/d4/model_000001.pt", 9), ("x/d12/meta_000900.json", 9)], "path string, modificationTime long")
    assert report.largest_model(report.checkpoint_catalogue(listing)).first().asDict() == {"tag": "d12", "last_step": 200, "last_modified": 6, "depth": 12}


def test_tokenizer_comparison(spark):
    base = spark.createDataFrame([("a", 100, 50), ("b", 100, 10), ("c", 8, 4)], "name string, bytes long, tokens long")
    ours = spark.createDataFrame([("a", 100, 40), ("b", 100, 20), ("c", 8, 4)], "name string, bytes long, tokens long")
    got = {r.name: (round(r.relative_diff_pct, 6), r.better) for r in mixture.compare_tokenizers(base, ours).collect()}
    assert got == {"a": (20.0, "ours"), "b": (-100.0, "base"), "c": (0.0, "tie")}


def test_budget_and_slices(spark):
    df = spark.createDataFrame([(i, 4) for i in range(3)], "doc_id long, n_chars long")
    assert selection.char_budget(df, 7, "doc_id").count() == 2
    assert selection.resume_after(df.withColumn("f", F.lit("a")), F.col("f"), F.col("doc_id"), ("a", 0)).count() == 2


def test_experiment_catalogue_and_views(spark):
    table = experiments.experiments_table(spark)
    assert table.count() == 37 and table.where("use_direction_token").count() == 13
    assert len(experiments.specs("diagnostic")) == 15
    blocks = spark.createDataFrame([(0, [10, 11, 12, 13])], "block_id long, tokens array<int>")
    by = {s["name"]: s for s in experiments.specs()}

    def views(name, step=100):
        rows = experiments.experiment_views(blocks, by[name], F.lit(step), 100, 64).collect()
        return {r.objective: (list(r.inputs), list(r.labels), r.weight) for r in rows}

    assert views("reverse_only")["primary"][:2] == ([13, 12, 11], [12, 11, 10])
    fwd = views("direction_token_low")
    assert fwd["primary"][:2] == ([4, 10, 11, 12], [-100, 11, 12, 13]) and fwd["reverse"][:2] == ([5, 13, 12, 11], [-100, 12, 11, 10])
    assert fwd["reverse"][2] == pytest.approx(0.08 * 0.15)
    full = views("mirror_bridge_mtp2")
    assert full["bridge"][:2] == ([10, 12, 11, 13], [11, 12]) and full["mtp2"][:2] == ([10, 11], [12, 13])
    assert "mtp2" not in views("mirror_bridge_mtp2", step=10)
    assert views("direction_mix_p20")["mixed"][0][0] in (4, 5)


def test_log_fields():
    import re

    line = "step 00012/00100 (12.00%) | loss: 3.250000 | lrm: 1.00 | dt: 250.10ms | tok/sec: 1,234,567 | bf16_mfu: 40.10 | epoch: 2 pq: 3 rg: 4 | total time: 0.10m | eta: 1.0m"
    want = {"step": "00012", "loss": "3.250000", "lrm": "1.00", "dt_ms": "250.10", "tok_sec": "1,234,567", "mfu": "40.10", "epoch": "2", "pq": "3", "rg": "4"}
    assert {k: re.search(X.LOG_FIELDS[k], line).group(1) for k in want} == want
    assert re.search(X.LOG_FIELDS["num_scaling_params"], "Number of parameters: 1,000 (scaling: 800)").group(1) == "800"
    assert re.search(X.LOG_FIELDS["params_wte"], "wte                     : 25,165,824").group(1) == "25,165,824"
    assert re.search(X.LOG_FIELDS["val_bpb"], "Step 00010 | Validation bpb: 0.912345").group(1) == "0.912345"
