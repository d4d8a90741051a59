"""Fits from sums: lines, parabolas, power laws, ridge. Rows are reduced to moments on the cluster;
only the moments of a fit (a p x p system for ridge) reach the driver or one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str], tie: str | None = None) -> DataFrame:
    """The row with the smallest value per key."""
    rank = F.struct(value, tie) if tie else F.col(value)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), rank).alias("__b")).select(*keys, "__b.*")


def ols(df: DataFrame, x: Column, y: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slope, intercept, r2, n)."""
    named = df.select(*keys, x.alias("__x"), y.alias("__y"))
    return named.groupBy(*keys).agg(
        F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"),
        F.regr_r2("__y", "__x").alias("r2"), F.count("*").alias("n"))


def power_law(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """y ~ 10^intercept * x^exponent from a line through the logs."""
    fit = ols(df, F.log10(x), F.log10(y), keys)
    return fit.select(*keys, F.col("slope").alias("exponent"), F.col("intercept"), "r2")


def isoflop_optimum(runs: DataFrame, budget: str = "flops_budget", params: str = "effective_params",
                    loss: str = "val_bpb", tokens: str = "tokens_trained") -> DataFrame:
    """(budget, opt_params, opt_bpb, opt_tokens, opt_ratio, fitted) per budget.

    Parabola of the loss over log10(params), centred per budget before powers are summed; its vertex
    if it opens upward, the best run otherwise. Tokens and ratio are interpolated at the vertex.
    """
    pts = runs.select(
        budget, F.log10(params).alias("lx"), F.col(loss).alias("y"), F.col(tokens).cast("double").alias("tok"),
        F.col(params).cast("double").alias("par"), (F.col(tokens) / F.col(params)).alias("ratio"))
    mean = pts.groupBy(budget).agg(F.avg("lx").alias("mx"))
    c = pts.join(mean, budget).withColumn("x", F.col("lx") - F.col("mx"))

    def total(e: Column, name: str) -> Column:
        return F.sum(e).alias(name)

    x, y = F.col("x"), F.col("y")
    m = c.groupBy(budget, "mx").agg(
        F.count("*").cast("double").alias("n"), total(x * x, "s2"), total(x * x * x, "s3"), total(x * x * x * x, "s4"),
        total(y, "sy"), total(x * y, "sxy"), total(x * x * y, "sxxy"),
        F.min_by(F.struct("par", "tok", "ratio", "y"), F.struct("y", "lx")).alias("best"))
    n, s2, s3, s4 = (F.col(v) for v in ("n", "s2", "s3", "s4"))
    sy, sxy, sxxy = (F.col(v) for v in ("sy", "sxy", "sxxy"))
    det = n * s4 * s2 - n * s3 * s3 - s2 * s2 * s2
    a = (sxxy * s2 * n - s3 * sxy * n - s2 * s2 * sy) / F.when(det != 0, det)
    b = (s4 * sxy * n - sxxy * s3 * n + s2 * (s3 * sy - sxy * s2)) / F.when(det != 0, det)
    coef = m.withColumns({"a": a, "b": b}).withColumn("c", (sy - s2 * F.col("a")) / n)
    fit = coef.select(
        budget, "mx", "best", F.coalesce(F.col("a") > 0, F.lit(False)).alias("fitted"),
        (-F.col("b") / (2 * F.col("a"))).alias("v"), "a", "b", "c").withColumn(
        "opt_log", F.when(F.col("fitted"), F.col("v") + F.col("mx")).otherwise(F.log10("best.par"))).withColumn(
        "opt_bpb", F.when(F.col("fitted"), F.col("a") * F.col("v") * F.col("v") + F.col("b") * F.col("v")
                          + F.col("c")).otherwise(F.col("best.y")))
    at = interp_at(pts, fit.select(budget, "opt_log"), [budget], "lx", "opt_log", ["tok", "ratio"])
    return fit.join(at.drop("opt_log"), budget).select(
        budget, F.pow(F.lit(10.0), "opt_log").alias("opt_params"), "opt_bpb",
        F.when(F.col("fitted"), F.col("tok")).otherwise(F.col("best.tok")).alias("opt_tokens"),
        F.when(F.col("fitted"), F.col("ratio")).otherwise(F.col("best.ratio")).alias("opt_ratio"), "fitted")


def interp_at(points: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, at: str,
              values: Sequence[str]) -> DataFrame:
    """Linear interpolation of `values` over `x` at one `at` per key, clamped at the ends. The bracket is
    the largest x below and the smallest x above, two aggregates per key."""
    j = points.join(queries, list(keys))
    packed = F.struct(F.col(x).alias("x"), *[F.col(v) for v in values])
    below, above = F.col(x) <= F.col(at), F.col(x) >= F.col(at)
    br = j.groupBy(*keys, at).agg(
        F.max_by(F.when(below, packed), F.when(below, F.col(x))).alias("lo"),
        F.min_by(F.when(above, packed), F.when(above, F.col(x))).alias("hi"))
    span = F.col("hi.x") - F.col("lo.x")
    frac = F.when(span > 0, (F.col(at) - F.col("lo.x")) / span).otherwise(0.0)
    return br.select(*keys, at, *[
        F.when(F.col("lo").isNull(), F.col(f"hi.{v}")).when(F.col("hi").isNull(), F.col(f"lo.{v}"))
        .otherwise(F.col(f"lo.{v}") + frac * (F.col(f"hi.{v}") - F.col(f"lo.{v}"))).alias(v) for v in values])


def scaling_summary(optima: DataFrame, budget: str = "flops_budget") -> DataFrame:
    """Exponents of N ~ C^a and D ~ C^b, their gap, the ratio the fits predict at the geometric mean of
    the smallest and largest budget, and mean and sample deviation of the ratios."""
    lc = F.log10(budget)
    s = optima.agg(
        F.regr_slope(F.log10("opt_params"), lc).alias("slope_n"), F.regr_intercept(F.log10("opt_params"), lc).alias("i_n"),
        F.regr_slope(F.log10("opt_tokens"), lc).alias("slope_d"), F.regr_intercept(F.log10("opt_tokens"), lc).alias("i_d"),
        F.sqrt(F.min(budget) * F.max(budget)).alias("ref_budget"),
        F.avg("opt_ratio").alias("mean_ratio"), F.stddev_samp("opt_ratio").alias("std_ratio"))
    ref = F.log10("ref_budget")
    return s.select(
        "slope_n", "slope_d", (F.col("slope_d") - F.col("slope_n")).alias("exponent_gap"), "ref_budget",
        F.pow(F.lit(10.0), F.col("i_d") + F.col("slope_d") * ref - F.col("i_n") - F.col("slope_n") * ref)
        .alias("ratio_at_ref"), "mean_ratio", "std_ratio")


def rank_predictors(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One line per feature, best R2 first."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    long = df.select(F.col(target).alias("__y"), F.expr(f"stack({len(features)}, {pairs}) as (feature, value)"))
    return ols(long, F.col("value"), F.col("__y"), ["feature"]).orderBy(F.col("r2").desc(), "feature")


def ridge(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float]) -> DataFrame:
    """(alpha, intercept, weights, weight_norm, r2). Normal equations are summed on the cluster in one
    aggregate; the driver solves a (p+1) x (p+1) system per alpha. The intercept is not penalised."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    p = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(cols[i] * y).alias(f"y{i}") for i in range(p)]
    row = df.agg(*sums, F.sum(y * y).alias("yy"), F.count("*").alias("n")).first()
    xtx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    xty = np.array([row[f"y{i}"] for i in range(p)])
    ss_tot = row["yy"] - xty[0] ** 2 / row["n"]
    out = []
    for alpha in alphas:
        w = np.linalg.solve(xtx + float(alpha) * np.diag([0.0] + [1.0] * (p - 1)), xty)
        ss_res = row["yy"] - 2 * w @ xty + w @ xtx @ w
        out.append((float(alpha), float(w[0]), [float(v) for v in w[1:]], float(np.linalg.norm(w[1:])),
                    float(1 - ss_res / ss_tot)))
    return df.sparkSession.createDataFrame(
        out, "alpha double, intercept double, weights array<double>, weight_norm double, r2 double")


def predict(df: DataFrame, features: Sequence[str], weights: Sequence[float], intercept: float, out: str) -> DataFrame:
    return df.withColumn(out, reduce(lambda s, fw: s + F.col(fw[0]) * F.lit(float(fw[1])), zip(features, weights),
                                     F.lit(float(intercept))))


def ensemble(df: DataFrame, estimates: Sequence[str], out: str = "estimate") -> DataFrame:
    """Mean of several models' estimates."""
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(e) for e in estimates]) / float(len(estimates)))


def head_to_head(measured: DataFrame, estimated: DataFrame, bucket: str, value: str) -> DataFrame:
    """Pairs of the same size: difference and improvement in percent."""
    a = measured.select(bucket, F.col(value).alias("base"))
    b = estimated.select(bucket, F.col(value).alias("other"))
    return a.join(b, bucket).withColumns({
        "diff": F.col("other") - F.col("base"),
        "improvement_pct": 100.0 * (F.col("other") - F.col("base")) / F.col("base")})


def run_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and max - min over repeated runs."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("spread"),
                                 F.count("*").alias("n"))
