"""Numeric expressions: schedules, throughput, parameter conventions, vector distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def objective_weight(base: Column | float, step: Column, total: Column | int, kind: str,
                     floor: float = 0.15, start: float = 0.2) -> Column:
    """Weight of an auxiliary objective at a step: `reverse_anneal` falls along a cosine from base to
    base*floor, `mtp_ramp` is 0 until `start` and then rises linearly, anything else is constant."""
    base = F.lit(base) if isinstance(base, (int, float)) else base
    total = F.lit(total) if isinstance(total, int) else total
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / F.greatest(F.lit(1), total).cast("double")))
    if kind == "reverse_anneal":
        weight = base * (F.lit(floor) + (1.0 - floor) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * p)))
    elif kind == "mtp_ramp":
        ramp = F.least(F.lit(1.0), (p - start) / max(1e-8, 1.0 - start))
        weight = F.when(p <= start, F.lit(0.0)).otherwise(base * ramp)
    else:
        weight = base
    return F.when(base <= 0, F.lit(0.0)).otherwise(weight)


def throughput_cols(step: Column, num_steps: Column, dt_sec: Column, batch_tokens: Column,
                    flops_per_token: Column, peak_flops: Column) -> dict[str, Column]:
    """Rates of a step; a step that took no time has none (null)."""
    flops_sec = F.try_divide(flops_per_token * batch_tokens, dt_sec)
    return {
        "pct_done": 100.0 * step / num_steps,
        "tok_per_sec": F.floor(F.try_divide(batch_tokens, dt_sec)).cast("long"),
        "flops_per_sec": flops_sec,
        "mfu": 100.0 * flops_sec / peak_flops,
    }


def effective_params(kind: str = "no_embedding") -> Column:
    """Parameter count under a convention: all, no_embedding (matrices and head) or transformer."""
    return {
        "all": F.col("params_total"),
        "no_embedding": F.col("params_transformer") + F.col("params_lm_head"),
        "transformer": F.col("params_transformer"),
    }[kind]


def rel_diff(base: Column, ours: Column) -> Column:
    """Reduction against the base in percent."""
    return (base - ours) / base * 100.0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def _norm(a: Column) -> Column:
    return F.greatest(F.sqrt(_dot(a, a)), F.lit(1e-12))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - _dot(a, b) / (_norm(a) * _norm(b))


def nmse(pred: Column, target: Column) -> Column:
    """Mean squared difference of the two unit vectors."""
    na, nb = _norm(pred), _norm(target)
    total = _dot(pred, pred) / (na * na) + _dot(target, target) / (nb * nb) - 2.0 * _dot(pred, target) / (na * nb)
    return total / F.size(pred)


def report_number(value: Column, is_int: Column) -> Column:
    """Report text of a number: four decimals, or an integer with commas from 10,000 on."""
    whole = value.cast("long")
    int_text = F.when(whole >= 10_000, F.format_number(whole, 0)).otherwise(whole.cast("string"))
    return F.when(is_int, int_text).otherwise(F.replace(F.format_number(value, 4), F.lit(","), F.lit("")))
