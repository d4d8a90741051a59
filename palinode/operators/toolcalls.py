"""Tool calls: auditing recorded results, finding calls in token streams, cutting completions."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from palinode.functions.sequences import bind, ids_text

# What a calculator expression may contain.
ARITHMETIC = r"^[0-9*+\-/.() ]+$"
COUNT_CALL = r"""^(['"])([A-Za-z0-9 ._()]*)\1\.count\((['"])([A-Za-z0-9 ._()]*)\3\)$"""

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
        ast.FloorDiv: operator.floordiv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return node.value
    if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
        return _OPS[type(node.op)](_value(node.left), _value(node.right))
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
        return _OPS[type(node.op)](_value(node.operand))
    raise ValueError("not arithmetic")


def arithmetic(expr: str) -> float | None:
    """Value of an expression made of numbers, + - * / // and parentheses; anything else is None."""
    try:
        return float(_value(ast.parse(expr.strip(), mode="eval")))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


@F.pandas_udf(DoubleType())
def _arithmetic(exprs: pd.Series) -> pd.Series:
    known = {e: arithmetic(e) for e in exprs.dropna().unique()}
    return exprs.map(known).astype("float64")


def is_arithmetic(expr: Column) -> Column:
    return expr.rlike(ARITHMETIC) & ~F.contains(expr, F.lit("**"))


def count_value(expr: Column) -> Column:
    """Value of a `'text'.count('part')` call, or null: occurrences without overlap."""
    hay, needle = F.regexp_extract(expr, COUNT_CALL, 2), F.regexp_extract(expr, COUNT_CALL, 4)
    hits = F.when(F.length(needle) > 0, (F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)) \
        .otherwise(F.length(hay) + 1)
    return F.when(expr.rlike(COUNT_CALL), hits.cast("double"))


def audit_tool_calls(calls: DataFrame, expr: str = "expr", result: str = "result") -> DataFrame:
    """Adds kind (arithmetic, count, refused), the recomputed value, and whether the record agrees."""
    clean = F.replace(F.col(expr), F.lit(","), F.lit(""))
    kind = F.when(is_arithmetic(clean), "arithmetic").when(clean.rlike(COUNT_CALL), "count").otherwise("refused")
    typed = calls.withColumn("kind", kind)
    value = F.coalesce(_arithmetic(F.when(F.col("kind") == "arithmetic", clean)),
                       F.when(F.col("kind") == "count", count_value(clean)))
    stated = F.replace(F.col(result), F.lit(","), F.lit("")).try_cast("double")
    return typed.withColumn("value", value).withColumn(
        "agrees", F.coalesce(F.abs(F.col("value") - stated) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col("value"))),
                             F.lit(False)))


def tool_spans(ids: Column, start: int, end: int) -> Column:
    """ARRAY<STRING> of comma-joined ids between each start marker and the next end marker."""
    text = F.concat(F.lit(","), F.replace(ids_text(ids), F.lit(","), F.lit(",,")), F.lit(","))
    found = F.regexp_extract_all(text, F.lit(f",{start},((?:,(?!{start},)\\d+,)*?),{end},"), F.lit(1))
    return F.transform(found, lambda s: F.replace(F.trim(s, F.lit(",")), F.lit(",,"), F.lit(",")))


def sampled_mask(ids: Column, output_start: int, output_end: int) -> Column:
    """1 for tokens a model sampled, 0 for tool output forced into the stream, markers included."""
    opens = F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: F.get(ids, i) == output_start)
    spans = F.transform(opens, lambda s: F.struct(
        s.alias("s"), F.array_position(F.slice(ids, s + 1, F.size(ids) - s), output_end).alias("n")))
    return bind(spans, lambda found: F.transform(ids, lambda _, i: F.when(F.exists(found, lambda p: (i >= p["s"]) & (
        (p["n"] == 0) | (i < p["s"] + p["n"]))), 0).otherwise(1)))


def truncate_completion(ids: Column, prompt_len: Column, stops: tuple[int, ...]) -> Column:
    """The generated part: the prompt stripped, cut in front of the first stop token."""
    body = F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))
    at = F.array_position(F.transform(body, lambda t: t.isin(*stops)), True)
    return F.when(at > 0, F.slice(body, F.lit(1), (at - 1).cast("int"))).otherwise(body)
