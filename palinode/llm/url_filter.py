"""URL verdicts: host and path rules, then a weighted vocabulary found by Aho-Corasick.

Strict terms reject alone, soft terms when several distinct ones occur. A term counts only with boundaries: the
characters next to it are no ASCII letters or digits. All terms are found in one pass over each URL by
an automaton built once per worker. An explicit rule that fits overrides the vocabulary.

Defined results: a null URL and one without `://` have an empty host and path, fit no rule and are judged by their
text alone (null: allow); an empty URL is allowed; the longest fitting rule wins and equal ones are the same rule;
repeated rows are judged alike; an empty table gives an empty result; other columns pass through, and one named
like an output gets `_in` appended to its name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palinode.llm.names import set_aside

# (verdict, host, path), e.g. ("allow", "example.net", "/en/") is the rule `example.net/en/`
Rule = tuple[str, str, str]
OUTPUTS = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")

STRICT_TERMS = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = ("ads", "bet", "bets", "bonus", "cheap", "click", "crack", "dating", "free", "gamble", "jackpot", "loan",
              "lottery", "nude", "pills", "poker", "popup", "sex", "slots", "track", "win", "winner")


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's host or a parent and whose path leads its path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        inside = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = inside & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


@functools.lru_cache(8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term.lower(), (term.lower(), weight))
    found.make_automaton()
    return found


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def term_hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms that stand in the URL between boundaries, sorted."""
    low, hits = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url), set()
    for end, (term, weight) in _automaton(strict, soft).iter(low):
        start = end - len(term) + 1
        if (not start or low[start - 1] not in _WORD) and (end + 1 == len(low) or low[end + 1] not in _WORD):
            hits.add((weight, term))
    return sorted(t for w, t in hits if w == "strict"), sorted(t for w, t in hits if w == "soft")


def judge_urls(df: DataFrame, rules: Sequence[Rule] = (), url: str = "url", strict: Sequence[str] = STRICT_TERMS,
               soft: Sequence[str] = SOFT_TERMS, max_soft: int = 1) -> DataFrame:
    """The table with host, path, rule, verdict (allow or block), strict_hits and soft_hits (lists of terms)."""
    df, url = set_aside(df, OUTPUTS, url)
    strict, soft = tuple(strict), tuple(soft)
    names = df.columns
    terms = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_hits(u or "", strict, soft) for u in batch.column(url).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], terms), pa.array([f[1] for f in found], terms)],
                [*names, "strict_hits", "soft_hits"])

    lists = T.ArrayType(T.StringType())
    schema = T.StructType([*df.schema.fields, T.StructField("strict_hits", lists), T.StructField("soft_hits", lists)])
    hits = df.mapInArrow(run, schema)
    split = hits.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.size("strict_hits") > 0) | (F.size("soft_hits") > max_soft), "block").otherwise("allow")
    return split.select(*[F.col(f"`{n}`") for n in names], "host", "path", rule.alias("rule"),
                        F.coalesce(ruled, own).alias("verdict"), "strict_hits", "soft_hits")
