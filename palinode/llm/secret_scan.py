"""Secret scan: named patterns, and a randomness test battery with false-discovery control for everything else.

Named kinds (assign, access, hex) are found by their patterns. Any other run of 20 or more key characters is a
candidate: its encoding (digits, hex in lower or upper case, base32, letters and digits, base64) is inferred from its
characters and its symbols are tested as draws from that alphabet: chi-squared uniformity, runs above and below the
middle, and lag-one serial correlation. A candidate must pass all three as random, and the opposite must be rejected:
that it is ordinary text which happens to use only that alphabet. Ordinary text is lower-case, upper-case or mixed words
with the letter frequencies of English, or mostly numbers, each narrowed to the alphabet; the likelihood ratio of uniform
symbols to the likeliest of them is x or more with a chance of exp(-x) at most if the string is such text. That p-value
goes through Benjamini-Hochberg over all candidates of like length in the corpus. Digits alone are never told from
numbers.

All steps are DataFrame functions. Positions come from the text's pieces between matches. The false-discovery step
aggregates counts per (length class, p-value bin), at most a few thousand rows.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive; a match of a named kind
that fails its length is dropped together with the text it took; spans of different kinds may overlap and all stay;
rows that repeat an id are scanned one by one; texts are scanned whole; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palinode.llm.scratch import stored

# Patterns of the named kinds, in the order in which spans at one place are listed.
ASSIGN = (r"[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
          r"|[aA][pP][iI]_?[kK][eE][yY]")
KINDS = {
    "assign": rf"""({ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "random": r"[A-Za-z0-9+/_-]{20,}",
}
ORDER = list(KINDS)
# a cheap test for a document to have any match of the kind
PROBES = {"assign": rf"""(?=[pPsStTaA])({ASSIGN})["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]", "hex": KINDS["hex"],
          "random": KINDS["random"]}

# Alphabets by inferred encoding; a symbol's value is its place.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
# letters of English a to z, in tenths of a per mille, and the shares of lower case, upper case, digits and signs in kinds of text
LETTERS = (820, 150, 280, 430, 1270, 220, 200, 610, 700, 15, 77, 400, 240, 670, 750, 190, 10, 600, 630, 910, 280, 98, 240, 15, 200, 7)
TEXTS = ((0.93, 0.02, 0.03, 0.02), (0.02, 0.93, 0.03, 0.02), (0.78, 0.16, 0.04, 0.02), (0.05, 0.05, 0.85, 0.05))
GATE = 3.3  # two-sided normal quantile of about 0.001


def _log_ratios(alphabet: str) -> list[list[float]]:
    """For every kind of text, ln(chance in uniform symbols / chance in the text) of each symbol of the alphabet."""
    one_case = alphabet in (alphabet.upper(), alphabet.lower())
    out = []
    for lower, upper, digits, signs in TEXTS:
        if one_case:
            lower = upper = lower + upper
        weights = [(lower if c.islower() else upper) * LETTERS[ord(c.lower()) - 97] / sum(LETTERS) if c.isalpha()
                   else digits / 10 if c.isdigit() else signs / 4 for c in alphabet]
        out.append([math.log(sum(weights) / len(alphabet) / w) for w in weights])
    return out


def _places(text: Column, kind: str) -> Column:
    """Array of (gap, value, part): characters between the last match and this one, the match, its second group."""
    pattern = F.lit(KINDS[kind])
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else values
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value"), parts.alias("part"))
    return F.when(F.regexp_like(text, F.lit(PROBES[kind])), zipped)


def _spans(rows: DataFrame, kind: str) -> DataFrame:
    """(row, kind, start, stop, value, part) of all matches of a kind."""
    each = rows.select("row", F.posexplode(kind).alias("k", "m"))
    before = W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    size = F.char_length("m.value")
    stop = F.sum(F.col("m.gap") + size).over(before)
    return each.select("row", F.lit(kind).alias("kind"), (stop - size).alias("start"), stop.alias("stop"),
                       F.col("m.value").alias("value"), F.col("m.part").alias("part"))


def with_battery(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds encoding, z_uniform, z_runs, z_serial (about standard normal for random strings) and neg_log_p, the bound
    on -ln p of the string being ordinary text."""
    v = F.col(value)
    encoding = (F.when(F.regexp_like(v, F.lit("^[0-9]+$")), "digits").when(F.regexp_like(v, F.lit("^[0-9a-f]+$")), "hex")
                .when(F.regexp_like(v, F.lit("^[0-9A-F]+$")), "hex_upper").when(F.regexp_like(v, F.lit("^[A-Z2-7]+$")), "base32")
                .when(F.regexp_like(v, F.lit("^[0-9A-Za-z]+$")), "alnum").otherwise("base64"))
    alphabet = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    rows = df.withColumn("encoding", encoding).withColumn("__alphabet", alphabet[F.col("encoding")]).withColumns({
        "__n": F.char_length(v).cast("double"), "__a": F.char_length("__alphabet").cast("double")})
    symbols = F.transform(F.split(v, "", -1), lambda c: F.instr(F.col("__alphabet"), c).cast("double") - 1)
    rows = rows.withColumn("__s", F.filter(symbols, lambda x: x >= 0))
    counts = F.transform(F.split("__alphabet", "", -1), lambda c: F.when(c == "", 0.0).otherwise(
        (F.col("__n") - F.char_length(F.replace(v, c, F.lit("")))).cast("double")))
    rows = rows.withColumn("__squares", F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)).withColumn(
        "__mean", F.aggregate("__s", F.lit(0.0), lambda s, x: s + x) / F.col("__n"))
    high = F.transform("__s", lambda x: x >= F.col("__a") / 2)
    rows = rows.withColumn("__h", high).withColumns({
        "__ups": F.size(F.filter("__h", lambda x: x)).cast("double"),
        "__turns": 1.0 + F.size(F.filter("__h", lambda x, i: (i > 0) & (x != F.get("__h", i - 1)))),
        "__var": F.aggregate("__s", F.lit(0.0), lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean"))),
        "__lag": F.aggregate(F.transform("__s", lambda x, i: F.coalesce(
            (x - F.col("__mean")) * (F.get("__s", i + 1) - F.col("__mean")), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)})
    n, a, up = F.col("__n"), F.col("__a"), F.col("__ups")
    down = n - up
    chi = a / n * F.col("__squares") - n
    runs_mean = 1 + 2 * up * down / n
    runs_var = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
    ratios = F.create_map(*[x for name, symbols in ALPHABETS.items() for x in (F.lit(name), F.array(*[
        F.array(*[F.lit(r) for r in kind]) for kind in _log_ratios(symbols)]))])[F.col("encoding")]
    likeliest = F.array_min(F.transform(ratios, lambda kind: F.aggregate(
        "__s", F.lit(0.0), lambda s, x: s + F.get(kind, x.cast("int")))))
    out = rows.withColumns({
        "z_uniform": (chi - (a - 1)) / F.sqrt(2 * (a - 1)),
        "z_runs": F.when(runs_var > 0, (F.col("__turns") - runs_mean) / F.sqrt(runs_var)).otherwise(99.0),
        "z_serial": F.when(F.col("__var") > 0, F.col("__lag") / F.col("__var") * F.sqrt(n)).otherwise(99.0),
        "neg_log_p": F.greatest(F.lit(0.0), likeliest)})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _discoveries(candidates: DataFrame, rate: float) -> DataFrame:
    """Candidates that Benjamini-Hochberg keeps at `rate`, within classes of like length (a doubling each)."""
    passed = (F.col("z_uniform") <= GATE) & (F.abs("z_runs") <= GATE) & (F.abs("z_serial") <= GATE)
    tested = candidates.withColumns({
        "__class": F.floor(F.log2(F.char_length("value") / 20.0)).cast("int"),
        # bins of a quarter on the scale of -ln p, rounded to the weaker side; all beyond 100 are alike
        "__bin": F.when(passed, F.least(F.lit(400), F.floor(F.col("neg_log_p") * 4))).otherwise(0).cast("int")})
    sizes = tested.groupBy("__class", "__bin").agg(F.count("*").alias("n"))
    down = W.partitionBy("__class").orderBy(F.desc("__bin")).rowsBetween(W.unboundedPreceding, 0)
    ranked = sizes.withColumns({"found": F.sum("n").over(down), "all": F.sum("n").over(W.partitionBy("__class"))})
    cut = ranked.where(F.exp(-F.col("__bin") / 4.0) * F.col("all") <= rate * F.col("found")).groupBy("__class").agg(
        F.min("__bin").alias("__cut"))  # one row per length class
    return tested.join(F.broadcast(cut), "__class").where(F.col("__bin") >= F.col("__cut")).drop("__class", "__bin", "__cut")


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per row of the table: key and `found`, an array of (start, rank, kind, stop, value) ordered by start, then
    kind; empty where there is nothing."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                            *[_places(body, kind).alias(kind) for kind in ORDER]), "secret-matches")
    long_enough = {"assign": F.char_length("part") >= 8, "access": F.char_length("value") >= 16, "hex": F.lit(True)}
    named = None
    for kind, enough in long_enough.items():
        spans = _spans(rows, kind).where(enough).drop("part")
        named = spans if named is None else named.union(spans)
    candidates = stored(with_battery(_spans(rows, "random").drop("part")), "secret-candidates")
    random = _discoveries(candidates, rate).select(*named.columns)
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind")).cast("int")
    listed = named.union(random).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", rank.alias("rank"), "kind", "stop", "value"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint,value:string>>")
    return rows.select("row", "key").join(listed, "row", "left").select(
        F.col("key").alias(key), F.coalesce("found", none).alias("found"))


def spans_text(found: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:stop of the spans (of some kinds), comma-joined."""
    kept = F.filter(found, lambda s: s["kind"].isin(kinds)) if kinds else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "<secret>", most: int = 500_000) -> DataFrame:
    """The table with every span of every kind in `text` replaced by `mark`; overlapping and touching spans become one
    mark, null texts stay null. What is cut depends on the text alone, so cuts are kept by its MD5, once for all its copies:
    rows with null or repeated ids are no special case, and no text moves while at most `most` texts have cuts (about
    64 MB are sent to every task then)."""
    digest = F.md5(F.col(text).cast("binary"))
    found = find_secrets(df.select(digest.alias("key"), F.col(text).alias("text")), "key", "text").where(F.size("found") > 0)
    found = found.groupBy(F.col("key").alias("__k")).agg(F.first("found").alias("__f"))
    spans = found.select("__k", F.explode("__f").alias("s")).select("__k", F.col("s.start").alias("a"), F.col("s.stop").alias("b"))
    earlier = W.partitionBy("__k").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(earlier), F.lit(True)).cast("int"))
    island = F.sum("new").over(W.partitionBy("__k").orderBy("a", "b").rowsBetween(W.unboundedPreceding, 0))
    merged = starts.withColumn("i", island).groupBy("__k", "i").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cuts = merged.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("__c"))
    cuts = stored(cuts, "secret-cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= most else cuts
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(text).alias("text"), digest.alias("__k"))
    joined = rows.join(cuts, "__k", "left")
    # the text before each cut, then what follows the last one
    heads = F.transform("__c", lambda c, i: F.substring(
        F.col("text"), F.coalesce(F.get("__c", i - 1)["b"], F.lit(0)).cast("int") + 1,
        (c["a"] - F.coalesce(F.get("__c", i - 1)["b"], F.lit(0))).cast("int")))
    tail = F.substring(F.col("text"), F.element_at("__c", -1)["b"].cast("int") + 1, F.char_length("text"))
    clean = F.when(F.col("__c").isNull(), F.col("text")).otherwise(F.array_join(F.array_append(heads, tail), mark))
    return joined.select(*[clean.alias(text) if c == text else F.col("doc")[c].alias(c) for c in df.columns])
