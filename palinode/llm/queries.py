"""Registered queries of the operators, one `opN_<name>` each over its whole table, and their SQL counterparts."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.llm.byte_bpe import encode
from palinode.llm.decontaminate import contaminated
from palinode.llm.language_id import identify, train
from palinode.llm.license_scan import scan_licenses
from palinode.llm.merkle import fold, leaf_digest, merkle_manifest, proof_digest
from palinode.llm.minhash import minhash_components
from palinode.llm.ngram_join import jaccard_components
from palinode.llm.quality import judge
from palinode.llm.secret_scan import find_secrets, spans_text
from palinode.llm.sharding import shuffle_shards
from palinode.llm.token_store import id_checksums, read_tokens, write_tokens
from palinode.llm.url_filter import SOFT_TERMS, STRICT_TERMS, judge_urls
from palinode.llm.whitening import whiten
from palinode.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LICENSE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), LICENSE_PHRASES).drop("hits")


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=5, num=3, den=4).drop("class_id")


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(spans_text(F.col("found"), ["assign", "access", "hex"]).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.col("found")).alias("spans"))


def _held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").where(~_held_out()))
    judged = identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


@_query
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-store")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1,
                 added_tokens=True)
    return id_checksums(read_tokens(spark, path))


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/"))


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("strict_hits").alias("n_strict"),
                         F.size("soft_hits").alias("n_soft"))


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle_shards(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@_query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                  outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


ORACLES["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT links.y, reach.c FROM reach JOIN links ON reach.doc_id = links.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def _count_terms(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


ORACLES["op8_url_filter"] = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
p AS (
  SELECT *, regexp_extract(low, '(?s)^.*?://([^/?#]*)', 1) AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    {_count_terms(STRICT_TERMS)} AS n_strict, {_count_terms(SOFT_TERMS)} AS n_soft FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN n_strict > 0 OR n_soft > 1 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM r
"""

ORACLES["op3_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[i:i + 4], ' ') AS g FROM t WHERE len(w) >= 5),
twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT g.doc_id, unnest(range(g.i, g.i + 5)) AS p FROM g JOIN twice ON g.doc_id = twice.doc_id AND g.g = twice.g)
  GROUP BY doc_id),
f AS (
  SELECT t.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR 3 * len(regexp_extract_all(text, '[!-@\[-`{-~]')) > 2 * word_chars
    OR 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars
    OR 5 * len(regexp_extract_all(text, '!!')) > n_words) AS kept
FROM b
"""


@_query
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = minhash_components(_table(spark, sf_dir, "documents"), n=2, num=4, den=5)
    return linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    # null where nothing is tampered with
    docs = docs.withColumn("changed", F.when(tampered, leaf_digest(*others, lowered)))
    made = merkle_manifest(docs, leaf_digest(*others, F.col("text")), carry=["changed"])
    folded = fold(F.coalesce("carried.changed", "leaf"), F.col("path"))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@_query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


ORACLES["op11_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2
      THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- the rarest fifth and one more of a set must hold a shingle of any set that is similar enough
rare AS (SELECT g, count(*) AS c FROM s GROUP BY g),
p AS (
  SELECT doc_id, g FROM (
    SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY rare.c, s.g) AS r
    FROM s JOIN rare ON rare.g = s.g JOIN n ON n.doc_id = s.doc_id)
  WHERE r <= n - (4 * n + 4) // 5 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE 5 * na.n >= 4 * nb.n AND 5 * nb.n >= 4 * na.n),
shared AS (
  SELECT x, y, count(*) AS c FROM pairs JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY x, y),
links AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT b.y, reach.c FROM reach JOIN both_ways b ON reach.doc_id = b.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

# the tree of the groups and that of the leaves alike: runs of 8, level by level
ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, len(t) + 1),
      lambda i: [ascii(t[i])::UBIGINT + 4294967296, 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, b: CASE WHEN ((CASE WHEN b > 0 THEN xor(crc, b - 4294967296) ELSE crc END) & 1) = 1
      THEN xor((CASE WHEN b > 0 THEN xor(crc, b - 4294967296) ELSE crc END) >> 1, 3988292384::UBIGINT)
      ELSE (CASE WHEN b > 0 THEN xor(crc, b - 4294967296) ELSE crc END) >> 1 END) AS crc
  FROM (SELECT doc_id, doc_id::VARCHAR AS t FROM documents)),
d AS (
  SELECT documents.*, xor(crc, 4294967295::UBIGINT) % 3 = 0 AS tampered,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents JOIN bits USING (doc_id)),
f AS (
  SELECT doc_id, lang, tampered, concat(strlen(doc_id::VARCHAR), ':', doc_id,
      coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(low) || ':' || low, '-') AS changed FROM d),
leaves AS (
  SELECT doc_id, sha256(head || body) AS leaf, CASE WHEN tampered THEN sha256(head || changed) ELSE sha256(head || body) END AS start,
    dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM f),
nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM nodes
  WHERE n > 1 GROUP BY tree, level, idx // 8),
tops AS (SELECT tree, max(level) AS height, max_by(h, level) AS subroot FROM nodes GROUP BY tree),
upper AS (
  SELECT 0 AS level, tree AS idx, subroot AS h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM upper
  WHERE n > 1 GROUP BY level, idx // 8),
top AS (SELECT max(level) AS height, max_by(h, level) AS root FROM upper),
steps AS (
  SELECT tree, level, idx, n, false AS above, h FROM nodes
  UNION ALL SELECT NULL, level, idx, n, true, h FROM upper),
runs AS (
  SELECT a.tree, a.above, a.level, a.idx,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM steps a JOIN steps b ON a.above = b.above AND a.level = b.level AND a.idx // 8 = b.idx // 8
    AND a.tree IS NOT DISTINCT FROM b.tree WHERE a.n > 1 GROUP BY a.tree, a.above, a.level, a.idx),
walk AS (
  SELECT doc_id, tree, false AS above, 0 AS level, idx, start AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.tree, w.above OR w.level = tops.height, CASE WHEN NOT w.above AND w.level = tops.height THEN 0 ELSE w.level + 1 END,
    CASE WHEN NOT w.above AND w.level = tops.height THEN w.tree ELSE w.idx // 8 END,
    CASE WHEN NOT w.above AND w.level = tops.height THEN w.h ELSE sha256(runs.l || w.h || runs.r) END,
    CASE WHEN NOT w.above AND w.level = tops.height THEN w.proof ELSE w.proof || runs.l || runs.r END
  FROM walk w JOIN tops ON tops.tree = w.tree CROSS JOIN top
    LEFT JOIN runs ON runs.above = w.above AND runs.level = w.level AND runs.idx = w.idx
      AND (w.above OR runs.tree = w.tree)
  WHERE NOT w.above OR w.level < top.height)
SELECT leaves.doc_id, leaf, subroot, root, sha256(walk.proof) AS proof_sha256, walk.h AS folded_root, walk.h = root AS verified
FROM walk JOIN leaves ON leaves.doc_id = walk.doc_id JOIN tops ON tops.tree = leaves.tree, top
WHERE walk.above AND walk.level = top.height
"""
