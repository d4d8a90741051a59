"""Byte-pair vocabularies trained on and applied to the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from palinode.functions.sequences import ids_text
from palinode.functions.tokens import pretokens
from palinode.operators import bpe
from palinode.plans.registry import byte_list, query
from palinode.plans.workflows import chat_rows, corpus_rows
from palinode.session import spread, table
from palinode.sources.corpus import read_corpus

N_MERGES = 256


def vocabulary(spark, d, n_merges: int = N_MERGES) -> bpe.Vocabulary:
    """Vocabulary trained on the documents table."""
    counts = bpe.pretoken_counts(table(spark, d, "documents", "doc_id"))
    return bpe.train_bpe(counts, 256 + n_merges + 9)


# The split of the core library without look-ahead: a white-space run before other text gives up its last character, so
# texts are cut in front of that first.
_SPLIT = (r"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+")
_PIECES = (r"flatten(list_transform(string_split(regexp_replace(text, '(\s)([^\S\r\n]\S)', '\1' || chr(1) || '\2', 'g'), chr(1)), "
           rf"lambda x: regexp_extract_all(x, '{_SPLIT}')))")
# A symbol is one character, its id behind a base without surrogates; merging a pair is `replace`, which goes left to
# right without overlap, and the characters that it takes away tell how often it fires.
_BASE = 19968
_SQL_TRAIN = f"""
pieces AS (SELECT doc_id, lang, text, {_PIECES} AS ps FROM documents),
counted AS (SELECT p, count(*)::BIGINT AS f FROM (SELECT unnest(ps) AS p FROM pieces) GROUP BY p),
step(rank, pair, p, f, s) AS (
  SELECT 0, ''::VARCHAR, p, f, array_to_string(list_transform({byte_list('p')}, lambda i: chr({_BASE} + i)), '') FROM counted
  UNION ALL
  SELECT rank + 1, best.pair, p, f, replace(s, best.pair, chr({_BASE} + 256 + rank)) FROM step, (
    SELECT pair FROM (
      SELECT unnest(list_distinct(list_transform(range(1, length(s)), lambda i: s[i:i + 1]))) AS pair, s, f FROM step)
    GROUP BY pair ORDER BY sum(f * ((length(s) - length(replace(s, pair, ''))) // 2)) DESC, pair LIMIT 1) AS best
  WHERE rank < {N_MERGES}),
coded AS (SELECT p, f, s FROM step WHERE rank = {N_MERGES})"""


@query(f"""WITH RECURSIVE {_SQL_TRAIN}
SELECT DISTINCT (rank - 1)::INT AS rank, (unicode(pair[1]) - {_BASE})::INT AS "left", (unicode(pair[2]) - {_BASE})::INT AS "right",
  (255 + rank)::INT AS new_id FROM step WHERE rank > 0""")
def train_bpe(spark, d):
    return vocabulary(spark, d).merge_table(spark)


@query(f"""SELECT p AS pretoken, count(*)::BIGINT AS freq FROM (SELECT unnest({_PIECES}) AS p FROM documents) GROUP BY p""")
def split_pretoken_counts(spark, d):
    return bpe.pretoken_counts(table(spark, d, "documents", "doc_id"))


@query("""SELECT doc_id, md5(text) AS digest FROM documents""")
def pretoken_round_trip(spark, d):
    """The split loses nothing: its pieces join back to the text."""
    return table(spark, d, "documents", "doc_id").select("doc_id", F.md5(F.array_join(pretokens(F.col("text")), "")).alias("digest"))


@query("""SELECT doc_id, md5(text) AS digest FROM documents""")
def encode_decode_round_trip(spark, d):
    vocab = vocabulary(spark, d)
    ids = bpe.encode(table(spark, d, "documents", "doc_id").select("doc_id", "text"), vocab).select("doc_id", "ids")
    return bpe.decode(ids, vocab).select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH RECURSIVE {_SQL_TRAIN},
placed AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pieces),
texts AS (
  SELECT doc_id, sum(length(s)) AS n, string_agg(array_to_string(list_transform(range(1, length(s) + 1), lambda i: unicode(s[i]) - {_BASE}), ','),
    ',' ORDER BY i) AS ids FROM placed JOIN coded USING (p) GROUP BY doc_id)
SELECT doc_id, (1 + coalesce(n, 0))::INT AS n, md5('{256 + N_MERGES}' || coalesce(',' || ids, '')) AS digest
FROM documents LEFT JOIN texts USING (doc_id)""")
def encode_bpe(spark, d):
    ids = bpe.encode(table(spark, d, "documents", "doc_id").select("doc_id", "text"), vocabulary(spark, d), prepend="<|bos|>")
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(ids_text(F.col("ids"))).alias("digest"))


@query(f"""WITH RECURSIVE {_SQL_TRAIN},
tokens AS (SELECT lang, sum(length(s)) AS tokens FROM (SELECT lang, unnest(ps) AS p FROM pieces) JOIN coded USING (p) GROUP BY lang),
sizes AS (SELECT lang, sum(strlen(text)) AS bytes FROM documents GROUP BY lang)
SELECT lang, bytes::BIGINT AS bytes, tokens::BIGINT AS tokens, bytes / tokens AS ratio FROM sizes JOIN tokens USING (lang)""")
def bpe_compression(spark, d):
    ids = bpe.encode(table(spark, d, "documents", "doc_id").select("lang", "text"), vocabulary(spark, d))
    return bpe.compression(ids, ["lang"])


@query("""SELECT sum(strlen(text))::BIGINT AS bytes FROM documents""")
def bpe_counts_bytes(spark, d):
    """Bytes of the corpus from encoded distinct pre-tokens: every token counts its length."""
    vocab = vocabulary(spark, d)
    counts = bpe.encode_counts(bpe.pretoken_counts(table(spark, d, "documents", "doc_id")), vocab)
    toks = counts.select("freq", F.explode("ids").alias("tok")).groupBy("tok").agg(F.sum("freq").alias("n"))
    sizes = bpe.token_bytes(vocab.table(spark)).select(F.col("token_id").alias("tok"), "n_bytes")
    return toks.join(sizes, "tok").agg(F.sum(F.col("n") * F.col("n_bytes")).alias("bytes"))


@query()
def token_bytes_table(spark, d):
    vocab = vocabulary(spark, d).table(spark)
    both = bpe.token_bytes(vocab, "true").withColumnRenamed("n_bytes", "n_true").join(
        bpe.token_bytes(vocab, "reference").select("token_id", F.col("n_bytes").alias("n_reference")), "token_id")
    return both.select("token_id", "is_special", "n_true", "n_reference")


@query()
def corpus_training_rows(spark, d):
    docs = spread(read_corpus(spark, f"{d}/documents.parquet", ["text"], position=True), "row_index")
    rows = corpus_rows(docs, vocabulary(spark, d), 512, 4, reverse=True, group=64, buffer=100, refill=16)
    return rows.select("stream_id", "row_id", F.md5(ids_text(F.col("inputs"))).alias("inputs"), F.md5(ids_text(F.col("targets"))).alias("targets"))


@query()
def chat_training_rows(spark, d):
    rows = chat_rows(table(spark, d, "conversations", "conv_id"), vocabulary(spark, d), 2048, 2, buffer=20)
    return rows.select("stream_id", "row_id", F.md5(ids_text(F.col("inputs"))).alias("inputs"), F.md5(ids_text(F.col("targets"))).alias("targets"))
