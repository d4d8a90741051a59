"""Split pattern, training, encoding and decoding against independent implementations."""

import random
import time

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from palinode.functions.tokens import BYTE_SPECIALS, SPLIT_PATTERN, byte_ids, bytes_text, pretokens, special_id
from palinode.operators import bpe
from palinode.operators.bpe_training import MergeTable
from palinode.plans.workflows import train_tokenizer

TRICKY = ["a  ! b", "x  y", "t\u0085\u0085u", "I'll say 12345 it's 'RE", "  lead\n\n tail  \r\n", "日本語 テスト 🙂🙂 ok", "", "tab\t\tend "]


def _train_model(counts, n_merges, min_freq=1):
    """Merge by merge, recounting everything."""
    words = {tuple(w.encode()): f for w, f in counts.items()}
    merges = []

    def fires(w, pair):
        n, i = 0, 0
        while i < len(w) - 1:
            if (w[i], w[i + 1]) == pair:
                n, i = n + 1, i + 2
            else:
                i += 1
        return n

    while len(merges) < n_merges:
        totals = {}
        for w, f in words.items():
            for pair in set(zip(w, w[1:])):
                totals[pair] = totals.get(pair, 0) + f * fires(w, pair)
        totals = {p: n for p, n in totals.items() if n >= min_freq}
        if not totals:
            break
        pair = min(totals, key=lambda p: (-totals[p], p))
        new = 256 + len(merges)
        merges.append(pair)
        out = {}
        for w, f in words.items():
            r, i = [], 0
            while i < len(w):
                if i < len(w) - 1 and (w[i], w[i + 1]) == pair:
                    r.append(new)
                    i += 2
                else:
                    r.append(w[i])
                    i += 1
            out[tuple(r)] = out.get(tuple(r), 0) + f
        words = out
    return merges


def test_split_matches_regex_module(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "i int, text string")
    got = {r.i: list(r.p) for r in df.select("i", pretokens(F.col("text")).alias("p")).collect()}
    for i, t in enumerate(TRICKY):
        assert got[i] == regex.findall(SPLIT_PATTERN, t), t


def test_byte_round_trip_and_broken_utf8(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "text string")
    assert all(r.text == r.back for r in df.select("text", bytes_text(byte_ids(F.col("text"))).alias("back")).collect())
    bad = spark.createDataFrame([([0xE6, 0x97, 65, 300],)], "ids array<int>").select(bytes_text(F.col("ids")).alias("t")).first().t
    assert bad == bytes([0xE6, 0x97, 65]).decode("utf-8", "replace")
    assert special_id("<|bos|>") == BYTE_SPECIALS["<|bos|>"] == 256 and special_id("<|bos|>", {"<|endoftext|>": 7}) == 7


@pytest.mark.parametrize("seed", range(5))
def test_training_equals_one_merge_at_a_time(spark, seed):
    rng = random.Random(seed)
    alphabet = "ab" if seed == 0 else "abcdeé "
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12)))
        counts[w] = counts.get(w, 0) + rng.choice([1, 1, 2, 5, 40])
    df = spark.createDataFrame(list(counts.items()), "pretoken string, freq long")
    want = _train_model(counts, 40, 2)
    assert bpe.train_bpe(df, 256 + 9 + 40, min_freq=2).merges == want
    # many short epochs: few hot pairs, and segments of few symbols
    assert bpe.train_bpe(df, 256 + 9 + 40, min_freq=2, hot_pairs=6, most_symbols=40).merges == want


def test_merge_table_counts_by_deltas():
    """After every merge the counts kept by deltas are those of a recount."""
    rng = np.random.default_rng(7)
    for alphabet in (1, 2, 4):
        words = [rng.integers(0, alphabet, rng.integers(1, 14)) for _ in range(60)]
        weights = rng.integers(1, 9, 60)
        table = MergeTable(np.concatenate(words), np.array([len(w) for w in words]), weights)
        counts = table.counts()
        for step in range(25):
            live = {c: n for c, n in counts.items() if n > 0}
            if not live:
                break
            code = min(live, key=lambda c: (-live[c], c))
            delta, again = table.merge(code, 256 + step)
            counts.pop(code)
            for c, change in delta.items():
                counts[c] = counts.get(c, 0) + change
            counts.update({c: table.count(c) for c in again})
            values, sizes = table.sequences()
            fresh = MergeTable(values, sizes, weights).counts()
            assert {c: n for c, n in counts.items() if n} == fresh


def test_long_pieces_are_encoded_in_one_pass(trained):
    vocab, _ = trained
    encoder, rng = bpe.PieceEncoder(vocab.ranks()), random.Random(3)
    enc = _tiktoken(vocab)
    for piece in ("".join(rng.choice("enratio") for _ in range(3000)), "e" * 999):
        assert encoder(piece.encode()) == enc.encode_ordinary(piece)
    began = time.time()
    assert len(encoder(("enratio" * 15_000).encode())) > 1000
    assert time.time() - began < 10


def _tiktoken(vocab):
    return tiktoken.Encoding("t", pat_str=SPLIT_PATTERN, mergeable_ranks=vocab.ranks(), special_tokens=vocab.special_ids)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return train_tokenizer(docs, 256 + 9 + 60), docs


def test_encode_matches_tiktoken_on_documents(spark, trained):
    vocab, docs = trained
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    rows = bpe.encode(docs.select("doc_id", "text").union(extra), vocab).collect()
    enc = _tiktoken(vocab)
    for r in rows:
        assert list(r.ids) == enc.encode_ordinary(r.text)
    ids = spark.createDataFrame([(list(r.ids),) for r in rows], "ids array<int>")
    assert {r.text for r in bpe.decode(ids, vocab).collect()} == {r.text for r in rows}


def test_encode_options_specials_and_nulls(spark, trained):
    vocab, _ = trained
    df = spark.createDataFrame([("<|bos|> hi",), (None,)], "text string")
    rows = bpe.encode(df, vocab, prepend="<|bos|>", append="<|assistant_end|>").collect()
    bos, end = vocab.special_ids["<|bos|>"], vocab.special_ids["<|assistant_end|>"]
    assert rows[0].ids[0] == bos and rows[0].ids[-1] == end and bos not in rows[0].ids[1:]
    assert list(rows[1].ids) == [bos, end]


def test_vocabulary_layouts_and_files(spark, trained, tmp_path):
    vocab, _ = trained
    assert min(vocab.special_ids.values()) == len(vocab.symbols) and len(vocab) == 256 + 9 + 60
    bpe.save_vocab(vocab, spark, str(tmp_path / "v"))
    assert bpe.load_vocab(spark, str(tmp_path / "v")) == vocab
    lab = bpe.Vocabulary(vocab.merges, ("<pad>", "<eos>"), specials_first=True)
    assert lab.special_ids == {"<pad>": 0, "<eos>": 1} and lab.ranks()[b"a"] == 97 + 2
    bpe.save_vocab(lab, spark, str(tmp_path / "l"))
    assert bpe.load_vocab(spark, str(tmp_path / "l")).special_ids == lab.special_ids


def test_token_bytes_modes(spark, trained):
    vocab, _ = trained
    table = vocab.table(spark)
    true = {r.token_id: r.n_bytes for r in bpe.token_bytes(table).collect()}
    ref = {r.token_id: r.n_bytes for r in bpe.token_bytes(table, "reference").collect()}
    for i, b in enumerate(vocab.symbols):
        assert true[i] == len(b) and ref[i] == len(b.decode("utf-8", "replace").encode())
    assert true[vocab.special_ids["<|bos|>"]] == 0 == ref[vocab.special_ids["<|bos|>"]]


def test_vocab_size_must_hold_bytes(spark):
    with pytest.raises(ValueError):
        bpe.train_bpe(spark.createDataFrame([("a", 1)], "pretoken string, freq long"), 100)


def test_counts_and_compression_agree_with_encoding(spark, trained):
    vocab, docs = trained
    by_doc = bpe.compression(bpe.encode(docs, vocab), []).first()
    counts = bpe.encode_counts(bpe.pretoken_counts(docs), vocab)
    assert counts.agg(F.sum(F.col("freq") * F.size("ids"))).first()[0] == by_doc.tokens
