"""The packing stream: tokens are made once, state is touched once a micro-batch, each stream has a store of its own."""

import glob
import os
import random

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from palinode.functions.tokens import text_word_ids, word_ids, word_tokens
from palinode.operators import packing
from palinode.plans.catalogue import files
from palinode.streaming import streams


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def written(monkeypatch, tmp_path):
    """Scratch folders of the file queries, by name."""
    monkeypatch.setattr(files, "scratch_dir", lambda spark, name: f"{tmp_path}/{name}")
    return tmp_path


def test_words_of_whole_texts_are_those_of_the_pattern(spark):
    rng = random.Random(4)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [None, "", " \t", "a", "12345 1234a", "٣٤٥1½½½é", "\x0b\xa0."]
    texts += ["".join(rng.choice("ab1 2\t.\n,é½Ⅷ٣😀\u0301\x0b漢") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["".join(chr(rng.choice(points)) + rng.choice(["", " "]) for _ in range(300)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    broken = spark.sql("SELECT -1 AS k, cast(unhex('6162FF20C3') AS string) AS t")
    t, words = F.col("t"), word_ids(word_tokens(F.col("t")), 4096)
    rows = df.union(broken).select("t", words.alias("a"), text_word_ids(t, 4096).alias("b"), text_word_ids(t, 4096, size=50).alias("c")).collect()
    assert len(rows) == len(texts) + 1 and all(r.a == r.b == r.c for r in rows)
    assert rows[0].b is None and rows[1].b == []


def test_token_documents_are_made_once(spark, tmp_path):
    rows = [(i, "one two three" if i % 5 else None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = files._token_docs(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    packed = packing.pack_bestfit_crop(docs, 3, "doc_id", keep_tail=True)
    assert _plan(packed).count("ArrowEvalPython") == 1  # a filter on the ids had them made a second time
    assert packed.agg(F.sum("n_docs")).first()[0] == 32
    arriving = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/documents.parquet")
    assert "Filter" not in streams.pack_stream(files._token_docs(arriving), 3)._jdf.queryExecution().analyzed().toString()


def test_each_stream_has_a_state_store_of_its_own(spark, written):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert files.stream_pack(spark, SMALL).count() > 0
    stores = [s for s in glob.glob(f"{written}/spc/state/0/*") if os.path.basename(s).isdigit()]
    n = files._own_stores(spark, 4)
    assert len(stores) == n < 8 == int(before) and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.range(4).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))).distinct().count() == 4


class _State:
    """A state variable that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def put(self, value):
        self.calls += 1
        self.value = value

    update = put

    def clear(self):
        self.put(None)


def test_the_packing_state_is_read_and_written_once_a_batch():
    class Handle(dict):
        def getListState(self, name, *_):
            return self.setdefault(name, _State())

        getValueState = getMapState = getListState

    rng = random.Random(9)
    docs = [(i // 2 if i < 40 else i, np.full(min(n, 33), i // 2, np.int32), n) for i, n in enumerate(rng.choices(range(60), k=300))]
    frames = lambda some: (pd.DataFrame(some[i:i + 7], columns=["doc", "ids", "size"]) for i in range(0, len(some), 7))
    handle, got = Handle(), []
    for at in range(0, 300, 100):  # orders that come twice, documents without ids, frames in any order
        processor = streams._PackingProcessor(33, 20, 7, "long", chunk=5)
        processor.init(handle)
        some = docs[at:at + 100]
        rng.shuffle(some)
        for out in processor.handleInputRows((1,), frames(some), None):
            got += zip(out["row_id"], map(list, out["tokens"]), out["n_docs"])
    packer, want = packing._BestFit(33, 20, 7, None), []
    known = [d for d in docs if d[2]]
    for at in range(0, 300, 100):
        for doc, ids, size in sorted((d for d in docs[at:at + 100] if d[2]), key=lambda d: (d[0], d[2])):
            want += [(list(r[0]), r[2]) for r in packer.add((ids, np.ones(len(ids), np.int32), size))]
    assert len(known) < 300 and [(t, n) for _, t, n in got] == want and [r for r, *_ in got] == list(range(len(want)))
    assert all(s.calls <= 3 * 3 for s in handle.values())
