"""License scan: a positional index of rare licence words, relative positions, mandatory key phrases.

Templates are word sequences. Their words are counted over all documents; the highest-IDF words of each template and
the words of its key phrase make up a positional index (word -> template, position). A document's index words are
looked up, postings are intersected by relative position (document position minus template position is the same for
words of one occurrence), and an occurrence counts if its whole key phrase stands there and the matched words
carry enough of the template's IDF weight. A phrase is a template that is its own key phrase: every place
where its words stand consecutively is found.

Everything is DataFrame functions: one pass counts the template words, one pass keeps each document's index words and
positions (rarely any), and only those are joined with the index, whose size is that of the templates.

Defined results: null and empty texts have no words, no places, empty label strings and score 0; overlapping
places all count; rows that repeat an id are scanned one by one; long texts are scanned whole; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.llm.scratch import stored

# between words; a word is digits, letters a-z and all characters beyond ASCII
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str


# Opening or naming sentences of public licences and the words that must stand in them.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "the mit license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("apache", "you may not use this file except in compliance with the license", "in compliance with the license"),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as "
                    "published by the free software foundation", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                    "hereby granted", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)


def words_of(text: Column) -> Column:
    # other capitals become small too: that moves no word border, and no template word is met by it
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _idf(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, float]:
    """ln((documents + 1) / (documents with the word + 1)) of every vocabulary word."""
    found = docs.select(F.explode_outer(F.array_append(
        F.array_intersect(words_of(F.col("text")), _strings(vocabulary)), F.lit(""))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}  # the vocabulary at most
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def scan_licenses(df: DataFrame, phrases: Mapping[str, str], key: str = "doc_id", text: str = "text",
                  notices: Sequence[Template] = NOTICES, rare: int = 6, coverage: float = 0.6) -> DataFrame:
    """One row per row of the table: key, n_words, n_base, first_word, last_word, base_labels (of `phrases`: phrase
    to label), labels (of phrases and notices), score (largest share of a template's index weight found, 1 for a
    phrase) and hits (label, start word, share of every accepted occurrence)."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    templates = [(label, phrase.split(), phrase.split(), True) for phrase, label in phrases.items()]
    templates += [(t.label, t.text.split(), t.key.split(), False) for t in notices]
    idf = _idf(docs, sorted({w for _, words, _, _ in templates for w in words}))

    index = []
    for t, (label, words, must, base) in enumerate(templates):
        at = _find(words, must)
        needed = set(range(at, at + len(must)))
        rarest = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:rare]
        places = sorted(needed | ({*rarest} if not base else set()))
        total = sum(idf[words[p]] for p in places) or 1.0
        index += [(words[p], t, p, p in needed, idf[words[p]] / total, len(must), label, base) for p in places]
    spark = df.sparkSession
    postings = spark.createDataFrame(index, "word string, template int, place int, needed boolean, weight double, "
                                            "n_needed int, label string, base boolean")  # as large as the templates
    anchors = sorted({r[0] for r in index})

    split = docs.select("key", words_of(F.col("text")).alias("words"))
    spotted = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))),
                       lambda x: x["word"].isin(anchors))
    rows = stored(split.select(
        F.monotonically_increasing_id().alias("row"), "key", F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", _strings(anchors)), spotted).alias("spots")), "license-words")

    hits = rows.select("row", F.explode("spots").alias("s")).select("row", F.col("s.pos").alias("pos"), F.col("s.word").alias("word"))
    votes = hits.join(F.broadcast(postings), "word").groupBy(
        "row", "template", "label", "base", "n_needed", (F.col("pos") - F.col("place")).alias("start")).agg(
        F.sum(F.col("needed").cast("int")).alias("n_found"), F.sum("weight").alias("share"))
    accepted = votes.where((F.col("n_found") == F.col("n_needed")) & (F.col("base") | (F.col("share") >= coverage)))
    share = F.when(F.col("base"), 1.0).otherwise(F.least(F.lit(1.0), F.round("share", 9)))
    found = accepted.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max(share).alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "label", share.alias("share")))).alias("hits"))
    return rows.drop("spots").join(found, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word",
        "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "hits")
