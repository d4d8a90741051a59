"""Language identification in two levels: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the lower-cased text (runs of other than letters count as one blank), as
shares of all trigrams of the text. A linear SVM per family (one against the rest) picks the family; inside it
every pair of languages has its own SVM and the language with most votes wins, summed margins breaking ties.
Families are given; a language of no given family is a family of its own.

Training reads a bounded sample: at most `per_language` labelled rows of each language (default 400), those with
the smallest hash of key and text. Their features are made by tasks and come to the driver, where the SVMs are
fitted; the weights, a fixed number of features times few classifiers, go to the tasks that predict.
Prediction is one pass over whole texts where they lie.

Defined results: null texts and texts without a letter are `und` with score 0, and without any training row all
are; rows whose label is null are not learned from; with one language, that is predicted for all other texts; a
score is the logistic of the deciding margin, the smaller of family and language; repeated rows are predicted
alike; an empty table gives an empty result; other columns pass
through, and one named like an output gets `_in` appended to its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palinode.llm.names import set_aside
from palinode.llm.segments import slices, text_bytes

FEATURES = 4096
UNKNOWN = "und"
OUTPUTS = ("lang_pred", "score")
# Closely related languages share a family.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every trigram; blanks stand before and behind a text, runs of them count once."""
    n = len(offsets) - 1
    body = _FOLD[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    blank = body == 32
    kept = ~blank
    kept[1:] |= ~blank[:-1] & ~first[1:]  # the first blank behind a letter
    body, doc = body[kept], doc[kept]
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(doc)) + 1  # a blank before every text
    body, doc = np.insert(body, np.append(0, edge), 32), np.insert(doc, np.append(0, edge), doc[np.append(0, edge)])
    body, doc = np.append(body, np.uint32(32)), np.append(doc, doc[-1])
    gram = (body[:-2] << np.uint32(16)) | (body[1:-1] << np.uint32(8)) | body[2:]
    cell = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int64)
    return cell, doc[:-2]


@dataclass
class Classifier:
    """`weights` (classifiers, FEATURES) and `bias`; first one per family, then one per pair inside a family."""

    families: list[list[str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        if not self.families or not n:
            return [UNKNOWN] * n, np.zeros(n)
        data, offsets = text_bytes(column)
        cell, doc = trigram_cells(data, offsets)
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        margins = np.stack([np.bincount(doc, w[cell], n) for w in self.weights], 1) / size[:, None] + self.bias \
            if len(self.weights) else np.zeros((n, 0))
        at = len(self.families) if len(self.families) > 1 else 0
        family = margins[:, :at].argmax(1) if at else np.zeros(n, np.int64)
        sure = margins[np.arange(n), family] if at else np.full(n, np.inf)
        out = np.empty(n, object)
        for f, langs in enumerate(self.families):
            mine = np.flatnonzero(family == f)
            votes, total = np.zeros((len(mine), len(langs))), np.zeros((len(mine), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                m = margins[mine, at]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                total[:, a] += m
                total[:, b] -= m
                at += 1
            best = (votes + 0.5 * np.tanh(total / 1e3)).argmax(1)
            out[mine] = np.array(langs, object)[best]
            if len(langs) > 1:
                sure[mine] = np.minimum(sure[mine], total[np.arange(len(mine)), best] / (len(langs) - 1))
        return out.tolist(), 1 / (1 + np.exp(-np.clip(sure, -50, 50)))


def _features(df: DataFrame, text: str, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_bytes(part.column(text))
                cell, doc = trigram_cells(data, offsets)
                counts = np.zeros((part.num_rows, FEATURES), np.float32)
                np.add.at(counts, (doc, cell), 1)
                counts /= np.maximum(counts.sum(1, keepdims=True), 1)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * FEATURES), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(label), lists], ["label", "features"])

    return df.select(label, text).mapInArrow(run, "label string, features array<float>")


def fit_svm(x: np.ndarray, y: np.ndarray, regularization: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, y = 1 or -1) by accelerated gradient steps."""
    def margins(v: np.ndarray) -> np.ndarray:  # the bias is the last number; x itself is not copied
        return x @ v[:-1] + v[-1]

    def back(m: np.ndarray) -> np.ndarray:
        return np.append(x.T @ m, m.sum())

    v = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(20):  # the largest curvature bounds the step
        v = back(margins(v / np.linalg.norm(v)))
    step = 1 / (2 * np.linalg.norm(v) / len(x) + regularization)
    w = ahead = np.zeros(x.shape[1] + 1, x.dtype)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * margins(ahead))
        after = ahead - step * (regularization * ahead - 2 / len(x) * back(y * slack))
        ahead, w = after + t / (t + 3) * (after - w), after
    return w[:-1].astype(np.float64), float(w[-1])


def train(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = 400,
          families: Mapping[str, tuple[str, ...]] = FAMILIES, regularization: float = 1e-2, rounds: int = 300) -> Classifier:
    """Fit on at most `per_language` rows of each label: that many times FEATURES numbers come to the driver."""
    labelled = rows.select(key, text, label).where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = W.partitionBy(label).orderBy(F.xxhash64(key, text), key)
    sample = labelled.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_language)
    points = _features(sample, text, label).toArrow()
    labels = np.array(points["label"].to_pylist(), object)
    x, at = np.empty((len(labels), FEATURES), np.float32), 0
    for chunk in points["features"].chunks:
        x[at:at + len(chunk)] = chunk.flatten().to_numpy().reshape(-1, FEATURES)
        at += len(chunk)
    del points
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(labels)):
        name = next((f for f, members in families.items() if lang in members), lang)
        groups.setdefault(name, []).append(lang)
    ordered = [groups[f] for f in sorted(groups)]
    weights, bias = [], []
    scale = 1 / np.maximum(x.std(0), 1e-5) if len(labels) else np.ones(FEATURES)
    x *= scale

    def fit(chosen: list[str], positive: list[str]) -> None:
        rows = np.isin(labels, chosen)
        side = np.where(np.isin(labels[rows], positive), 1, -1).astype(np.float32)
        w, b = fit_svm(x if rows.all() else x[rows], side, regularization, rounds)
        weights.append(w * scale)
        bias.append(b)

    if len(ordered) > 1:
        for members in ordered:
            fit(sorted(set(labels)), members)
    for members in ordered:
        for a, b in combinations(members, 2):
            fit([a, b], [a])
    return Classifier(ordered, np.array(weights).reshape(len(weights), FEATURES), np.array(bias))


def identify(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The table with `lang_pred` and `score`."""
    df, text = set_aside(df, [*OUTPUTS, "__lettered"], text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # classifiers times FEATURES numbers
    lettered, names = "__lettered", df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):  # a text's last trigram reaches into the next text of its slice
                langs, score = shared.value.predict(part.column(text))
                known = np.asarray(part.column(lettered).to_pylist(), bool)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names),
                     pa.array([x if k else UNKNOWN for x, k in zip(langs, known)], pa.string()),
                     pa.array(np.where(known & np.array([x != UNKNOWN for x in langs], bool), score, 0.0))],
                    [*names, *OUTPUTS])

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.withColumn(lettered, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
