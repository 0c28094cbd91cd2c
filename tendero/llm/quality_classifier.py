"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's features are its words and pairs of words, and the same for the *shapes* of
its words (letters, capitals, digits and signs with repeats folded: ``Abc###`` is
``Aa#``), hashed into one weight vector of fixed size. Words weigh 1/sqrt(n) each and
shapes ``SHAPE_WEIGHT``/n each, so no length of text drowns the other part. A score is
the logistic of a sparse dot product.

Training takes at most ``sample`` labelled documents (those with the smallest hash of
their id), in one task; the weights, whose size is fixed by ``bits``, go to all tasks.

Rows: null and empty texts have the bias alone as their score; long texts are taken
whole; unlabelled documents and null labels are not trained on; with no label at all
every score is 0.5. Repeated rows are scored one by one. A null id counts as held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendero.llm import words as W

SHAPE_WEIGHT = 4.0
FEATURE_BYTES = 1_000_000  # bytes of text whose features are held at a time: some 60 bytes of arrays for each
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def _shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: classes of characters, each run once."""
    shape = _SHAPE[data]
    keep = ~W.SPACE[data]
    same = np.zeros(len(data), bool)
    same[1:] = shape[1:] == shape[:-1]
    same[starts] = False
    kept = keep & ~same
    at = np.concatenate(([0], np.cumsum(kept)))
    return W.word_hashes(shape[kept], at[starts], at[ends])


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Per text: hashed features and their weights, and the edges of each text's part."""
    starts, ends, bounds = W.word_spans(data, offsets)
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    last = np.zeros(len(starts), bool)
    last[bounds[1:][counts > 0] - 1] = True
    parts = []
    for family, h in enumerate((W.word_hashes(W.LOWER[data], starts, ends), _shape_hashes(data, starts, ends))):
        weight = 1 / np.sqrt(np.maximum(counts, 1)) if family == 0 else SHAPE_WEIGHT / np.maximum(counts, 1)
        pair = W.mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(family))
        pair_of = text[:-1][~last[:-1]]
        parts += [(W.mix(h + np.uint64(family + 7)), text, weight[text]), (pair[~last[:-1]], pair_of, weight[pair_of])]
        # a word like the one before it
        if len(h):
            same = (h[1:] == h[:-1]) & ~last[:-1]
            where = text[1:][same]
            parts.append((np.full(len(where), 17 + family, np.uint64), where, (SHAPE_WEIGHT / np.maximum(counts, 1))[where]))
    index = np.concatenate([p[0] for p in parts]) >> np.uint64(0) & np.uint64((1 << bits) - 1)
    row = np.concatenate([p[1] for p in parts])
    return index.astype(np.int64), row, np.concatenate([p[2] for p in parts])


class Examples:
    """Sparse rows end to end in pairs of flat arrays, none of which is copied as the rows become more."""

    def __init__(self, room: int = 1 << 20):
        self.room, self.parts, self.at, self.rows = room, [], 0, []

    def add(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        if not self.parts or self.at + len(index) > len(self.parts[-1][0]):
            room = max(self.room, len(index))
            self.parts.append((np.zeros(room, np.int32), np.zeros(room, np.float32)))
            self.at = 0
        end = self.at + len(index)
        for part, x in zip(self.parts[-1], (index, value)):
            part[self.at:end] = x
        self.rows.append((len(self.parts) - 1, self.at, end, label))
        self.at = end

    def __iter__(self):
        for k, at, end, label in self.rows:
            index, value = self.parts[k]
            yield index[at:end], value[at:end], label


def ftrl(examples, bits: int, *, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05,
         epochs: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) learnt from a list of (index, value, label)."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in examples:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(value @ w, -35, 35)))
            g = (p - label) * value
            z[index] += g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[index] += g * g
    return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0).astype(np.float32)


def _trainer(bits: int):
    def run(batches):
        examples = Examples()
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for at, end, data, offsets in W.slices(batch.column(0), FEATURE_BYTES):
                index, row, value = features(data, offsets, bits)
                order = np.argsort(row, kind="stable")
                index, row, value = index[order], row[order], value[order]
                edges = np.searchsorted(row, np.arange(end - at + 1))
                for k in range(end - at):
                    i, v = index[edges[k]:edges[k + 1]], value[edges[k]:edges[k + 1]]
                    unique, inverse = np.unique(i, return_inverse=True)
                    examples.add(np.append(unique, 1 << bits), np.append(np.bincount(inverse, v, len(unique)), 1.0), labels[at + k])
        if examples.rows:
            weights = ftrl(examples, bits).tobytes()
            del examples
            yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary())], ["weights"])
    return run


def train(labelled: DataFrame, *, sample: int = 20_000, bits: int = 18) -> np.ndarray:
    """Weights from (doc_id, text, label); at most ``sample`` rows, of the smallest hashes of the id."""
    chosen = (labelled.where("label is not null and doc_id is not null")
              .select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", F.col("label").cast("double").alias("label"))
              .orderBy("h", "doc_id", "label", F.xxhash64("text")).limit(sample))
    found = chosen.select("text", "label").mapInArrow(W.trimmed(_trainer(bits)), "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every row in ``score_col``, which must be a new name."""
    if score_col in docs.columns:
        raise ValueError(f"docs already has a column {score_col}")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits, place = (len(weights) - 1).bit_length() - 1, docs.columns.index(text_col)

    def run(batches):
        w = shared.value.astype(np.float64)
        for batch in batches:
            for at, end, data, offsets in W.slices(batch.column(place), FEATURE_BYTES):
                index, row, value = features(data, offsets, bits)
                dot = np.bincount(row, w[index] * value, end - at) + w[-1]
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))],
                                                 [*part.schema.names, score_col])

    return docs.mapInArrow(W.trimmed(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def remainder(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null ids give 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, sample: int = 20_000, bits: int = 18) -> np.ndarray:
    """Weights learnt from the labelled rows of ``docs`` outside fold 0."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(remainder("doc_id", folds) != 0).where("label is not null")
    # the sample is chosen by ids alone and has a fixed size: no text is shuffled to meet its label
    chosen = (known.join(docs.select("doc_id"), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id", F.col("label").cast("double")).limit(sample))
    return train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sample=sample, bits=bits)


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, threshold: float = 0.3,
                   sample: int = 20_000, bits: int = 18) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rows of fold 0 are never trained on."""
    weights = fit(docs, labels, folds=folds, sample=sample, bits=bits)
    return score(docs.select("doc_id", "text"), weights).select(
        "doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
