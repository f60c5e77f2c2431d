"""Toxicity: a character n-gram linear classifier on naive Bayes features.

Features are hashed character n-grams, present or absent in a whole text.
Each is scaled by its naive Bayes log-count ratio between toxic and other
training texts; a logistic model on the scaled features gives the score.
Only features whose ratio stands out from chance are kept, so that very long
texts don't gather noise.

Fitting uses at most ``MAX_TOXIC`` and ``MAX_OTHER`` labelled rows (the least
by a hash of the id), counted and encoded on the executors; scoring is one
pass over all texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import checkpointed, lean, name_package
from shardloom.llm.ngrams import hashed

SIZES = (3, 4, 5)
BITS = 20
MAX_TOXIC = 4000
MAX_OTHER = 8000
#: Standard errors by which a feature's rates in the classes must differ.
STANDS_OUT = 4.5
#: Rows of the sample that a feature must occur in.
LEAST_ROWS = 3
#: Tasks that the sample is dealt out to.
SAMPLE_TASKS = 12
SMOOTH = 0.5


@dataclass(frozen=True)
class Model:
    """Kept features (hashes, ascending), their weights and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[self.features] = self.weights
        return w


def _present(text: str, table: np.ndarray) -> np.ndarray:
    """Distinct hashes of the text's n-grams that ``table`` marks."""
    hits = [h[table[h] != 0] for h in hashed(text.lower(), SIZES, BITS)]
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, dtype=np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each class each feature occurs."""
    seen = np.zeros((2, 1 << BITS), dtype=np.uint32)
    n = [0, 0]
    for b in batches:
        for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            mark = np.zeros(1 << BITS, dtype=bool)
            for h in hashed((t.as_py() or "").lower(), SIZES, BITS):
                mark[h] = True
            seen[y] += mark
            n[y] += 1
    if sum(n):
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64())], names=["seen", "n0", "n1"])


def _encoder(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.zeros(1 << BITS, dtype=np.int32)
        at[features] = np.arange(1, len(features) + 1)
        for b in batches:
            # ascending numbers of the kept features, as packed steps: the sample's rows go to the driver
            x = [zlib.compress(np.diff(at[_present(t.as_py() or "", at)], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], names=["x", "y"])

    return run


def _logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, penalty: float = 1e-4, steps: int = 150, chunk: int = 1000) -> tuple[np.ndarray, float]:
    """Weights (already times the ratios) and bias, by Adam over all rows.

    Rows are taken in chunks, so that besides their column numbers only a
    chunk's values are held at once.
    """
    parts = [(slice(i, min(i + chunk, len(rows))), np.concatenate(rows[i : i + chunk]), np.array([len(r) for r in rows[i : i + chunk]])) for i in range(0, len(rows), chunk)]
    rows.clear()
    w, b = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        scaled = (w * ratio).astype(np.float32)
        gw, gb = np.zeros(len(ratio)), 0.0
        for own, col, n in parts:
            ends = np.concatenate(([0], np.cumsum(scaled[col], dtype=np.float64)))[np.concatenate(([0], np.cumsum(n)))]
            z = np.diff(ends) + b
            g = weight[own] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / total
            gw += np.bincount(col, weights=np.repeat(g, n), minlength=len(ratio))
            gb += g.sum()
        gw = gw * ratio + penalty * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = 0.05 / (1 + t / 50)
        w -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= lr * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w * ratio, float(b)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER, stands_out: float = STANDS_OUT, least_rows: int = LEAST_ROWS) -> Model:
    """Fit on at most ``max_toxic + max_other`` labelled rows, by the order of a hash of their id.

    Rows with a null label or id are left out; of clashing labels of an id the
    larger counts; a null text counts as empty. Without rows of both classes
    the model scores the only class known (no rows at all: 0). A feature is kept
    if it occurs in ``least_rows`` rows or more and its rates in the classes
    differ by more than ``stands_out`` standard errors.
    """
    name_package(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("y"))
    ids = checkpointed(known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"))
    pick = None
    for y, most in ((1, max_toxic), (0, max_other)):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        pick = part if pick is None else pick.union(part)
    # the picked ids are bounded by the two limits, so they may be broadcast, and texts are never shuffled
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = checkpointed(texts.join(F.broadcast(pick), "id").select("text", "y").repartition(SAMPLE_TASKS))
    seen, n = np.zeros((2, 1 << BITS), dtype=np.int32), np.zeros(2)
    for part in sample.mapInArrow(_counts, "seen binary, n0 long, n1 long").toLocalIterator():
        seen += np.frombuffer(zlib.decompress(part.seen), dtype=np.uint32).reshape(2, -1)
        n += (part.n0, part.n1)
    if not n.all():
        return Model(np.empty(0, dtype=np.int64), np.empty(0), 20.0 if n[1] else -20.0)
    some = np.nonzero(seen.sum(axis=0) >= least_rows)[0]
    pooled = (seen[:, some].sum(axis=0) + 1) / (n.sum() + 2)
    z = (seen[1, some] / n[1] - seen[0, some] / n[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    features = some[np.abs(z) > stands_out]
    p, q = (seen[1, features] + SMOOTH), (seen[0, features] + SMOOTH)
    ratio = np.log(p / (n[1] + 2 * SMOOTH)) - np.log(q / (n[0] + 2 * SMOOTH))
    got = sample.mapInArrow(_encoder(features), "x binary, y int").toArrow()
    x = [np.cumsum(np.frombuffer(zlib.decompress(r.as_buffer()), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int32) - 1 for r in got.column("x")]
    y = got.column("y").to_numpy().astype(float)
    del got
    # the sample's classes weigh as in all labelled rows
    whole = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, whole[1] / max(1, y.sum()), whole[0] / max(1, (1 - y).sum()))
    w, b = _logistic(x, y, weight, ratio)
    return Model(features, w, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): every row once; null and empty texts get the score of no features.

    Very long texts are read whole; repeated rows and null ids are answered each;
    an empty table gives no rows; other columns are not read, so clashing names do no harm.
    """
    name_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.lookup()
        for b in batches:
            z = np.array([float(table[_present(t.as_py() or "", table)].sum()) for t in b.column(1)]) + model.bias
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.

    Each row is decided by its own text alone: repeated rows stay or go together,
    ids may be null or repeat, extra columns pass through whatever their names. Null and
    empty texts score as texts without features; a score of just ``threshold`` goes.
    Very long texts are read whole. An empty table stays empty.
    """
    name_package(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.lookup()
        for b in batches:
            z = np.array([float(table[_present(t.as_py() or "", table)].sum()) for t in b.column(at)]) + model.bias
            keep = 1 / (1 + np.exp(-np.clip(z, -40, 40))) < threshold
            yield pa.RecordBatch.from_arrays(list(b.columns), names=names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
