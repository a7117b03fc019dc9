"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(w.x - t_k): one weight vector over hashed byte n-grams of the text, shared by all grades, and
ordered thresholds t_0 <= t_1 <= ..., so the tail probabilities never cross. They give the expected grade and the
probability of reaching a wanted grade, by which texts are selected. Scoring adds up looked-up weights over whole texts.

The fit draws labelled rows of each grade by the hash of their id, at most fit_rows of them and until their whole texts
reach fit_bytes; classes are weighted back to their shares in all labels.

Defined results: a null or empty text has no n-grams and is graded by the thresholds alone; with fewer than two grades
among the labels every text gets that grade (or the highest, without labels) and is kept; repeated rows are graded
each; a null id is kept; a null label is no label; an empty table gives an empty table; `grade` ignores other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow
from .samples import FIT_BYTES, labelled

FIT_ROWS = 1000
#: (n, bits): n-grams of n bytes are hashed to 2**bits weights.
FAMILIES = ((1, 8), (3, 11), (5, 12))
SIZE = sum(1 << bits for _, bits in FAMILIES)
_CHUNK = 1 << 21


def _hashed(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (as far as it goes)."""
    code = data[: len(data) - n + 1].astype(np.uint64)
    for k in range(1, n):
        code = code * np.uint64(257) + data[k : len(data) - n + 1 + k]
    if n == 1:
        return code.astype(np.int64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def vector(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams, family by family."""
    out, at = np.zeros(SIZE, dtype=np.float32), 0
    data = np.frombuffer(text or b"", dtype=np.uint8)
    for n, bits in FAMILIES:
        size, counts = 1 << bits, np.zeros(1 << bits)
        for k in range(0, max(0, len(data) - n + 1), _CHUNK):
            counts += np.bincount(_hashed(data[k : k + _CHUNK + n - 1], n, bits), minlength=size)
        out[at : at + size] = np.sqrt(counts / max(1.0, counts.sum()))
        at += size
    return out


class Model:
    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade > grades[k]) for k = 0 .. len(grades) - 2, a row for each text."""
        s = np.array([float(vector(t) @ self.weights) for t in texts])
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: list[tuple[int, bytes]], totals: dict[int, int], steps: int = 200, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    grades = sorted(totals)
    have = sorted({g for g, _ in rows})
    if len(have) < 2:
        only = have or grades[-1:] or [1]
        return Model(only, np.zeros(SIZE, dtype=np.float32), np.zeros(0))
    x = np.empty((len(rows), SIZE), dtype=np.float32)
    for k, (_, t) in enumerate(rows):
        x[k] = vector(t)
    y = np.array([have.index(g) for g, _ in rows])
    share = np.array([totals[g] for g in have], dtype=float) / sum(totals[g] for g in have)
    weight = (share / np.bincount(y, minlength=len(have)))[y]
    above = (y[:, None] > np.arange(len(have) - 1)[None, :]).astype(float)
    # thresholds as a first value and non-negative gaps keep their order
    start = -np.log(np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3) / np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3))
    mean = x.mean(axis=0)
    p = np.concatenate([np.zeros(SIZE), start[:1], np.log(np.expm1(np.maximum(np.diff(start), 1e-2)))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    x -= mean
    for k in range(1, steps + 1):
        w, gaps = p[:SIZE], np.logaddexp(0, p[SIZE + 1 :])
        t = p[SIZE] + np.concatenate([[0.0], np.cumsum(gaps)])
        tail = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32))[:, None] - t[None, :], -40, 40)))
        # the likelihood of a grade is the difference of neighbouring tails
        full = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], axis=1)
        at = np.arange(len(y))
        prob = np.clip(full[at, y] - full[at, y + 1], 1e-9, None)
        slope = full * (1 - full)
        ds = -weight * (slope[at, y] - slope[at, y + 1]) / prob
        dt = np.zeros(len(t))
        for j in range(len(t)):
            dt[j] = (weight * slope[:, j + 1] * ((y == j + 1).astype(float) - (y == j)) / prob).sum()
        back = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([x.T @ ds.astype(np.float32) + ridge * w, [back[0]], back[1:] / (1 + np.exp(-p[SIZE + 1 :]))])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    w = p[:SIZE]
    t = p[SIZE] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, p[SIZE + 1 :]))])
    return Model(have, w.astype(np.float32), t + float(mean @ w))


def ratings(labels: DataFrame) -> Column:
    """Grades of the label table: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


def grade(docs: DataFrame, labels: DataFrame, reach: int = 1, least: float = 0.5, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """doc_id, expected_grade, p_reach (probability of grade >= reach) and keep for every row of docs."""
    model = fit(*labelled(docs, labels, ratings(labels), F.lit(True), fit_rows, fit_bytes))
    packed = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = packed.value
        for b in batches:
            expected, p = expectation(m, b.column("text").to_pylist(), reach)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected), pa.array(p), pa.array(p >= least)], ["doc_id", "expected_grade", "p_reach", "keep"])

    double = [T.StructField(c, T.DoubleType()) for c in ("expected_grade", "p_reach")]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *double, T.StructField("keep", T.BooleanType())]))


def expectation(model: Model, texts: list[bytes | None], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grades and probabilities of a grade of at least `reach`."""
    n, grades = len(texts), np.array(model.grades, dtype=float)
    tails = model.tails(texts) if n and len(grades) > 1 else np.zeros((n, max(0, len(grades) - 1)))
    expected = grades[0] + tails @ np.diff(grades)
    under = int((grades < reach).sum())
    if under == 0:
        return expected, np.ones(n)
    return expected, tails[:, under - 1] if under < len(grades) else np.zeros(n)


def select(docs: DataFrame, labels: DataFrame, reach: int = 1, least: float = 0.5, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The rows of docs whose probability of a grade >= reach is at least `least`, with their columns, in one pass."""
    model = fit(*labelled(docs, labels, ratings(labels), F.lit(True), fit_rows, fit_bytes))
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, p = expectation(packed.value, [None if t is None else t.encode() for t in b.column("text").to_pylist()], reach)
            yield b.filter(pa.array(p >= least))

    return in_arrow(docs, run, docs.schema)
