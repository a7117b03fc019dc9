"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary texts, one on windows of toxic texts, each with the
same ordinary tail, so that they differ only in what they were trained on. As most of a toxic text is ordinary prose, the
toxic dictionary is trained in rounds: the windows of each half of the toxic texts are compressed under a dictionary of the
other half, and those that it shortens as hardly any ordinary window is are what the next one is trained on. Every text is
cut into overlapping windows; each window is compressed under both dictionaries, and the differences of the compressed
lengths, counted at several thresholds, give a score by a logistic calibration that is fitted on training texts not used
for the dictionaries.

The fit draws labelled training rows of each class by the hash of their id, at most fit_rows of them and until they reach
fit_bytes; it works on windows of their whole texts. Everything is scored, over whole texts.

Defined results: a null or empty text has no windows and gets the calibrated score of that; without labels of one class
all scores are 0 (no toxic ones) or 1 (no others); repeated rows are scored each; a null id is kept; a null label is no
label; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder
from .samples import FIT_BYTES, labelled

FIT_ROWS = 4000
WINDOW, STRIDE = 60, 40
DICT_BYTES, MARK_BYTES = 80_000, 3_072
#: The rounds of the toxic dictionary: how many, its size in the first, the windows, and the share of ordinary windows that
#: may be shortened as much.
ROUNDS, FIRST_BYTES, PART, PART_STRIDE, ORDINARY = 3, 32_000, 24, 6, 0.003
THRESHOLDS = (2, 3, 4, 5, 6)
#: Every window is led by this many bytes that both dictionaries know, so that it is never stored raw, whose fixed length
#: would hide small savings.
LEAD = 24
_BATCH = 1 << 20


def _compressor(content: bytes) -> z.ZstdCompressor:
    # fixed parameters: those chosen by size would differ between the dictionaries
    params = z.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=7, min_match=5, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(compression_params=params, dict_data=d)


def _trained(size: int, samples: list[bytes], **how: int) -> bytes:
    """The content of a dictionary trained on samples; the samples themselves where they are too few to train on."""
    # mixed, as training stops early at a long run of samples that share nothing, such as one junk text
    samples = sorted(samples, key=zlib.crc32)
    try:
        content = z.train_dictionary(size, samples, **how).as_bytes()
    except z.ZstdError:
        content = b"".join(samples)
    return content[-size:]


def _lengths(c: z.ZstdCompressor, windows: list[bytes], lead: bytes) -> np.ndarray:
    n = np.fromiter(map(len, windows), dtype=np.int64, count=len(windows)) + len(lead)
    cuts = np.stack([np.cumsum(n) - n, n], axis=1).astype(np.uint64)
    packed = c.multi_compress_to_buffer(z.BufferWithSegments(b"".join([lead + w for w in windows]), cuts.tobytes()), threads=1)
    return np.fromiter(map(len, packed), dtype=np.int64, count=len(windows))


def _windows(texts: list[bytes], size: int, step: int) -> list[bytes]:
    return [t[k : k + size] for t in texts for k in range(0, len(t), step)]


def differences(pair: tuple[z.ZstdCompressor, z.ZstdCompressor], texts: list[bytes], lead: bytes = b"") -> list[np.ndarray]:
    """For each text, the bytes that the toxic dictionary saves over the ordinary one, window by window."""
    out: list[np.ndarray] = []
    for text in texts:
        parts = []
        step = _BATCH // STRIDE * STRIDE
        for k in range(0, len(text), step):
            chunk = text[k : k + step + WINDOW - STRIDE]
            starts = np.arange(0, max(1, min(len(chunk), step) - (WINDOW - STRIDE)), STRIDE)
            ends = np.minimum(starts + WINDOW, len(chunk))
            windows = [chunk[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
            sizes = [_lengths(c, windows, lead) for c in pair]
            parts.append(sizes[0] - sizes[1])
        out.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))
    return out


def features(d: np.ndarray) -> list[float]:
    n = max(1, len(d))
    top = np.sort(d)[::-1][:8] if len(d) else np.zeros(1)
    counts = [int((d >= t).sum()) for t in THRESHOLDS]
    mean = float(d.mean()) if len(d) else 0.0
    return [*(float(np.log(c / n + 1e-3)) for c in counts), *(float(np.sqrt(c)) for c in counts), float(top[0]), float(top[:3].mean()), float(top.mean()), mean, float(np.log(n)), 1.0]


class Model:
    """Dictionaries and calibration; small and of bounded size, so it travels with the tasks."""

    def __init__(self, ordinary: bytes, toxic: bytes, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, constant: float | None = None) -> None:
        self.ordinary, self.toxic, self.mean, self.scale, self.weights, self.constant = ordinary, toxic, mean, scale, weights, constant

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        pair = _compressor(self.ordinary), _compressor(self.toxic)
        x = np.array([features(d) for d in differences(pair, [(t or b"").lower() for t in texts], self.ordinary[-LEAD:])])
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights, -40, 40)))


def _telling(toxic: list[bytes], ordinary: list[bytes], base: bytes) -> list[bytes]:
    """Windows of the toxic texts that a dictionary of the other half of them shortens as hardly any ordinary window is."""
    lead, halves = base[-LEAD:], [_windows(toxic[k::2], PART, PART_STRIDE) for k in (0, 1)]
    others = _windows(ordinary, PART, PART)
    plain = _compressor(base)
    before, chosen, size = [_lengths(plain, w, lead) if w else np.zeros(0) for w in (*halves, others)], halves, FIRST_BYTES
    for _ in range(ROUNDS):
        marks = [_trained(size, w, k=12, d=8) for w in chosen]
        chosen, size = [], MARK_BYTES
        for k in (0, 1):
            c = _compressor(marks[1 - k] + base)
            saved, usual = (was - _lengths(c, w, lead) if w else np.zeros(0) for was, w in ((before[k], halves[k]), (before[2], others)))
            least = next(v for v in range(1, 10_000) if (usual >= v).sum() <= ORDINARY * len(usual))
            chosen.append([halves[k][i] for i in np.flatnonzero(saved >= least).tolist()])
    return chosen[0] + chosen[1] or halves[0] + halves[1]


def fit(rows: list[tuple[int, bytes]], totals: dict[int, int]) -> Model:
    """A model from (label, text) rows; totals are the counts of the labels in all training rows."""
    by = {k: list(dict.fromkeys(t.lower() for label, t in rows if label == k)) for k in (0, 1)}
    if not by[0] or not by[1]:
        none = np.zeros(0)
        return Model(b"", b"", none, none, none, constant=1.0 if by[1] else 0.0)
    cut = {k: max(1, len(v) * 6 // 10) for k, v in by.items()}
    toxic, ordinary = by[1][: cut[1]], by[0][: cut[0]]
    base = _trained(DICT_BYTES, _windows(ordinary[::2], WINDOW, WINDOW), k=48, d=8)
    mark = _trained(MARK_BYTES, _telling(toxic, ordinary[1::2], base), k=12, d=8)
    model = Model(base, mark + base[len(mark) :], np.zeros(0), np.zeros(0), np.zeros(0))
    held = [(k, t) for k in (0, 1) for t in (by[k][cut[k] :] or by[k])]
    pair = _compressor(model.ordinary), _compressor(model.toxic)
    x = np.array([features(d) for d in differences(pair, [t for _, t in held], base[-LEAD:])])
    y = np.array([k for k, _ in held], dtype=float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.mean[-1], model.scale[-1] = 0.0, 1.0
    x = (x - model.mean) / model.scale
    # rows are weighted so that the classes stand as in all training rows
    share = totals.get(1, 0) / max(1, sum(totals.get(k, 0) for k in (0, 1)))
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    w, ridge = np.zeros(x.shape[1]), 0.5 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.7, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, by a model fitted on the rows that are not held out."""
    train = remainder(F.col("doc_id"), 3) != 1
    model = fit(*labelled(docs, labels, F.col("toxic"), train, fit_rows, fit_bytes))
    packed = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = packed.value.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = T.StructField("held_out", T.BooleanType())
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], held, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
