"""Language-model scores by deleted interpolation of word bigrams.

P(w | v) mixes the maximum-likelihood estimate of the bigram with P(w); the weight depends on the frequency bucket of the
context word v. P(w) mixes the word's maximum-likelihood estimate with its spelling: byte trigrams whose estimates of every
order (uniform, one, two, three bytes) are mixed by the frequency bucket of the two-byte context. All words are words of the
bigrams, however rare. All weights are learned by expectation-maximisation on counts held out from the training texts; the
counts are then pooled.

Words and bigrams are counted over all training texts. Texts travel as segments of about SEGMENT tokens. The most frequent
words, at most HEAD_ROWS, are broadcast; a segment's other words are joined with the word table, once a segment. Then the
segment sends its distinct bigrams to GROUPS of them by hash, where they are counted over all segments, and gets their counts
back. So a frequent word or bigram costs one entry per segment, nothing is joined by occurrence, and all counts are exact.
HEAD_ROWS decides what is broadcast and nothing else. The number of groups grows with the tokens, so that a group's bigrams
fit a task.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text for the split; rows that
repeat an id and text are scored each; without training texts base_score is log10(1/1) per token and score is the uniform
spelling's; an empty table gives an empty table; other columns are ignored; over 2**32 places of distinct words are an error.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_for, remainder, stash

HEAD_ROWS = 300_000
SEGMENT = 1_000_000
#: Bigrams that a task counts at a time, about, and the most groups that a segment is dealt to.
GROUP, GROUPS = 1_500_000, 16_384
END = b"\n"  # no word holds a white-space character
END_ID, OTHER = 0, 1
BUCKETS = 48
_FLUSH = 250_000
_REST, _HELD, _OUT = range(3)


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _count(docs: DataFrame, n: int, out: int, held: int) -> DataFrame:
    """(w, n_rest, n_held): counts of the training tokens, n_held in the part kept back for the mixture weights."""
    part = remainder(F.col("doc_id"), n)
    rows = docs.filter(part != out).select((part == held).alias("held"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            got = [pa.array([c[w] for w in words], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *got], ["w", "n_rest", "n_held"])

        for b in batches:
            for held_back, text in zip(b.column("held").to_pylist(), b.column("text")):
                counts[held_back].update(tokens(text.as_py()))
                if len(counts[0]) + len(counts[1]) > _FLUSH:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "w binary, n_rest long, n_held long").groupBy("w").agg(F.sum("n_rest").alias("n_rest"), F.sum("n_held").alias("n_held"))


def _cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells of the words' spellings, end to end, and where each word starts. A word ends with a space; END is itself."""
    data = np.frombuffer(b"".join(w if w == END else w + b" " for w in words), dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter((1 if w == END else len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes) - sizes
    one, two = np.roll(data, 1), np.roll(data, 2)
    one[starts], two[starts] = 0x20, 0x0A
    second = starts[sizes > 1] + 1
    two[second] = 0x20
    return (two << 16) | (one << 8) | data, starts


def _trigrams(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells and their counts in the two parts, from the word table; at most 2**24 by construction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros((2, 0))
        for b in batches:
            for k in range(0, b.num_rows, 100_000):
                s = b.slice(k, 100_000)
                cells, starts = _cells(s.column("w").to_pylist())
                sizes = np.diff(np.append(starts, len(cells)))
                more = [np.repeat(s.column(c).to_numpy().astype(float), sizes) for c in ("n_rest", "n_held")]
                keys, at = np.unique(np.concatenate([keys, cells]), return_inverse=True)
                sums = np.stack([np.bincount(at, weights=np.concatenate([have, new]), minlength=len(keys)) for have, new in zip(sums, more)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x.astype(np.int64)) for x in sums)], ["g", "n_rest", "n_held"])

    got = table.mapInArrow(run, "g long, n_rest long, n_held long").groupBy("g").agg(F.sum("n_rest").alias("n_rest"), F.sum("n_held").alias("n_held")).toArrow()
    return tuple(got[c].to_numpy() for c in ("g", "n_rest", "n_held"))


class Spelling:
    """Interpolated byte trigrams. Keeps the seen cells only; others are computed from the lower orders."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None) -> None:
        order = np.argsort(cells)
        self.cells, self.counts = cells[order], counts[order].astype(float)
        self.pairs = np.bincount(self.cells >> 8, weights=self.counts, minlength=1 << 16)  # of contexts
        self.two = np.zeros((256, 256))
        np.add.at(self.two, ((self.cells >> 8) & 255, self.cells & 255), self.counts)
        self.one = self.two.sum(axis=0)
        self.weights = np.full((BUCKETS, 4), 0.25) if weights is None else weights

    def estimates(self, cells: np.ndarray) -> np.ndarray:
        """The four estimates of each cell; one that has never seen its context takes the next lower order's."""
        out = np.empty((len(cells), 4))
        out[:, 0] = 1 / 256
        n = self.one.sum()
        out[:, 1] = self.one[cells & 255] / n if n else 1 / 256
        before = self.two.sum(axis=1)[(cells >> 8) & 255]
        out[:, 2] = np.where(before > 0, self.two[(cells >> 8) & 255, cells & 255] / np.maximum(before, 1), out[:, 1])
        at = np.searchsorted(self.cells, cells)
        seen = np.zeros(len(cells))
        if len(self.cells):
            at = np.minimum(at, len(self.cells) - 1)
            seen = np.where(self.cells[at] == cells, self.counts[at], 0.0)
        context = self.pairs[cells >> 8]
        out[:, 3] = np.where(context > 0, seen / np.maximum(context, 1), out[:, 2])
        return out

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        return bucket(self.pairs[cells >> 8])

    def learn(self, cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> None:
        """Expectation-maximisation of the weights of each bucket on held-out counts."""
        parts, which = self.estimates(cells), self.bucket(cells)
        for _ in range(rounds):
            joint = parts * self.weights[which]
            share = counts[:, None] * joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            total = np.full_like(self.weights, 1e-3)  # buckets without held-out counts stay even
            np.add.at(total, which, share)
            self.weights = total / total.sum(axis=1, keepdims=True)

    def log10(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        cells, starts = _cells(words)
        keys, at = np.unique(cells, return_inverse=True)
        p = (self.estimates(keys) * self.weights[self.bucket(keys)]).sum(axis=1)
        return np.add.reduceat(np.log10(p)[at], starts)


def bucket(counts: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context: octaves of its count."""
    return np.minimum(np.log2(np.asarray(counts) + 1).astype(int), BUCKETS - 1)


def mixture(n: np.ndarray, ratio: np.ndarray, rounds: int = 200) -> float:
    """The weight of the first of two estimates, by expectation-maximisation over events seen n times with this ratio."""
    w = 0.5
    for _ in range(rounds):
        w = float((n * w * ratio / (w * ratio + 1 - w)).sum() / n.sum())
        w = min(max(w, 1e-6), 1 - 1e-6)
    return w


def ratios(counts: np.ndarray, total: float, spell: np.ndarray) -> np.ndarray:
    """Words' own estimates over their spellings' (as log10); beyond e**600 a spelling has no share in a mixture anyway."""
    with np.errstate(divide="ignore"):
        return np.exp(np.minimum(np.log(counts / total) - spell * math.log(10), 600.0))


def mixed_log10(weight: float, estimates: np.ndarray, spell: np.ndarray) -> np.ndarray:
    """log10 of weight * estimate + (1 - weight) * 10**spell, however small the spelling is."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(weight * estimates), math.log(1 - weight) + spell * math.log(10)) / math.log(10)


def _own_weight(table: DataFrame, spelling: Spelling, n_rest: int) -> float:
    """The weight of a word's own estimate against its spelling, by EM over a histogram of the held-out words."""
    packed = table.sparkSession.sparkContext.broadcast(spelling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = np.concatenate([packed.value.log10(b.column("w").slice(k, 20_000).to_pylist()) for k in range(0, b.num_rows, 20_000)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("n_rest"), b.column("n_held"), pa.array(logs)], ["n_rest", "n_held", "spell"])

    binned = table.filter("n_held > 0").select("w", "n_rest", "n_held").mapInArrow(run, "n_rest long, n_held long, spell double")
    # the bins are quarter octaves of the count by tenths of the logarithm
    # so far down as -300 a spelling has no share in a double, whatever its length, so these words have a bin in common
    low = F.greatest(F.floor(F.col("spell") * 10), F.lit(-3000))
    got = binned.groupBy(F.when(F.col("n_rest") > 0, F.floor(4 * F.log2("n_rest"))).otherwise(-1).alias("c"), low.alias("s")).agg(
        F.sum("n_held").alias("n"), F.avg("n_rest").alias("count"), F.avg("spell").alias("spell")
    )
    rows = got.orderBy("c", "s").toArrow()
    if not rows.num_rows or not n_rest:
        return 0.5
    n, count, spell = (rows[c].to_numpy().astype(float) for c in ("n", "count", "spell"))
    return mixture(n, ratios(count, n_rest, spell))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data) or b"", dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize).T).view(kind).ravel()


def _pack_words(words: list[bytes]) -> bytes:
    """Words, which hold no white space, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    text = zstandard.ZstdDecompressor().decompress(data)
    return text.split(b"\n") if text else []


class Vocabulary:
    """Places of the frequent words, their counts in the training part and in all, and log10 of their probabilities by both."""

    def __init__(self, words: list[bytes], rest: np.ndarray, every: np.ndarray, log_rest: np.ndarray, log_every: np.ndarray) -> None:
        self.ids = {w: k for k, w in enumerate(words)}
        self.rest, self.every, self.log_rest, self.log_every = rest, every, log_rest, log_every


class Words:
    """The probability of a word: its own estimate mixed with its spelling's."""

    def __init__(self, weight: float, total: int, spelling: Spelling) -> None:
        self.weight, self.total, self.spelling = weight, total, spelling

    def log10(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        spell = [self.spelling.log10(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
        return mixed_log10(self.weight, counts / max(self.total, 1), np.concatenate(spell or [np.zeros(0)]))


def pairs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bigram key of every token of texts end to end; the first of a text has the end token before it."""
    return (before(ids, sizes, np.uint64(END_ID)) << np.uint64(32)) | ids


def before(values: np.ndarray, sizes: np.ndarray, end: object) -> np.ndarray:
    """The value of the token before each; `end` for the first of a text."""
    out = np.roll(values, 1)
    out[np.cumsum(sizes) - sizes] = end
    return out


def _dealt(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sorted keys by group, then key; the groups in that order; where each group starts."""
    g = (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    g = g[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
    return order, g[starts], starts


def _segments(docs: DataFrame, modulus: int, out: int, held: int, packed, segment: int) -> DataFrame:
    """Texts as places of frequent words, about SEGMENT tokens to a row; `rare` lists the other words, to be
    joined with the word table, `packed` holds them for the tasks, `which` places them."""
    part = remainder(F.col("doc_id"), modulus)
    kind = F.when(part == out, _OUT).when(part == held, _HELD).otherwise(_REST)
    rows = docs.select("doc_id", kind.alias("kind"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType(
        [
            T.StructField("seg", T.LongType()),
            T.StructField("kind", T.IntegerType()),
            T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)),
            T.StructField("sizes", T.BinaryType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("rare", T.ArrayType(T.BinaryType())),
            T.StructField("which", T.BinaryType()),
            T.StructField("packed", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = packed.value.ids
        held_back: list[dict | None] = [None, None, None]

        def close(k: int) -> pa.RecordBatch:
            s, held_back[k] = held_back[k], None
            cols = [
                pa.array([int.from_bytes(os.urandom(8), "little", signed=True)], pa.int64()), pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(s["sizes"])], pa.int32()), pa.concat_arrays(s["doc_ids"])),
                pa.array([_pack(np.array(s["sizes"], dtype=np.int64))], pa.binary()), pa.array([_pack(np.concatenate(s["ids"]))], pa.binary()), pa.array([list(s["rare"])], pa.list_(pa.binary())), pa.array([_pack(np.array(s["which"], dtype=np.int32))], pa.binary()),
                pa.array([_pack_words(list(s["rare"]))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, schema.names)

        for b in batches:
            for at, (k, text) in enumerate(zip(b.column("kind").to_pylist(), b.column("text"))):
                s = held_back[k]
                if s is None:
                    s = held_back[k] = {"ids": [], "sizes": [], "doc_ids": [], "rare": {}, "which": [], "n": 0}
                own = tokens(text.as_py())
                found = [places.get(w, OTHER) for w in own]
                if OTHER in found:
                    rare = s["rare"]
                    s["which"] += [rare.setdefault(w, len(rare)) for w, f in zip(own, found) if f == OTHER]
                s["ids"].append(np.array(found, dtype=np.int32))
                s["sizes"].append(len(own))
                s["doc_ids"].append(b.column("doc_id").slice(at, 1))
                s["n"] += len(own)
                if s["n"] >= segment:
                    yield close(k)
        for k in range(3):
            if held_back[k]:
                yield close(k)

    return rows.mapInArrow(run, schema)


class _Segment:
    """A row of `_segments` with what the word table knows of its rare words: ids, counts of the training part and of all."""

    def __init__(self, row: dict) -> None:
        self.places, self.sizes, self.which = (_unpack(row[c].as_py(), t) for c, t in (("ids", np.int32), ("sizes", np.int64), ("which", np.int32)))
        self.rare = _unpack_words(row["packed"].as_py())
        self.tail = np.flatnonzero(self.places == OTHER)
        self.rare_ids = np.full(len(self.rare), OTHER, dtype=np.uint64)
        self.rare_rest, self.rare_every = np.zeros(len(self.rare)), np.zeros(len(self.rare))
        if row["known"].is_valid and len(row["known"].values):
            k, *cols = (row["known"].values.field(c).to_numpy() for c in ("k", "id", "n_rest", "c"))
            for mine, theirs in zip((self.rare_ids, self.rare_rest, self.rare_every), cols):
                mine[k] = theirs

    def by_token(self, head: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = head[self.places]
        out[self.tail] = rare[self.which]
        return out

    def keys(self) -> np.ndarray:
        ids = self.places.astype(np.uint64)
        ids[self.tail] = self.rare_ids[self.which]
        return pairs(ids, self.sizes)


def _known(keys: np.ndarray) -> np.ndarray:
    """Bigrams of words that the training texts hold; no other can have a count."""
    return ((keys >> np.uint64(32)) != OTHER) & ((keys & np.uint64(0xFFFFFFFF)) != OTHER)


def _sent(packed, learned, groups: int):
    """The distinct bigrams of every segment by group. Those held out bring the bucket of their context and log2 of its
    count times the word's probability, both by the training part, which is what their weights are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, words = packed.value, learned.value
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                s, kind = _Segment(row), row["kind"].as_py()
                keys, first, n = np.unique(s.keys(), return_index=True, return_counts=True)
                here = _known(keys)
                keys, first, n = keys[here], first[here], n[here].astype(np.uint32)
                order, g, starts = _dealt(keys, groups)
                keys, first, n = keys[order], first[order], n[order]
                ends = np.append(starts[1:], len(keys))
                cols = [pa.array([_pack(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in zip(starts, ends)], pa.binary()), pa.array([_pack(n[i:j]) for i, j in zip(starts, ends)], pa.binary())]
                if kind == _HELD:
                    context = before(s.by_token(voc.rest, s.rare_rest), s.sizes, voc.rest[END_ID])[first]
                    logs = s.by_token(voc.log_rest, words.log10(s.rare, s.rare_rest))[first]
                    at = bucket(context).astype(np.uint8)
                    scale = (np.log2(np.maximum(context, 1)) + logs * math.log2(10)).astype(np.float32)
                    cols += [pa.array([_pack(x[i:j]) for i, j in zip(starts, ends)], pa.binary()) for x in (at, scale)]
                else:
                    cols += [pa.nulls(len(g), pa.binary())] * 2
                m = len(g)
                head = [pa.array([row["seg"].as_py()] * m, pa.int64()), pa.array([kind] * m, pa.int32()), pa.array(g.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*head, *cols], ["seg", "kind", "g", "k", "n", "bucket", "scale"])

    return run


_BINS, _LOW = 512, 160


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by group: the training counts of every segment's bigrams, in the order they came in; then, without
    a segment, a histogram of the held-out bigrams by context bucket and eighth octaves of the ratio of the two estimates."""
    histogram = np.zeros((2, BUCKETS * _BINS))
    names = ["seg", "g", "n", "cell", "held", "ratio"]
    rows: list[tuple] = []
    group = None

    def close() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        rest, every = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        ends = np.cumsum([len(r[2]) for r in rows])
        places = [at[end - len(r[2]) : end] for r, end in zip(rows, ends)]
        for (_, kind, _, n, _, _), place in zip(rows, places):  # a segment has a bigram once
            if kind == _REST:
                rest[place] += n
            if kind != _OUT:
                every[place] += n
        for (_, kind, _, n, context, scale), place in zip(rows, places):
            if kind == _HELD:
                seen = rest[place] > 0
                ratio = np.zeros(len(place))
                ratio[seen] = rest[place][seen] * np.exp2(-scale[seen].astype(float))
                bins = np.where(seen, np.clip(np.floor(8 * np.log2(np.maximum(ratio, 1e-30))) + _LOW, 1, _BINS - 1), 0).astype(int)
                cell = context.astype(int) * _BINS + bins
                for k, w in enumerate((n, n * ratio)):
                    histogram[k] += np.bincount(cell, weights=w, minlength=BUCKETS * _BINS)
        m = len(rows)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.float64(), pa.float64())]
        out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([group] * m, pa.int32()), pa.array([_pack(every[p]) for p in places], pa.binary()), *none], names)
        rows.clear()
        return out

    for b in batches:
        for seg, kind, g, k, n, context, scale in zip(*(b.column(c) for c in ("seg", "kind", "g", "k", "n", "bucket", "scale"))):
            if g.as_py() != group:
                if rows:
                    yield close()
                group = g.as_py()
            held = (_unpack(context.as_py(), np.uint8), _unpack(scale.as_py(), np.float32)) if context.is_valid else (None, None)
            rows.append((seg.as_py(), kind.as_py(), np.cumsum(_unpack(k.as_py(), np.uint64)), _unpack(n.as_py(), np.uint32), *held))
    if rows:
        yield close()
    cells = np.flatnonzero(histogram[0])
    m = len(cells)
    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(cells), *(pa.array(h[cells]) for h in histogram)], names)


def weights_of(cells: np.ndarray, held: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The bigram's weight in each context bucket, from the histogram; an unseen context has none, a bucket without
    held-out bigrams takes the nearest lower one's."""
    out = np.zeros(BUCKETS)
    for k in range(1, BUCKETS):
        here = (cells // _BINS) == k
        out[k] = mixture(held[here], ratio[here] / held[here]) if here.any() else out[k - 1]
    return out


def score(docs: DataFrame, modulus: int = 7, out: int = 2, held: int = 3, head_rows: int = HEAD_ROWS, segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs."""
    spark = docs.sparkSession
    counted = _count(docs, modulus, out, held).withColumn("c", F.col("n_rest") + F.col("n_held"))
    place = F.monotonically_increasing_id()
    table = stash(counted.withColumn("place", place))  # written, so a word keeps its place
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sums = table.agg(F.sum("n_rest").alias("rest"), F.sum("c").alias("n"), F.count("*").alias("v"), (F.max(task) + 1).alias("tasks"), F.max(row).alias("rows")).first()
    rest, n, v, tasks = sums["rest"] or 0, sums["n"] or 0, sums["v"], sums["tasks"] or 1
    g, g_rest, g_held = _trigrams(table)
    learner = Spelling(g[g_rest > 0], g_rest[g_rest > 0])
    learner.learn(g[g_held > 0], g_held[g_held > 0].astype(float))
    spelling = Spelling(g, g_rest + g_held, learner.weights)
    own = _own_weight(table, learner, rest) if n else 0.0
    by_rest, by_every = Words(own if rest else 0.0, rest, learner), Words(own, n, spelling)

    cut = cut_for(table, "c", head_rows)
    head = table.filter((F.col("c") >= cut) & (F.col("w") != END)).select("w", "n_rest", "c").orderBy(F.desc("c"), "w").toArrow()
    end = table.filter(F.col("w") == END).agg(F.sum("n_rest").alias("n_rest"), F.sum("c").alias("c")).first()
    words = [END, b"", *head["w"].to_pylist()]  # no token is empty, so OTHER's place has no word
    counts = {c: np.concatenate([[end[c] or 0, 0], head[c].to_numpy()]).astype(float) for c in ("n_rest", "c")}
    voc = Vocabulary(words, counts["n_rest"], counts["c"], by_rest.log10(words, counts["n_rest"]), by_every.log10(words, counts["c"]))
    if len(words) + ((sums["rows"] or 0) + 1) * tasks >= 1 << 32:
        raise ValueError("over 2**32 places of words: bigram keys would not fit 64 bits")
    ids = (F.lit(len(words)) + row * tasks + task).alias("id")
    rare_table = table.filter((F.col("c") < cut) & (F.col("w") != END)).select("w", ids, "n_rest", "c")
    packed = spark.sparkContext.broadcast(voc)
    learned, model = spark.sparkContext.broadcast(by_rest), spark.sparkContext.broadcast(by_every)

    groups = min(GROUPS, 1 + n // GROUP)
    segs = stash(_segments(docs, modulus, out, held, packed, segment))
    asked = segs.select("seg", F.posexplode("rare").alias("k", "w"))
    known = stash(asked.join(rare_table, "w").groupBy("seg").agg(F.collect_list(F.struct("k", "id", "n_rest", "c")).alias("known")))
    whole = segs.drop("rare").join(known, "seg", "left")
    sent = whole.drop("doc_ids").mapInArrow(_sent(packed, learned, groups), "seg long, kind int, g int, k binary, n binary, bucket binary, scale binary")
    back = stash(sent.repartition("g").sortWithinPartitions("g").mapInArrow(_counted, "seg long, g int, n binary, cell long, held double, ratio double"))
    seen = back.filter("seg is null").groupBy("cell").agg(F.sum("held").alias("held"), F.sum("ratio").alias("ratio")).orderBy("cell").toArrow()
    weights = weights_of(*(seen[c].to_numpy() for c in ("cell", "held", "ratio")))
    got = back.filter("seg is not null").groupBy("seg").agg(F.collect_list(F.struct("g", "n")).alias("got"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, every = packed.value, model.value
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                s = _Segment(row)
                keys, at = np.unique(s.keys(), return_inverse=True)
                sent_keys = np.flatnonzero(_known(keys))
                order, g, _ = _dealt(keys[sent_keys], groups)
                n_of = np.zeros(len(keys))
                if len(g):
                    found = {x["g"].as_py(): x["n"].as_py() for x in row["got"].values}
                    n_of[sent_keys[order]] = np.concatenate([_unpack(found[int(x)], np.int64) for x in g])
                count = s.by_token(head.every, s.rare_every)
                context = before(count, s.sizes, head.every[END_ID])
                weight = weights[bucket(context)]
                with np.errstate(divide="ignore"):
                    pair = np.log(weight * n_of[at] / np.maximum(context, 1))
                word = s.by_token(head.log_every, every.log10(s.rare, s.rare_every)) * math.log(10)
                logs = np.logaddexp(pair, np.log1p(-weight) + word) / math.log(10)
                m, starts = len(s.sizes), np.cumsum(s.sizes) - s.sizes
                cols = [row["doc_ids"].values, pa.array([row["kind"].as_py() == _OUT] * m, pa.bool_()), pa.array(s.sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.full(m, n, dtype=np.int64))]
                cols += [pa.array(np.add.reduceat(np.log10(count + 1), starts) - s.sizes * math.log10(n + v + 1)), pa.array(np.add.reduceat(logs, starts))]
                yield pa.RecordBatch.from_arrays(cols, names)

    types = (T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    return whole.join(got, "seg", "left").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(a, t) for a, t in zip(names[1:], types))]))
