"""Periodic runs of words: stretches that repeat a period of q words at least four times, and texts without the repeats.

A run is a stretch with smallest period q (words q apart are identical) of max(6, 4q) words or more that no neighbouring
word extends. For each power of two b, the blocks of b words that start at multiples of b are the integer-sequence keys of
an Aho-Corasick automaton, which is searched across the document. A run with b <= q < 2b holds an aligned block whole
whose copy q words on is in the run too, so every run has an occurrence at a distance of b up to 2b - 1 from a block of
its own words. Such an occurrence seeds an exact extension to both sides. A seed within a run of a period that divides its
distance belongs to that run; as scales go up, those runs are known by then, and so what is left has q as its smallest period.

Blocks whose first words (up to four) don't recur at a distance of their scale can't seed anything and are no keys. Texts
are read in chunks of some CHUNK bytes, with a separator between documents that no run can cross; a longer text is a chunk
of its own, and no text is cut.

Defined results: words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes, numbered from 0; a null text has no words; rows that
repeat an id are rows of their own; ids may be null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: A run has so many words at least, and repeats its period so often.
WORDS, TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _agree_until(codes: np.ndarray, i: int, q: int) -> int:
    """The first place from i on that differs from the one q further, or has none there."""
    step = 16
    while (n := min(step, len(codes) - q - i)) > 0:
        differ = codes[i : i + n] != codes[i + q : i + q + n]
        if differ[k := int(differ.argmax())]:
            return i + k
        i, step = i + n, step * 4
    return i


def _agree_from(codes: np.ndarray, i: int, q: int) -> int:
    """The first of the places up to i that agree, one after another, with those q further."""
    step = 16
    while (n := min(step, i)) > 0:
        differ = codes[i - n : i] != codes[i - n + q : i + q]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i, step = i - n, step * 4
    return i


class _Grams:
    """For each place, the next place but a few with the same words."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n, self.rank = len(codes), codes.astype(np.int64)
        self._sort()

    def _sort(self) -> None:
        order = np.argsort(self.rank, kind="stable")
        self.keys = self.rank[order] * self.n + order

    def double(self, width: int) -> None:
        """Grams of twice the width; those that the end cuts off get a rank of their own."""
        pair = np.full(self.n, -1, dtype=np.int64)
        if self.n > width:
            pair[: self.n - width] = self.rank[: self.n - width] * (int(self.rank.max()) + 2) + self.rank[width:]
        self.rank = np.unique(pair, return_inverse=True)[1]
        self._sort()

    def recur(self, at: np.ndarray, b: int) -> np.ndarray:
        """Whether the gram at each place is found again b to 2b - 1 places on."""
        base = self.rank[at] * self.n
        k = np.searchsorted(self.keys, base + np.minimum(at + b, self.n))
        found = self.keys[np.minimum(k, self.n - 1)]
        return (k < self.n) & (found >= base + at + b) & (found < base + np.minimum(at + 2 * b, self.n))


def _seeds(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, b: int, grams: _Grams) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, distances) of the occurrences that the automaton of scale b finds at a fitting distance."""
    at = np.arange(0, len(codes) - b, b)
    at = at[grams.recur(at, b)]
    none = np.empty(0, dtype=np.int64)
    if not len(at):
        return none, none
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple[int, ...], int] = {}
    block = np.full(len(codes) // b + 1, -1, dtype=np.int64)
    for a in at.tolist():
        key = tuple(codes[a : a + b].tolist())
        if (k := number.setdefault(key, len(number))) == len(number) - 1:
            automaton.add_word(key, k)
        block[a // b] = k
    automaton.make_automaton()
    found = np.full(len(codes), -1, dtype=np.int64)
    for d in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
        s = int(starts[d])
        hits = list(automaton.iter(tuple(codes[s : int(ends[d])].tolist())))
        if hits:
            e, k = np.array(hits, dtype=np.int64).T
            found[s + e - b + 1] = k
    place = np.flatnonzero(found >= 0)
    place = place[place >= b]
    own = (place - b) // b
    fits = block[own] == found[place]
    return own[fits] * b, place[fits] - own[fits] * b


def find_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of sequences that lie one after another, each with a code of its own behind it."""
    runs: list[tuple[int, int, int]] = []
    if not len(codes):
        return runs
    b, grams, longest = 1, _Grams(codes), int((ends - starts).max())
    while TIMES * b <= longest:
        if b in (2, 4):
            grams.double(b // 2)
        at, q = _seeds(codes, starts, ends, b, grams)
        known = np.zeros(len(at), dtype=bool)
        for s, n, p in runs:
            part = slice(np.searchsorted(at, s), np.searchsorted(at, s + n))
            known[part] |= (q[part] % p == 0) & (at[part] + q[part] + b <= s + n)
        at, q = at[~known], q[~known]
        order = np.lexsort((at, q))
        last_q = upto = -1
        for a, p in zip(at[order].tolist(), q[order].tolist()):
            if p == last_q and a < upto:
                continue
            first, last_q, upto = _agree_from(codes, a, p), p, _agree_until(codes, a + b, p)
            if upto + p - first >= max(WORDS, TIMES * p):
                runs.append((first, upto + p - first, p))
        b *= 2
    return sorted((s, n, p) for s, n, p in runs)


def _chunk(texts: list[bytes | None]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs of each text, in its own word numbers, and the texts without what runs repeat."""
    whole = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", dtype=np.uint8)
    space = (whole == 0x20) | ((whole >= 0x09) & (whole <= 0x0D))
    edge = np.diff(space.astype(np.int8), prepend=1)
    begins, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = stops - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole[~space].tobytes())])
    code = np.asarray(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), dtype=np.int64)
    opens = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    upto = np.searchsorted(begins, opens)  # words before each text
    document = np.repeat(np.arange(len(texts)), np.diff(upto))
    codes = np.empty(len(code) + len(texts), dtype=np.int64)
    codes[np.arange(len(code)) + document] = code
    ends = upto[1:] + np.arange(len(texts))
    codes[ends] = (int(code.max()) + 1 if len(code) else 0) + np.arange(len(texts))
    starts = upto[:-1] + np.arange(len(texts))
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    keep = np.ones(len(codes), dtype=bool)
    for s, n, p in find_runs(codes, starts, ends):
        d = int(np.searchsorted(starts, s, side="right")) - 1
        own[d].append((s - int(starts[d]), n, p))
        keep[s + p : s + n] = False
    kept = np.delete(keep, ends)
    # every word with one space behind it, then those that stay
    spaced = whole[~space | (edge == 1)]
    spaced = spaced.copy()
    spaced[np.cumsum(sizes + 1) - 1] = 0x20
    stays = np.repeat(kept, sizes + 1)
    cuts = np.concatenate([[0], np.cumsum(np.where(kept, sizes + 1, 0))])[upto]
    out = spaced[stays].tobytes()
    return own, [out[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and then period) and collapsed, the text's words without
    those that a run holds after its first period, joined by one space."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, a = b.column("text").to_pylist(), 0
            while a < len(texts):
                z, size = a + 1, len(texts[a] or b"")
                while z < len(texts) and size + len(texts[z] or b"") <= CHUNK:
                    size += len(texts[z] or b"")
                    z += 1
                runs, left = _chunk(texts[a:z])
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), pa.array(rows, shape), pa.array(left, pa.binary())], ["doc_id", "runs", "collapsed"])
                a = z

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = own.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, in a tenth of which (by the id's hash) the words from some place on repeat a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")
    g, n = F.floor(h / 10), F.size(F.coalesce(words, F.array().cast("array<string>")))
    a = F.col("a").cast("int")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.when((h % 10 == 0) & (n > 0), g % n).alias("a"), g.alias("g"))
    left = F.size("words") - a
    p = (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What `detect` found as one row of numbers and hashes per document."""
    r = lambda c: F.col(f"_r.{c}")
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    ranked = F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period")))
    best = found.withColumn("_r", F.array_max(ranked))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-r("start")).alias("start"), r("length").alias("length"), (-r("period")).alias("period"),
        F.expr("(1000 * _r.length) div (-_r.period)").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(docs: DataFrame) -> DataFrame:
    return digests(detect(with_repeats(docs)))
