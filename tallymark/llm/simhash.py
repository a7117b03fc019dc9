"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 positional bytes. Single posting
lists (8 x 256 of them) grow with the corpus, so postings are intersected four at a time: the pairs that meet under one of
the 70 four-byte keys are exactly the pairs whose tally of shared positional bytes reaches 4. They are then verified by
their Hamming distance. Only distinct fingerprints enter the index, and a key's members yield a spanning forest of their
links, never all their pairs.

Defined results: a null text or one without words has fingerprint zero, linked like any other; a repeated row gets its
own output row; a null id keeps its fingerprint and takes the component of its class; ties go to the smallest id; an empty
table gives an empty table; other columns are ignored by `components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, spread, stash

SHINGLE = 4
MAX_BITS = 4
#: Members of one key that a task compares at a time; larger keys are split into pairs of blocks of this size.
BLOCK = 4096
#: Tasks among which `roots` deals the edges of a vertex.
SALT = 16
_CHUNK = 1 << 15


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of a UTF-8 text; fewer words than a shingle has are one."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = list(accumulate(map(len, words), lambda a, x: a + 1 + x))
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text: its shingles' hashes, each bit by strict majority."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(values), _CHUNK):
        part = values[k : k + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row, over whole texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that span the components of members (signed longs) under links of at most max_bits."""
    x = members.view(np.uint64)
    left, edges = np.ones(len(x), dtype=bool), []
    while left.any():
        first = int(np.flatnonzero(left)[0])
        left[first] = False
        todo = [first]
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(x[rest] ^ x[at]) <= max_bits]
            left[near] = False
            edges += [(int(members[at]), int(members[k])) for k in near]
            todo += near.tolist()
    return edges


class _Union:
    """Union-find that shortens what a task emits to one edge per vertex, towards the smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        top = a
        while (t := self.up.setdefault(top, top)) != top:
            top = t
        while self.up[a] != top:
            self.up[a], a = top, self.up[a]
        return top

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        pairs = [(a, r) for a in list(self.up) if (r := self.root(a)) != a]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)] + [pa.array([0] * len(pairs), pa.int64())], ["a", "b", "n"])


def _link(max_bits: int, block: int):
    """Over rows sorted by key: edges (a, b, 0), and (key, 0, n) for each key of n > block members, left for later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = _Union()
        held_key, held, dropped = None, [], 0

        def close() -> pa.RecordBatch | None:
            nonlocal held, dropped
            out = None
            if dropped:
                out = pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (held_key, 0, dropped + sum(map(len, held)))], ["a", "b", "n"])
            elif held:
                for a, b in _forest(np.concatenate(held), max_bits):
                    union.add(a, b)
            held, dropped = [], 0
            return out

        for b in batches:
            if not b.num_rows:
                continue
            key, fp = (b.column(c).to_numpy() for c in ("key", "fp"))
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            size = ends - starts
            inner = np.ones(len(starts), dtype=bool)
            inner[[0, -1]] = False  # may go on in a neighbouring batch
            two = starts[inner & (size == 2)]
            near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= max_bits]
            for k in near.tolist():
                union.add(int(fp[k]), int(fp[k + 1]))
            for k in np.flatnonzero((inner & (size > 2)) | ~inner).tolist():
                part = fp[starts[k] : ends[k]]
                if key[starts[k]] != held_key:
                    if (out := close()) is not None:
                        yield out
                    held_key = int(key[starts[k]])
                if dropped or sum(map(len, held)) + len(part) > block:
                    dropped += len(part)
                else:
                    held.append(part.copy())
            if len(union.up) > 500_000:
                yield union.batch()
        if (out := close()) is not None:
            yield out
        yield union.batch()

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span the link components of the distinct fingerprints in column fp."""
    need = 8 - max_bits
    if not 1 <= need <= 8:
        raise ValueError("max_bits must be from 0 to 7")
    masks = [sum(0xFF << 8 * p for p in c) for c in combinations(range(8), need)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("s", "v")).select(F.xxhash64("s", "v").alias("key"), "fp")
    schema = "a long, b long, n long"
    first = stash(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_link(max_bits, block), schema))
    edges = first.filter("n = 0").select("a", "b")
    large = first.filter("n > 0").select(F.col("a").alias("key"), "n")
    if count := large.count():
        side = large.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).select("key", "blocks")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        units = (
            keys.join(small(side, count), "key")
            .withColumn("own", own)
            .select("key", "fp", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
            .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        )
        again = units.repartition("key").sortWithinPartitions("key").mapInArrow(_link(max_bits, 1 << 62), schema)
        edges = edges.union(stash(again.select("a", "b")))
    return edges.distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex of its component.

    Alternating large-star and small-star steps, each a join with per-vertex minima, in which a vertex of many edges
    is dealt to SALT tasks; every round is written to the shared folder, so lineage stays short. Ends when a round changes nothing.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every vertex meets its minimum in SALT places, so that one of many edges is not a single task's
        salted = both.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(11)), F.lit(SALT)).cast("int"))
        pairs = salted.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["a", "salt"])
        if large:
            out = pairs.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = pairs.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.filter("a <> b").distinct()

    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (at := state(now)) != before:
        before = at
        if not at[0]:
            break
        now = stash(star(star(now, True), False))
    return now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) for every row of docs."""
    marked = stash(fingerprints(docs, doc_id, text, shingle))
    classes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    up = roots(links(classes.select("fp"), max_bits))
    rooted = stash(classes.join(up, classes.fp == up.v, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    n_classes, n_rows = rooted.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = stash(spread(rooted, lowest, "root", n_classes).select("fp", "component_id", F.col("rows").alias("n")))
    return spread(marked, named, "fp", n_rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each component (found: doc_id, component_id): that of its smallest doc_id, with its columns.

    Rows without an id cannot be named and all stay; of rows that repeat the smallest id, the one with the smallest text
    stays (then the smallest by its other columns as JSON). Only ids are shuffled, but for the rows of repeated ids.
    """
    gone = stash(found.filter("doc_id <> component_id").select("doc_id").distinct())
    twice = stash(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    kept, again = docs.join(small(gone, gone.count()), "doc_id", "left_anti"), twice.count()
    if not again:
        return kept.select(*docs.columns)
    repeated, row = kept.join(small(twice, again), "doc_id", "left_semi"), F.struct(*docs.columns)
    least = repeated.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select(F.col("row").alias("it"))
    return kept.join(small(twice, again), "doc_id", "left_anti").select(*docs.columns).union(least.select("it.*"))
