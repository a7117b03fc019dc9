"""Near-duplicates by SimHash: a positional inverted index of fingerprints proposes, exact Jaccard of word shingles decides.

Two texts are linked when their sets of hashed shingles have a similarity of NEAR (4/5) or more. Texts of one set form a
class. At a similarity of 0.8 each bit of two SimHash fingerprints differs with a probability of at most 0.1515 (the angle
of the sets over pi), too much for 64 bits and four of them. So a class has a fingerprint of WORDS words, cut into 85
positional units of UNIT bits, and is posted under the value of each unit. A pair at exactly 0.8 shares none of them with a
probability of 3e-6, above that with less. Those that meet in a posting list and whose sizes allow a similarity of 0.8 are
verified by EXTRA further words: they go on if at most FAR of those 192 bits differ (29 are expected at 0.8 and 96 of unlike
texts). Sets of at most SMALL shingles, whose votes are too few for these figures, are also posted under themselves and under
what each shingle leaves when it goes, which finds every link of a smaller set exactly.

Every list of a large group would propose the group's links again. So the first FIRST units (and small sets) are posted alone;
a posting of the other units carries the smallest class that these linked its class to, and links within one such are not proposed.

Classes that are connected this way are candidate groups; each member's whole set then goes to its group's task, where every
pair that can reach 0.8 is found from its rarest shingles and counted exactly. A group of over BLOCK shingles is dealt to
blocks by hash and its sets go to the task of each pair of blocks, so that no task holds more than two blocks.

Defined results: a null text or one without words has the empty set, and all such are one class; a repeated row gets its
own output row; a null id takes the component of its class, and of null ids alone one row stays; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, small, spread, stash
from .simhash import _Union, roots, shingle_hashes

SHINGLE = 5
NEAR = (4, 5)
WORDS, EXTRA = 17, 3
UNIT, FAR = 12, 60
SMALL = 8
#: Units that are posted before the others.
FIRST = 10
BLOCK = 1_500_000
#: Members of a posting list that are compared pair by pair at once; of longer lists a spanning forest is sought.
ROOM = 128
_draw = np.random.default_rng(42)
_TURN = _draw.integers(0, 1 << 64, WORDS + EXTRA, dtype=np.uint64)
_TIMES, _MIX = (_draw.integers(0, 1 << 63, (2, WORDS + EXTRA), dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, shingle), dtype=np.uint64))


def fingerprint(values: np.ndarray) -> np.ndarray:
    """The SimHash of a set: WORDS + EXTRA words, each bit by strict majority over the hashes, remixed for every word."""
    ones = np.zeros((8, 8 * (WORDS + EXTRA)), dtype=np.int64)
    for k in range(0, len(values), 255):  # no more, as a byte counts the votes of its bit
        h = (values[k : k + 255, None] ^ _TURN) * _TIMES
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        for bit in range(8):
            ones[bit] += ((h >> np.uint64(bit)) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits((2 * ones > len(values)).T, axis=1, bitorder="little").ravel().view(np.uint64)


def units(fps: np.ndarray) -> np.ndarray:
    """The posting keys of fingerprints, one a row: place of the unit and its value."""
    per = 64 // UNIT
    cut = (fps[:, :WORDS, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(UNIT))) & np.uint64((1 << UNIT) - 1)
    return ((np.arange(WORDS * per, dtype=np.uint64) << np.uint64(UNIT)) | cut.reshape(len(fps), -1)).view(np.int64)


def small_keys(values: np.ndarray) -> list[int]:
    """Keys of a set of SMALL shingles or less that can have a link: of itself and of it without each of its shingles."""
    if not NEAR[0] <= len(values) <= SMALL:
        return []
    sets = [values, *(np.delete(values, k) for k in range(len(values)))]
    return [xxhash.xxh64_intdigest(s.tobytes(), 43) - (1 << 63) for s in sets]


def _marked(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th, cls, n, fp and few (keys of small sets) of every row of doc_id, th, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n, fps, few = [], [], [], []
            for x in b.column("text"):
                s = shingle_set(x.as_py(), shingle)
                cls.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                n.append(len(s))
                fps.append(fingerprint(s).tobytes() if len(s) >= NEAR[0] else None)
                few.append(small_keys(s))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(np.array(cls, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(few, pa.list_(pa.int64()))],
                ["doc_id", "th", "cls", "n", "fp", "few"],
            )

    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("th", "cls", "n")), T.StructField("fp", T.BinaryType()), T.StructField("few", T.ArrayType(T.LongType()))])
    return in_arrow(rows, run, schema)


_POSTED = ["key", "n", "top", "x", "y", "z"]


def _posted(low: int, high: int | None):
    """Over rows of top, n, fp, few: a row for each posting under the units from low to high and under few, with the EXTRA words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n, top = (b.column(c).to_numpy() for c in ("n", "top"))
                fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, WORDS + EXTRA)
                few = b.column("few").to_pylist()
                whose = np.flatnonzero(n >= SMALL)
                keys = units(fps[whose])[:, low:high]
                owner = np.r_[np.repeat(whose, keys.shape[1]), np.repeat(np.arange(len(few)), [len(f) for f in few])].astype(np.int64)
                key = np.r_[keys.ravel(), np.array([k for f in few for k in f], dtype=np.int64)]
                extra = fps[:, WORDS:].view(np.int64)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, n[owner], top[owner], *extra.T)], _POSTED)

    return run


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the EXTRA words allow a similarity of NEAR; n is the size of the larger set."""
    return (np.bitwise_count(x ^ y).sum(axis=-1) <= FAR) | (n <= SMALL)


def _spanning(n: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a posting list, in order of n, under sizes and words that allow a similarity of NEAR."""
    low, high = np.searchsorted(NEAR[1] * n, NEAR[0] * n, "left"), np.searchsorted(NEAR[0] * n, NEAR[1] * n, "right")
    left, edges = np.ones(len(n), dtype=bool), []
    for first in range(len(n)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo:
            at = todo.pop()
            rest = low[at] + np.flatnonzero(left[low[at] : high[at]])
            near = rest[_close(words[rest], words[at], np.maximum(n[rest], n[at]))].tolist()
            left[near] = False
            edges += [(at, k) for k in near]
            todo += near
    return edges


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over postings sorted by key and n: edges of tops that connect the verified pairs of every list."""
    union, held = _Union(), None

    def link(key: np.ndarray, n: np.ndarray, top: np.ndarray, *extra: np.ndarray) -> None:
        words = np.stack(extra, axis=1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        long = ends - starts > ROOM
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            if (top[s:e] == top[s]).all():
                continue
            for a, b in _spanning(n[s:e], words[s:e]):
                union.add(int(top[s + a]), int(top[s + b]))
        end = np.repeat(np.where(long, 0, ends), ends - starts)
        at, k = np.arange(len(key)), 1
        while len(at := at[at + k < end[at]]):
            at = at[NEAR[1] * n[at] >= NEAR[0] * n[at + k]]  # sizes ascend, so who fails here fails with the next
            apart = at[top[at] != top[at + k]]
            for x in apart[_close(words[apart], words[apart + k], n[apart + k])].tolist():
                union.add(int(top[x]), int(top[x + k]))
            k += 1

    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(c).to_numpy() for c in _POSTED]
        if held:
            rows = [np.r_[x, y] for x, y in zip(held, rows)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last list may go on in the next batch
        if last:
            link(*(x[:last] for x in rows))
        held = [x[last:].copy() for x in rows]
        if len(union.up) > 500_000:
            yield union.batch()
    if held:
        link(*held)
    yield union.batch()


def forest(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that span the components of sets under a similarity of NEAR or more."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    df = np.bincount(ids, minlength=len(values))
    stop = np.cumsum(df)
    mark = np.zeros(len(values), dtype=np.int64)
    left, more, edges = np.ones(len(sets), dtype=bool), len(sets), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], more, todo = False, more - 1, [first]
        while todo and more:
            at = todo.pop()
            own, n = ids[starts[at] : ends[at]], int(sizes[at])
            # a set that shares 4/5 of these holds one at least of any n - ceil(4n/5) + 1 of them
            few = n - -(-NEAR[0] * n // NEAR[1]) + 1
            rare = own[np.argpartition(df[own], few - 1)[:few]]
            rare = rare[df[rare] > 1]
            if not len(rare):
                continue
            near = np.zeros(len(sets), dtype=bool)
            for t in rare.tolist():
                near[owner[stop[t] - df[t] : stop[t]]] = True
            near &= left & (NEAR[1] * sizes >= NEAR[0] * n) & (NEAR[0] * sizes <= NEAR[1] * n)
            mark[own] = 1
            for k in np.flatnonzero(near).tolist():
                both = int(mark[ids[starts[k] : ends[k]]].sum())
                if NEAR[1] * both >= NEAR[0] * (n + int(sizes[k]) - both):
                    left[k], more = False, more - 1
                    edges.append((names[at], names[k]))
                    todo.append(k)
            mark[own] = 0
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by unit: the exact edges of each group, or of each pair of its blocks."""
    held, names, sets = None, [], []

    def close() -> pa.RecordBatch:
        edges = forest(names, sets) if len(names) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        for root, cls, s in zip(*(b.column(c).to_pylist() for c in ("unit", "cls", "s"))):
            if root != held:
                yield close()
                held, names, sets = root, [], []
            if cls not in names[-1:]:  # a row that repeats id and text
                names.append(cls)
                sets.append(np.frombuffer(s, dtype=np.uint64))
    yield close()


def proposals(classes: DataFrame) -> list[DataFrame]:
    """Edges (a, b, n) over cls, by the first units and then by the others, that together connect all verified pairs."""
    posted = classes.filter(F.col("n") >= NEAR[0]).select("cls", "n", "fp", "few")
    found = []
    for low, high in ((0, FIRST), (FIRST, None)):
        if found:
            up = found[0].groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))
            posted = posted.filter(F.col("n") >= SMALL).join(up, posted.cls == up.v, "left").withColumn("few", F.array().cast("array<long>"))
        rows = posted.select((F.coalesce("root", "cls") if found else F.col("cls")).alias("top"), "n", "fp", "few")
        lists = in_arrow(rows, _posted(low, high), ", ".join(f"{c} long" for c in _POSTED)).repartition("key").sortWithinPartitions("key", "n", "top")
        found.append(stash(lists.mapInArrow(_meet, "a long, b long, n long")))
    return found


def _rooted(docs: DataFrame, shingle: int, block: int) -> tuple[DataFrame, DataFrame, int, int]:
    """doc_id, th and cls of every row; cls, its least doc_id and th, rows and root of every class; how many classes and rows."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("binary").alias("text"))
    marked = stash(_marked(rows, shingle))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    classes = stash(marked.groupBy("cls").agg(least, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("few").alias("few"), F.count("*").alias("rows")).select("cls", "least.doc_id", "least.th", "n", "fp", "few", "rows"))
    first, other = proposals(classes)
    groups = roots(first.union(other).select("a", "b"))
    groups = stash(groups.union(groups.select("root", "root").distinct()).toDF("cls", "root"))
    members = groups.join(classes.select("cls", "n", F.col("doc_id").alias("least"), F.col("th").alias("its")), "cls")
    large = stash(members.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")).filter("blocks > 1"))
    wanted = stash(members.join(small(large, large.count()), "root", "left").select("cls", "root", "least", "its", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    chosen = rows.join(small(wanted, wanted.count()), (F.col("th") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("root", "cls", "blocks", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                found = [shingle_set(x.as_py(), shingle).tobytes() for x in s.column("text")]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in ("root", "cls", "blocks")), pa.array(found, pa.binary())], ["root", "cls", "blocks", "s"])

    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = in_arrow(chosen, sets, "root long, cls long, blocks int, s binary").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "cls", "s")
    whole = dealt.repartition("unit").sortWithinPartitions("unit", "cls")
    up = roots(stash(in_arrow(whole, _verify, "a long, b long")))
    rooted = stash(classes.join(up, classes.cls == up.v, "left").select("cls", "doc_id", "th", "rows", F.coalesce("root", "cls").alias("root")))
    n_classes, n_rows = rooted.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    return marked.select("doc_id", "th", "cls"), rooted, n_classes, n_rows


def components(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id (smallest id reachable over links) for every row of docs."""
    marked, rooted, n_classes, n_rows = _rooted(docs, shingle, block)
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = stash(spread(rooted.select("cls", "root", "rows"), lowest, "root", n_classes).select("cls", "component_id", F.col("rows").alias("n")))
    return spread(marked.select("doc_id", "cls"), named, "cls", n_rows).select("doc_id", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row of docs for each component: that of the smallest id, or one without an id where none has one.

    A row is known by its id and text, so rows without an id go as others do, and an id that several texts have goes with each
    of them by itself. Of several texts of that id in the component the one with the smallest hash stays, of rows that repeat
    both the one whose columns are smallest as JSON. Only ids and hashes are shuffled, but for the rows that repeat both.
    """
    marked, rooted, n_classes, n_rows = _rooted(docs, shingle, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    lowest = rooted.groupBy("root").agg(first, F.count("*").alias("n")).select("root", F.col("first.doc_id").alias("least"), F.col("first.th").alias("its"), "n")
    named = stash(spread(rooted.select("cls", "root", "rows"), lowest, "root", n_classes).select("cls", "least", "its", F.col("rows").alias("n")))
    stays = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("th") == F.col("its"))
    pairs = spread(marked, named, "cls", n_rows).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.first(stays).alias("_stays"), F.count("*").alias("_n"))
    found = stash(pairs.filter("NOT _stays OR _n > 1"))
    gone, twice = (found.filter(c).select("_id", "_th") for c in ("NOT _stays", "_stays"))
    id_, th = docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    those = lambda df: id_.eqNullSafe(df["_id"]) & (th == df["_th"])
    again = twice.count()
    kept = docs.join(small(gone, gone.count()), those(gone), "left_anti")
    if not again:
        return kept
    repeated, row = docs.join(small(twice, again), those(twice), "left_semi"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = repeated.groupBy(id_, th).agg(F.min_by(row, F.to_json(row)).alias("row")).select(F.col("row").alias("it"))
    return kept.join(small(twice, again), those(twice), "left_anti").union(least.select("it.*"))
