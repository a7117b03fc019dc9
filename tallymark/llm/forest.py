"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one queue over all of them, exact reranking.

Equal vectors are one class, of which only the first ids matter, so a vector that a third of the rows repeat is one row of
the index. The trees are fitted on a bounded sample of classes (FIT_ROWS, by a hash of the vector): each node projects on
the difference of two of its sample's unit vectors and splits at the median. Every class is then sent down every tree, so
the index holds all rows; a leaf has about LEAF_ROWS of them, or as many as the sample's leaves of MIN_FIT allow.

A query enters the roots of all trees into one priority queue. A node costs the squared distances to the planes that were
crossed to reach it; the cheapest node of any tree comes first, until the leaves that came out hold `budget` rows. The
budget is calibrated: for at most CALIBRATE queries a scan finds the true neighbours, and the budget is the least that
finds `recall` of them. So hard data cost more, and recall does not fall as the table grows.

All rows of the leaves that came out are scored exactly. Rows and queries meet leaf by leaf; a leaf with over BLOCK rows or
queries is dealt in blocks, so nothing is dropped and no task holds more than a block of each.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
without an id; a query meets only vectors of its own length; rows that repeat an id are candidates and queries each, and
only the query's own row is none of its candidates; ties go to the smaller id; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stash

FIT_ROWS = 65_536
MIN_FIT = 4
LEAF_ROWS = 256
CALIBRATE = 256
BLOCK = 4096
_ROWS = 4096
OUT = "query_id long, rank int, vec_id long, score double"


class Forest:
    """Trees as flat arrays: of an inner node its plane and both children, of a leaf -1 minus its number."""

    def __init__(self, unit: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.roots: list[int] = []
        self.leaves = 0
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.kids: list[list[int]] = []
        for _ in range(trees):
            self.roots.append(self._grow(unit, np.arange(len(unit)), leaf, rng))
        self.plane = np.array(self.normals).reshape(-1, unit.shape[1])
        self.cut, self.child = np.array(self.cuts), np.array(self.kids, dtype=np.int64).reshape(-1, 2)

    def _grow(self, unit: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        todo: list[tuple[np.ndarray, int, int]] = [(rows, -1, 0)]
        root = 0
        while todo:
            rows, parent, side = todo.pop()
            split = self._split(unit, rows, rng) if len(rows) > leaf else None
            if split is None:
                self.leaves += 1
                node = -self.leaves
            else:
                node = len(self.kids)
                normal, cut, right = split
                self.normals.append(normal)
                self.cuts.append(cut)
                self.kids.append([0, 0])
                todo += [(rows[~right], node, 0), (rows[right], node, 1)]
            if parent < 0:
                root = node
            else:
                self.kids[parent][side] = node
        return root

    @staticmethod
    def _split(unit: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
        """A plane that has rows on both sides; None if a few draws find none."""
        for _ in range(4):
            a, b = unit[rng.choice(rows, 2, replace=False)]
            if (size := float(np.linalg.norm(a - b))) > 1e-12:
                normal = (a - b) / size
                at = unit[rows] @ normal
                cut = float(np.median(at))
                right = at > cut
                if right.any():
                    return normal, cut, right
        return None

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        """Rows by trees: the leaf of each unit vector in each tree."""
        out = np.empty((len(unit), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            node = np.full(len(unit), root, dtype=np.int64)
            while (at := np.flatnonzero(node >= 0)).size:
                here = node[at]
                right = np.einsum("ij,ij->i", unit[at], self.plane[here]) > self.cut[here]
                node[at] = self.child[here, right.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def costs(self, unit: np.ndarray) -> np.ndarray:
        """Queries by leaves: what each leaf costs."""
        far = unit @ self.plane.T - self.cut
        out = np.zeros((len(unit), self.leaves))
        for root in self.roots:
            todo = [(root, np.zeros(len(unit)))]
            while todo:
                node, cost = todo.pop()
                if node < 0:
                    out[:, -1 - node] = cost
                else:
                    d = far[:, node]
                    todo += [(int(self.child[node, 0]), cost + np.square(np.maximum(d, 0))), (int(self.child[node, 1]), cost + np.square(np.minimum(d, 0)))]
        return out

    def search(self, unit: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
        """The leaves of all trees in the order of one queue, until they hold `budget` rows."""
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < budget:
            cost, node = heapq.heappop(queue)
            while node >= 0:  # the near side costs nothing more
                d = float(unit @ self.plane[node]) - float(self.cut[node])
                near = int(d > 0)
                heapq.heappush(queue, (cost + d * d, int(self.child[node, 1 - near])))
                node = int(self.child[node, near])
            found.append(-1 - node)
            held += int(sizes[-1 - node])
        return found


def _scaled(packed: pa.Array, kind: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over a power of two each, so that squares neither overflow nor vanish, and their lengths."""
    x = np.frombuffer(b"".join(packed.to_pylist()), dtype=kind).reshape(-1, d).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x
    return x, np.sqrt(np.square(x).sum(axis=1))


def _unit(packed: pa.Array, kind: str, d: int) -> np.ndarray:
    x, size = _scaled(packed, kind, d)
    return x / size[:, None]


def _pack(vectors: DataFrame, vec_id: str, embedding: str, kind: str) -> DataFrame:
    """uid, vec_id, size and packed (the components' bytes) of the vectors that take part; written, so that a uid stays a row's."""
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).filter("vec_id is not null and size(embedding) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                s = b.slice(k, _ROWS)
                sizes = np.asarray(s.column("embedding").value_lengths(), dtype=np.int64)
                values = np.asarray(s.column("embedding").flatten().to_numpy(zero_copy_only=False), dtype=kind) + np.dtype(kind).type(0)  # -0.0 is 0.0
                starts = np.cumsum(sizes) - sizes
                for d in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == d)
                    x = values[starts[at][:, None] + np.arange(d)]
                    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    at, x = at[good], x[good]
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([s.column("uid").take(take), s.column("vec_id").take(take), pa.array(np.full(len(at), d, dtype=np.int32)), pa.array((r.tobytes() for r in x), pa.binary())], ["uid", "vec_id", "size", "packed"])

    return stash(rows.mapInArrow(run, "uid long, vec_id long, size int, packed binary"))


def _classes(packed: DataFrame, asks: Column, k: int) -> DataFrame:
    """cid, first, members (the first k + 1 of its vec_id and uid), packed, size and whether a query is among them."""
    first = F.row_number().over(Window.partitionBy("size", "packed").orderBy("vec_id", "uid"))
    few = packed.withColumn("_n", first).filter(F.col("_n") <= k + 1).groupBy("size", "packed").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("members"))
    asked = packed.filter(asks).select("size", "packed").distinct().withColumn("asked", F.lit(True))
    out = few.join(asked, ["size", "packed"], "left")
    return stash(out.select(F.col("members")[0]["uid"].alias("cid"), F.col("members")[0]["vec_id"].alias("first"), "members", "packed", "size", F.coalesce("asked", F.lit(False)).alias("asked")))


def _exact(q: np.ndarray, q_size: np.ndarray, x: np.ndarray, x_size: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, always summed alike, so that a pair has one score wherever it meets."""
    return np.multiply(q, x).sum(axis=1) / (q_size * x_size)


def _best(q: tuple, x: tuple, own: np.ndarray, cid: np.ndarray, first: np.ndarray, k: int) -> tuple[list[np.ndarray], ...]:
    """(query places, row places, scores) of the k best rows of every query; its own class is none of them."""
    (qv, qs), (xv, xs) = q, x
    near = (qv / qs[:, None]) @ (xv / xs[:, None]).T
    near[own[:, None] == cid[None, :]] = -np.inf
    least = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
    i, j = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
    score = _exact(qv[i], qs[i], xv[j], xs[j])
    order = np.lexsort((first[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], score[nth < k]


def _true_neighbours(classes: DataFrame, sample: pa.Table, kind: str, d: int, k: int) -> list[tuple[int, bytes]]:
    """(place in the sample, packed) of the k nearest classes of every sampled query, by one scan."""
    packed = classes.sparkSession.sparkContext.broadcast((sample["cid"].to_numpy(), _scaled(sample["packed"], kind, d)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = packed.value
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                s = b.slice(at, _ROWS)
                i, j, score = _best(q, _scaled(s.column("packed"), kind, d), own, s.column("cid").to_numpy(), s.column("first").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), s.column("first").take(pa.array(j)), s.column("packed").take(pa.array(j)), pa.array(score)], ["q", "first", "packed", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    found = classes.select("cid", "first", "packed").mapInArrow(scan, "q int, first long, packed binary, score double").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k)
    out = [(r["q"], bytes(r["packed"])) for r in found.select("q", "packed").collect()]  # at most CALIBRATE times k rows
    packed.unpersist()
    return out


def _budget(forest: Forest, sizes: np.ndarray, sample: pa.Table, truth: list[tuple[int, bytes]], kind: str, d: int, k: int, recall: float) -> int:
    """The least number of rows in leaves with which the queue finds `recall` of the true neighbours."""
    least = len(forest.roots) * (k + 1)
    if not truth:
        return least
    leaves = forest.leaf_of(_unit(pa.array([p for _, p in truth], pa.binary()), kind, d))
    asks = np.array([q for q, _ in truth])
    need = np.empty(len(truth))
    unit = _unit(sample["packed"], kind, d)
    for q in np.unique(asks).tolist():
        order = np.argsort(forest.costs(unit[q : q + 1])[0], kind="stable")
        until = np.empty(len(order))
        until[order] = np.cumsum(sizes[order])
        mine = asks == q
        need[mine] = until[leaves[mine]].min(axis=1)
    return max(least, int(np.sort(need)[min(len(need) - 1, int(np.ceil(recall * len(need))))]))


def nearest(vectors: DataFrame, asks: Column | str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 8, recall: float = 0.95, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest other rows found for every row that `asks` (a condition on vec_id) names."""
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"
    asks = F.expr(asks) if isinstance(asks, str) else asks
    packed = _pack(vectors, vec_id, embedding, kind)
    classes = _classes(packed, asks, k)
    counts = classes.groupBy("size").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).filter("asked > 0").collect()
    parts = [_one_size(packed, classes.filter(F.col("size") == r["size"]).drop("size"), asks, r["size"], r["n"], kind, k, trees, recall, fit_rows, leaf_rows, block, seed) for r in counts]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], OUT)


def _one_size(packed: DataFrame, classes: DataFrame, asks: Column, d: int, n: int, kind: str, k: int, trees: int, recall: float, fit_rows: int, leaf_rows: int, block: int, seed: int) -> DataFrame:
    spark = classes.sparkSession
    by_hash = F.xxhash64("packed")
    fit = classes.select("packed").orderBy(by_hash, "packed").limit(fit_rows).toArrow()
    forest = Forest(_unit(fit["packed"].combine_chunks(), kind, d), trees, max(MIN_FIT, leaf_rows * fit.num_rows // n), seed)
    shared = spark.sparkContext.broadcast(forest)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                s = b.slice(at, _ROWS)
                leaves = shared.value.leaf_of(_unit(s.column("packed"), kind, d))
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(leaves.tolist(), pa.list_(pa.int32()))], [*s.schema.names, "leaves"])

    index = stash(classes.select("cid", "first", "packed", "asked").mapInArrow(down, "cid long, first long, packed binary, asked boolean, leaves array<int>"))
    # a row for each leaf of the forest, whose size the sample bounds
    held = index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toArrow()
    sizes = np.zeros(forest.leaves, dtype=np.int64)
    sizes[held["leaf"].to_numpy()] = held["count"].to_numpy()
    asked = index.filter("asked").select("cid", "packed")
    sample = asked.orderBy(by_hash, "packed").limit(CALIBRATE).toArrow().combine_chunks()
    sample = pa.table({c: sample[c].combine_chunks() for c in sample.column_names})
    truth = _true_neighbours(index, sample, kind, d, k)
    budget = _budget(forest, sizes, sample, truth, kind, d, k, recall)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                found = [shared.value.search(u, sizes, budget) for u in _unit(s.column("packed"), kind, d)]
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(found, pa.list_(pa.int32()))], ["cid", "packed", "leaves"])

    visits = stash(asked.repartition(F.col("cid")).mapInArrow(ask, "cid long, packed binary, leaves array<int>"))
    came = visits.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toArrow()
    blocks = np.maximum(1, -(-sizes // block))
    turns = np.ones(forest.leaves, dtype=np.int64)
    turns[came["leaf"].to_numpy()] = np.maximum(1, -(-came["count"].to_numpy() // block))
    seen = np.zeros(forest.leaves, dtype=bool)
    seen[came["leaf"].to_numpy()] = True
    at = np.flatnonzero(seen)
    dealt = spark.createDataFrame(pa.table({"leaf": pa.array(at, pa.int32()), "blocks": pa.array(blocks[at], pa.int32()), "turns": pa.array(turns[at], pa.int32())}))

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.withColumn("leaf", F.explode("leaves")).drop("leaves").join(F.broadcast(dealt), "leaf")
        rows = rows.withColumn(own, F.pmod(F.xxhash64("cid"), F.col(own)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"q": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(none)
        x = _scaled(left["packed"], kind, d)
        cid, first, own = left["cid"].to_numpy(), left["first"].to_numpy(), right["cid"].to_numpy()
        parts = []
        for a in range(0, len(own), 512):
            q = _scaled(right["packed"].slice(a, 512), kind, d)
            i, j, score = _best(q, x, own[a : a + 512], cid, first, k)
            parts.append(pa.table({"q": own[i + a], "cid": cid[j], "first": first[j], "score": score}))
        return pa.concat_tables(parts)

    by = ["leaf", "blocks", "turns"]
    rows = deal(index.select("cid", "first", "packed", "leaves"), "blocks", "turns").groupBy(*by)
    met = rows.cogroup(deal(visits, "turns", "blocks").groupBy(*by)).applyInArrow(meet, "q long, cid long, first long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first", "cid")
    found = met.groupBy("q", "cid").agg(F.min("first").alias("first"), F.max("score").alias("score")).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n", "first")

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, size = _scaled(b.column("packed"), kind, d)
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("cid"), pa.array(_exact(x, size, x, size))], ["q", "cid", "score"])

    every = found.select("q", "cid", "score").union(asked.mapInArrow(itself, "q long, cid long, score double"))
    lists = every.join(classes.select("cid", "members"), "cid").groupBy("q").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("s"), m["vec_id"].alias("vec_id"), m["uid"].alias("uid"))))).alias("near"))
    # the queries of a class have their list in common; only their own row is left out
    lists = stash(lists.join(classes.filter("asked").select(F.col("cid").alias("q"), "packed"), "q").select("packed", F.sort_array("near").alias("near")))
    queries = packed.filter(asks).filter(F.col("size") == d).select("uid", "vec_id", "packed")
    both = queries.join(F.broadcast(lists) if lists.count() <= BROADCAST_ROWS // 50 else lists, "packed")
    mine = F.slice(F.filter("near", lambda m: m["uid"] != F.col("uid")), 1, k)
    out = both.select(F.col("vec_id").alias("query_id"), F.posexplode(mine).alias("p", "m"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("m.vec_id").alias("vec_id"), (-F.col("m.s")).alias("score"))
