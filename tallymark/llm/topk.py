"""Exact top-k inner-product search with vector approximations.

A file is written once: of every vector a cell of CELL_BITS bits per component, by the vector's own scale, and beside it,
as another column, its exact components. A scan reads the cells alone and bounds each inner product from both sides; rows
whose upper bound is below the kth lower bound are gone. Exact vectors are then read by joins, in the order of the upper
bounds: the first few of each query, and after them those whose bound still reaches the kth score found.

Equal vectors are one class, of which only the first k + 1 rows by id can be among the k best of anything; the file holds a
class once, and its rows come back at the end. So no bound has to tell equal vectors apart, and a vector that a third of
the rows repeat costs one row. Queries, by class too, go to the tasks in slices of bounded size (SLICE_BYTES), one after
another.

Defined results: vectors that are null, empty or hold a null or non-finite component (after scaling) take no part, nor do
rows without an id; a query meets only vectors of its own length; rows that repeat an id are candidates and queries each,
and only the query's own row is none of its candidates; ties go to the smaller id; sums beyond a long are clamped to it; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stash

SLICE_BYTES = 32 << 20
#: Bits of a cell number, per component.
CELL_BITS = 6
_QUERIES = 512
_ROWS = 4096
_HELD = 1 << 20
_EXACT = 2.0**52


def _vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer vectors as float64) of the rows that take part, by vector length."""
    where = np.flatnonzero(~np.asarray(lists.is_null()))
    if not len(where):
        return
    kept = lists.take(pa.array(where))
    sizes = np.asarray(kept.value_lengths(), dtype=np.int64)
    values = np.asarray(kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(256.0 * values[starts[at][:, None] + np.arange(d)])
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield where[at[fine]], x[fine]


def _width(top: np.ndarray) -> np.ndarray:
    """The width of a vector's cells, from its largest component."""
    return np.maximum(1.0, np.ceil((2 * top + 1) / (1 << CELL_BITS)))


def approximations(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """uid, vec_id, size, top, cells and exact of the vectors that take part; written, so that a uid stays a row's."""
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).filter("vec_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                s = b.slice(k, _ROWS)
                for at, x in _vectors(s.column("embedding")):
                    top = np.abs(x).max(axis=1)
                    cells = np.clip(np.floor((x + top[:, None]) / _width(top)[:, None]), 0, (1 << CELL_BITS) - 1).astype(np.uint8)
                    take = pa.array(at)
                    cols = [s.column("uid").take(take), s.column("vec_id").take(take), pa.array(np.full(len(at), x.shape[1], dtype=np.int32)), pa.array(top)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(map(bytes, cells), pa.binary()), pa.array((r.tobytes() for r in x), pa.binary())], ["uid", "vec_id", "size", "top", "cells", "exact"])

    return stash(rows.mapInArrow(run, "uid long, vec_id long, size int, top double, cells binary, exact binary"))


class _Near:
    """The candidates of one length's queries so far, and the kth lower bound of each."""

    def __init__(self, uids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.uids, self.q, self.k = uids, q, k
        self.best = np.full((len(q), k), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held, self.room = 0, _HELD
        self.above, self.below = np.clip(q, 0, None).sum(axis=1), np.clip(q, None, 0).sum(axis=1)
        self.most = float(np.abs(q).max())

    def offer(self, uids: np.ndarray, top: np.ndarray, cells: np.ndarray) -> None:
        width = _width(top)
        low = cells * width[:, None] - top[:, None]
        for a in range(0, len(self.q), _QUERIES):
            rows = slice(a, a + _QUERIES)
            corner = self.q[rows] @ low.T
            upper, lower = (corner + side[rows, None] * (width - 1) for side in (self.above, self.below))
            if float(top.max()) * self.most * cells.shape[1] * 2 >= _EXACT:  # sums that floats round
                slack = (np.abs(self.q[rows]) @ (np.abs(low) + width[:, None]).T) * cells.shape[1] * 2.0**-50
                upper, lower = upper + slack, lower - slack
            own = self.uids[rows, None] == uids[None, :]
            upper[own] = lower[own] = -np.inf
            every = np.concatenate([self.best[rows], lower], axis=1)
            self.best[rows] = np.partition(every, every.shape[1] - self.k, axis=1)[:, every.shape[1] - self.k :]
            i, j = np.nonzero((upper >= self.best[rows].min(axis=1)[:, None]) & (upper > -np.inf))
            self.parts.append((i + a, uids[j], upper[i, j], lower[i, j]))
            self.held += len(i)
        if self.held > self.room:
            self.prune()
            self.room = max(_HELD, 2 * self.held)  # so that what stays is not looked at again and again

    def prune(self) -> tuple[np.ndarray, ...]:
        q, uids, upper, lower = (np.concatenate([p[c] for p in self.parts]) for c in range(4))
        keep = upper >= self.best.min(axis=1)[q]
        self.parts = [tuple(x[keep] for x in (q, uids, upper, lower))]
        self.held = int(keep.sum())
        return self.parts[0]


def _product(a: np.ndarray, b: np.ndarray) -> int:
    if float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) < _EXACT:
        return int(a @ b)
    return max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b))))


def _classes(file: DataFrame, asks: Column, k: int) -> DataFrame:
    """uid and vec_id (of the first row), members (the first k + 1 rows), size, top, cells, exact and asked, one row for each vector."""
    first = F.row_number().over(Window.partitionBy("exact").orderBy("vec_id", "uid"))
    few = file.withColumn("_n", first).filter(F.col("_n") <= k + 1)
    own = few.groupBy("exact").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("members"), *[F.first(c).alias(c) for c in ("size", "top", "cells")])
    asked = file.filter(asks).select("exact").distinct().withColumn("asked", F.lit(True))
    out = own.join(asked, "exact", "left")
    return stash(out.select(F.col("members")[0]["uid"].alias("uid"), F.col("members")[0]["vec_id"].alias("vec_id"), "members", "size", "top", "cells", "exact", F.coalesce("asked", F.lit(False)).alias("asked")))


def top_k(vectors: DataFrame, asks: Column | str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows for every row that `asks` (a condition on vec_id) names."""
    spark = vectors.sparkSession
    asks = F.expr(asks) if isinstance(asks, str) else asks
    rows = approximations(vectors, vec_id, embedding)
    file = _classes(rows, asks, k)
    asked = file.filter("asked")
    slices = max(1, -(-(asked.agg(F.sum(8 * F.col("size"))).first()[0] or 0) // slice_bytes))

    def one(part: int) -> DataFrame:
        """q and uid (classes) and score: the k best other classes of the slice's queries, and their own."""
        table = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(slices)) == part).select("uid", "vec_id", "size", "exact").toArrow()
        uids, sizes, exact = table["uid"].to_numpy(), table["size"].to_numpy(), table["exact"].to_pylist()
        groups = [(uids[at], np.stack([np.frombuffer(exact[i]) for i in at])) for at in (np.flatnonzero(sizes == d) for d in np.unique(sizes))]
        packed = spark.sparkContext.broadcast(groups)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = {q.shape[1]: _Near(own, q, k) for own, q in packed.value}
            for b in batches:
                for at in range(0, b.num_rows, _ROWS):
                    s = b.slice(at, _ROWS)
                    size, uid, top = (s.column(c).to_numpy() for c in ("size", "uid", "top"))
                    for d in np.unique(size).tolist():
                        if d in near:
                            here = np.flatnonzero(size == d)
                            cells = np.frombuffer(b"".join(s.column("cells").take(pa.array(here)).to_pylist()), dtype=np.uint8).reshape(-1, d)
                            near[d].offer(uid[here], top[here], cells)
            for n in near.values():
                if n.parts:
                    q, uid, upper, lower = n.prune()
                    yield pa.RecordBatch.from_arrays([pa.array(n.uids[q]), pa.array(uid), pa.array(upper), pa.array(lower)], ["q", "uid", "upper", "lower"])

        found = stash(file.select("uid", "size", "top", "cells").mapInArrow(scan, "q long, uid long, upper double, lower double"))
        by = Window.partitionBy("q")
        least = found.withColumn("n", F.row_number().over(by.orderBy(F.desc("lower"), "uid"))).filter(F.col("n") == k).select("q", F.col("lower").alias("least"))
        left = found.join(least, "q", "left").filter("least is null or upper >= least")
        left = stash(left.select("q", "uid", "upper", F.row_number().over(by.orderBy(F.desc("upper"), "uid")).alias("n")))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = {u: x for own, q in packed.value for u, x in zip(own.tolist(), q)}
            for b in batches:
                got = [_product(of[q], np.frombuffer(x)) for q, x in zip(b.column("q").to_pylist(), b.column("exact").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("uid"), b.column("vec_id"), pa.array(got, pa.int64())], ["q", "uid", "vec_id", "score"])

        def read(wanted: DataFrame) -> DataFrame:
            pairs = small(wanted, wanted.count())
            return stash(file.select("uid", "vec_id", "exact").join(pairs, "uid").select("q", "uid", "vec_id", "exact").mapInArrow(score, "q long, uid long, vec_id long, score long"))

        first = read(left.filter(F.col("n") <= 4 * k).select("q", "uid"))
        kth = first.withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "vec_id", "uid"))).filter(F.col("n") == k).select("q", F.col("score").alias("kth"))
        open_ = left.filter(F.col("n") > 4 * k).join(kth, "q", "left").filter("kth is null or upper >= kth").select("q", "uid")
        every = first.union(read(open_)).withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "vec_id", "uid"))).filter(F.col("n") <= k)
        itself = read(spark.createDataFrame(pa.table({"q": pa.array(uids, pa.int64()), "uid": pa.array(uids, pa.int64())})))
        out = stash(every.select("q", "uid", "score").union(itself.select("q", "uid", "score")))
        packed.unpersist()
        return out

    best = reduce(DataFrame.union, [one(p) for p in range(slices)])
    listed = best.join(file.select("uid", "members"), "uid").groupBy("q").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct(F.col("score").alias("s"), m["vec_id"].alias("vec_id"), m["uid"].alias("uid"))))).alias("near"))
    # the queries of a class have their list in common; only their own row is left out
    ahead = lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] > b["s"], -1).otherwise(1)).when(F.struct(a["vec_id"], a["uid"]) < F.struct(b["vec_id"], b["uid"]), -1).when(a["uid"] == b["uid"], 0).otherwise(1)
    lists = stash(listed.join(asked.select(F.col("uid").alias("q"), "exact"), "q").select("exact", F.array_sort("near", ahead).alias("near")))
    queries = rows.filter(asks).select("uid", "vec_id", "exact")
    both = queries.join(F.broadcast(lists) if lists.count() <= BROADCAST_ROWS // 50 else lists, "exact")
    mine = F.slice(F.filter("near", lambda m: m["uid"] != F.col("uid")), 1, k)
    out = both.select(F.col("vec_id").alias("query_id"), F.posexplode(mine).alias("p", "m"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("m.vec_id").alias("vec_id"), F.col("m.s").alias("score"))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.u AS qu, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.u <> q.u AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY qu ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
