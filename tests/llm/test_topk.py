import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import topk


def brute(rows, k, asked):
    ints = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ints):
        if asked(i):
            found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for m, (j, v) in enumerate(ints) if m != n and len(v) == len(q)]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_matches_brute_force(spark):
    r = random.Random(4)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(r.gauss(0, 0.3)) for _ in range(16)]) for i in range(400)]
    rows += [(i, [0.5] * 16) for i in range(400, 430)] + [(50, rows[50][1]), (900, [0.1] * 8), (950, [0.2] * 8), (901, [0.3] * 8)]
    rows += [(1000, None), (1001, []), (1050, [f(0.1)] * 15 + [None]), (1100, [math.nan] * 16), (1150, [math.inf] * 16), (None, [0.1] * 16), (1200, [0.0] * 16)]
    rows += [(1250, [1e30] * 3), (1251, [-1e30] * 3), (1252, [1e-3] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else f(x) for x in v]) for i, v in rows]
    got = sorted(tuple(x) for x in topk.top_k(df, "vec_id % 50 = 0").collect())
    assert got == brute(rows, 5, lambda i: i % 50 == 0)


def test_slices_and_empty(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 10 == 0, k=3, slice_bytes=200).collect())
    assert got == brute(rows, 3, lambda i: i % 10 == 0)
    assert topk.top_k(df.filter("false"), "true").collect() == []


def test_bounds_hold_and_pruning_is_exact(spark, monkeypatch):
    """Few bits and little room for candidates: the bounds are wide, and the result is the same."""
    monkeypatch.setattr(topk, "CELL_BITS", 2)
    monkeypatch.setattr(topk, "_HELD", 50)
    monkeypatch.setattr(topk, "_ROWS", 16)
    r = random.Random(9)
    x = np.array([[r.gauss(0, 3000) // 1 for _ in range(12)] for _ in range(300)])
    near = topk._Near(np.arange(20), x[:20], 5)
    top = np.abs(x).max(axis=1)
    cells = np.clip(np.floor((x + top[:, None]) / topk._width(top)[:, None]), 0, 3).astype(np.uint8)
    near.offer(np.arange(300), top, cells)
    q, uid, upper, lower = near.prune()
    exact = (x[q] * x[uid]).sum(axis=1)
    assert (lower <= exact).all() and (exact <= upper).all() and len(q) < 20 * 299
    for k in range(20):
        best = sorted(((-(x[k] @ x[j]), j) for j in range(300) if j != k))[:5]
        assert {j for _, j in best} <= set(uid[q == k].tolist())


def test_equal_vectors_are_one_row_of_the_file(spark, monkeypatch):
    """10,000 rows repeat a vector and 200 of them ask: what the scan holds does not depend on the repeats."""
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(10_000)] + [(20_000 + i, [-float(i % 7), 1.0, -1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    held = []
    read = topk.stash
    monkeypatch.setattr(topk, "stash", lambda d: (lambda t: held.append((t.columns, t.count())) or t)(read(d)))
    got = sorted(tuple(x) for x in topk.top_k(df, "vec_id % 50 = 0").collect())
    assert max(n for c, n in held if "upper" in c) <= 64
    want = []
    for i in range(0, 10_000, 50):
        own = [j for j in range(7) if j != i][:5]
        want += [(i, r, j, 128 * 128 + 64 * 64 + 256 * 256) for r, j in enumerate(own, 1)]
    assert [x for x in got if x[0] < 10_000] == want
