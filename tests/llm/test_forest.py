import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import forest


def brute(rows, k, asked):
    """(query place, [(score, id)]) by plain sums, of the rows that take part."""
    kept = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))
    out = []
    for n, (i, q) in enumerate(kept):
        if asked(i):
            near = sorted((round(-cos(q, v), 12), j) for m, (j, v) in enumerate(kept) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def taken(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect())


def test_whole_budget_is_exact_with_ties_repeats_and_bad_rows(spark):
    r = random.Random(5)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(r.gauss(0, 1)) for _ in range(8)]) for i in range(150)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, -1.0, 0.5, 0.0, 3.0]) for i in range(200, 320)] + [(50, rows[50][1]), (50, rows[7][1])]
    rows += [(330, [0.1] * 3), (350, [0.3, 0.2, 0.1]), (331, [0.2, -0.1, 0.4])]
    rows += [(400, None), (450, []), (500, [0.0] * 8), (550, [math.nan] * 8), (600, [1.0] * 7 + [None]), (None, [1.0] * 8), (650, [-0.0] * 7 + [1e30]), (651, [0.0] * 7 + [1e-30])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else f(x) for x in v]) for i, v in rows]
    got = taken(forest.nearest(df, "vec_id % 50 = 0", recall=2.0, leaf_rows=8, block=16, trees=3))
    want = brute(rows, 5, lambda i: i % 50 == 0)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_recall_on_noise_and_on_groups(spark):
    rng = np.random.default_rng(3)
    for x in (rng.standard_normal((1500, 24)), rng.standard_normal((30, 24))[rng.integers(0, 30, 1500)] + 0.2 * rng.standard_normal((1500, 24))):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {t[:3:2] for t in taken(forest.nearest(df, F.col("vec_id") % 15 == 0, leaf_rows=32))}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit[::15] @ unit.T
        near[np.arange(100), np.arange(0, 1500, 15)] = -2
        want = {(15 * a, int(b)) for a in range(100) for b in np.argsort(-near[a])[:5]}
        assert len(got & want) / len(want) >= 0.9


def test_the_queue_takes_leaves_in_the_order_of_their_cost():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.Forest(unit, 3, 10, 2)
    leaves = f.leaf_of(unit)
    sizes = np.bincount(leaves.ravel(), minlength=f.leaves)
    assert sizes.sum() == 1200 and sizes.min() > 0
    costs = f.costs(unit[:5])
    for q in range(5):
        order = f.search(unit[q], sizes, 1200)
        assert sorted(order) == list(range(f.leaves)) and np.all(np.diff(costs[q][order]) >= -1e-12)
        assert set(order[:3]) == set(leaves[q].tolist())
        few = f.search(unit[q], sizes, 100)
        assert few == order[: len(few)] and sizes[few].sum() >= 100 > sizes[few[:-1]].sum()


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = taken(forest.nearest(df, "vec_id % 50 = 0"))
    assert [g[:3] for g in got] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert got[0][3] == pytest.approx(1.0) and got[1][3] == pytest.approx(math.sqrt(0.5))
    assert forest.nearest(df.filter("false"), "true").collect() == []
    assert forest.nearest(df, "vec_id = 7").collect() == []
    assert forest.nearest(df.limit(1), "true").collect() == []
