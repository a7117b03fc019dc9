import random

import numpy as np
import xxhash

from tallymark.llm import simhash


def brute(rows):
    fps = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    up = list(range(len(fps)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, f"{f:016x}", low.get(root(k))) for k, (i, f) in enumerate(fps)), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghé", k=r.randint(1, 6))) for _ in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One"), (1004, "one"), (1005, "a b c"), (1003, "One"), (None, "A b C")]
    for i in range(n):
        t = r.choices(words, k=r.randint(1, 400))
        rows.append((i, " ".join(t)))
        for k in range(r.randint(0, 4)):
            u = list(t)
            for _ in range(r.randint(0, 6)):
                u[r.randrange(len(u))] = r.choice(words).upper()
            rows.append((2000 + 10 * i + k, "\x0b".join(u)))
    return rows + [(5000, "x " * 50_000)]


def test_matches_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((tuple(r) for r in simhash.components(df).collect()), key=str)
    assert got == brute(rows)


def test_large_keys_are_split_without_loss(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)}
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (8, 4096):
        up = {x.v: x.root for x in simhash.roots(simhash.links(df, block=block)).collect()}
        want = {}
        edges = simhash._forest(np.array(fps), 4)
        u = simhash._Union()
        for a, b in edges:
            u.add(a, b)
        for f in fps:
            if u.root(f) != f:
                want[f] = u.root(f)
        assert {a: b for a, b in up.items() if a != b} == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(df).collect() == []


def test_roots_of_a_hub_and_a_chain_need_no_broadcast(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("broadcast")

    monkeypatch.setattr(simhash, "spread", refuse)
    edges = [(7, k) for k in range(1000, 1300)] + [(k, k + 1) for k in range(2000, 2040)] + [(5, 5), (1001, 7), (2040, 3)]
    got = {x.v: x.root for x in simhash.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1000, 1300), 7) | dict.fromkeys(range(2000, 2041), 3)
