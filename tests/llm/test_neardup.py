import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import decontam, neardup, simhash


def near(a, b):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghé", k=r.randint(2, 6))) for _ in range(500)]
    rows = [(1000, None), (1001, ""), (1002, " \n "), (1003, "One"), (1004, "one"), (1003, "One"), (None, "A b C"), (1005, "a b c")]
    for i in range(50):
        t = r.choices(words, k=r.randint(20, 400))
        rows.append((i, " ".join(t)))
        for k in range(6):
            u = list(t)
            for _ in range(r.randint(0, len(t) // 30)):
                u[r.randrange(len(u))] = r.choice(words).upper()
            rows.append((2000 + 10 * i + k, "\n".join(u)))
    line = " ".join(r.choices(words, k=60))
    return rows + [(3000 + i, line + " " + " ".join(r.choices(words, k=30))) for i in range(30)]


def brute(rows):
    out, left = [], set(range(len(rows)))
    while left:
        todo, group = [left.pop()], []
        while todo:
            a = todo.pop()
            group.append(a)
            more = {b for b in left if near(rows[a][1], rows[b][1])}
            left -= more
            todo += more
        least = min((rows[a][0] for a in group if rows[a][0] is not None), default=None)
        out += [(rows[a][0], least) for a in group]
    return sorted(out, key=str)


def test_components_match_brute_force_jaccard(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert sorted((tuple(r) for r in neardup.components(df).collect()), key=str) == brute(rows)


def test_the_stage_drops_edited_copies(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows = []
    for i in range(20):
        t = r.choices(words, k=200)
        u = list(t)
        u[40], u[90], u[140] = "x", "y", "z"  # 181 of 211 shingles
        rows += [(i, " ".join(t), 0), (100 + i, " ".join(u), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == list(range(20))


def test_the_stage_drops_copies_without_an_id_and_keeps_other_texts_of_an_id(spark):
    r = random.Random(8)
    a, b, c, e = (" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (7, a), (None, b), (None, b), (None, b.upper()), (7, c), (3, c), (7, e), (None, None), (9, "")]
    df = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(3)
    kept = [tuple(x) for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    assert {x[:2] for x in kept if x[1] not in (b, b.upper())} == {(7, a), (3, c), (7, e), (9, "")}
    assert [x[0] for x in kept if x[1] in (b, b.upper())] == [None] and len(kept) == 5


def test_empty(spark):
    assert neardup.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_groups_are_dealt_to_pairs_of_blocks(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in neardup.components(df, block=400).collect()), key=str) == brute(rows)


def test_representatives_with_maps_repeats_and_clashing_names(spark):
    schema = "doc_id long, text string, row map<string,int>, count long, id_ long, hash_ long"
    rows = [(1, "b", {"x": 1}, 1, 1, 1), (1, "a", {"y": 2}, 2, 2, 2), (1, "a", {"y": 1}, 3, 3, 3), (2, "c", None, 4, 4, 4), (None, "d", None, 5, 5, 5), (3, None, None, 6, 6, 6)]
    docs = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 1), (None, None), (3, 3)], "doc_id long, component_id long")
    kept = simhash.representatives(docs, found)
    assert kept.columns == docs.columns
    assert sorted((x["count"], x["text"]) for x in kept.collect()) == [(3, "a"), (5, "d"), (6, None)]
    empty = spark.createDataFrame([], schema)
    assert simhash.representatives(empty, found.limit(0)).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(x["count"] for x in decontam.clean(docs, none).collect()) == [1, 2, 3, 4, 5, 6]
    assert decontam.clean(empty, none).collect() == []


def test_the_index_is_of_simhash_fingerprints():
    r = np.random.default_rng(7)
    for n in (5, 300, 700):
        values = r.integers(0, 1 << 64, n, dtype=np.uint64)
        got, mask = neardup.fingerprint(values), (1 << 64) - 1
        for w in (0, 9, neardup.WORDS + neardup.EXTRA - 1):
            mixed = []
            for v in values.tolist():
                h = (v ^ int(neardup._TURN[w])) * int(neardup._TIMES[w]) & mask
                h = (h ^ h >> 32) * int(neardup._MIX[w]) & mask
                mixed.append(h ^ h >> 29)
            assert int(got[w]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > n)
    missed, shared, pairs = 0, 0, 300
    for _ in range(pairs):
        both, own = r.integers(0, 1 << 64, 160, dtype=np.uint64), r.integers(0, 1 << 64, 40, dtype=np.uint64)
        a, b = (neardup.fingerprint(np.r_[both, x]) for x in (own[:20], own[20:]))  # 160 of 200: exactly 0.8
        same = neardup.units(np.stack([a, b]))
        hits = int((same[0] == same[1]).sum())
        missed += not hits
        shared += hits
        assert neardup._close(a[neardup.WORDS :], b[neardup.WORDS :], np.int64(180))
        assert not neardup._close(a[neardup.WORDS :], neardup.fingerprint(own)[neardup.WORDS :], np.int64(180))
    assert missed == 0 and 10 < shared / pairs < 14  # 85 units, each shared with a probability of 0.8485 ** 12


def test_links_of_the_smallest_texts_are_all_found(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(50_000)]
    rows = []
    for i in range(400):  # 4 to 7 shingles against one more: similarities of 0.8 to 0.875
        t = r.sample(words, 8 + i % 4)
        rows += [(i, " ".join(t)), (1000 + i, " ".join([*t, "more"]))]
    got = {x.doc_id: x.component_id for x in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i] == got[i] == i for i in range(400))


def test_long_posting_lists_span_what_pairs_do(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    r = np.random.default_rng(9)
    n, words = np.sort(r.integers(9, 30, 200)), r.integers(0, 1 << 64, (20, 3), dtype=np.uint64)[r.integers(0, 20, 200)]
    edges = neardup._spanning(n, words)
    near = {(a, b) for a in range(200) for b in range(a + 1, 200) if 5 * n[a] >= 4 * n[b] and (words[a] == words[b]).all()}
    assert {tuple(sorted(e)) for e in edges} <= near
    up = list(range(200))
    for a, b in edges:
        up = [up[a] if x == up[b] else x for x in up]
    assert all(up[a] == up[b] for a, b in near)
    assert sorted((tuple(r) for r in neardup.components(df).collect()), key=str) == brute(rows)


def test_a_large_group_is_not_proposed_by_every_list(spark, monkeypatch):
    r = random.Random(10)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    base, rows = r.choices(words, k=200), corpus(5)
    for i in range(300):
        t = list(base)
        for _ in range(3):
            t[r.randrange(200)] = r.choice(words)
        rows.append((5000 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked = neardup._marked(df.selectExpr("doc_id", "0L AS th", "CAST(text AS BINARY) AS text"), 5)
    classes = simhash.stash(marked.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "fp", "few")]))
    for k, v in (("shuffle.partitions", "48"), ("adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        made = neardup.proposals(classes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(x.count() for x in made) < 15 * 300 + 2 * len(rows)  # one for each list and class would be some 40 times as many
    found = []
    for first in (neardup.FIRST, 85, 1):  # all units at once connect the same classes
        monkeypatch.setattr(neardup, "FIRST", first)
        one, other = neardup.proposals(classes)
        assert first < 85 or not other.count()
        found.append(sorted(map(tuple, simhash.roots(one.union(other).select("a", "b")).collect())))
    assert len(found[0]) > 400 and found[0] == found[1] == found[2]
