import hashlib
import random
import re

from tallymark.llm import decontam


def split(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = split(t)
        if i is None or not w:
            continue
        k = min(13, len(w))
        for p in range(len(w) - k + 1):
            wins.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if (x := tuple(w[p : p + k])) in wins:
                    hit |= set(range(p, p + k))
                    ids |= wins[x]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed, shorts):
    r = random.Random(seed)
    voc = [f"{c}{k}" for c in ("a", "Bé", "Ñ", "ß") for k in range(40)] + ["the"] * 20
    items = [(i, " ".join(r.choices(voc, k=r.randint(13, 60)))) for i in range(12)] + [(90, None), (91, " ,."), (None, "x y z"), (92, "the " * 30)]
    items += [(7, items[7][1])]
    if shorts:
        items += [(20 + k, " ".join(r.choices(voc, k=k))) for k in (1, 3, 8, 9, 12)]
    docs = [(500, None), (501, ""), (502, "... !!"), (None, "the " * 14), (503, "the " * 40)]
    for i in range(80):
        w = r.choices(voc, k=r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            src = (items[r.randrange(12)][1]).split()
            a = r.randrange(len(src))
            p = r.randint(0, len(w))
            w[p:p] = [x.upper() if r.random() < 0.3 and x.isascii() else x for x in src[a : a + r.randint(1, 40)]]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    return docs + [docs[10], docs[10], docs[500 - 500]], items


def test_matches_brute_force(spark):
    for seed, shorts in ((1, False), (2, True)):
        docs, items = case(seed, shorts)
        d = spark.createDataFrame([(i, t, "w", 5) for i, t in docs], "doc_id long, text string, words string, n int")
        b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, fp string")
        got = sorted((tuple(r) for r in decontam.query(d, b).collect()), key=str)
        assert got == brute(docs, items)


def test_shuffled_fingerprints_give_the_same_rows(spark):
    """Beyond the bound nothing is broadcast; 300 items and a third of the rows share one passage."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for seed, shorts in ((1, False), (2, True)):
            docs, items = case(seed, shorts)
            passage = " ".join(f"shared{k}" for k in range(30))
            items += [(1000 + i, passage) for i in range(300)]
            docs += [(2000 + i, f"x{i} {passage} y{i}") for i in range(40)] + [(None, passage), (None, passage)]
            d = spark.createDataFrame([(i, t, "w", 5) for i, t in docs], "doc_id long, text string, id string, th int")
            b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, fp string")
            found = decontam.contamination(d, b, limit=0)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
            got = sorted((tuple(r) for r in decontam.digest(found).collect()), key=str)
            assert got == brute(docs, items)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_key_holds_all_documents(spark):
    """Marks that documents have of their own are spread, also where nothing is hit."""
    rows = spark.range(2000).selectExpr("id as doc_id", "concat('a b c ', id) as text", "xxhash64(concat('a b c ', id)) as text_hash")
    prints = spark.createDataFrame([(13, 1)], "len int, fp long")
    for found in (decontam._streamed(rows, prints, set(), 13), decontam._shuffled(rows, prints, set(), 13)):
        assert found.count() == 2000
        assert found.groupBy("len", "fp").count().filter("count > 1").count() == 0


def test_wide_tables_are_not_broadcast(spark):
    from tallymark.llm import common

    wide = spark.range(3).selectExpr("id", "repeat('x', 1000) as t")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.light(wide)) and not hinted(common.light(wide, 2))
    old, common.BROADCAST_BYTES = common.BROADCAST_BYTES, 2000
    try:
        assert not hinted(common.light(wide))
    finally:
        common.BROADCAST_BYTES = old


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontam.query(d, b).collect()] == [(2, 0, False)]
    assert decontam.query(d.filter("false"), b).collect() == []


def test_plan_runs_no_python(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontam.query(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
