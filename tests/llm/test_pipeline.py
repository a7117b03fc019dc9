import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as c
from tallymark.llm import pieces, quality, samples
from tests.llm import test_decontam as d
from tests.llm import test_pii as p
from tests.llm import test_neardup as n


def write(spark, base):
    r = random.Random(4)
    parts = ["th", "er", "on", "an", "re", "ing", "st", "ou", "ble", "né"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        w = [word() for _ in range(r.randint(30, 150))]
        poor = r.random() < 0.3
        if i % 16 == 3:
            w[5:5] = items[i % 5][1].split()
        if i % 7 == 2:
            w[3:3] = ["a.b@c.org", "10.1.2.3", "4111111111111111", "+1", "234", "567", "8901"]
        if poor:
            w = [x + r.choice(["$$$", "%%%", "***"]) for x in w]
        text = " ".join(w)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if poor else 1, 0))
        if i % 10 == 4:
            docs.append((1000 + i, text.replace(w[2], "zz", 1), "en", "s", len(text)))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (4, docs[4][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return docs, items


def near_duplicates(rows):
    """Smallest id of each component of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    kept, left = set(), set(range(len(rows)))
    while left:
        todo, group = [left.pop()], []
        while todo:
            a = todo.pop()
            group.append(rows[a][0])
            more = {b for b in left if n.near(rows[a][1], rows[b][1])}
            left -= more
            todo += more
        kept.add(min(group))
    return kept


def test_run_matches_brute_force(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows, items = write(spark, base)
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(*samples.labelled(docs, labels, quality.ratings(labels), F.lit(True), quality.FIT_ROWS))
    _, good = quality.expectation(model, [None if t is None else t.encode() for _, t, *_ in rows], 1)
    rows = [x for x, ok in zip(rows, good) if ok >= 0.5]
    assert 80 < len(rows) < 150
    kept = near_duplicates([x[:2] for x in rows])
    rows = list({x[0]: x for x in sorted(rows, key=lambda x: (x[1] or "", -(x[4] or 0))) if x[0] in kept}.values())
    bad = {x[0] for x in d.brute([x[:2] for x in rows], items) if x[-1]}
    assert bad
    table, want = pieces.load(), {}
    for i, t, *_ in rows:
        if i in bad:
            continue
        if t is not None:
            at, out = 0, ""
            for s, e, k in sorted((a, b, k) for k, a, b in p.brute(t)):
                if s >= at:
                    out += t[at:s] + f"[{k}]"
                at = max(at, e)
            t = out + t[at:]
        want[i] = (t, None if t is None else [x for ch in pieces.chunks(t) for x in pieces.encode_chunk(table, ch)])
    out = c.run(spark, base)
    assert out.columns == [*docs.columns, "tokens", "round_trip"]
    got = {x.doc_id: (x.text, x.tokens) for x in out.collect()}
    assert all(x.round_trip for x in out.collect())
    assert got == want
    assert any("[email]" in (t or "") for t, _ in got.values()) and not any(re.search("@", t or "") for t, _ in got.values())


def test_empty_tables(spark, tmp_path):
    base = f"file://{tmp_path}"
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], columns).write.parquet(f"{base}/{name}.parquet")
    assert c.run(spark, base).collect() == []
