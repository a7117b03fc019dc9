import random
import zlib

import numpy as np
import pytest

from tallymark.llm import quality, toxicity


def texts(seed, n):
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "ing", "st", "ou", "né", "ble"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 300))]
        toxic, poor = r.random() < 0.3, r.random() < 0.3
        if toxic:
            for _ in range(max(3, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(["wretch", "nincompoop", "buffoon", "knave", "scoundrel"])
        if poor:
            w = [x + r.choice(["$$$", "%%%", "***"]) for x in w]
        docs.append((i, " ".join(w), "zz", None))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = texts(1, 900)
    docs += [(900, None, None, None), (901, "", None, None), (None, "x", None, None), (5, docs[5][1], None, None), (902, "word " * 60_000, None, None)]
    labels += [(903, 1, None), (904, None, 1), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, label int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark, frames):
    docs, labels, known = frames
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 905
    truth = {i: t for i, _, t in known if i is not None}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None and r.doc_id < 900]
    right = np.mean([p == t for p, t in held])
    assert right > 0.9, right
    empty = {r.score for r in rows if r.doc_id in (900, 901)}
    assert len(empty) == 1


def test_labels_of_held_out_rows_are_not_used(spark, frames):
    docs, labels, _ = frames
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    few = docs.filter("doc_id < 40")
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).join(few.select("doc_id"), "doc_id").collect()} for x in (labels, flipped))
    assert a == b


def test_missing_classes_and_empty_tables(spark, frames):
    docs, labels, _ = frames
    few = docs.limit(3)
    assert {r.score for r in toxicity.score(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    assert {r.score for r in toxicity.score(few, labels.filter("false")).collect()} == {0.0}
    assert toxicity.score(docs.filter("false"), labels).collect() == []
    assert {(r.expected_grade, r.keep) for r in quality.grade(few, labels.filter("false")).collect()} == {(1.0, True)}
    assert {(r.expected_grade, r.p_reach) for r in quality.grade(few, labels.filter("quality = 0")).collect()} == {(0.0, 0.0)}
    assert quality.grade(docs.filter("false"), labels).collect() == []


def test_quality_grades(spark, frames):
    docs, labels, known = frames
    rows = quality.grade(docs, labels.filter("doc_id % 2 = 0")).collect()
    truth = {i: q for i, q, _ in known}
    odd = [r for r in rows if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 900]
    assert np.mean([r.keep == (truth[r.doc_id] == 1) for r in odd]) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_reach <= 1 for r in rows)
    kept = quality.select(docs, labels.filter("doc_id % 2 = 0"))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.keep)


def test_thresholds_are_ordered():
    r = random.Random(2)
    rows = [(g, " ".join(r.choices(["aa", "bb", "cc", "dd"][: g + 1], k=30)).encode()) for g in range(4) for _ in range(40)]
    m = quality.fit(rows, {0: 40, 1: 40, 2: 40, 3: 40})
    assert (np.diff(m.thresholds) >= 0).all()
    e, _ = quality.expectation(m, [t for _, t in rows], 1)
    assert np.corrcoef(e, [g for g, _ in rows])[0, 1] > 0.8


def test_gradient_of_the_cumulative_link():
    # the fitted likelihood cannot be improved by moving any threshold a little
    r = random.Random(3)
    rows = [(g, bytes([97 + g]) * 20 + r.randbytes(20)) for g in range(3) for _ in range(60)]
    m = quality.fit(rows, {0: 60, 1: 60, 2: 60}, steps=400, ridge=1e-2)

    def loss(t):
        tails = quality.Model(m.grades, m.weights, t).tails([x for _, x in rows])
        full = np.concatenate([np.ones((len(rows), 1)), tails, np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        y = np.array([g for g, _ in rows])
        return -np.log(full[at, y] - full[at, y + 1]).sum()

    base = loss(m.thresholds)
    assert all(loss(m.thresholds + d) >= base - 0.05 for d in ([0.05, 0], [-0.05, 0], [0, 0.05], [0, -0.05]))
