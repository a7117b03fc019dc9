import hashlib
import random
import re
import zlib

import numpy as np

from tallymark.llm import periodic


def runs_of(words):
    """Every maximal stretch of every period, by definition."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(q % p == 0 and all(words[k] == words[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def texts():
    r = random.Random(11)
    out = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "ab " * 40, "x y " * 3, "x y " * 4, "a a a a b " * 9, "é ü é ü é ü é ü", "a\x0ba\x0ca\ra\na\ta", "a a " * 7]
    for n in range(160):
        letters = "ab" if n % 3 == 0 else "abcd" if n % 3 == 1 else [f"w{k}" for k in range(300)]
        words = [r.choice(letters) for _ in range(r.randrange(1, 130))]
        for _ in range(n % 4):
            q = r.randrange(1, 20)
            part = [r.choice(letters) for _ in range(q)]
            at = r.randrange(len(words) + 1)
            words[at:at] = (part * 9)[: r.randrange(3 * q, 9 * q + 1)]
        out.append("  ".join(words) + "\n" * (n % 2))
    return out


def test_matches_the_definition(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    rows += [(None, "z z z z z z z", 2), (3, "q w e " * 6, 3), (3, "q w e " * 6, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int").repartition(3)
    got = sorted((tuple(x) for x in periodic.query(df).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert periodic.query(df.filter("false")).collect() == []


def test_spans_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "say it again it again it again it again now"), (2, "none here")], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.detect(df).collect()}
    assert got == {1: ([(1, 8, 2)], "say it again now"), 2: ([], "none here")}


def test_long_texts_and_chunks(spark, monkeypatch):
    """A text longer than a chunk is read whole; what spans chunks doesn't matter to the others."""
    monkeypatch.setattr(periodic, "CHUNK", 64)
    r = random.Random(2)
    long = " ".join(str(r.randrange(50)) for _ in range(700)) + " tail of it" * 400
    own, left = periodic._chunk([long.encode(), b"a b " * 4])
    assert own == [runs_of(long.split()), [(0, 8, 2)]] and left[1] == b"a b"


def test_one_word_many_times_takes_no_time():
    codes = np.array([0] * 60_000 + [1])
    assert periodic.find_runs(codes, np.array([0]), np.array([60_000])) == [(0, 60_000, 1)]
