import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tallymark.llm import trie


def brute(rows, shared):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = own
    if shared:
        made = {c: own.get(c - int(math.fmod(c, 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + t[h:] for c, t in own.items()}
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not kids[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table():
    r = random.Random(8)
    rows = []
    for c in range(260):
        for turn in range(r.choice([1, 1, 2, 3, 6, 9, 30])):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["", "a", "bé", "longer text 😀"])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 380) for t in range(4)]
    rows += [(400, None, None, None), (400, 3, "user", None), (401, 0, "us", "erx"), (402, 0, "user", "x"), (None, 1, "user", "lost"), (-5, 1, "user", "x"), (1099, 0, "user", "alone")]
    r.shuffle(rows)
    return rows


def taken(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("shared", [False, True])
def test_matches_brute_force(spark, monkeypatch, shared):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = table()
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    got = taken(trie.query(df) if shared else trie.prefix_trie(df))
    assert got == brute(rows, shared)


def test_oracle_says_the_same(spark):
    rows = table()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(trie.ORACLE)
    at = [rel.columns.index(c) for c in COLUMNS]
    assert sorted((tuple(x[i] for i in at) for x in rel.fetchall()), key=str) == brute(rows, True)


def test_chains_of_one_child_and_an_empty_table(spark):
    df = spark.createDataFrame([(7, t, "user", "ab") for t in range(40)] + [(9, t, "user", "ab") for t in range(25)], "conv_id long, turn int, role string, text string")
    got = taken(trie.prefix_trie(df))
    assert got == brute([tuple(r) for r in df.collect()], False) and len(got) == 41
    assert trie.prefix_trie(df.filter("false")).collect() == []


def test_only_points_are_created(spark):
    df = spark.createDataFrame([(c, t, "user", "x" if t < 30 else str(c)) for c in range(20) for t in range(60)], "conv_id long, turn int, role string, text string")
    pieces = trie._sorted_pieces(trie._chained(trie.sequences(df)))
    points = trie._points(pieces, trie._distinct(pieces))
    assert points.count() == 21  # the branch at 30 and the leaves, of 630 nodes
    assert taken(trie.prefix_trie(df)) == brute([tuple(r) for r in df.collect()], False)
