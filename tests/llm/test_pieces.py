import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallymark.llm import pieces, sentencepiece_codec, tokencount

SPECIAL = "<|x|>"


@pytest.fixture(scope="module")
def library():
    # the same pieces and scores, read as a unigram model
    data = open(pieces.MODEL, "rb").read() + b"\x12\x02\x18\x01"
    return sentencepiece.SentencePieceProcessor(model_proto=data)


@lru_cache
def lookup():
    return {p: (i, s) for p, i, s in pieces.load().pieces}


def brute(table, chunk):
    """Best path by trying every edge in the order of starts, as the rules say."""
    by, longest = lookup(), 16
    best = [(0.0, [])] + [None] * len(chunk)
    for a in range(len(chunk)):
        for b in range(a + 1, min(len(chunk), a + longest) + 1):
            if (x := by.get(chunk[a:b])) is not None:
                ids, s = [x[0]], x[1]
            elif b == a + 1:
                ids, s = [table.bytes[k] for k in chunk[a:b].encode()], table.unknown
            else:
                continue
            if best[b] is None or best[a][0] + s > best[b][0]:
                best[b] = (best[a][0] + s, best[a][1] + ids)
    return best[-1][1]


def words(seed, n):
    r = random.Random(seed)
    parts = ["th", "er", "tion", "ée", "ñ", "ß", "a", "b", "Q", "1", "_", ".", "ing", "xx", "日", "\n", "𝄞", "\t"]
    return ["".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(n)]


def test_chunks_match_the_rules_and_the_library(library):
    table = pieces.load()
    assert table.longest == 16
    for w in words(1, 1500):
        chunk = pieces.SPACE + w
        ids = pieces.encode_chunk(table, chunk)
        assert ids == brute(table, chunk)
        assert pieces.best(table, chunk)[1][-1] == len(ids)
        if not re.search(r"[\n\t𝄞]", w) and all(c in table.single for c in w):
            assert ids == library.encode(w), w


def documents():
    r = random.Random(2)
    texts = [None, "", " ", "   ", "a  b   c ", "\n\n x\t", "日本 語", "pre▁post", "x" * 30_000, "word " * 20_000]
    return [(i, t, "t", None) for i, t in enumerate(texts)] + [(100 + i, r.choice([" ", "  ", " \n"]).join(words(i, r.randint(1, 60))), "t", None) for i in range(150)] + [(None, "th", "t", None), (100, "dup", "t", None), (100, "dup", "t", None)]


def test_encoding_counts_and_round_trip(spark):
    table = pieces.load()
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, decoded int").repartition(3)
    want = {t: None if t is None else [i for c in pieces.chunks(t) for i in brute(table, c)] if len(t) < 5000 else [i for c in pieces.chunks(t) for i in pieces.encode_chunk(table, c)] for _, t, *_ in rows}
    for head in (200_000, 10):
        out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, rows=head)).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.tokens == want[r.text]
            assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))
    counts = tokencount.count(df).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts) == sorted((str(i), len(want[t] or [])) for i, t, *_ in rows)
    assert {r.round_trip for r in sentencepiece_codec.query(df).collect()} == {True}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.count(df).collect() == [] and sentencepiece_codec.query(df).collect() == []


def test_known_chunks_are_solved_without_the_counts(monkeypatch):
    table = pieces.load()
    table.machine()
    chunks = [pieces.SPACE + w for w in words(5, 400)]
    want = [brute(table, c) for c in chunks]
    assert [pieces.encode_chunk(table, c) for c in chunks] == want
    monkeypatch.setattr(pieces, "best", None)
    known = [k for k, c in enumerate(chunks) if table.single.issuperset(c)]
    assert len(known) > 50 and [pieces.encode_chunk(table, chunks[k]) for k in known] == [want[k] for k in known]


def test_words_are_the_chunks_and_runs_decode_as_ids_do():
    table = pieces.load()
    r = random.Random(6)
    texts = [t for _, t, *_ in documents()] + ["".join(r.choices(" ab▁é\n", k=r.randint(1, 9))) for _ in range(2000)] + [" ".join(words(7, 20)), "a ", " a"]
    for t in texts:
        assert [pieces.SPACE + w for w in pieces.words(t)] == list(pieces.chunks(t))
    ids = [r.choices(range(len(table.texts)), k=r.randint(0, 9)) for _ in range(500)] + [[], [table.bytes[0xE2]], []]
    flat = pa.array([i for x in ids for i in x], pa.int32())
    assert pieces.decode_runs(table, flat, np.cumsum([len(x) for x in ids])) == [pieces.decode_ids(table, x) for x in ids]
    assert pieces.decode_runs(table, flat[:0], np.array([0, 0])) == ["", ""] and pieces.decode_runs(table, flat[:0], np.array([], dtype=int)) == []


def test_encoding_takes_neither_pattern_nor_single_ids(monkeypatch):
    table = pieces.load()
    t = " ".join(words(8, 50)).replace("▁", "")
    monkeypatch.setattr(pieces, "CHUNK", None)
    assert pieces.words(t) == t.split(" ")
    monkeypatch.setattr(pieces, "decode_ids", None)
    solved = sentencepiece_codec._Solved(table, ([], b"", np.zeros(0, dtype=np.int64)))
    ids = pa.array(np.frombuffer(b"".join(map(solved.__getitem__, pieces.words(t))), dtype=np.int32))
    assert pieces.decode_runs(table, ids, np.array([len(ids)])) == [t]


def test_the_piece_table_of_the_lattice_comes_without_python_workers(spark):
    words = spark.range(3).select(F.concat(F.lit(pieces.SPACE), F.col("id").cast("string")).alias("chunk"))
    found = sentencepiece_codec.lattice(words, pieces.load())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
    table = pieces.Table([], [*range(256)], -1.0, [])
    assert sorted(map(tuple, sentencepiece_codec.lattice(words, table).select("ids").collect())) == [([0xE2, 0x96, 0x81, 0x30 + k],) for k in range(3)]
