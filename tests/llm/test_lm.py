import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tallymark.llm import lm


def corpus(seed, n):
    r = random.Random(seed)
    voc = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(200)]
    weights = [1 / (k + 1) for k in range(200)]
    rows = [(i, r.choice([" ", "\n", "\x0b "]).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in r.choices(voc, weights, k=r.randint(0, 80)))) for i in range(n)]
    return rows + [(5000, None), (5001, ""), (None, "a b"), (5002, "zz q " * 3), (7, rows[7][1]), (7, rows[7][1]), (5003, "q" * 3000), (5004, "a " * 50_000)]


def part(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7


def toks(t):
    return (t or "").encode().lower().split() + [b"\n"]


class Triples:
    """Spelling by byte triples, from dictionaries of counts: four estimates, mixed by the octave of the context's count."""

    def __init__(self, counts, weights=None):
        self.counts, self.total = counts, sum(counts.values())
        self.one, self.two, self.first, self.pair = Counter(), Counter(), Counter(), Counter()
        for t, n in counts.items():
            self.one[t[2]] += n
            self.two[t[1:]] += n
            self.first[t[1]] += n
            self.pair[t[:2]] += n
        self.weights = weights if weights is not None else [[0.25] * 4 for _ in range(48)]

    def parts(self, t):
        out = [1 / 256, self.one[t[2]] / self.total if self.total else 1 / 256]
        out.append(self.two[t[1:]] / self.first[t[1]] if self.first[t[1]] else out[1])
        out.append(self.counts[t] / self.pair[t[:2]] if self.pair[t[:2]] else out[2])
        return out

    def octave(self, t):
        return min(47, int(math.log2(self.pair[t[:2]] + 1)))

    def learn(self, held, rounds=60):
        events = [(self.octave(t), self.parts(t), n) for t, n in held.items()]
        for _ in range(rounds):
            share = [[1e-3] * 4 for _ in range(48)]
            for k, parts, n in events:
                joint = [w * x for w, x in zip(self.weights[k], parts)]
                for i, x in enumerate(joint):
                    share[k][i] += n * x / sum(joint)
            self.weights = [[x / sum(row) for x in row] for row in share]

    def log10(self, word):
        triples = letters(word)
        return sum(math.log10(sum(w * x for w, x in zip(self.weights[self.octave(t)], self.parts(t)))) for t in triples)


def letters(word):
    spelt = b"\n \n" if word == b"\n" else b"\n " + word + b" "
    return [spelt[k : k + 3] for k in range(len(spelt) - 2)]


def em(events, rounds=200):
    """The weight of the first estimate from (count, first / second) events."""
    w = 0.5
    for _ in range(rounds):
        w = sum(n * w * x / (w * x + 1 - w) for n, x in events) / sum(n for n, _ in events)
        w = min(max(w, 1e-6), 1 - 1e-6)
    return w


def brute(rows):
    """(id, score) of every row by plain dictionaries over all words, exact expectation-maximisation and no histogram."""
    words, grams, spelt = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        if part(i) != 2:
            k, before = int(part(i) == 3), b"\n"
            for w in toks(t):
                words[k][w] += 1
                grams[k][before, w] += 1
                spelt[k].update(letters(w))
                before = w
    learner = Triples(spelt[0])
    learner.learn(spelt[1])
    pooled = Triples(spelt[0] + spelt[1], learner.weights)
    rest, every = words[0], words[0] + words[1]
    n_rest, n_every = sum(rest.values()), sum(every.values())
    own = em([(n, rest[w] / n_rest / 10 ** learner.log10(w) if rest[w] else 0.0) for w, n in words[1].items()])
    memo = {}

    def word(w, counts, total, spelling):
        if (w, total) not in memo:
            far = spelling.log10(w) + math.log10(1 - own)
            memo[w, total] = far if not counts[w] else math.log10(own * counts[w] / total + 10**far)
        return memo[w, total]

    events = {}
    for (v, w), n in grams[1].items():
        ratio = grams[0][v, w] / rest[v] / 10 ** word(w, rest, n_rest, learner) if grams[0][v, w] else 0.0
        events.setdefault(int(math.log2(rest[v] + 1)), []).append((n, ratio))
    weight = [0.0] * 48
    for k in range(1, 48):
        weight[k] = em(events[k]) if k in events else weight[k - 1]
    bigrams, out = grams[0] + grams[1], []
    for i, t in rows:
        before, s = b"\n", 0.0
        for w in toks(t):
            lam = weight[min(47, int(math.log2(every[before] + 1)))]
            far = math.log10(1 - lam) + word(w, every, n_every, pooled)
            s += math.log10(lam * bigrams[before, w] / every[before] + 10**far) if bigrams[before, w] else far
            before = w
        out.append((str(i), s))
    return sorted(out)


def test_base_and_score_match_brute_force(spark):
    rows = corpus(1, 400)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, w string").repartition(3)
    train = Counter(w for i, t in rows if part(i) != 2 for w in toks(t))
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), part(i) == 2, len(toks(t)), sum(train[w] > 0 for w in toks(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in toks(t)), 5)) for i, t in rows)
    exact = brute(rows)
    for head, segment in ((lm.HEAD_ROWS, lm.SEGMENT), (20, 500)):
        out = lm.score(df, head_rows=head, segment=segment).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
        got = sorted((str(r.doc_id), r.score) for r in out)
        assert [i for i, _ in got] == [i for i, _ in exact]
        for (i, a), (_, b) in zip(got, exact):
            assert abs(a - b) <= 0.004 * abs(b) + 1e-6, (i, a, b)


def test_what_is_broadcast_changes_nothing(spark):
    df = spark.createDataFrame(corpus(5, 120), "doc_id long, text string").repartition(3)
    every = [sorted((str(r.doc_id), r.n_known, round(r.base_score, 7), round(r.score, 7)) for r in lm.score(df, head_rows=h, segment=k).collect()) for h, k in ((lm.HEAD_ROWS, lm.SEGMENT), (20, 500), (0, 3000))]
    assert every[0] == every[1] == every[2]


def test_word_order_and_repeats_matter(spark):
    r = random.Random(3)
    voc = ["".join(r.choices("abcdefgh", k=4)) for _ in range(300)]
    known = [" ".join(r.choices(voc, k=60)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(known)] + [(1000 + i, t) for i, t in enumerate(known)]
    rows += [(5000 + i, " ".join(reversed(t.split()))) for i, t in enumerate(known[:40])]
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [i for i in range(40) if part(i) == 2 and part(1000 + i) != 2 and part(5000 + i) == 2]
    assert held
    for i in held:  # a copy of a training text, and the same words backwards: equal by words, apart by bigrams
        assert abs(got[i].base_score - got[5000 + i].base_score) < 1e-6
        assert got[i].score > got[5000 + i].score + 10


def test_groups_do_not_change_results(spark, monkeypatch):
    df = spark.createDataFrame(corpus(2, 60), "doc_id long, text string").repartition(3)
    one = sorted((str(r.doc_id), round(r.score, 9)) for r in lm.score(df).collect())
    monkeypatch.setattr(lm, "GROUP", 1000)
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in lm.score(df).collect()) == one


def test_spelling_is_a_distribution():
    words = [b"ab", b"abc", b"b", b"\n"]
    cells, _ = lm._cells(words)
    keys, counts = np.unique(cells, return_counts=True)
    s = lm.Spelling(keys, counts)
    s.learn(keys, counts.astype(float))
    for context in (keys[0] >> 8, keys[1] >> 8, 0x4142):
        every = (int(context) << 8) + np.arange(256)
        p = (s.estimates(every) * s.weights[s.bucket(every)]).sum(axis=1)
        assert abs(p.sum() - 1) < 1e-9
    assert (s.weights >= 0).all() and np.allclose(s.weights.sum(axis=1), 1)


def test_empty_and_without_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).collect() == []
    out = next(i for i in range(100) if part(i) == 2)
    (row,) = lm.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0


def test_words_are_spelled_to_their_end():
    r = random.Random(4)
    counts = Counter({bytes(r.choices(b"abc ", k=3)): r.randint(1, 50) for _ in range(40)})
    weights = np.random.default_rng(2).dirichlet(np.ones(4), 48)
    spell = lm.Spelling(np.array([x[0] << 16 | x[1] << 8 | x[2] for x in counts]), np.array(list(counts.values())), weights)
    words = [bytes(r.choices(b"abcdz", k=n)) for n in (1, 30, 180, 300, 600, 3000)]
    got = spell.log10(words)
    assert np.allclose(got, [Triples(counts, weights).log10(w) for w in words], rtol=1e-9)
    assert np.all(np.diff(got) < 0) and got[-1] < -1000
    # a spelling that no double holds leaves the word's own estimate, and nothing but it where there is none
    assert np.allclose(lm.mixed_log10(0.25, np.array([0.5, 0.0, 0.0]), np.array([-4000.0, -4000.0, -2.0])), [math.log10(0.125), math.log10(0.75) - 4000, math.log10(0.75) - 2])
    assert lm.mixture(np.array([1.0, 1.0]), lm.ratios(np.array([3.0, 0.0]), 10.0, np.array([-4000.0, -4000.0]))) == 0.5


def test_segments_carry_their_rare_words_packed():
    words = [b"a", "é".encode(), b"\x00b", b"zz" * 500]
    assert lm._unpack_words(lm._pack_words(words)) == words and lm._unpack_words(lm._pack_words([])) == []
    packed = {c: pa.scalar(lm._pack(np.array(v, dtype=t))) for c, v, t in (("ids", [2, 1, 1, 1, 1, 0], np.int32), ("sizes", [6], np.int64), ("which", [0, 2, 1, 2], np.int32))}
    known = pa.array([[{"k": 2, "id": 77, "n_rest": 0, "c": 8}, {"k": 0, "id": 9, "n_rest": 3, "c": 4}]])[0]
    s = lm._Segment(packed | {"packed": pa.scalar(lm._pack_words(words)), "known": known})
    assert s.rare == words and s.rare_ids.tolist() == [9, lm.OTHER, 77, lm.OTHER]
    assert s.by_token(np.zeros(3), s.rare_every).tolist() == [0, 4, 8, 0, 8, 0]
