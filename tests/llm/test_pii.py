import hashlib
import random
import re

import duckdb

from tallymark.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(t):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, t or "") if ok(k, m[0])]


FIXED = [
    None, "", "a@b.c", "é𝄞 x.y+z@mail-1.example.com, 10.0.0.255 and 256.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "x4111111111111111y 5500000000000004 0 00000000000000 1234567890123", "+1 (269) 555-3296 4524132264652876", "+49 30 1234567. +1+2 345-678-9012(",
    "a@b.c-d%x@y.z @a.b a@b@c.d a@b. foo@bar", "0001.002.03.4 1.2.3 000000000000000000.1.1.1 1..2.3.4", "9" * 5000 + " " + "1 " * 3000, "a" * 20000 + "@" + "b." * 3000,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432; DE88370400440532013000", "my ssn 123-45-6789 but 123-45-6789" + "x" * 60 + " 987-65-4321", "+" * 3000 + "1" * 20,
]


def test_base_spans_match_brute_force(spark):
    r = random.Random(5)
    bits = ["@", ".", "+", "-", " ", "(", ")", "1", "22", "333", "4111111111111111", "a", "b.c", "é", "𝄞", "x@y.zz", "10.1.2.3", "+1 234 567 8901", "\n", "%"]
    texts = FIXED + ["".join(r.choices(bits, k=r.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, spans array<int>").repartition(4)
    for row in pii.query(df).collect():
        want = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (texts[row.doc_id], want, row.spans)
        assert [row[f"n_{k}"] for k, _ in BASE] == [sum(x[0] == k for x in want) for k, _ in BASE]
        assert row.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))


def test_checksums_and_context_of_added_kinds(spark):
    texts = {1: FIXED[13], 2: FIXED[14], 3: "DE89370400440532013001", 4: "987-65-4321"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.txt, round(s.score, 2)) for s in r.spans if s.kind in ("iban", "ssn")] for r in pii.spans(df).collect()}
    assert got[1] == [("iban", "DE89 3704 0044 0532 0130 00", 1.2), ("iban", "GB82WEST12345698765432", 1.2)]
    assert got[2][0] == ("ssn", "123-45-6789", 0.7)
    assert got[3] == got[4] == []


def test_ibans_end_where_they_end(spark):
    de, gb, no, xx = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "XX08 1234 5678 901"
    texts = {
        1: f"IBAN {de} BIC COBADEFF please", 2: f"{de} {gb} 42", 3: f"AB12 {de} X", 4: f"é {no} {no} 7 A", 5: f"{de}x {de}_ a{de} {de[:-1]}1",
        6: f"REF 12 {xx} 99", 7: f"é {de}", 8: f"{gb}.", 9: "AB12 " * 4000,
    }
    want = {1: [de], 2: [de, gb], 3: [de], 4: [no, no], 5: [], 6: [xx], 7: [de], 8: [gb]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if s.kind == "iban"] for r in pii.spans(df).collect()}
    assert {i: [s.txt for s in got[i]] for i in want} == want
    assert all(texts[i][s.start : s.end] == s.txt for i in got for s in got[i])
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert out[1] == "IBAN [iban] BIC COBADEFF please" and out[2] == "[iban] [iban] 42" and out[3] == "AB12 [iban] X"


def test_oracle_agrees_on_texts_that_hold_ibans(spark):
    r = random.Random(7)
    bits = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "XX08 1234 5678 901", "AB12", "BIC", "X", "7", "42", "é", ".", "_", "a", "123-45-6789", "ssn"]
    texts = [None, "", *("".join(x + r.choice([" ", " ", " ", "", "-"]) for x in r.choices(bits, k=r.randint(1, 9))) for _ in range(1500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    rel = con.sql(pii.ORACLE)
    got = sorted(tuple(row[c] for c in rel.columns) for row in pii.query(df).collect())
    assert got == sorted(rel.fetchall())
    assert sum("iban" in row[-1] for row in got) > 500


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é call +1 (269) 555-3296 or a@b.cc!", 9), (2, None, 9), (3, "none", 9)], "doc_id long, text string, start int")
    assert [tuple(r) for r in pii.redacted(df).orderBy("doc_id").collect()] == [(1, "é call [phone] or [email]!", 9), (2, None, 9), (3, "none", 9)]


def test_empty(spark):
    assert pii.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
