import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as t


def one(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_numbers(spark):
    cases = {"3.0K": (3000, True), "26.6K": (26600, True), "1.6M": (1600000, True), "584": (584, False), "1,234": (1234, False), "": (None, False), "HEAL": (None, False), "l58": (158, False), "2O0": (200, False), "1.5B": (158, False), "1.5b": (1500000000, True), "1.2.3K": (None, False), "(12)": (12, False), "1.620.935": (1620935, False), "200.000": (200000, False), "9" * 30: (None, False), "2.5k": (2500, True), "0.0005K": (0, True)}
    assert [tuple(x) for x in one(spark, t.parse_number, list(cases))] == list(cases.values())
    assert tuple(one(spark, t.parse_number, [None])[0]) == (None, False)


def test_fractions(spark):
    cases = {"232/548,725": (232, 548725), "0/50,000": (0, 50000), "text": (None, None), "x 1.5K / 2M y": (1500, 2000000), "": (None, None), "2O0/500": (0, 500)}
    assert [tuple(x) for x in one(spark, t.parse_fraction, list(cases))] == list(cases.values())


def test_names_keys_and_lines(spark):
    assert one(spark, t.normalise_name, ["Long Swordsman", "Man-at-Arms", "Καλημέρα", "  Chu–Ko’Nu 2 ", None]) == ["long swordsman", "man at arms", "", "chu ko'nu", None]
    assert one(spark, t.extract_key, ["id 12345678", "1,234,567", "1234", "1234567890123", "a12345b", None, "x 55555 66666"]) == ["12345678", "1234567", None, None, None, None, "55555"]
    assert one(spark, t.flat_text, ["Severely  Wounded: 12/3,4"]) == ["severely wounded 12/3,4"]
    assert one(spark, t.is_numeric, ["1,2", "x", "12K", "(5)"]) == [True, False, True, True]


def test_digit_trimming(spark):
    assert one(spark, t.trim_leading_groups, ["8 55,965", "257 609", "1 620 935", "", "1,2 3 4"]) == ["55,965", "257 609", "1 620 935", "", "3 4"]
    assert one(spark, t.strip_fused_digits, ["42200,000", "200000", "200,000", "1,2,3"]) == ["200,000", "200000", "200,000", "1,2,3"]
    assert one(spark, lambda x: t.parse_number(t.trailing_number(x))["value"], ["200.000", "1.620.935", "ES 200.000", "x"]) == [200000, 1620935, 200000, None]


def test_cells(spark):
    assert one(spark, t.cell, ["+Bob", "=SUM(A1)", None, "-1", "@x", "a=b"]) == ["'+Bob", "'=SUM(A1)", "", "'-1", "'@x", "a=b"]
    assert one(spark, lambda x: t.link(x, "Go"), ['http://a/"b', "", None]) == ['=HYPERLINK("http://a/%22b", "Go")', "", ""]
    assert one(spark, t.report_number, ["1,234", "12.9", "-3.7", "x", "", None]) == [1234, 12, -3, 0, 0, 0]
    assert one(spark, t.column_letters, [1, 26, 27, 36, 702, 703], "int") == ["A", "Z", "AA", "AJ", "ZZ", "AAA"]


def test_media(spark):
    heads = [b"\x89PNG\r\n\x1a\n123", b"\xff\xd8\xff\xe0", b"GIF89a..", b"RIFF1234WEBPx", b"?"]
    assert one(spark, t.media_type, [bytearray(h) for h in heads], "binary") == ["image/png", "image/jpeg", "image/gif", "image/webp", "image/png"]
    df = spark.createDataFrame([("image/x", None), (None, "a.PNG"), (None, "b.txt"), ("text/plain", None)], "m string, n string")
    assert [r[0] for r in df.select(t.is_image(F.col("m"), F.col("n"))).collect()] == [True, True, False, False]


if __name__ == "__main__":
    pytest.main([__file__])


def test_letters_of_columns_beyond_three_places(spark):
    def letters(n):
        out = ""
        while n > 0:
            n, left = divmod(n - 1, 26)
            out = chr(65 + left) + out
        return out

    some = [0, 702, 703, 18277, 18278, 18279, 18304, 475254, 475255, 900_000, 2**53 + 1, 2**63 - 1, None]
    assert one(spark, t.column_letters, some, "long") == [None if n is None else letters(n) for n in some]
    assert one(spark, t.column_letters, [18278, 18279], "int") == ["ZZZ", "AAAA"]
