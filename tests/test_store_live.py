import datetime as dt
import shutil
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymark.operators import choose, report, sessions, store
from tallymark.sources import dimensions as d
from tallymark.sources import messages
from tallymark.streaming import live

COLUMNS = {"facts": ("Governor ID", "Name", "Food"), "troops": ("Governor ID", "Unit")}


def facts(spark, *rows):
    return spark.createDataFrame(rows, "`Governor ID` string, Name string, Food string")


def troops(spark, *rows):
    return spark.createDataFrame(rows, "`Governor ID` string, Unit string")


def test_a_change_of_one_key_writes_one_bucket(spark, tmp_path):
    t = store.Tables(spark, f"file://{tmp_path}/t", COLUMNS, buckets=16)
    many = [(str(k), f"n{k}", "1") for k in range(200)]
    assert t.write_submissions("facts", "troops", facts(spark, *many), troops(spark, *[(str(k), u) for k in range(200) for u in "ab"])) == 1
    first = t.manifest()[1]["tables"]
    assert t.write_submissions("facts", "troops", facts(spark, (" 7 ", "", "9"), ("7", "", "8")), troops(spark, ("7", "c")), spark.createDataFrame([("7", "R")], "gid string, name string")) == 2
    second = t.manifest()[1]["tables"]
    for name in COLUMNS:
        assert sum(first[name][b] != second[name][b] for b in first[name]) == 1 and len(second[name]) == len(first[name])
    now = {r["Governor ID"].strip(): (r["Name"], r["Food"]) for r in t.read("facts").collect()}
    assert len(now) == 200 and now["7"] == ("R", "8") and now["8"] == ("n8", "1")
    assert sorted(r["Unit"] for r in t.read("troops").filter("trim(`Governor ID`) = '7'").collect()) == ["c"]
    old = {r["Governor ID"]: r["Food"] for r in t.read("facts", 1).collect()}
    assert old["7"] == "1" and t.read("troops").count() == 399
    # a key without children loses its rows; the other tables of its bucket stay
    t.write_submissions("facts", "troops", facts(spark, ("7", "x", "")), troops(spark).limit(0))
    assert t.read("troops").count() == 398 and t.read("facts").count() == 200


def test_a_failed_change_and_a_second_writer_leave_no_trace(spark, tmp_path):
    t = store.Tables(spark, f"file://{tmp_path}/t", COLUMNS, buckets=4)
    t.write_submissions("facts", "troops", facts(spark, ("1", "a", "")), troops(spark, ("1", "u")))

    def bad(now):
        return now.withColumn("Unit", F.raise_error(F.lit("no")).cast("string"))

    with pytest.raises(Exception, match="no"):
        t.change(facts(spark, ("1", "b", "")), {"facts": lambda now: now.withColumn("Name", F.lit("b")), "troops": bad})
    assert t.versions() == [1] and t.read("facts").first()["Name"] == "a"
    with pytest.raises(store.Conflict):
        t._publish(1, {})
    with pytest.raises(ValueError, match="other keys"):
        t.change(facts(spark, ("1", "b", "")), {"facts": lambda now: facts(spark, *[(str(k), "", "") for k in range(50)])})
    for k in range(5):
        t.change(facts(spark, ("1", "", "")), {"facts": lambda now, k=k: now.withColumn("Food", F.lit(str(k)))})
    assert t.versions() == [4, 5, 6] and t.read("facts").first()["Food"] == "4" and t.read("troops").count() == 1
    folders = [p for p in Path(tmp_path, "t/data/facts").glob("*/_bucket=*")]
    assert len(folders) == 3
    assert store.Tables(spark, f"file://{tmp_path}/t", COLUMNS, buckets=99).buckets == 4


def test_one_bad_row_leaves_the_others_written_once(spark, tmp_path):
    seen, tries = [], []

    def apply(batch, number):
        tries.append(batch.count())
        rows = batch.withColumn("x", F.when(F.col("id") % 37 == 5, F.raise_error(F.lit("bad row")).cast("long")).otherwise(F.col("id"))).collect()
        seen.extend(r.x for r in rows)

    ledger = live.Ledger(spark, f"file://{tmp_path}/ledger")
    run = live.isolating(apply, ledger, f"{tmp_path}/bad")
    run(spark.range(100).repartition(3), 4)
    bad = spark.read.parquet(f"{tmp_path}/bad").collect()
    assert sorted(r.id for r in bad) == [5, 42, 79] and all("bad row" in r.reason and r.batch == 4 for r in bad)
    assert sorted(seen) == [k for k in range(100) if k % 37 != 5] and len(tries) < 45
    # the same batch again: what is done stays done
    n = len(seen)
    run(spark.range(100).repartition(5), 4)
    assert len(seen) == n
    run(spark.range(0), 5)
    run(spark.range(3), 6)
    assert len(seen) == n + 3


def test_the_roster_is_a_snapshot(spark, tmp_path):
    now, path = [0.0], tmp_path / "roster"
    spark.createDataFrame([("1", "A")], "gid string, name string").write.parquet(str(path))
    side = live.Snapshot(lambda: spark.read.parquet(str(path)), f"{tmp_path}/versions", clock=lambda: now[0])
    got = []
    run = live.with_static(side, lambda b, n, r: got.append(sorted(x.name for x in r.collect())))
    run(None, 0)
    shutil.rmtree(path)  # the file is gone: what was read stays, for as long as it is gone
    run(None, 1)
    now[0] = 400
    run(None, 2)
    spark.createDataFrame([("1", "B")], "gid string, name string").write.parquet(str(path))
    run(None, 3)
    spark.createDataFrame([("2", "C")], "gid string, name string").write.mode("append").parquet(str(path))
    now[0] = 500
    run(None, 4)
    assert side.get(force=True).count() == 2
    assert got == [["A"], ["A"], ["A"], ["B"], ["B"]]
    with pytest.raises(Exception):
        live.Snapshot(lambda: spark.read.parquet(f"{tmp_path}/none"), f"{tmp_path}/v").get()


def test_a_sheet_with_a_title_line_gives_the_roster(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Kingdom 1234,,\n\nRank,Governor ID,Governor Name,Power\n1,"12,345,678","Says ""hi"", twice",9\n2,99,\n3,abc,Nobody,1\n4,7\n5,99,"Two\nlines",3\n')
    grid = d.sheet_grid(spark, f"file://{tmp_path}/s.csv")
    assert [len(r.cells) for r in grid.orderBy("pos").collect()] == [3, 0, 4, 4, 3, 4, 2, 4]
    assert {r.gid: r.name for r in d.roster(grid).collect()} == {"12345678": 'Says "hi", twice', "99": "Two\nlines"}


def test_closing_sessions_take_text_ids_and_repeated_ones(spark):
    rows = "array<struct<key_name:string,count:bigint,known:boolean,in_ram_zone:boolean>>"
    t = dt.datetime(2024, 1, 1)
    data = [("r", "1", t + dt.timedelta(minutes=m), i, 10, None, [("a", n, True, False)]) for i, (m, n) in enumerate([(0, 4), (1, 10), (2, 3), (40, 3), (41, 10)])]
    df = spark.createDataFrame(data, f"reading_id string, gid string, event_ts timestamp, seq long, wounded_current long, ram_current long, rows {rows}")
    assert [r.session for r in sessions.closing_sessions(df).orderBy("seq").collect()] == [0, 0, 1, 2, 2]
    assert set(sessions.closing_sessions(df).columns) == {*df.columns, "session"}


def test_siege_records_and_units_from_a_file(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"units": {"Long Bow": {"tier": "T2", "type": "Archer"}, "long-bow": {"tier": "T3", "type": "Archer", "power": 9}}}')
    assert [tuple(r) for r in d.read_units(spark, f"{tmp_path}/u.json").collect()] == [("long bow", "T3", "Archer", 9)]
    judged = spark.createDataFrame([("7", "=N", "u", 1, 0, 0, 2, 5, "FAIL", ["a", "b"], "http://x", None)], "gid string, name string, user_name string, n_t1 long, n_t2 long, n_t3 long, n_t4 long, n_t5 long, siege_verdict string, siege_notes array<string>, image_url string, message_url string")
    row = report.siege_records(judged, F.lit(dt.datetime(2024, 1, 2, 3, 4, 5))).first()
    assert len(row) == 14 == len(report.SIEGE_CHECK)
    assert list(row)[:10] == ["2024-01-02 03:04:05", "7", "'=N", "u", "1", "0", "0", "2", "5", "8"]
    assert row[10] == "FAIL" and "a" in row[11] and "b" in row[11]


def test_what_no_query_calls(spark):
    votes = spark.createDataFrame([(1, "gold", 5, 2), (1, "food", 7, 1), (2, "wood", 1, 1)], "img long, resource string, value long, votes long")
    assert {r.img: r.expected for r in choose.expected_resources(votes, ["img"]).collect()} == {1: ["food", "gold"], 2: ["wood"]}
    reads = spark.createDataFrame([(1, 0, "12"), (1, 1, "1 2"), (1, 2, "123"), (1, 3, None), (2, 0, "")], "img long, pass_id int, text string")
    assert {r.img: r.text for r in choose.longest(reads, ["img"]).collect()} == {1: "1 2", 2: ""}
    scales = spark.createDataFrame([(1, 5, None), (1, 5, None), (2, 5, 1), (2, 5, None)], "img long, total long, n long")
    assert {r.img: r.same for r in choose.invariant(scales, ["img"], ["total", "n"]).collect()} == {1: True, 2: False}


def test_a_picture_is_decoded_to_pixels(spark, tmp_path):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([10, y, 7, 200, y, 9]) for y in range(3))  # two pixels, no filter
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got = messages.decoded(spark, str(tmp_path / "a.png")).first()
    assert (got.width, got.height, got.channels) == (2, 3, 3)
    assert bytes(got.data) == b"".join(bytes([7, y, 10, 9, y, 200]) for y in range(3))  # blue, green, red


def test_the_commonest_suffix_and_its_ties(spark):
    votes = spark.createDataFrame([(1, "K"), (1, "M"), (1, "K"), (2, "M"), (2, "B"), (2, None), (3, None)], "img long, suffix string")
    assert {r.img: r.suffix for r in choose.suffix_of(votes, ["img"]).collect()} == {1: "K", 2: "B"}
