import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import images, report, sessions, sink
from tallymark.operators.reconcile import resolve
from tallymark.sources import dimensions as d
from tallymark.sources import messages
from tallymark.streaming import live

T0 = dt.datetime(2024, 1, 1)
READING = (
    "reading_id long, gid string, event_ts timestamp, seq long, user_name string, image_url string, message_url string, source string, warnings array<string>, rss_approx boolean, "
    "expected_resources array<string>, wounded_current long, wounded_capacity long, ram_current long, ram_capacity long, food long, wood long, stone long, gold long"
)
ROW = "reading_id long, pos int, raw_name string, count long, name_visible boolean, in_ram_zone boolean, tier string, troop_type string"


def reading(i, gid, minute, wounded=None, ram=None, food=None, user="u", url=None, seconds=0, **more):
    return (i, gid, T0 + dt.timedelta(minutes=minute, seconds=seconds), i, user, url, url, "local", more.get("warnings", []), more.get("approx", False), more.get("expected", []), wounded, None, ram, None, food, None, None, None)


def merged(spark, readings, rows, minutes=30):
    r = sessions.gap_sessions(spark.createDataFrame(readings, READING), minutes=minutes)
    rows = spark.createDataFrame([(i, p, n, c, True, n == "Battering Ram", None, None) for i, items in rows.items() for p, (n, c) in enumerate(items)], ROW)
    return sessions.merge(r, resolve(rows, d.units(spark), d.tiers(spark)))


def test_merge(spark):
    a, b = [("Long Swordsman", 47)], [("Longbowman", 27), ("Cataphract", 158), ("Battering Ram", 84)]
    readings = [reading(0, "1", 0, 232, 84, 5, url="x"), reading(1, "1", 5, 232, None, None, "v", expected=["food", "wood"]), reading(2, "1", 35, None, None, 9, url="y", approx=True, warnings=["w"])]
    readings += [reading(3, "2", 0, 73), reading(4, "2", 1, 232), reading(5, "3", 0, 10), reading(6, "3", 30, 10, seconds=1)]
    subs, rows = merged(spark, readings, {0: a, 1: b, 2: a, 3: [("Knight", 73)], 4: [("Knight", 0), ("(name cut off)", 3), ("Cataphract", 158)], 5: [("Knight", 9)], 6: [("Knight", 10)]})
    got = {(r.gid, r.session): r for r in subs.collect()}
    one = got["1", 0]
    assert one.status == "Complete" and one.identified == 316 and one.food == 9 and one.user_name == "u" and one.rss_approx and one.cost_incomplete
    assert one.image_urls == ["x", "y"] and one.sources == ["local"] * 3 and one.notes == ["w"]
    two = got["2", 0]
    assert two.identified == 158 and two.merge_notes == ["Hospital total changed (73 -> 232); earlier screenshots discarded."] and two.epoch == 1
    assert ("3", 1) in got and got["3", 0].status == "Totals only"  # 30 minutes and a second
    assert rows.filter("gid = '1'").count() == 4
    records = report.submission_records(subs.withColumn("name", F.lit("=N")))
    assert records.columns == list(report.SUBMISSIONS) and len(report.SUBMISSIONS) == 36
    row = records.filter("`Governor ID` = '1'").first()
    assert row["Name"] == "'=N" and row["T4"] == "232" and row["Screenshot"].startswith("'=HYPERLINK") and row["RSS Exact?"] == "No (rounded by game)" and row["Read By"] == "local"
    troops = report.troop_records(rows, subs.withColumn("name", F.lit("N")), ["gid", "session"]).filter("`Governor ID` = '1'").collect()
    assert [r["Unit"] for r in troops] == ["Cataphract", "Long Swordsman", "Longbowman", "Battering Ram"] and len(report.TROOPS) == 10


def test_gap_of_exactly_the_timeout_keeps_the_session(spark):
    r = spark.createDataFrame([reading(0, "1", 0), reading(1, "1", 30), reading(2, "1", 60, seconds=1)], READING)
    assert [x.session for x in sessions.gap_sessions(r).orderBy("seq").collect()] == [0, 0, 1]


def test_closing_and_live_sessions_agree(spark, tmp_path):
    r = random.Random(7)
    readings, rows = [], {}
    for i in range(120):
        minute = r.randint(0, 900)
        readings.append(reading(i, str(r.randint(1, 5)), minute, r.choice([None, 10, 20, 20, 250_000]), r.choice([None, 5])))
        rows[i] = [(n, r.choice([5, 10])) for n in r.sample(["Knight", "Archer", "Battering Ram", "Nobody"], r.randint(0, 2))]
    frame = spark.createDataFrame(readings, READING)
    raw = spark.createDataFrame([(i, p, n, c, True, n == "Battering Ram", None, None) for i, items in rows.items() for p, (n, c) in enumerate(items)], ROW)
    item = F.struct("key_name", "name", "count", "known", "in_ram_zone")
    per = resolve(raw, d.units(spark), d.tiers(spark)).groupBy("reading_id").agg(F.collect_list(item).alias("rows"))
    full = frame.join(per, "reading_id", "left").withColumn("rows", F.coalesce("rows", F.expr(f"cast(array() as {live.ROWS})")))
    closed = sessions.closing_sessions(full.withColumn("rows", F.transform("rows", lambda x: x.dropFields("name"))))
    batch = {x.seq: x.start for x in closed.withColumn("start", F.expr("min(event_ts) over (partition by gid, session)")).collect()}
    path = str(tmp_path / "in")
    full.repartition(1).sortWithinPartitions("event_ts", "seq").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    seen = []
    q = live.write_each(live.live_sessions(stream), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert {x.seq: x.session_start for x in seen} == batch and len(seen) == 120
    assert any(x.complete for x in seen) and any(x.closed and not x.complete for x in seen)


def test_a_key_comes_once_in_an_upsert(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    have = rows(("a", 1), (" b ", 2), (None, 3))
    got = sink.upsert(have, rows(("b", 5), ("c", 6), (None, 7), (None, 8)), "k").collect()
    assert sorted((r.k or "", r.v) for r in got) == [("", 3), ("", 7), ("", 8), ("a", 1), ("b", 5), ("c", 6)]
    with pytest.raises(Exception, match="key more than once: b"):
        sink.upsert(have, rows(("b", 5), (" b", 6)), "k").collect()
    with pytest.raises(Exception, match="key more than once: b"):
        sink.upsert(have.limit(0), rows(("b", 5), ("b", 5)), "k").count()
    assert sink.upsert(have, have.limit(0), "k").count() == 3


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    wide = spark.createDataFrame([(k, "x" * 1000, [k]) for k in range(50)], "k long, v string, bits array<long>")
    planned = lambda df: "BroadcastHashJoin" in spark.range(9).join(df, F.col("id") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert planned(d.small(wide, rows=50)) and d.small(wide.limit(0)).count() == 0
        assert not planned(d.small(wide, rows=49)) and not planned(d.small(wide, size=40_000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables(spark, tmp_path):
    cols = list(report.SUBMISSIONS)
    def table(*rows):
        return spark.createDataFrame([tuple(r.get(c, "") for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))

    one, two = {"Governor ID": "111", "Name": "A", "Notes": "n", "Total Power": "1,000", "Total In Hospital": "5", "Fill Check": "pass"}, {"Governor ID": " 222 ", "Fill Check": "FAIL", "Total Power": "x"}
    store = sink.Store(spark, f"file://{tmp_path}/t", report.SUBMISSIONS)
    assert store.count() == 0
    store.write(sink.upsert(store.read(), table(one, two)))
    store.write(sink.upsert(store.read(), table({"Governor ID": "222", "Name": "B", "Fill Check": "FAIL"})))
    assert store.versions() == [1, 2] and sorted(r["Name"] for r in store.read().collect()) == ["A", "B"]
    edits = [("111", "T4+T5 Troops", "150,000", "Ed"), ("222", "Food", "abc", ""), ("333", "Name", "x", ""), ("222", "Total Power", "1", "")]
    e = spark.createDataFrame(edits, "`Governor ID` string, field string, value string, editor string")
    assert sorted(r.reason for r in sink.edit_errors(store.read(), e).collect()) == ["Food needs a number, got 'abc'.", "No row for governor 333.", "Total Power is not editable."]
    after = {r["Governor ID"]: r for r in sink.edit(store.read(), e, F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()}
    assert after["111"]["T4+T5 Troops"] == "150000" and after["111"]["Fill Check"] == "Pass" and "(set by Ed), at or above the 100,000" in after["111"]["Fill Note"]
    assert after["111"]["Notes"] == "n | edited by Ed 2024-01-02 03:04: T4+T5 Troops: (blank) -> 150000; fill check recomputed to Pass" and after["222"]["Food"] == ""
    keys = spark.createDataFrame([("111",)], "`Governor ID` string")
    assert [r["Governor ID"] for r in sink.remove(store.read(), keys).collect()] == ["222"] and sink.removed(store.read(), keys).count() == 1
    kids = spark.createDataFrame([("111", "a"), ("111", "b"), ("222", "c")], "`Governor ID` string, v string")
    assert sorted(r.v for r in sink.replace_children(kids, keys, kids.limit(0)).collect()) == ["c"]
    got = report.campaign_totals(table(one, two, {})).first()
    assert tuple(got) == (2, 1000, 5, 1, 1, 0)
    assert tuple(report.campaign_totals(sink.cleared(store.read())).first()) == (0, 0, 0, 0, 0, 0)


def test_messages_and_replies(spark, tmp_path):
    line = '{"message_id":%d,"channel_id":%d,"author_is_bot":%s,"user_name":"u","text":"%s","mentions_bot":%s,"event_ts":"2024-01-01T00:00:00Z","attachments":[%s],"message_url":"m"}'
    img = '{"name":"a.png","mime":null,"url":"x"}'
    rows = [(1, 1, "false", "id 12,345,678", "false", img), (2, 2, "false", "no id", "false", img), (3, 3, "false", "", "false", img), (4, 1, "true", "12345", "false", img), (5, 1, "false", "12345", "true", ""), (6, 1, "false", "12345", "false", img + "," + img), (7, 9, "false", "", "false", "")]
    (tmp_path / "m.json").write_text("\n".join(line % r for r in rows))
    got = {r.message_id: (r.route, r.gid, r.reject) for r in messages.route(messages.messages(spark, str(tmp_path / "m.json"))).collect()}
    assert got == {1: ("submission", "12345678", None), 2: ("siege", None, "no governor id"), 3: ("test", "test", None), 5: ("report", "12345", None), 6: ("submission", "12345", "more than one image"), 7: (None, None, None)}
    reply = '{"current_wounded":5,"values_were_abbreviated":true,"notes":" n ","rows":[{"name":" Knight ","name_readable":true,"count":5,"section":"Ram_Zone"},{"name":"","name_readable":true,"count":null}]}'
    readings, each = messages.readings_from_replies(spark.createDataFrame([(1, reply), (2, "junk")], "reading_id long, reply string"))
    got = {r.reading_id: r for r in readings.collect()}
    assert got[1].warnings == ["Row 'unnamed' had no readable count and was skipped.", "n"] and got[1].rss_approx and got[1].wounded_current == 5
    assert [(r.raw_name, r["count"], r.in_ram_zone, r.name_visible) for r in each.collect()] == [("Knight", 5, True, True)]
    assert messages.Options.load({"TALLYMARK_WORKERS": "3", "TALLYMARK_CREDENTIALS": "your_key"}).workers == 3


def test_images(spark):
    px = [(1, x, y, *((220, 180, 40) if min(x, y) < 3 or max(x, y) > 21 else (120, 60, 200))) for x in range(25) for y in range(25)] + [(1, 60 + x, y, 250, 250, 250) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(px, "image_id int, x int, y int, r int, g int, b int")
    assert [tuple(r) for r in images.frame_blobs(df).collect()] == [(1, 0, 0, 24, 24)]  # the last pixels, not the ones behind them
    inner = df.filter("x BETWEEN 5 AND 15 AND y BETWEEN 5 AND 15")
    assert images.tier_of(inner, df.filter("x >= 60"), ["image_id"]).first().tier == "T4"
    assert images.tier_of(inner, inner, ["image_id"]).first().tier is None
    bits = images.glyph_bits(df.filter("x >= 60"), ["image_id"]).first().bits
    assert bits == [-1] * 16
    green = spark.createDataFrame([(1, x, y, 40, 200, 60) for x in range(10) for y in range(10)], df.schema)
    assert images.resource_of(green, ["image_id"]).first().resource == "food"
