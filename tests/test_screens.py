import datetime as dt

from pyspark.sql import functions as F

from tallymark.functions.text import cell
from tallymark.operators import reconcile, report, screens, sessions, sink
from tallymark.operators.layout import TOKEN
from tallymark.sources import dimensions as d
from tallymark.sources import messages
from tallymark.streaming import live


def line(image, no, top, *words):
    """A line of (text, left) words of 20 pixels a word."""
    return (image, no, " ".join(w for w, _ in words), [(w, x, top, x + 20, top + 10) for w, x in words], top, top + 10)


LINES = f"image_id long, line_no int, text string, words array<{TOKEN}>, top int, bottom int"


def test_rows_with_and_without_names(spark):
    lines = [
        line(1, 0, 100, ("Longbowman", 50), ("1,200", 200)),
        line(1, 1, 130, ("Nieznany", 50), ("77", 205)),  # unnamed, above the end of the list, in the column
        line(1, 2, 160, ("Nieznany", 50), ("78", 290)),  # out of the column
        line(1, 3, 300, ("Nieznany", 50), ("79", 200)),  # below the end of the list
        line(1, 4, 170, ("Nieznany", 50), ("5/10", 200)),
        line(1, 5, 180, ("Cataphract", 50)),  # a known name without a count is no unnamed row
        line(1, 6, 190, ("ab", 50), ("80", 200)),
        line(2, 0, 100, ("Nieznany", 50), ("81", 200)),  # no named row: the frame decides
        line(2, 1, 130, ("Banner", 50), ("1", 200)),
        line(3, 0, 100, ("Nieznany", 50), ("82", 200)),  # no totals
        line(3, 1, 130, ("Battering", 50), ("Ram", 80), ("zones", 110), ("9", 200)),
    ]
    df = spark.createDataFrame(lines, LINES)
    anchors = spark.createDataFrame([(1, 400, 460), (2, 400, 460), (3, None, 460)], "image_id long, wounded_top int, ram_top int")
    density = spark.createDataFrame([(2, 0, 0.37), (2, 1, 0.0)], "image_id long, line_no int, density double")
    got = {(r.image_id, r.line_no): (r.raw_name, r["count"], r.known_name) for r in screens.read_rows(df, d.units(spark), anchors, ["image_id"], density).collect()}
    assert got == {(1, 0): ("longbowman", 1200, True), (1, 1): ("Nieznany", 77, False), (2, 0): ("Nieznany", 81, False)}
    assert screens.unnamed_rows(df, d.units(spark), anchors, ["image_id"]).count() == 1
    # the end of the list is 2.2 units above the totals
    low = spark.createDataFrame([(1, 200, 240)], "image_id long, wounded_top int, ram_top int")
    assert [r.line_no for r in screens.unnamed_rows(df, d.units(spark), low, ["image_id"]).collect()] == []


def test_grid(spark):
    box = "image_id long, pos int, left int, top int, right int, bottom int, "
    blobs = spark.createDataFrame([(1, 0, 0, 100, 30, 130, "Siege", "T1"), (1, 1, 0, 200, 30, 230, "Siege", None), (1, 2, 0, 300, 30, 330, "Archer", "T4"), (1, 3, 0, 400, 30, 430, "Siege", "T2")], box + "class string, tier string")
    numbers = spark.createDataFrame([(1, 0, 60, 20, 90, 40, "1,096"), (1, 1, 60, 105, 90, 125, "1,500"), (1, 2, 60, 205, 90, 225, "40"), (1, 3, 60, 305, 90, 325, "9")], box + "text string")
    lines = spark.createDataFrame([(2, "no units"), (3, "hello")], "image_id long, text string")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    got = {r.image_id: r for r in screens.read_grid(images, blobs, numbers, lines, ["image_id"]).collect()}
    assert (got[1].n_t1, got[1].total, got[1].readable) == (1500, 1500, True)
    assert len(got[1].warnings) == 2 and "40 troops" in got[1].warnings[0] and "count" in got[1].warnings[1]
    assert (got[2].total, got[2].warnings, got[2].readable) == (0, [], True)
    assert got[3].warnings == [screens.NO_ICONS] and not got[3].readable


def test_costs(spark):
    gold, wood = (200, 190, 40), (190, 110, 40)
    pixels = [(1, x, y, *gold) for x in range(0, 25) for y in range(0, 30)] + [(1, x, y, *wood) for x in range(200, 225) for y in range(0, 30)]
    tokens = spark.createDataFrame([(1, 0, "1.5M", 2.0, 5.0, 15.0, 40.0), (1, 1, "17.7", 225.0, 5.0, 15.0, 40.0), (1, 2, "9", 400.0, 5.0, 15.0, 40.0), (1, 3, "x", 2.0, 5.0, 15.0, 40.0)], "image_id long, pos int, text string, left double, top double, height double, unit double")
    values = screens.cost_values(tokens, spark.createDataFrame(pixels, "image_id long, x int, y int, r int, g int, b int"), ["image_id"])
    got = {r.pos: (r.resource, r.value) for r in values.collect()}
    assert got == {0: ("gold", 1_500_000), 1: ("wood", 17_700_000)}
    assert {(r.resource, r.votes) for r in screens.cost_votes(screens.all_readings(values, values), ["image_id"]).collect()} == {("gold", 2), ("wood", 2)}


def test_cost_incomplete_is_judged_at_the_last_reading_that_asks(spark):
    from tests.test_sessions_sink import reading, merged

    asks = ["food", "wood"]
    subs, _ = merged(spark, [reading(0, "1", 0, 100, food=5, expected=asks), reading(1, "1", 1, 100), reading(2, "2", 0, 50, food=1, expected=["food"])], {0: [("Knight", 1)]})
    got = {r.gid: r.cost_incomplete for r in subs.collect()}
    assert got == {"1": True, "2": False}


def test_rows_that_do_not_count_close_no_session(spark):
    rows = "array<struct<key_name:string,name:string,count:bigint,known:boolean,in_ram_zone:boolean>>"
    t = dt.datetime(2024, 1, 1)
    data = [(i, "1", t + dt.timedelta(minutes=i), i, 10, None, [("a", "a", 10, True, False), ("b", "b", 0, False, False), ("c", "(cut)", 3, True, False)]) for i in range(2)]
    df = spark.createDataFrame(data, f"reading_id long, gid string, event_ts timestamp, seq long, wounded_current long, ram_current long, rows {rows}")
    assert [r.session for r in sessions.closing_sessions(df).orderBy("seq").collect()] == [0, 1]


def test_cells_quote_texts_only(spark):
    row = spark.range(1).select(cell(F.lit(-5)).alias("n"), cell(F.lit("-5")).alias("t")).first()
    assert (row.n, row.t) == ("-5", "'-5")


def test_glyph_file_round_trip_and_sheet(spark, tmp_path):
    bits = [(1 << k) - (1 << 64 if k == 63 else 0) for k in (0, 5, 63, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29, 31)]
    assert d.read_glyphs(spark, f"{tmp_path}/none.json").collect() == []
    templates = spark.createDataFrame([("Siege", bits), ("Archer", bits[::-1])], d.GLYPH)
    more = d.add_glyphs(templates, spark.createDataFrame([("Siege", bits), ("Siege", [0] * 16), (None, bits)], d.GLYPH))
    assert more.count() == 3
    d.write_glyphs(more, f"{tmp_path}/glyphs")
    back = d.read_glyphs(spark, f"{tmp_path}/glyphs")
    assert sorted(map(tuple, ((r["class"], tuple(r.bits)) for r in back.collect()))) == sorted((r["class"], tuple(r.bits)) for r in more.collect())
    (tmp_path / "sheet.csv").write_text("Governor ID,Name\n1,A\n2,\n")
    grid = d.sheet_grid(spark, f"{tmp_path}/sheet.csv")
    assert [(r.pos, r.cells) for r in grid.collect()] == [(0, ["Governor ID", "Name"]), (1, ["1", "A"]), (2, ["2", ""])]


def test_sources(spark, tmp_path):
    images = spark.createDataFrame([(1, bytearray(b"ok"), "image/png"), (2, bytearray(b"bad"), "image/png"), (3, bytearray(6 << 20), "image/png")], "reading_id long, content binary, mime string")

    def reader(content, mime):
        if content == b"bad":
            raise ValueError("no reply")
        return '{"current_wounded": 5}'

    got = {r.reading_id: (r.reply, r.error) for r in messages.read_externally(images, reader).collect()}
    assert got == {1: ('{"current_wounded": 5}', None), 2: (None, "ValueError: no reply"), 3: (None, "image too large")}
    assert images.filter("reading_id = 1").select(messages.request_body(F.col("content")).alias("u")).first().u == "data:image/png;base64,b2s="
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert messages.credentials('{"a": 1}') == messages.credentials(f"{tmp_path}/c.json") == {"a": 1} and messages.credentials(" ") == {}


def test_writing_archiving_and_mirroring(spark, tmp_path):
    facts, children = sink.Store(spark, f"{tmp_path}/f", ("Governor ID", "Name")), sink.Store(spark, f"{tmp_path}/c", ("Governor ID", "Unit"))
    roster = spark.createDataFrame([("1", "R")], "gid string, name string")
    both = "`Governor ID` string, Name string"
    for name in ("", "Given"):
        sink.write_submission(facts, children, spark.createDataFrame([("1", name)], both), spark.createDataFrame([("1", name)], "`Governor ID` string, Unit string"), roster)
        assert [(r.Name) for r in facts.read().collect()] == [name or "R"] and [r.Unit for r in children.read().collect()] == [name]
    images = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "7", ".png", bytearray(b"x"))], "ts timestamp, gid string, suffix string, content binary")
    assert sink.archive(images, f"{tmp_path}/raw") and spark.read.parquet(f"{tmp_path}/raw").first().file == "20240102-030405_7.png"
    (tmp_path / "file").write_text("")
    assert not sink.archive(images, f"{tmp_path}/file/x")
    for k in range(2):
        sink.mirror(spark.createDataFrame([(k, "ok")], "key int, outcome string"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_batches_that_fail(spark, tmp_path):
    batch, seen = spark.range(3), []
    live.guarded(lambda b, n: seen.append(b.count()), f"{tmp_path}/bad")(batch, 0)

    def fail(b, n):
        raise ValueError("poor batch")

    live.guarded(fail, f"{tmp_path}/bad")(batch, 1)
    kept = spark.read.parquet(f"{tmp_path}/bad")
    assert seen == [3] and kept.count() == 3 and kept.first().reason == "ValueError: poor batch" and kept.first().batch == 1


def test_reports_and_dry_run(spark):
    readings = spark.createDataFrame([(1, 50, None, 1, None, None, None), (2, None, None, None, None, None, None)], "reading_id long, wounded_current long, ram_current long, food long, wood long, stone long, gold long")
    rows = spark.createDataFrame([(1, 0, "Knight", 50, True, False, None, None)], "reading_id long, pos int, raw_name string, count long, name_visible boolean, in_ram_zone boolean, tier string, troop_type string")
    grid = spark.createDataFrame([(1, 9, []), (2, 7, ["w"])], "reading_id long, total long, warnings array<string>")
    got = {r.reading_id: r for r in reconcile.dry_run(readings, rows, d.units(spark), d.tiers(spark), grid).collect()}
    assert got[1].ok and got[1].siege_total is None and not got[2].ok and got[2].siege_total == 7 and got[2].siege_warnings == ["w"]
    assert readings.select(reconcile.rss_map().alias("m")).first().m == {"food": 1, "wood": None, "stone": None, "gold": None}
    many = spark.range(1).select(report.shown_problems(F.array(*map(F.lit, "abcd"))).alias("p")).first().p
    assert many == "- a\n- b\n- c"
    subs = spark.createDataFrame([("1", 0, "Complete", "Pass", 50, ["m"])], "gid string, session int, status string, verdict string, total_in_hospital long, missing array<string>")
    listed = spark.createDataFrame([("1", 0, "Knight" * 300, 50, "T4", None, True, 200, False)], "gid string, session int, name string, count long, tier string, type string, known boolean, power_total long, in_ram_zone boolean")
    shown = report.display(subs, listed, ["gid", "session"]).first()
    assert len(shown.troops) == 1024 and shown.totals == "**Total in hospital: 50**" and shown.problems == "- m"
    judged = spark.createDataFrame([("1", 1, 0, 0, 0, 2, "Fail", ["x"])], "gid string, n_t1 long, n_t2 long, n_t3 long, n_t4 long, n_t5 long, siege_verdict string, siege_notes array<string>")
    assert report.siege_display(judged, ["gid"]).first().counts.startswith("T1: 1")


def test_closing_by_hand(spark):
    t = dt.datetime(2024, 1, 1)
    subs = spark.createDataFrame([("1", 0, t), ("1", 1, t + dt.timedelta(minutes=50)), ("2", 0, t)], "gid string, session int, updated_at timestamp").withColumns({c: F.lit("x") for c in ("status", "verdict", "missing")})
    now = F.lit(t + dt.timedelta(minutes=60))
    closed, missing = sessions.closed_by_hand(subs, spark.createDataFrame([("1",), ("2",)], "gid string"), now)
    assert [(r.gid, r.session) for r in closed.collect()] == [("1", 1)] and [r.gid for r in missing.collect()] == ["2"]
    assert [(r.gid, r.minutes_left) for r in sessions.status(subs, now).collect()] == [("1", 20)]
