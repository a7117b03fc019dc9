from pyspark.sql import functions as F

from tallymark.operators import choose, layout, reconcile, rules
from tallymark.sources import dimensions as d

ROW = "reading_id long, pos int, raw_name string, count long, name_visible boolean, in_ram_zone boolean, tier string, troop_type string"
HEAD = "reading_id long, wounded_current long, ram_current long"
GOLD = [("Long Swordsman", 47), ("Longbowman", 27), ("Cataphract", 158), ("Battering Ram", 84)]


def frames(spark, cases):
    rows, heads = [], []
    for i, (wounded, ram, items) in enumerate(cases):
        heads.append((i, wounded, ram))
        for p, item in enumerate(items):
            name, n, *rest = item
            visible, tier, kind = (rest + [True, None, None][len(rest) :])[:3]
            rows.append((i, p, name, n, visible, False, tier, kind))
    return spark.createDataFrame(heads, HEAD), spark.createDataFrame(rows, ROW)


def test_evaluate(spark):
    cases = [
        (232, 84, GOLD),
        (232, 84, [*GOLD[:2], ("Cataphract", 153), GOLD[3]]),
        (316, 0, GOLD),
        (200, None, [("", 43, False), ("Knight", 22), ("Knight", 135)]),
        (7, None, [("Bretteur", 7, True, "T4")]),
        (5, None, []),
        (None, None, [("Nobody", 3)]),
    ]
    heads, rows = frames(spark, cases)
    out, resolved = reconcile.evaluate(heads, rows, d.units(spark), d.tiers(spark))
    got = {r.reading_id: r for r in out.collect()}
    assert got[0].problems == [] and got[0].ok and got[0].total_troops == 316 and got[0].total_power == 232 * 4 + 84
    assert got[0].types_present == ["Infantry", "Archer", "Cavalry", "Siege"] and got[0].tiers_present == ["T1", "T4"] and not got[0].power_is_partial
    assert got[1].problems == ["Wounded rows add up to 227 but the total says 232 (off by 5)."]
    assert got[2].ok, got[2].problems  # the rams are wounded rows, as only that makes the sum exact
    assert [r.in_ram_zone for r in resolved.filter("reading_id = 2 AND raw_name = 'Battering Ram'").collect()] == [False]
    assert not got[3].ok and "scrolled out of view (count: 43)" in got[3].problems[-1]
    assert got[4].ok and got[4].n_t4 == 7 and got[4].total_power == 28 and got[4].types_present == []
    assert got[5].problems == ["Wounded rows add up to 0 but the total says 5 (off by 5).", "No troop rows were read at all."]
    assert got[6].problems[0].startswith("Could not read") and got[6].power_is_partial and got[6].total_power == 0
    assert "Unknown unit 'Nobody'" in got[6].problems[1]


def test_fill_check_and_siege_rules(spark):
    cases = [
        (150000, None, [("Knight", 150000)], "Pass"),
        (500, 200000, [("Battering Ram", 200000), ("Knight", 500)], "FAIL"),
        (180000, None, [("Knight", 120000)], "Pass"),
        (150000, None, [("Knight", 60000)], "Unconfirmed"),
        (40000, None, [], "FAIL"),
        (120000, None, [("Someone", 120000, True, "T5")], "Pass"),
        (None, None, [("Knight", 1)], "Unknown"),
    ]
    heads, rows = frames(spark, [c[:3] for c in cases])
    _, resolved = reconcile.evaluate(heads, rows, d.units(spark), d.tiers(spark))
    per = resolved.groupBy("reading_id").agg(*rules.state_columns())
    full = heads.join(per, "reading_id", "left").fillna(0, ["identified", "high_tier", "unknown_tier", "listed", "siege"])
    none = F.array().cast("array<string>")
    full = full.withColumns({c: F.coalesce(c, none) for c in ("unknown_names", "unknown_tier_names")})
    got = {r.reading_id: r for r in rules.judge(full).collect()}
    assert [got[i].verdict for i in range(len(cases))] == [c[3] for c in cases]
    assert "99,500 short" in got[1].note and got[2].unaccounted == 60000 and got[0].status == "Complete" and got[6].status == "Unreadable"
    assert got[3].awaiting_more and got[3].status == "Totals only" and got[3].missing[0].startswith("90,000 of 150,000")
    siege = spark.createDataFrame([(0, 0, 0, 0, 0), (200000, 0, 0, 75000, 10**6), (300000, 5, 0, 80000, 0)], "n_t1 long, n_t2 long, n_t3 long, n_t4 long, n_t5 long")
    got = [(r.siege_verdict, len(r.siege_notes)) for r in rules.siege_rules(siege).collect()]
    assert got == [("Pass", 1), ("Pass", 1), ("FAIL", 3)]


def test_dimensions(spark):
    units = d.units(spark)
    assert units.count() == len(d.UNITS)
    learned = spark.createDataFrame([(0, "Bretteur", " t4", "cavalry", None), (1, "x", "T9", "Siege", None), (2, "militia", "T2", "Infantry", 7)], "pos int, name string, tier string, type string, power long")
    after = {r.key: tuple(r)[1:] for r in d.learn(units, learned).collect()}
    assert after["bretteur"] == ("T4", "Cavalry", None) and after["militia"] == ("T2", "Infantry", 7) and len(after) == len(d.UNITS) + 1
    assert [r.reason for r in d.rejected(learned).collect()] == ["unknown tier"]
    grid = spark.createDataFrame([(0, ["Kingdom roster"]), (1, ["#", "Governor ID", "Name"]), (2, ["1", "111,222", " Ann "]), (3, ["2", "x1", "Bob"]), (4, ["3", "333"]), (5, ["4", "111222", "Anna"])], "pos int, cells array<string>")
    assert [tuple(r) for r in d.roster(grid).collect()] == [("111222", "Anna")]
    plain = spark.createDataFrame([(0, ["5", "E"]), (1, ["6", ""])], "pos int, cells array<string>")
    assert sorted(tuple(r) for r in d.roster(plain).collect()) == [("5", "E"), ("6", "")]
    keys = spark.createDataFrame([("5",), ("6",), ("7",)], "gid string")
    assert [r.gid for r in reconcile.pass_roster(keys, d.roster(plain)).collect()] == ["5"]
    assert reconcile.pass_roster(keys, d.roster(plain), available=False).count() == 3


def test_name_match(spark):
    lines = ["royal crossbowman 1", "battering ram zone", "unknownish crossbowman 3", "x Man-at-Arms 5", "a knight", "12 crossbowman", "teutonic knight 4"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, text string")
    got = {r.line_id: r.unit for r in reconcile.match_names(df, d.units(spark)).collect()}
    assert got == {0: "royal crossbowman", 3: "man at arms", 4: "knight", 5: "crossbowman", 6: "teutonic knight"}


def test_choosing(spark):
    votes = spark.createDataFrame([("a", v) for v in (1, 1, 2)] + [("b", v) for v in (1, 1, 2, 2)] + [("c", 5)] + [("d", None)], "k string, value long")
    got = {r.k: r.winner for r in choose.vote(votes, ["k"]).collect()}
    assert got == {"a": 1, "b": None, "c": None}
    cand = "key long, reading_id int, n_rows int, food long, wood long, stone long, gold long, rss_approx boolean, warnings array<string>, wounded_current long, problems array<string>"
    df = spark.createDataFrame([(1, 0, 3, None, 5, None, 1, False, ["Could not read the food, stone cost.", "w"], 9, ["p"]), (1, 1, 2, 7, 5, None, 2, True, [], 9, []), (2, 0, 4, None, None, None, None, False, [], None, ["p"]), (2, 1, 1, None, None, None, None, False, [], 5, ["p", "q"])], cand)
    shared = {(r.key, r.reading_id): r for r in choose.share_values(df, "key").collect()}
    assert shared[1, 0].food == 7 and shared[1, 0].gold == 1 and shared[1, 0].rss_approx and shared[1, 0].warnings == ["w", "Could not read the stone cost."]
    assert {r.key: r.reading_id for r in choose.best_reading(df, "key").collect()} == {1: 1, 2: 1}
    glyphs = spark.createDataFrame([(1, [-1, 0]), (2, [0, 0])], "id int, bits array<long>")
    templates = spark.createDataFrame([("A", [-1, 0]), ("B", [-1, -1])], "class string, bits array<long>")
    assert {r.id: (r["class"], r.best, r.second) for r in choose.classify_glyphs(glyphs, templates, ["id"]).collect()} == {1: ("A", 1.0, 0.5), 2: (None, 0.5, 0.0)}


def test_layout(spark):
    tok = "img int, text string, left int, top int, right int, bottom int"
    words = [(1, "609", 160, 101, 200, 130), (1, "257", 100, 100, 150, 129), (1, "Knight", 10, 104, 90, 130), (1, "4", 400, 100, 420, 129), (1, "below", 10, 150, 60, 170)]
    lines = layout.group_lines(spark.createDataFrame(words, tok), ["img"])
    got = lines.select("line_no", "text", layout.count_word(F.col("words"))["text"].alias("n")).orderBy("line_no").collect()
    assert [(r.text, r.n) for r in got] == [("Knight 257 609 4", "257 609"), ("below", None)]
    text = [(1, 0, "Severely Wounded Units"), (1, 1, "abc/def"), (1, 2, "27,213/50,000"), (2, 0, "x 232/548,725"), (2, 1, "Battering Ram Zone"), (2, 2, "84/500"), (2, 3, "84/200,000")]
    got = {r.img: tuple(r)[1:] for r in layout.read_totals(spark.createDataFrame(text, "img int, line_no int, text string"), ["img"]).collect()}
    assert got == {1: (None, None, 27213, 50000), 2: (232, 548725, None, None)}
    numbers = spark.createDataFrame([(1, 0, 100, 10, 120, 20, "55"), (1, 1, 101, 11, 140, 20, "55,965"), (1, 2, 300, 10, 320, 20, "7")], "img int, pos int, left int, top int, right int, bottom int, text string")
    assert sorted(r.text for r in layout.bucket_dedupe(numbers, ["img"]).collect()) == ["55,965", "7"]
    icons = spark.createDataFrame([(1, 0, 60, 5, 90, 25), (1, 1, 50, 6, 80, 26), (1, 2, 200, 5, 240, 25)], "img int, pos int, left int, top int, right int, bottom int")
    assert {r.pos: r.number for r in layout.match_icons(icons, numbers, ["img"]).collect()} == {0: "55", 1: None, 2: "7"}
