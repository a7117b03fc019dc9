import random

from pyspark.sql import functions as F

from tallymark.operators import images, portraits, regions, screens

PIXEL = "img long, x int, y int, r int, g int, b int"
GOLD, WHITE, PURPLE = (220, 180, 40), (250, 250, 250), (140, 40, 200)


def test_points_meet_the_boxes_that_hold_them_and_nothing_else(spark):
    r = random.Random(1)
    points = [(r.randint(0, 2), r.randint(-40, 140), r.randint(-40, 140)) for _ in range(500)]
    boxes = [(r.randint(0, 2), k, x := r.randint(-50, 100), x + r.randint(0, 70), y := r.randint(-50, 100), y + r.randint(0, 70)) for k in range(40)]
    df = regions.in_boxes(spark.createDataFrame(points, "img int, x int, y int"), spark.createDataFrame(boxes, "img int, box_id int, x0 int, x1 int, y0 int, y1 int"), ["img"])
    want = sorted((i, x, y, k) for i, x, y in points for j, k, a, b, c, e in boxes if i == j and a <= x < b and c <= y < e)
    assert sorted((p.img, p.x, p.y, p.box_id) for p in df.collect()) == want
    plan = df._jdf.queryExecution().toString()
    assert "_tx" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def ring(img, left, top, w, h):
    return [(img, x, y, *GOLD) for x in range(left, left + w + 1) for y in range(top, top + h + 1) if min(x - left, left + w - x, y - top, top + h - y) < 2]


def test_types_are_read_between_portrait_and_name(spark):
    """One row with a cross beside its portrait, one with a bar, one without a portrait of its own but with a cross."""
    px, rows = [], []
    for line, (mid, kind) in enumerate([(40, "cross"), (100, "bar"), (160, "cross"), (220, None)]):
        full = ring(1, 20, mid - 8, 24, 22)
        px += full if line != 2 else [p for p in full if p[2] <= mid + 12]
        px += [(1, x, y, *PURPLE) for x in range(22, 43) for y in range(mid - 6, mid + 1)]
        on = {"cross": lambda x, y: x in (57, 58, 59) or y in (-1, 0, 1), "bar": lambda x, y: x < 56, None: lambda x, y: False}[kind]
        px += [(1, x, mid + y, *WHITE) for x in range(50, 67) for y in range(-7, 8) if on(x, y)]
        rows.append((1, line, float(mid), 78.0, 20.0))
    pixels = spark.createDataFrame(px, PIXEL)
    images = spark.createDataFrame([(1, 200, 300)], "img long, width int, height int")
    read = portraits.read_portraits(spark.createDataFrame(rows, "img long, line_no int, centre double, name_left double, unit double"), pixels, images, ["img"])
    got = {r.line_no: r for r in read.collect()}
    assert [(got[k].tier, got[k].fitted, got[k].left, got[k].right) for k in range(4)] == [("T4", False, 20, 44), ("T4", False, 20, 44), ("T4", True, 20, 44), ("T4", False, 20, 44)]

    def glyph(line):
        box = spark.createDataFrame([(1, line, 46, 76, int(rows[line][2]) - 8, int(rows[line][2]) + 8)], "img long, line_no int, x0 int, x1 int, y0 int, y1 int")
        return portraits.glyph_bits(regions.in_boxes(pixels, box, ["img"]), ["img"]).first().bits

    learned = portraits.learn_templates(spark.createDataFrame([("Siege", glyph(0)), ("Archer", glyph(1)), ("Siege", glyph(0)), (None, glyph(1))], "class string, bits array<bigint>"))
    assert learned.count() == 2
    types = {r.line_no: r["class"] for r in portraits.row_types(read, pixels, images, learned, ["img"]).collect()}
    assert types == {0: "Siege", 1: "Archer", 2: "Siege", 3: None}


def test_templates_are_checked_by_the_others(spark):
    a, b, c = [0] * 16, [-1] * 16, [0] * 15 + [255]
    rows = [(1, "Siege", a), (2, "Siege", c), (3, "Archer", b), (4, "Archer", a), (5, "Cavalry", b), (6, None, a)]
    got = {r.id: (r.found, r.outcome) for r in portraits.check_templates(spark.createDataFrame(rows, "id int, class string, bits array<bigint>"), ["id"]).collect()}
    # 1 is like 4, of another class, but as much like 2; 3 and 5 are each the other's only likeness, and 4's is 1
    assert got == {1: (None, "unknown"), 2: (None, "unknown"), 3: ("Cavalry", "differ"), 4: ("Siege", "differ"), 5: ("Archer", "differ")}
    more = [(k, "Siege", a) for k in range(3)] + [(k, "Archer", b) for k in range(3, 6)] + [(9, "Siege", b)]
    got = {r.id: r.outcome for r in portraits.check_templates(spark.createDataFrame(more, "id int, class string, bits array<bigint>"), ["id"]).collect()}
    assert got == {0: "agree", 1: "agree", 2: "agree", 3: "unknown", 4: "unknown", 5: "unknown", 9: "differ"}


def test_cost_strips_need_two_totals_of_one_size(spark):
    rows = [(1, 100, 200, 220, 240, 260, 2.0), (2, 100, 200, 220, 240, 268, 2.0), (3, 100, 200, 220, 208, 228, 2.0), (4, 100, 200, 200, 240, 260, 2.0), (5, 100, 200, 220, 240, 267, 1.0), (6, 1990, 200, 220, 240, 260, 2.0)]
    totals = spark.createDataFrame(rows, "img long, wounded_left int, wounded_top int, wounded_bottom int, ram_top int, ram_bottom int, scale double")
    images = spark.createDataFrame([(k, 1000, 800) for k in range(1, 7)], "img long, width int, height int")
    got = {r.img: tuple(r)[1:] for r in screens.cost_strips(totals, images, ["img"]).collect()}
    assert got == {1: (150, 450, 64, 96, 20.0), 5: (300, 900, 128, 192, 40.0)}


def test_the_reach_of_a_column_is_in_pixels_of_the_original(spark):
    from tests.test_screens import LINES, d, line

    lines = spark.createDataFrame([line(1, 0, 100, ("Longbowman", 50), ("1,200", 200)), line(1, 1, 130, ("Nieznany", 50), ("77", 240))], LINES)
    tops = spark.createDataFrame([(1, 400, 460)], "image_id long, wounded_top int, ram_top int")
    read = lambda anchors: [r.line_no for r in screens.unnamed_rows(lines, d.units(spark), anchors, ["image_id"]).collect()]
    assert read(tops) == [1] and read(tops.withColumn("scale", F.lit(2.0))) == []


def stored_screen(spark, tmp_path):
    """rows, pixels and images of 40 screens, as scanned from files far smaller than what they hold."""
    px = spark.range(40).selectExpr("id AS img", "explode(sequence(40, 64)) AS x").selectExpr("img", "x", "explode(sequence(32, 54)) AS y", "220 AS r", "180 AS g", "40 AS b")
    rows = spark.range(40).selectExpr("id AS img", "0L AS line_no", "40d AS centre", "74d AS name_left", "20d AS unit")
    for name, df in (("pixels", px.filter("x IN (40, 41, 63, 64) OR y IN (32, 33, 53, 54)")), ("rows", rows), ("images", rows.selectExpr("img", "200 AS width", "560 AS height"))):
        df.write.parquet(f"{tmp_path}/{name}")
    return [spark.read.parquet(f"{tmp_path}/{name}") for name in ("rows", "pixels", "images")]


def plan_of(spark, df):
    """The plan of df where Spark may broadcast whatever it takes to be under 1 GB."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_column_is_fitted_without_a_broadcast(spark, tmp_path):
    rows, pixels, sizes = stored_screen(spark, tmp_path)
    fit = lambda: portraits.column_fit(rows, portraits.frame_pixels(pixels, ["img"]), sizes, ["img"])
    assert "SortMergeJoin" in (plan := plan_of(spark, fit)) and "Broadcast" not in plan
    assert {tuple(r)[1:] for r in fit().collect()} == {(40, 64, 3.0, 22.0)}


def test_portraits_are_read_without_a_broadcast(spark, tmp_path):
    rows, pixels, sizes = stored_screen(spark, tmp_path)
    read = lambda: portraits.read_portraits(rows, pixels, sizes, ["img"])
    assert "SortMergeJoin" in (plan := plan_of(spark, read)) and "Broadcast" not in plan
    assert {tuple(r)[5:] for r in read().collect()} == {(40, 32, 64, 54, None, False)}


def test_costs_are_read_without_a_broadcast(spark, tmp_path):
    icon = spark.range(40).selectExpr("id AS img", "explode(sequence(110, 121)) AS x").selectExpr("img", "x", "explode(sequence(20, 39)) AS y", "40 AS r", "200 AS g", "60 AS b")
    icon.write.parquet(f"{tmp_path}/pixels")
    spark.range(40).selectExpr("id AS img", "0L AS pos", "'7K' AS text", "100d AS left", "20d AS top", "20d AS height", "40d AS unit").write.parquet(f"{tmp_path}/tokens")
    tokens, pixels = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("tokens", "pixels"))
    costs = lambda: screens.cost_values(tokens, pixels, ["img"])
    assert "SortMergeJoin" in (plan := plan_of(spark, costs)) and "Broadcast" not in plan
    assert sorted(tuple(r) for r in costs().collect()) == [(i, 0, "food", 7000, True) for i in range(40)]


def connected(pixels, reach):
    """Boxes of the connected pixels of each image, whatever their size."""
    out, left = [], set(pixels)
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            i, x, y = todo.pop()
            near = {(i, x + a, y + b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)} & left
            left -= near
            todo += near
            group += near
        xs, ys = [p[1] for p in group], [p[2] for p in group]
        out.append((group[0][0], min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


def test_blobs_go_on_over_the_edges_of_tiles(spark):
    r = random.Random(3)
    some = [(i, r.randint(-30, 50), r.randint(-30, 50)) for i in range(3) for _ in range(700)]
    snake = [(9, x, y) for x in range(0, 60, 4) for y in range(60)] + [(9, x + d, 59 * (x // 4 % 2)) for x in range(0, 56, 4) for d in range(4)]
    for reach, tile in ((1, 8), (2, 7), (2, 512), (3, 16)):
        df = spark.createDataFrame([(*p, *GOLD) for p in some + snake + some[:50]], PIXEL).repartition(4)
        got = images.frame_blobs(df, "img", reach, side=1, aspect=(0, 1e9), tile=tile).collect()
        assert sorted(tuple(b) for b in got) == [b for b in connected(some + snake, reach) if b[3] > b[1] and b[4] > b[2]]


def test_blobs_inside_a_tile_are_written_once(spark, monkeypatch):
    df = spark.range(30).selectExpr("CAST(id AS string) AS img", "explode(sequence(40, 64)) AS x").selectExpr("img", "x", "explode(sequence(32, 56)) AS y", "220 AS r", "180 AS g", "40 AS b").filter("x IN (40, 64) OR y IN (32, 56)")
    written, kept = [], images.kept
    monkeypatch.setattr(images, "kept", lambda d: written.append(kept(d)) or written[-1])
    assert sorted(tuple(b)[1:] for b in images.frame_blobs(df, "img").collect()) == 30 * [(40, 32, 64, 56)]
    assert sum(d.count() for d in written) == 30  # the 48 runs of a frame were, in each round


def test_templates_of_several_blocks_and_lengths_match_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, r.choice("BCA"), [r.getrandbits(64) - 2**63 for _ in range(n)]) for n in (1, 2, 3) for k in range(100 * n, 100 * n + 40)]
    rows += [(500 + k, r.choice("ABC"), [b ^ (1 << r.randrange(62)) for b in rows[k][2]]) for k in range(0, 120, 3)] + [(700 + k, *rows[k][1:]) for k in range(0, 30, 7)]
    rows += [(800, "A", None), (801, None, [1]), (802, "D", [1] * 9), (803, "A", [None, 1]), (804, "A", [-1] * 5), (805, "B", [-2] * 5)]

    def found(i, bits):
        same = [(c, sum((x ^ y).bit_count() if (x ^ y) >= 0 else 64 - (~(x ^ y)).bit_count() for x, y in zip(bits, b)) / (64 * len(b))) for j, c, b in rows if j != i and c and b and None not in b and len(b) == len(bits)]
        best = sorted((d, c) for c, d in {c: min(d for e, d in same if e == c) for c, _ in same}.items())
        return best[0][1] if best and best[0][0] <= 0.34 and (best[1][0] if len(best) > 1 else 1) - best[0][0] >= 0.03 else None

    monkeypatch.setattr(portraits, "BLOCK_LEAST", 20)
    out = portraits.check_templates(spark.createDataFrame(rows, "id int, class string, bits array<bigint>").repartition(3), ["id"], 0.66, 0.03)
    want = {i: None if None in b else found(i, b) for i, c, b in rows if c and b}
    assert {x.id: x.found for x in out.collect()} == want and len({*want.values()}) == 4
    assert "bit_count" not in out._jdf.queryExecution().executedPlan().toString()  # no row for a pair
