"""Queries over screens that the test tables draw: every row is a portrait, a cost token or a box, pixel by pixel.

What the reader must find follows from the row that was drawn, so the oracles say it without any search.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import images, portraits, regions, screens
from tallymark.operators.store import Tables
from tallymark.operators.tables import kept, shared_folder
from tallymark.sources.dimensions import roster

from .queries import TIER_OF, _t, query

COLOURS = {"ECONOMY": (150, 150, 150), "SMALL": (40, 200, 60), "MEDIUM": (40, 80, 220), "LARGE": (140, 40, 200), "PROMO": (150, 50, 30), "STANDARD": (20, 20, 20)}
FRAME = (220, 180, 40)
_TIER = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TIER_OF.items()) + " END"


def _rgb(kind: Column, table: dict[str, tuple[int, int, int]]) -> Column:
    return F.coalesce(*[F.when(kind == k, F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", rgb)])) for k, rgb in table.items()])


def _grid(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """A row for every pixel from x0 to x1 and y0 to y1."""
    return df.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))


def _parts(spark: SparkSession, sf_dir: str, *columns: str, per: int) -> DataFrame:
    """part with `per` of its keys to an img. The file is small and what is drawn from it is not, so it is dealt by img."""
    p = _t(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / per).alias("img"), "p_partkey", *columns)
    return p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "img")


def _list_screens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pixels, images): eight parts to a screen. The fourth has no lower edge of its frame and the sixth no frame at
    all; beside every part of a size that four divides the panel has the portrait's colour."""
    p = _parts(spark, sf_dir, "p_type", "p_size", per=8)
    rows = p.select("img", (F.col("p_partkey") % 8).alias("line_no"), "p_type", "p_size")
    rows = rows.withColumns({"left": 40 + F.col("img") % 7, "mid": 40 + 60 * F.col("line_no")})
    px = _grid(rows, F.col("left") - 13, F.col("left") + 24, F.col("mid") - 8, F.col("mid") + 14)
    dx, dy, line = F.col("x") - F.col("left"), F.col("y") - F.col("mid"), F.col("line_no")
    ring = (dx >= 0) & (dx.isin(0, 1, 23, 24) | dy.isin(-8, -7, 13, 14)) & (line != 5) & ((line != 3) | (dy <= 12))
    inside = dx.between(2, 22) & dy.between(-6, 0)
    beside = (dx < -2) & dy.between(-6, 0) & (F.col("p_size") % 4 == 0)
    colour = F.when(ring, F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", FRAME)])).when(inside | beside, _rgb(F.col("p_type"), COLOURS))
    pixels = kept(px.withColumn("c", colour).filter("c IS NOT NULL").select("img", "x", "y", "c.*"))
    found = rows.select("img", "line_no", F.col("mid").cast("double").alias("centre"), (F.col("left") + 34).cast("double").alias("name_left"), F.lit(20.0).alias("unit"))
    return found, pixels, rows.select("img").distinct().withColumns({"width": F.lit(200), "height": F.lit(560)})


@query(
    f"""SELECT p_partkey // 8 AS img, p_partkey % 8 AS line_no, 40 + p_partkey // 8 % 7 AS "left", 32 + 60 * (p_partkey % 8) AS top, 64 + p_partkey // 8 % 7 AS "right", 54 + 60 * (p_partkey % 8) AS bottom,
  CASE WHEN p_partkey % 8 <> 5 AND p_size % 4 > 0 THEN {_TIER} END AS tier, p_partkey % 8 = 3 AND p_size % 4 > 0 AND p_type <> 'STANDARD' AS fitted FROM part"""
)
def portrait_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portraits.read_portraits(*_list_screens(spark, sf_dir), ["img"]).select("img", "line_no", "left", "top", "right", "bottom", "tier", "fitted")


@query(
    """WITH r AS (SELECT p_partkey // 8 AS img, 40 + p_partkey // 8 % 7 AS x FROM part WHERE p_partkey % 8 NOT IN (3, 5))
SELECT img, min(x) AS "left", min(x) + 24 AS "right", 3.0::DOUBLE AS "offset", 22.0::DOUBLE AS height FROM r GROUP BY img"""
)
def portrait_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pixels, sizes = _list_screens(spark, sf_dir)
    return portraits.column_fit(rows, portraits.frame_pixels(pixels, ["img"]), sizes, ["img"])


@query(
    """WITH p AS (SELECT DISTINCT l_suppkey % 50 AS img, l_partkey % 64 AS x, l_orderkey % 64 AS y FROM lineitem),
b AS (SELECT s_suppkey % 50 AS img, s_suppkey AS box_id, s_suppkey % 23 - 3 AS x0, s_suppkey % 23 + 5 + s_nationkey AS x1, s_suppkey % 57 - 2 AS y0, s_suppkey % 57 + 10 + s_suppkey % 13 AS y1 FROM supplier),
c AS (SELECT img, box_id, greatest(x0, 0) AS x0, least(x1, 64) AS x1, greatest(y0, 0) AS y0, least(y1, 64) AS y1 FROM b WHERE x1 - x0 >= 10 AND y1 - y0 >= 10),
k AS (SELECT * FROM c WHERE x1 - x0 >= 10 AND y1 - y0 >= 10),
h AS (SELECT k.img, box_id, sum((y = y0)::INT + (y = y1 - 1)::INT + (x = x0)::INT + (x = x1 - 1)::INT) AS n FROM k JOIN p ON p.img = k.img AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2)
SELECT k.img, k.box_id, coalesce(n, 0)::DOUBLE / (2 * (x1 - x0 + y1 - y0)) AS share FROM k LEFT JOIN h ON h.box_id = k.box_id"""
)
def frame_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("img"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y")).distinct()
    s, x, y = F.col("s_suppkey"), F.col("s_suppkey") % 23 - 3, F.col("s_suppkey") % 57 - 2
    boxes = _t(spark, sf_dir, "supplier").select((s % 50).alias("img"), s.alias("box_id"), x.alias("x0"), (x + 8 + F.col("s_nationkey")).alias("x1"), y.alias("y0"), (y + 12 + s % 13).alias("y1"))
    sizes = boxes.select("img").distinct().withColumns({"width": F.lit(64), "height": F.lit(64)})
    return regions.ring_share(boxes, points, sizes, ["img"])


ICONS = {"food": (40, 200, 60), "wood": (190, 110, 40), "stone": (120, 120, 125), "gold": (200, 190, 40)}
ICON_OF = {"ECONOMY": "food", "SMALL": "wood", "MEDIUM": "stone", "LARGE": "gold", "PROMO": "food", "STANDARD": "wood"}


def _cost_strips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, pixels): four parts to a strip, with an icon in the first window beside the token, in the second, in both or
    in none; a fifth of the tokens are no numbers and another fifth have lost their suffix."""
    p = _parts(spark, sf_dir, "p_type", "p_size", per=4)
    k, m = F.col("p_partkey"), F.col("p_partkey") % 7
    bare = F.concat((k % 90 + 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    text = F.when(F.col("p_size") % 5 == 0, "x").when(F.col("p_size") % 5 == 1, bare).otherwise(F.concat(k.cast("string"), F.lit("K")))
    kind = F.coalesce(*[F.when(F.col("p_type") == a, F.lit(b)) for a, b in ICON_OF.items()])
    tokens = p.select("img", (k % 4).alias("pos"), text.alias("text"), (100 + 150 * (k % 4)).cast("double").alias("left"), F.lit(20.0).alias("top"), F.lit(20.0).alias("height"), F.lit(40.0).alias("unit"), m.alias("m"), kind.alias("kind"))
    near = F.when(F.col("m").isin(0, 1, 5, 6), F.struct(F.lit(10).alias("at"), F.col("kind").alias("icon")))
    far = F.when(F.col("m").isin(2, 3), F.struct(F.lit(-33).alias("at"), F.col("kind").alias("icon"))).when(F.col("m").isin(5, 6), F.struct(F.lit(-33).alias("at"), F.lit("stone").alias("icon")))
    icons = tokens.select("img", F.col("left").cast("long").alias("left"), F.explode(F.array_compact(F.array(near, far))).alias("i"))
    at = F.col("left") + F.col("i.at")
    pixels = kept(_grid(icons, at, at + 11, F.lit(20), F.lit(39)).withColumn("c", _rgb(F.col("i.icon"), ICONS)).select("img", "x", "y", "c.*"))
    return tokens.drop("m", "kind"), pixels


@query(
    "WITH t AS (SELECT p_partkey // 4 AS img, p_partkey % 4 AS pos, p_partkey AS k, p_size % 5 AS s, p_partkey % 90 + 10 AS i, p_size % 10 AS d, p_partkey % 7 AS m, CASE p_type "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ICON_OF.items())
    + """ END AS resource FROM part), n AS (SELECT img, count(*) FILTER (s > 1) AS ks FROM t GROUP BY 1)
SELECT t.img, pos, resource, CASE WHEN s > 1 THEN k * 1000 WHEN ks > 0 THEN i * 1000 + d * 100 ELSE i * 10 + d END AS value, s > 1 OR ks > 0 AS approx FROM t JOIN n ON t.img = n.img WHERE s > 0 AND m <> 4"""
)
def cost_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.cost_values(*_cost_strips(spark, sf_dir), ["img"])


@query(
    """WITH p AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN 19 ELSE 20 + p_size % 9 END AS w, CASE WHEN p_size % 7 = 0 THEN 60 ELSE 22 + p_size % 5 END AS h FROM part)
SELECT p_partkey // 8 AS img, 10 + p_size AS "left", 5 + 80 * (p_partkey % 8) AS top, 10 + p_size + w AS "right", 5 + 80 * (p_partkey % 8) + h AS bottom FROM p WHERE w >= 20 AND w / h BETWEEN 0.6 AND 1.7"""
)
def icon_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a gap of one pixel in each side, narrow ones, tall ones, and specks."""
    p = _parts(spark, sf_dir, "p_size", per=8)
    k, s = F.col("p_partkey"), F.col("p_size")
    boxes = p.select("img", (10 + s).alias("left"), (5 + 80 * (k % 8)).alias("top"), F.when(s % 4 == 0, 19).otherwise(20 + s % 9).alias("w"), F.when(s % 7 == 0, 60).otherwise(22 + s % 5).alias("h"))
    dx, dy = F.col("x") - F.col("left"), F.col("y") - F.col("top")
    edge = ((dx == 0) | (dx == F.col("w")) | (dy == 0) | (dy == F.col("h"))) & (dx != 9) & (dy != 11) & (dx <= F.col("w"))
    speck = (dx == F.col("w") + 6) & (dy % 7 == 0)
    px = _grid(boxes, F.col("left"), F.col("left") + F.col("w") + 6, F.col("top"), F.col("top") + F.col("h")).filter(edge | speck)
    return images.frame_blobs(kept(px.select("img", "x", "y", *[F.lit(v).alias(c) for c, v in zip("rgb", FRAME)])), "img")


@query(
    """WITH b AS (SELECT vec_id, label, list_transform(embedding[1:24], lambda x: x > 0) AS s FROM embeddings),
a AS (SELECT b.vec_id, b.label, t.label AS other, max((64 - 24 + len(list_filter(range(1, 25), lambda i: b.s[i] = t.s[i]))) / 64.0) AS g FROM b JOIN b t ON b.vec_id <> t.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, other) AS rn FROM a),
o AS (SELECT vec_id, label, CASE WHEN max(g) FILTER (rn = 1) >= 0.66 AND max(g) FILTER (rn = 1) - coalesce(max(g) FILTER (rn = 2), 0) >= 0.03 THEN max(other) FILTER (rn = 1) END AS found FROM r GROUP BY ALL)
SELECT label AS class, CASE WHEN found IS NULL THEN 'unknown' WHEN found = label THEN 'agree' ELSE 'differ' END AS outcome, count(*) AS n FROM o GROUP BY ALL"""
)
def template_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.aggregate(F.transform(F.slice("embedding", 1, 24), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    glyphs = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("class"), F.array(word).alias("bits"))
    return portraits.check_templates(glyphs, ["vec_id"], margin=0.03).groupBy("class", "outcome").agg(F.count("*").alias("n"))


@query(
    """WITH u AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT 'facts' AS tab, c_custkey::VARCHAR AS key, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'u' || n END AS value FROM customer LEFT JOIN u ON k = c_custkey
UNION ALL SELECT 'children', o_custkey::VARCHAR, o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT k FROM u)
UNION ALL SELECT 'children', o_custkey::VARCHAR, o_orderkey::VARCHAR FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'O'"""
)
def bucketed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers and their orders are written; then those with an urgent order are, with only their urgent orders that
    are not open; both tables are read as the second manifest has them."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    text = lambda df, **cols: df.select(*[F.col(v).cast("string").alias(k) for k, v in cols.items()])
    tables = Tables(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {"facts": ("key", "value"), "children": ("key", "value")}, "key")
    tables.write_submissions("facts", "children", text(c, key="c_custkey", value="c_mktsegment"), text(o, key="o_custkey", value="o_orderkey"))
    urgent = o.filter("o_orderpriority LIKE '1%'")
    named = urgent.groupBy("o_custkey").agg(F.concat(F.lit("u"), F.count("*")).alias("n"))
    tables.write_submissions("facts", "children", text(named, key="o_custkey", value="n"), text(urgent.filter("o_orderstatus <> 'O'"), key="o_custkey", value="o_orderkey"))
    return tables.read("facts").select(F.lit("facts").alias("tab"), "key", "value").union(tables.read("children").select(F.lit("children"), "key", "value"))


@query(
    """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 ELSE c_custkey END AS id, c_name AS n, c_custkey % 7 AS m, c_custkey % 11 AS s FROM customer)
SELECT id::VARCHAR AS gid, arg_max(n, k) AS name FROM r WHERE m > 0 AND s > 0 GROUP BY id"""
)
def roster_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a title line before its header, ids with commas, repeated ids, ids that are none and short rows."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    gid = F.when(k % 7 == 0, "none").otherwise(F.format_number(F.when(k % 3 == 0, k - 1).otherwise(k), 0))
    cells = F.when(k % 11 == 0, F.array(F.lit("x"), gid)).otherwise(F.array(F.lit("x"), gid, F.col("c_name"), F.lit("more")))
    title = spark.createDataFrame([(0, ["Kingdom 1"]), (1, []), (2, ["Rank", " Governor ID", "governor NAME "])], "pos int, cells array<string>")
    return roster(title.union(c.select((k + 2).cast("int"), cells)))


@query(
    """WITH t AS (SELECT l_orderkey AS img, (['food', 'wood', 'stone', 'gold'])[l_partkey % 4 + 1] AS r, l_suppkey % 3 AS v, l_returnflag = 'R' AS a FROM lineitem),
c AS (SELECT img, r, v, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT img, r, max(n) AS top FROM c GROUP BY ALL),
w AS (SELECT c.img, c.r, CASE WHEN count(*) = 1 AND max(top) >= 2 THEN max(v) END AS v FROM c JOIN m ON c.img = m.img AND c.r = m.r AND n = top GROUP BY ALL),
p AS (SELECT img, max(v) FILTER (r = 'food') AS food, max(v) FILTER (r = 'wood') AS wood, max(v) FILTER (r = 'stone') AS stone, max(v) FILTER (r = 'gold') AS gold,
  array_to_string(list_filter(['food', 'wood', 'stone', 'gold'], lambda x: list_contains(list(r), x)), ',') AS expected, array_to_string(list_filter(['food', 'wood', 'stone', 'gold'], lambda x: list_contains(list(r) FILTER (v IS NULL), x)), ', ') AS lost FROM w GROUP BY img),
a AS (SELECT img, bool_or(a) AS a FROM t GROUP BY 1)
SELECT p.img, food, wood, stone, gold, a AND coalesce(food, wood, stone, gold) IS NOT NULL AS rss_approx, expected, CASE WHEN coalesce(food, wood, stone, gold) IS NOT NULL AND lost <> '' THEN 'Could not read the ' || lost || ' cost.' ELSE '' END AS warning FROM p JOIN a ON p.img = a.img"""
)
def cost_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(r) for r in ("food", "wood", "stone", "gold")])
    read = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img"), F.element_at(kinds, (F.col("l_partkey") % 4 + 1).cast("int")).alias("resource"), (F.col("l_suppkey") % 3).alias("value"), (F.col("l_returnflag") == "R").alias("approx"))
    out = screens.resolve_costs(read, ["img"])
    return out.select("img", "food", "wood", "stone", "gold", "rss_approx", F.array_join("expected_resources", ",").alias("expected"), F.array_join("warnings", " ").alias("warning"))
