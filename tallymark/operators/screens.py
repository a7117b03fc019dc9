"""Whole screens from extracted tables: named and unnamed rows, the grid of siege icons, cost tokens, the portrait column.

Inputs are tables of lines, boxes, numbers and pixels per image; each step is a join or an aggregation by the image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import parse_number
from tallymark.sources.dimensions import RESOURCES, TIERS

from .choose import vote
from .images import resource_of
from .layout import count_word, islands, match_icons, merge_numbers, name_start
from .reconcile import match_names
from .regions import clipped, in_boxes, whole
from .tables import dealt

# How far above the totals the list ends and how near to the counts' column a number must be (in units, and
# at least in pixels), the least frame density of a row without a column, the header's margins, the phrases of an empty
# grid, the windows beside a cost token that hold its icon, in the order they are tried; the widths, the peak's share and the
# gaps of a portrait column; where the cost strip lies from the upper total (in units), how uneven the two totals may be, and
# the least unit and sides of a strip.
LIST_END, COLUMN_REACH, COLUMN_LEAST, DENSITY = 2.2, 1.2, 25.0, 0.08
HEADER_UP, HEADER_DOWN = 20, 10
EMPTY_GRID = ("no units",)
ICON_WINDOWS = ((-0.10, 0.55), (-0.85, -0.08), (-0.45, 0.25))
COLUMN_WIDTH, COLUMN_PEAK, COLUMN_GAP = (0.8, 2.0), 0.45, 3

STRIP, UNEVEN, STRIP_UNIT, STRIP_SIDES = ((5.0, 20.0), (-1.8, -0.2)), 1.35, 6, (20, 6)

# What the readers say.
NO_ICONS = "No troop icons found in the screenshot."
NO_COUNT = "Found a siege icon but could not read its count - send a clearer screenshot if this matters for the check."


def all_readings(*variants: DataFrame) -> DataFrame:
    """The candidates of every variant, one below another."""
    return reduce(DataFrame.unionByName, variants)


def named_rows(lines: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no, raw_name, count and x: lines without a "/" that hold a known name and a count right of it."""
    plain = lines.filter(~F.contains("text", F.lit("/")))
    known = match_names(plain, units, (*key, "line_no"))
    found = plain.join(known, [*key, "line_no"]).withColumn("_w", count_word(F.col("words")))
    rows = found.select(*key, "line_no", F.col("unit").alias("raw_name"), parse_number(F.col("_w.text"))["value"].alias("count"), ((F.col("_w.left") + F.col("_w.right")) / 2).alias("x"))
    return rows.filter("count IS NOT NULL")


def unnamed_rows(lines: DataFrame, units: DataFrame, anchors: DataFrame, key: list[str], density: DataFrame | None = None) -> DataFrame:
    """key, line_no, raw_name (as read) and count of lines that look like rows but hold no known name.

    anchors: key, wounded_top and ram_top, and scale if the image was enlarged for the reader (the reach is in pixels of the
    original, at least COLUMN_LEAST); without both an image has no such rows. The line stands above the list's end;
    its last number has a value and stands in the mean column of the named rows' counts; a word of three letters or more
    stands left of it. An image without named rows has no column: there the frame density left of the name (density: key,
    line_no, density) decides.
    """
    named = named_rows(lines, units, key)
    column = named.groupBy(*key).agg(F.avg("x").alias("_x"))
    unit, scale = F.col("ram_top") - F.col("wounded_top"), F.col("scale") if "scale" in anchors.columns else F.lit(1.0)
    ends = anchors.filter(unit > 0).select(*key, (F.col("wounded_top") - LIST_END * unit).alias("_floor"), F.greatest(COLUMN_REACH * unit / scale, F.lit(COLUMN_LEAST)).alias("_reach"))
    matched = all_readings(match_names(lines, units, (*key, "line_no")).select(*key, "line_no"), named.select(*key, "line_no")).distinct()
    rest = lines.filter(~F.contains("text", F.lit("/"))).join(matched, [*key, "line_no"], "left_anti").join(ends, key).filter(F.col("top") < F.col("_floor"))
    before = F.filter("words", lambda w: (w["left"] < F.col("_n.left")) & (F.length(F.regexp_replace(w["text"], r"[^\p{L}]", "")) >= 3))
    tried = rest.withColumn("_n", F.try_element_at(merge_numbers(F.col("words")), F.lit(-1))).filter("_n IS NOT NULL").withColumn("raw_name", F.array_join(F.transform(before, lambda w: w["text"]), " "))
    tried = tried.withColumn("count", parse_number(F.col("_n.text"))["value"]).filter("count > 0 AND raw_name <> ''").join(column, key, "left")
    near = F.abs((F.col("_n.left") + F.col("_n.right")) / 2 - F.col("_x")) <= F.col("_reach")
    if density is None:
        return tried.filter(near).select(*key, "line_no", "raw_name", "count")
    seen = tried.join(density.select(*key, "line_no", "density"), [*key, "line_no"], "left")
    framed = F.col("_x").isNull() & name_start(F.col("words")).isNotNull() & (F.coalesce("density", F.lit(0.0)) >= DENSITY)
    return seen.filter(F.coalesce(near, F.lit(False)) | framed).select(*key, "line_no", "raw_name", "count")


def read_rows(lines: DataFrame, units: DataFrame, anchors: DataFrame, key: list[str], density: DataFrame | None = None) -> DataFrame:
    """The named rows and the unnamed ones: key, line_no, raw_name, count, known_name."""
    named = named_rows(lines, units, key).drop("x").withColumn("known_name", F.lit(True))
    return named.unionByName(unnamed_rows(lines, units, anchors, key, density).withColumn("known_name", F.lit(False)))


def read_grid(images: DataFrame, blobs: DataFrame, numbers: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """One row per image: key, n_t1 .. n_t5, total, warnings, readable.

    blobs: key, pos, box, class and tier of every icon; numbers: key, pos, box and text; lines: key and flat text. Numbers
    of the header, above the topmost icon, are left out; only siege icons count, each with the number to its right; an icon
    whose count or tier is unread is warned of and not counted. No icons: empty if the screen says so, unreadable if not.
    """
    header = blobs.groupBy(*key).agg((F.min("top") - HEADER_UP + HEADER_DOWN).alias("_cut"))
    below = numbers.join(header, key).filter(F.col("top") >= F.col("_cut")).drop("_cut")
    siege = match_icons(blobs.filter(F.col("class") == "Siege"), below, key).withColumn("_v", parse_number(F.col("number"))["value"])
    unread = F.concat(F.lit("Found a siege icon ("), F.format_number("_v", 0), F.lit(" troops) but could not read its tier - send a clearer screenshot if this matters for the check."))
    warning = F.when(F.col("number").isNull(), NO_COUNT).when(F.col("_v").isNotNull() & F.col("tier").isNull(), unread)
    sums = siege.groupBy(*key).agg(
        *[F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("_v"))), F.lit(0)).cast("long").alias(f"n_{t.lower()}") for t in TIERS],
        F.transform(F.sort_array(F.collect_list(F.when(warning.isNotNull(), F.struct("pos", warning.alias("w"))))), lambda s: s["w"]).alias("warnings"),
    )
    says = reduce(Column.__or__, [F.contains("text", F.lit(p)) for p in EMPTY_GRID])
    empty = lines.groupBy(*key).agg(F.coalesce(F.bool_or(says), F.lit(False)).alias("_empty"))
    icons = blobs.groupBy(*key).agg(F.count("*").alias("_icons"))
    out = images.select(*key).join(icons, key, "left").join(empty, key, "left").join(sums, key, "left").fillna(0, [f"n_{t.lower()}" for t in TIERS])
    lost = F.col("_icons").isNull() & ~F.coalesce("_empty", F.lit(False))
    counts = [F.col(f"n_{t.lower()}") for t in TIERS]
    none = F.array().cast("array<string>")
    return out.select(*key, *counts, sum(counts[1:], counts[0]).alias("total"), F.when(lost, F.array(F.lit(NO_ICONS))).otherwise(F.coalesce("warnings", none)).alias("warnings"), (~lost).alias("readable"))


def cost_values(tokens: DataFrame, pixels: DataFrame, key: list[str]) -> DataFrame:
    """key, pos, resource, value and approx of cost tokens (key, pos, text, left, top, height, unit).

    A token's resource is that of the first window beside it whose pixels (key, x, y, r, g, b) make an icon; tokens without
    a number or an icon drop. A bare decimal takes the commonest suffix of its image's tokens (the first of equals).
    """
    read = tokens.filter(parse_number(F.col("text"))["value"].isNotNull())
    suffix = F.substring("text", -1, 1)
    common = read.filter(suffix.rlike("[KkMmBb]")).groupBy(*key, suffix.alias("_s")).agg(F.count("*").alias("_n"), F.min("pos").alias("_p"))
    common = common.groupBy(*key).agg(F.max_by("_s", F.struct("_n", -F.col("_p"))).alias("_s"))
    at = lambda share: whole(F.col("left") + F.col("unit") * share).alias
    windows = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), at(a)("x0"), at(b)("x1")) for i, (a, b) in enumerate(ICON_WINDOWS)]))
    boxes = read.select(*key, "pos", windows.alias("v"), whole(F.col("top") - F.col("height") * 0.35).alias("y0"), whole(F.col("top") + F.col("height") * 1.35).alias("y1")).select(*key, "pos", "v.*", "y0", "y1")
    inside = in_boxes(pixels, boxes, key)
    icons = resource_of(inside, [*key, "pos", "w"]).filter("resource IS NOT NULL").groupBy(*key, "pos").agg(F.min_by("resource", "w").alias("resource"))
    bare = F.contains("text", F.lit(".")) & ~suffix.rlike("[KkMmBb]") & F.col("_s").isNotNull()
    both = read.join(dealt(icons), [*key, "pos"]).join(dealt(common), key, "left").withColumn("_v", parse_number(F.when(bare, F.concat("text", "_s")).otherwise(F.col("text"))))
    return both.select(*key, "pos", "resource", F.col("_v.value").alias("value"), F.col("_v.approx").alias("approx")).filter("value IS NOT NULL")


def cost_votes(values: DataFrame, key: list[str]) -> DataFrame:
    """key, resource, value and votes of the values that several passes read."""
    return values.filter(F.col("resource").isin(*RESOURCES)).groupBy(*key, "resource", "value").agg(F.count("*").alias("votes"))


def cost_strips(totals: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """key, x0, x1, y0, y1 (in pixels of the original) and unit of the band that holds the costs.

    totals: key, wounded_left, wounded_top, wounded_bottom, ram_top, ram_bottom (as read) and scale. Both totals are of one
    size, so boxes of unequal height cannot be measured from: such an image, or one whose unit or band is too small, has no
    strip and leaves its costs to a better reading.
    """
    high, low = F.col("wounded_bottom") - F.col("wounded_top"), F.col("ram_bottom") - F.col("ram_top")
    unit = (F.col("ram_top") - F.col("wounded_top")) / F.col("scale")
    even = (F.least(high, low) > 0) & (F.greatest(high, low) <= UNEVEN * F.least(high, low))
    sized = totals.filter(even).withColumn("unit", unit).filter(F.col("unit") >= STRIP_UNIT)
    x, y = F.col("wounded_left") / F.col("scale"), F.col("wounded_top") / F.col("scale")
    side = lambda at, shares: [whole(at + F.col("unit") * v).cast("long") for v in shares]
    boxes = sized.select(*key, "unit", *[c.alias(n) for c, n in zip([*side(x, STRIP[0]), *side(y, STRIP[1])], ("x0", "x1", "y0", "y1"))])
    cut = clipped(boxes, images.withColumn("height", F.lit(2**31)), key).withColumn("y1", F.greatest("y1", F.lit(0)))
    return cut.filter((F.col("x1") - F.col("x0") >= STRIP_SIDES[0]) & (F.col("y1") - F.col("y0") >= STRIP_SIDES[1])).select(*key, "x0", "x1", "y0", "y1", "unit")


def resolve_costs(values: DataFrame, key: list[str]) -> DataFrame:
    """key, the four resources, rss_approx, expected_resources and warnings from the values that all passes read.

    A resource has the value that alone has the most votes and two of them at least. One rounded value marks them all as
    rounded. What got any vote is expected; what is expected and has no value is warned of. Without any value nothing is
    marked and nothing warned of.
    """
    seen = values.filter(F.col("resource").isin(*RESOURCES) & F.col("value").isNotNull())
    won = vote(seen, [*key, "resource"])
    cost = lambda r: F.max(F.when(F.col("resource") == r, F.col("winner")))
    sums = won.groupBy(*key).agg(*[cost(r).alias(r) for r in RESOURCES], F.collect_set("resource").alias("_seen"))
    marked = seen.groupBy(*key).agg(F.bool_or("approx").alias("_approx"))
    got = F.coalesce(*[F.col(r) for r in RESOURCES]).isNotNull()
    expected = F.filter(F.array(*map(F.lit, RESOURCES)), lambda r: F.array_contains("_seen", r))
    lost = F.array_compact(F.array(*[F.when(F.col(r).isNull() & F.array_contains("_seen", r), F.lit(r)) for r in RESOURCES]))
    told = F.when(got & (F.size(lost) > 0), F.array(F.concat(F.lit("Could not read the "), F.array_join(lost, ", "), F.lit(" cost.")))).otherwise(F.array().cast("array<string>"))
    return sums.join(marked, key).select(*key, *RESOURCES, (got & F.col("_approx")).alias("rss_approx"), expected.alias("expected_resources"), told.alias("warnings"))


def name_anchor(rows: DataFrame, key: list[str], x: str = "name_left") -> DataFrame:
    """key and anchor, the median of where the names start, which a few misread rows do not move."""
    return rows.groupBy(*key).agg(F.median(x).alias("anchor"))


def column_pair(profile: DataFrame, key: list[str]) -> DataFrame:
    """key, left and right of the portrait column from a profile (key, x, n, unit) of frame pixels by x.

    Strong columns, at COLUMN_PEAK of the peak or more, are clustered by gaps; of the pairs of clusters of a fitting width the
    heaviest is the frame's two sides (the first of equals); without one the widest cluster is, if it fits by itself.
    """
    peak = F.max("n").over(Window.partitionBy(*key))
    strong = profile.withColumn("_peak", peak).filter((F.col("_peak") >= F.greatest(F.lit(4.0), 0.4 * F.col("unit"))) & (F.col("n") >= COLUMN_PEAK * F.col("_peak")))
    clusters = islands(strong, key, "x", COLUMN_GAP).groupBy(*key, "island").agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.sum("n").alias("_w"), F.count("*").alias("_n"), F.max("unit").alias("_unit"))
    fits = lambda width: width.between(COLUMN_WIDTH[0] * F.col("_unit"), COLUMN_WIDTH[1] * F.col("_unit"))
    # a screen has a handful of clusters, so its pairs are few
    right = clusters.select(*key, F.col("island").alias("_i2"), F.col("_b").alias("_b2"), F.col("_w").alias("_w2"))
    pairs = clusters.join(dealt(right), key).filter((F.col("_i2") > F.col("island")) & fits(F.col("_b2") - F.col("_a")))
    best = pairs.groupBy(*key).agg(F.max_by(F.struct(F.col("_a").alias("left"), F.col("_b2").alias("right")), F.struct(F.col("_w") + F.col("_w2"), -F.col("island"), -F.col("_i2"))).alias("_p"))
    wide = clusters.groupBy(*key).agg(F.max_by(F.struct("_a", "_b", "_unit"), F.struct("_n", -F.col("island"))).alias("_c")).select(*key, "_c.*").filter(fits(F.col("_b") - F.col("_a")))
    return best.join(dealt(wide), key, "full").select(*key, F.coalesce("_p.left", "_a").alias("left"), F.coalesce("_p.right", "_b").alias("right"))


def frame_runs(profile: DataFrame, key: list[str], gap: Column | float) -> DataFrame:
    """key, top and bottom of the runs of rows (key, y, hits) that at least two frame pixels cross."""
    return islands(profile.filter("hits >= 2"), key, "y", gap).groupBy(*key, "island").agg(F.min("y").alias("top"), F.max("y").alias("bottom")).drop("island")


def nearest_run(runs: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """key, top and bottom of the run whose centre is closest to the target of its key; the upper one of equals."""
    far = F.abs((F.col("top") + F.col("bottom")) / 2 - F.col("target"))
    return runs.join(targets.select(*key, "target"), key).groupBy(*key).agg(F.min_by(F.struct("top", "bottom"), F.struct(far, "top")).alias("_r")).select(*key, "_r.*")
