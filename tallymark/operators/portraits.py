"""The portraits of a screen's rows: each row's own frame, a column fitted to all rows of the screen, tiers and types.

A row's own box comes first. Rows whose frame is too faint for that take the box that the others of their screen agree on,
if there is a frame at that place. Everything is a join on tiles or an aggregation by the row or the screen: rows are
(key, line_no, centre, name_left, unit), pixels (key, x, y, r, g, b) and images (key, width, height).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.sources.dimensions import GLYPH_MARGIN as CLEAR
from tallymark.sources.dimensions import GLYPH_SCORE

from .choose import classify_glyphs
from .images import glyph_bits, hsv, is_frame, tier_of
from .layout import islands
from .regions import SIDES, clipped, in_boxes, ring_share, whole
from .screens import column_pair, name_anchor
from .tables import dealt, kept

# How far the search goes left of a name, how far above and below a row (in units); the widths of an own
# frame (in units) and its heights (in widths); the same of a fitted one; where portraits hang and how high they are when
# no row says; the share of frame that a fitted box needs; the part of a portrait, and of what lies beside it, that shows its colour.
SEARCH_LEFT, SEARCH_RIGHT, OWN_BAND, FIT_BAND, SCAN = 3.2, 0.05, (0.05, 0.75), 0.9, 1.3
OWN_WIDTH, OWN_HEIGHT, FIT_HEIGHT = (0.7, 2.2), (0.85, 1.7), (0.8, 1.8)
HANGS, TALL, RING = 0.45, 1.2, 0.4
INSET, BAND, BESIDE = 0.20, (0.14, 0.34), (0.55, 0.12)
GLYPH_HALF, GLYPH_MARGIN = 0.42, 2
LINE = "line_no"
#: Blocks of distinct glyphs that are compared in pairs: at most so many, unless they grow beyond the most rows; the least rows of one.
BLOCKS, BLOCK_MOST, BLOCK_LEAST = 32, 65_536, 4096


def frame_pixels(pixels: DataFrame, key: list[str]) -> DataFrame:
    """key, x and y of the pixels in a frame's colour."""
    return hsv(pixels).filter(is_frame()).select(*key, "x", "y")


def _boxes(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    return df.withColumns({n: whole(c).cast("long") for n, c in zip(SIDES, (x0, x1, y0, y1))})


def _gap() -> Column:
    """Rows of frame pixels so far apart are of one run."""
    return F.greatest(F.lit(2), whole(F.col("unit") * 0.15))


def _vertical_runs(bands: DataFrame, frame: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no, top, bottom and n (how many lines) of the runs of lines that two frame pixels cross, within each row's band."""
    lines = in_boxes(frame, bands.select(*key, LINE, "unit", *SIDES), key).groupBy(*key, LINE, "y").agg(F.count("*").alias("hits"), F.max("unit").alias("unit"))
    return islands(lines.filter("hits >= 2"), [*key, LINE], "y", _gap()).groupBy(*key, LINE, "island").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("n"))


def own_boxes(rows: DataFrame, frame: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no, left, top, right and bottom of the rows whose own frame is found left of their name.

    Columns that the frame crosses are joined to runs over gaps of half a unit; of the runs as wide as a portrait the one
    nearest to the name counts. Its lines are joined to runs alike, and the one nearest to where portraits hang must be as
    high as a portrait, or the row has no box.
    """
    by, u, c = [*key, LINE], F.col("unit"), F.col("centre")
    right = whole(F.col("name_left"))
    bands = clipped(_boxes(rows.filter("unit > 0 AND name_left IS NOT NULL"), right - u * SEARCH_LEFT, right, c - u * OWN_BAND[0], c + u * OWN_BAND[1]), images, key)
    bands = bands.filter("x1 - x0 >= 8 AND y1 - y0 >= 2").withColumn("_least", F.greatest(F.lit(1), F.floor((F.col("y1") - F.col("y0")) / 10)))
    hits = in_boxes(frame, bands, key).groupBy(*by, "x").agg(F.count("*").alias("hits"), *[F.max(n).alias(n) for n in ("_least", "unit", "centre")]).filter("hits >= _least")
    runs = islands(hits, by, "x", F.greatest(F.lit(3.0), u * 0.5)).groupBy(*by, "island").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.max("unit").alias("unit"), F.max("centre").alias("centre"))
    width = F.col("right") - F.col("left")
    wide = kept(runs.filter(width.between(OWN_WIDTH[0] * u, OWN_WIDTH[1] * u)).groupBy(*by).agg(F.max_by(F.struct("left", "right", "unit", "centre"), "right").alias("r")).select(*by, "r.*"))
    scans = clipped(_boxes(wide, F.col("left"), F.col("right"), c - u * SCAN, c + u * SCAN), images, key)
    high = _vertical_runs(scans, frame, key).filter("n >= 2").join(dealt(wide), by)
    far = F.abs((F.col("top") + F.col("bottom")) / 2 - (c + u * HANGS))
    best = high.groupBy(*by).agg(F.min_by(F.struct("left", "top", "right", "bottom"), F.struct(far, "top")).alias("b")).select(*by, "b.*")
    return best.filter((F.col("bottom") - F.col("top")).between(width * OWN_HEIGHT[0], width * OWN_HEIGHT[1]))


def column_fit(rows: DataFrame, frame: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """key, left, right, offset and height: the column that all rows of a screen share.

    Frame pixels are counted by x over the rows' bands, left of the median start of the names; the heaviest pair of columns
    is the frame's two sides. Offset (of a portrait's centre from its row's) and height are the medians of the rows whose
    frame reads cleanly between those sides, or the usual ones if none does.
    """
    u, c = F.col("unit"), F.col("centre")
    anchors = name_anchor(rows.filter("unit > 0"), key)
    both = rows.filter("unit > 0").join(dealt(anchors), key)
    bands = clipped(_boxes(both, F.col("anchor") - u * SEARCH_LEFT, F.col("anchor") - u * SEARCH_RIGHT, c - u * FIT_BAND, c + u * FIT_BAND), images, key).filter("x1 - x0 >= 8")
    profile = in_boxes(frame, bands, key).groupBy(*key, "x").agg(F.count("*").alias("n"), F.max("unit").alias("unit"))
    pair = kept(column_pair(profile, key))
    width = F.col("right") - F.col("left")
    sides = rows.filter("unit > 0").join(dealt(pair), key)
    runs = _vertical_runs(clipped(_boxes(sides, F.col("left"), F.col("right"), c - u * SCAN, c + u * SCAN), images, key), frame, key).join(dealt(sides), [*key, LINE])
    usable = runs.filter((F.col("bottom") - F.col("top")).between(width * FIT_HEIGHT[0], width * FIT_HEIGHT[1]))
    middle = (F.col("top") + F.col("bottom")) / 2
    clean = usable.groupBy(*key, LINE).agg(F.min_by(F.struct((middle - c).alias("o"), (F.col("bottom") - F.col("top")).alias("h")), F.struct(F.abs(middle - (c + u * HANGS)), "top")).alias("r"))
    medians = clean.groupBy(*key).agg(F.median("r.o").alias("_o"), F.median("r.h").alias("_h"))
    units = rows.filter("unit > 0").groupBy(*key).agg(F.max("unit").alias("unit"))
    return pair.join(dealt(units), key).join(dealt(medians), key, "left").select(*key, "left", "right", F.coalesce("_o", u * HANGS).alias("offset"), F.coalesce("_h", width * TALL).alias("height"))


def tiers_in(boxes: DataFrame, pixels: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no and tier by the colour in the upper part of each box; NULL if it is unclear or that of the panel beside it."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    fit = boxes.filter((w >= 10) & (h >= 10))
    y0, y1 = F.col("top") + h * BAND[0], F.col("top") + h * BAND[1]
    inner = clipped(_boxes(fit, F.col("left") + w * INSET, F.col("right") - w * INSET, y0, y1), images, key).filter("x1 - x0 >= 3 AND y1 - y0 >= 2")
    outer = clipped(_boxes(fit, F.col("left") - whole(w * BESIDE[0]), F.col("left") - whole(w * BESIDE[1]), y0, y1), images, key).filter("x1 - x0 >= 2 AND y1 - y0 >= 2")
    seen = lambda part: in_boxes(pixels, part.select(*key, LINE, *SIDES), key)
    return tier_of(seen(inner), seen(outer), [*key, LINE])


def read_portraits(rows: DataFrame, pixels: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """The rows with left, top, right, bottom, tier and fitted (whether the tier is by the fitted box).

    The fitted box serves rows whose own box gives no tier, and only where its ring is frame; a tier that the own box gives
    is never overruled. Rows without a box of their own have the fitted one.
    """
    by = [*key, LINE]
    frame = kept(frame_pixels(pixels, key))
    own = kept(own_boxes(rows, frame, images, key))
    first = kept(tiers_in(own, pixels, images, key).filter("tier IS NOT NULL"))
    top = F.col("centre") + F.col("offset") - F.col("height") / 2
    fitted = rows.join(dealt(column_fit(rows, frame, images, key)), key).join(dealt(first), by, "left_anti")
    fitted = kept(fitted.select(*by, whole(F.col("left")).alias("left"), whole(top).alias("top"), whole(F.col("right")).alias("right"), whole(top + F.col("height")).alias("bottom")))
    rings = ring_share(fitted.select(*by, F.col("left").alias("x0"), F.col("right").alias("x1"), F.col("top").alias("y0"), F.col("bottom").alias("y1")), frame, images, key, LINE)
    framed = fitted.join(dealt(rings.filter(F.col("share") >= RING)), by, "left_semi")
    second = tiers_in(framed, pixels, images, key).filter("tier IS NOT NULL")
    box = lambda df, name: dealt(df.select(*by, F.struct("left", "top", "right", "bottom").alias(name)))
    full = rows.join(box(own, "_own"), by, "left").join(box(fitted, "_fit"), by, "left")
    full = full.join(dealt(first.select(*by, F.col("tier").alias("_t1"))), by, "left").join(dealt(second.select(*by, F.col("tier").alias("_t2"))), by, "left")
    side = lambda c: F.coalesce(F.col(f"_own.{c}"), F.col(f"_fit.{c}")).cast("long").alias(c)
    return full.select(*rows.columns, *map(side, ("left", "top", "right", "bottom")), F.coalesce("_t1", "_t2").alias("tier"), (F.col("_t1").isNull() & F.col("_t2").isNotNull()).alias("fitted"))


def row_types(rows: DataFrame, pixels: DataFrame, images: DataFrame, templates: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no and class of the glyph between each row's portrait (see `read_portraits`) and its name; NULL if unclear."""
    by, u, c = [*key, LINE], F.col("unit"), F.col("centre")
    boxes = _boxes(rows.filter("unit > 0 AND right IS NOT NULL AND name_left IS NOT NULL"), F.col("right") + GLYPH_MARGIN, whole(F.col("name_left")) - GLYPH_MARGIN, c - u * GLYPH_HALF, c + u * GLYPH_HALF)
    seen = in_boxes(pixels, clipped(boxes, images, key).filter("x1 - x0 >= 6 AND y1 - y0 >= 6").select(*by, *SIDES), key)
    found = classify_glyphs(glyph_bits(seen, by), templates, by)
    return rows.select(*by).join(dealt(found.select(*by, "class")), by, "left")


def learn_templates(glyphs: DataFrame) -> DataFrame:
    """class and bits of labelled glyphs (key columns, class, bits): what the classifier is to compare with, each once."""
    return glyphs.filter("class IS NOT NULL AND bits IS NOT NULL").select("class", "bits").distinct()


def _nearest_classes(group: pa.Table) -> pa.Table:
    """Over glyphs and templates (shown: whether it is a glyph) of one length: each glyph's two nearest classes and by how many bits they differ."""
    group = group.combine_chunks()
    glyphs, others = group.filter(group["shown"]), group.filter(pc.invert(group["shown"]))
    w = group["w"][0].as_py()
    words = lambda t: t["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, w)
    found = others["class"].combine_chunks().dictionary_encode() if len(others) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), group["class"].combine_chunks().slice(0, 0))
    by_name = pc.sort_indices(found.dictionary).to_numpy()
    code = np.argsort(by_name)[found.indices.to_numpy()]
    order = np.argsort(code, kind="stable")
    starts, ids = np.searchsorted(code[order], np.arange(len(by_name))), others["id"].to_numpy()[order]
    a, b, own, n = words(glyphs), words(others)[order], glyphs["id"].to_numpy(), glyphs["n"].to_numpy()
    whose = np.argsort(ids)
    least, out, step = 64 * w + 1, [], max(1, (1 << 20) // max(1, len(b)))
    for k in range(0, len(a) if len(b) else 0, step):
        differ = np.zeros((len(a[k : k + step]), len(b)), dtype=np.uint16 if w < 1000 else np.int32)
        for c in range(w):
            differ += np.bitwise_count(a[k : k + step, c, None] ^ b[:, c])
        at = np.minimum(np.searchsorted(ids, own[k : k + step], sorter=whose), len(ids) - 1)
        alone = np.flatnonzero((ids[whose[at]] == own[k : k + step]) & (n[k : k + step] == 1))
        differ[alone, whose[at[alone]]] = least
        per, rows = np.minimum.reduceat(differ, starts, axis=1), np.arange(len(differ))
        for _ in range(2):
            first = per.argmin(axis=1)  # of equals the first by name
            good = per[rows, first] < least
            out.append((own[k : k + step][good], first[good], per[rows, first][good]))
            per[rows, first] = least
    whole = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, dtype=np.int64) for c in range(3)]
    return pa.table({"id": pa.array(whole[0], pa.int64()), "_class": found.dictionary.take(pa.array(by_name)).take(pa.array(whole[1], pa.int64())), "_d": pa.array(whole[2].astype(np.int64))})


def check_templates(glyphs: DataFrame, key: list[str], score: float = GLYPH_SCORE, margin: float = CLEAR) -> DataFrame:
    """key, class, found and outcome (agree, differ or unknown): each labelled glyph classified by all the others.

    A glyph's own template does not vouch for it unless another glyph of its class has the same. Equal glyphs are judged
    once. Every glyph meets every template of its length: both are dealt to blocks, and a task compares a pair of blocks and
    puts out the two nearest classes of each glyph, of which those of all blocks are among the two nearest.
    """
    shown = glyphs.filter("class IS NOT NULL AND bits IS NOT NULL")
    counted = kept(shown.groupBy("class", "bits").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    rows = counted.count()
    blocks = max(1, -(-rows // BLOCK_MOST), min(BLOCKS, -(-rows // BLOCK_LEAST)))
    whole = counted.filter(~F.exists("bits", lambda x: x.isNull()) & (F.size("bits") > 0)).select("id", "class", F.col("bits").cast("array<long>").alias("bits"), "n", F.size("bits").alias("w"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    side = lambda i, j, is_glyph: whole.select("id", "class", "bits", "n", "w", i.alias("i"), j.alias("j"), F.lit(is_glyph).alias("shown"))
    pairs = side(F.col("own"), every, True).union(side(every, F.col("own"), False)).repartition(blocks * blocks, "w", "i", "j").groupBy("w", "i", "j")
    near = pairs.applyInArrow(_nearest_classes, T.StructType([T.StructField("id", T.LongType()), T.StructField("_class", counted.schema["class"].dataType), T.StructField("_d", T.LongType())]))
    scored = near.groupBy("id", "_class").agg(F.min("_d").alias("_d")).join(dealt(counted), "id").select("class", "bits", "_class", (1 - F.col("_d") / (64 * F.size("bits"))).alias("_s"))
    ranked = scored.withColumn("_rn", F.row_number().over(Window.partitionBy("class", "bits").orderBy(F.desc("_s"), "_class")))
    best = ranked.groupBy("class", "bits").agg(F.max(F.when(F.col("_rn") == 1, F.col("_s"))).alias("_1"), F.coalesce(F.max(F.when(F.col("_rn") == 2, F.col("_s"))), F.lit(0.0)).alias("_2"), F.max(F.when(F.col("_rn") == 1, F.col("_class"))).alias("_found"))
    sure = (F.col("_1") >= score) & (F.col("_1") - F.col("_2") >= margin)
    out = shown.select(*key, "class", "bits").join(dealt(best), ["class", "bits"], "left").withColumn("found", F.when(sure, F.col("_found")))
    outcome = F.when(F.col("found").isNull(), "unknown").when(F.col("found") == F.col("class"), "agree").otherwise("differ")
    return out.select(*key, "class", "found", outcome.alias("outcome"))
