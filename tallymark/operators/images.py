"""Colours, icons and glyphs from tables of pixels (image_id, box_id, x, y, r, g, b).

Hue, saturation and value are column arithmetic and every decision is a histogram per box or a join, so the pixels stay in
the JVM, but for the frame pixels of `frame_blobs`, which meet by tile in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.sources.dimensions import RESOURCES

from .tables import dealt, kept

# The tier of a colour, and the least share of it.
TIER_OF_COLOUR = {"GREY": "T1", "GREEN": "T2", "BLUE": "T3", "PURPLE": "T4", "GOLD": "T5"}
TIER_SHARE = 0.55
GLYPH_SIZE = 32
# Fixed values, of hue in degrees and of saturation, value and shares from 0 to 1.
# A named colour: below which value there is none, the gilding (least value and saturation, hues), below which saturation a
# pixel is grey, and the hues where gold ends and starts again, and where green and blue end.
DARK, GILDING, GREY_BELOW = 0.18, (0.72, 0.55, (38, 62)), 0.25
GOLD_BELOW, GOLD_FROM, GREEN_BELOW, BLUE_BELOW = 70, 330, 170, 258
# A frame: least value and saturation, hues.
FRAME = (0.28, 0.45, (25, 68))
# A resource icon: below which value a pixel is left out, a white one (below this saturation, above this value), below which
# saturation it is grey, where orange, yellow and green end; the least pixels and share of the box; the shares to exceed.
ICON_DARK, ICON_WHITE, ICON_GREY = 0.30, (0.10, 0.88), 0.22
ORANGE_BELOW, YELLOW_BELOW, ICON_GREEN_BELOW = 40, 70, 170
ICON_LEAST, STONE_SHARE, FOOD_SHARE, WOOD_SHARE = (60, 0.18), 0.5, 0.12, 0.45
# A glyph: above which value and below which saturation a pixel is of its shape; the least pixels and extent of a shape.
GLYPH_WHITE, GLYPH_LEAST = (0.62, 0.35), (20, 3)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: what a generator puts out is not inlined where it is used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def hsv(df: DataFrame) -> DataFrame:
    """Adds hue (degrees), sat and val."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    parts = _once(df, _r=r, _g=g, _b=b, _high=F.greatest(r, g, b), _low=F.least(r, g, b))
    r, g, b, high = (F.col(c) for c in ("_r", "_g", "_b", "_high"))
    span = high - F.col("_low")
    sector = F.when(r == high, ((high - b) - (high - g)) / span).when(g == high, 2.0 + ((high - r) - (high - b)) / span).otherwise(4.0 + ((high - g) - (high - r)) / span)
    hue = F.when(span == 0, 0.0).otherwise(F.pmod(sector / 6.0, F.lit(1.0)) * 360)
    sat = F.when(high == 0, 0.0).otherwise(span / F.when(high == 0, 1.0).otherwise(high))
    return _once(parts, hue=hue, sat=sat, val=high).drop("_r", "_g", "_b", "_high", "_low")


def colour_bucket() -> Column:
    """The named colour of a pixel with hsv columns; NULL for dark pixels and bright gilding."""
    value, saturation, hues = GILDING
    return (
        F.when(F.col("val") < DARK, None)
        .when((F.col("val") > value) & (F.col("sat") > saturation) & F.col("hue").between(*hues), None)
        .when(F.col("sat") < GREY_BELOW, "GREY")
        .when((F.col("hue") < GOLD_BELOW) | (F.col("hue") >= GOLD_FROM), "GOLD")
        .when(F.col("hue") < GREEN_BELOW, "GREEN")
        .when(F.col("hue") < BLUE_BELOW, "BLUE")
        .otherwise("PURPLE")
    )


def is_frame() -> Column:
    value, saturation, hues = FRAME
    return (F.col("val") > value) & (F.col("sat") > saturation) & F.col("hue").between(*hues)


def dominant_colour(pixels: DataFrame, key: list[str]) -> DataFrame:
    """key, colour and share of its commonest bucket; ties go to the first name."""
    counted = hsv(pixels).withColumn("colour", colour_bucket()).filter("colour IS NOT NULL").groupBy(*key, "colour").agg(F.count("*").alias("_n"))
    return counted.groupBy(*key).agg(F.min_by("colour", F.struct(-F.col("_n"), F.col("colour"))).alias("colour"), (F.max("_n") / F.sum("_n")).alias("share"))


def tier_of(inside: DataFrame, outside: DataFrame, key: list[str]) -> DataFrame:
    """key and tier: by the colour inside, if it has its share and is not the colour around the box."""
    around = dominant_colour(outside, key).select(*key, F.col("colour").alias("_o"))
    tier = F.coalesce(*[F.when(F.col("colour") == c, F.lit(t)) for c, t in TIER_OF_COLOUR.items()])
    sure = (F.col("share") >= TIER_SHARE) & ~F.coalesce(F.col("colour") == F.col("_o"), F.lit(False))
    return dominant_colour(inside, key).join(dealt(around), key, "left").select(*key, F.when(sure, tier).alias("tier"))


def resource_of(pixels: DataFrame, key: list[str]) -> DataFrame:
    """key and resource of an icon by the shares of its colours; NULL if it is none of the four."""
    drop = (F.col("val") < ICON_DARK) | ((F.col("sat") < ICON_WHITE[0]) & (F.col("val") > ICON_WHITE[1]))
    kind = F.when(F.col("sat") < ICON_GREY, "grey").when(F.col("hue") < ORANGE_BELOW, "orange").when(F.col("hue") < YELLOW_BELOW, "yellow").when(F.col("hue") < ICON_GREEN_BELOW, "green")
    marked = hsv(pixels).withColumn("_k", F.when(~drop, kind))
    sums = marked.groupBy(*key).agg(F.count("*").alias("area"), F.count("_k").alias("total"), *[F.count_if(F.col("_k") == c).alias(c) for c in ("grey", "orange", "yellow", "green")])
    share = lambda c: F.col(c) / F.col("total")
    food, wood, stone, gold = RESOURCES
    few = (F.col("total") < ICON_LEAST[0]) | (F.col("total") < ICON_LEAST[1] * F.col("area"))
    found = F.when(few, None).when(share("grey") > STONE_SHARE, stone).when(share("green") > FOOD_SHARE, food).when(F.col("yellow") > F.col("orange"), gold).when(share("orange") > WOOD_SHARE, wood)
    return sums.select(*key, found.alias("resource"))


def frame_density(pixels: DataFrame, key: list[str]) -> DataFrame:
    return hsv(pixels).groupBy(*key).agg(F.avg(is_frame().cast("int")).alias("density"))


def glyph_bits(pixels: DataFrame, key: list[str]) -> DataFrame:
    """key and bits, 16 longs: the near-white shape of a box, cropped and scaled to 32 x 32; no row for a small shape."""
    on = hsv(pixels).filter((F.col("val") > GLYPH_WHITE[0]) & (F.col("sat") < GLYPH_WHITE[1]))
    box = on.groupBy(*key).agg(F.min("x").alias("_l"), F.max("x").alias("_r"), F.min("y").alias("_t"), F.max("y").alias("_b"), F.count("*").alias("_n"), F.collect_set(F.struct("x", "y")).alias("_on"))
    least, extent = GLYPH_LEAST
    good = box.filter((F.col("_n") >= least) & (F.col("_r") - F.col("_l") >= extent) & (F.col("_b") - F.col("_t") >= extent))

    def word(k: Column) -> Column:
        def bit(acc: Column, j: Column) -> Column:
            i = k * 64 + j
            gx, gy = i % GLYPH_SIZE, F.floor(i / GLYPH_SIZE)
            sx = F.col("_l") + F.floor(gx * (F.col("_r") - F.col("_l") + 1) / GLYPH_SIZE)
            sy = F.col("_t") + F.floor(gy * (F.col("_b") - F.col("_t") + 1) / GLYPH_SIZE)
            there = F.array_contains("_on", F.struct(sx.cast("int").alias("x"), sy.cast("int").alias("y")))
            return acc.bitwiseOR(F.when(there, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    return good.select(*key, F.transform(F.sequence(F.lit(0), F.lit(15)), word).alias("bits"))


def _tile_blobs(reach: int, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over pixels (key, tx, ty, x, y) sorted by key and tile: the connected pixels of each tile, and which it shares."""
    wide, high = tile + 3 * reach, tile + 2 * reach

    def blobs(b: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        tx, ty, x, y = (b.column(c).to_numpy() for c in ("tx", "ty", "x", "y"))
        at, row = np.unique((group * high + y - ty * tile) * wide + x - tx * tile, return_index=True)
        line, lx = np.divmod(at, wide)
        first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (lx[1:] - lx[:-1] > reach)])
        last = np.r_[first[1:], len(at)] - 1
        u, v = [], []
        for d in range(1, reach + 1):  # runs of a line so far below that come as near
            low = np.searchsorted(at[last], (line[first] + d) * wide + np.maximum(lx[first] - reach, 0))
            n = np.searchsorted(at[first], (line[first] + d) * wide + np.minimum(lx[last] + reach, wide - 1), "right") - low
            u.append(np.repeat(np.arange(len(n)), n))
            v.append(np.arange(len(u[-1])) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))
        u, v, label = np.concatenate(u), np.concatenate(v), np.arange(len(first))
        while len(u):
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            while (label[label] != label).any():
                label = label[label]
            apart = label[u] != label[v]
            u, v = u[apart], v[apart]
        x, y, key = x[row], y[row], b.column(0).take(pa.array(row[first]))
        shared = (lx < reach) | (lx >= tile) | (line % high < reach) | (line % high >= tile)
        of = np.repeat(label, last - first + 1)
        root = np.unique(label)
        box = [np.full(len(first), s * 2**62) for s in (1, 1, -1, -1)]
        for out, value, fn in zip(box, (x[first], y[first], x[last], y[first]), (np.minimum, np.minimum, np.maximum, np.maximum)):
            fn.at(out, label, value)
        open_ = np.zeros(len(first), dtype=bool)
        open_[of[shared]] = True
        whose = np.r_[root, of[shared]]
        none = np.zeros(len(root), dtype=np.int64)
        edge = [pa.array(np.r_[none, c[shared]], mask=np.r_[none == 0, np.zeros(shared.sum(), dtype=bool)]) for c in (x, y)]
        return pa.RecordBatch.from_arrays([key.take(pa.array(whose)), *(pa.array(c[whose]) for c in (y[first], x[first], *box, open_)), *edge], [b.schema.names[0], *_BLOB])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            b = pa.concat_batches([held, b]) if held else b
            if not b.num_rows:
                continue
            parts = [b.column(0).dictionary_encode().indices.to_numpy(), b.column("tx").to_numpy(), b.column("ty").to_numpy()]
            group = np.cumsum(np.r_[False, np.any([p[1:] != p[:-1] for p in parts], axis=0)])
            start = int(np.searchsorted(group, group[-1]))  # the last tile may go on in the next batch
            if start:
                yield blobs(b.slice(0, start), group[:start])
            held = b.slice(start)
            if held.num_rows > 2 * high * wide:  # rows that repeat a pixel
                x, y = (held.column(c).to_numpy() for c in ("x", "y"))
                held = held.take(pa.array(np.unique(np.stack([x, y]), axis=1, return_index=True)[1]))
        if held:
            yield blobs(held, np.zeros(held.num_rows, dtype=np.int64))

    return run


_BLOB = ["y0", "x0", "left", "top", "right", "bottom", "open", "px", "py"]


def frame_blobs(pixels: DataFrame, key: str = "image_id", reach: int = 2, side: int = 20, aspect: tuple[float, float] = (0.6, 1.7), tile: int = 512) -> DataFrame:
    """key and the boxes (left, top, right, bottom) of the connected frame pixels that are icons by size and shape.

    Pixels up to `reach` apart in both directions are neighbours. An image is dealt by tiles, and a tile also gets what lies
    up to `reach` right of it and below, so every pair of neighbours meets in one. A task connects the pixels of a tile, which
    its area bounds; a blob is named by its first pixel. Blobs of two tiles that share a pixel are linked, and the least name
    then spreads over these links, both along a link and from a name to the name's own, which halves the way that is left,
    until a round changes nothing. Only what reaches a tile's edge takes part in that, and no image is gathered in one task.
    """
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor(F.col(c) / tile)))
    lit = hsv(pixels).filter(is_frame()).select(key, F.col("x").cast("long"), F.col("y").cast("long")).dropna()
    placed = lit.withColumn("tx", tiles("x")).withColumn("ty", tiles("y")).select(key, "tx", "ty", "x", "y")
    kind = T.StructType([placed.schema[key], *(T.StructField(c, T.BooleanType() if c == "open" else T.LongType()) for c in _BLOB)])
    found = placed.repartition(key, "tx", "ty").sortWithinPartitions(key, "tx", "ty").mapInArrow(_tile_blobs(reach, tile), kind).withColumn("name", F.struct("y0", "x0"))
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    icon = (w >= side) & (h >= side) & (w / h).between(*aspect)
    found = kept(found.filter(F.col("open") | icon))
    met = found.filter("px IS NOT NULL").groupBy(key, "px", "py").agg(F.min("name").alias("other"), F.collect_set("name").alias("_all"))
    links = met.select(key, F.explode("_all").alias("name"), "other").filter("name <> other").distinct()
    both = kept(links.union(links.select(key, "other", "name")))
    label = kept(both.select(key, "name", F.col("name").alias("label")).distinct())
    while True:
        by_link = both.join(dealt(label.select(key, F.col("name").alias("other"), "label")), [key, "other"]).select(key, "name", "label")
        by_label = label.select(key, "name", F.col("label").alias("at")).join(dealt(label.select(key, F.col("name").alias("at"), "label")), [key, "at"]).select(key, "name", "label")
        lowest = by_link.union(by_label).union(label).groupBy(key, "name").agg(F.min("label").alias("label"))
        after = kept(lowest.join(dealt(label.withColumnRenamed("label", "_was")), [key, "name"]))
        changed = after.filter(F.col("label") != F.col("_was")).limit(1).count()
        label = after.drop("_was")
        if not changed:
            break
    named = found.filter("px IS NULL").join(dealt(label), [key, "name"], "left").withColumn("label", F.coalesce("label", "name"))
    boxes = named.groupBy(key, "label").agg(*[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), ("left", "top", "right", "bottom"))])
    return boxes.filter(icon).drop("label")
