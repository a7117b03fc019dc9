"""Which points lie in which boxes of an image: an equi-join on tiles with an exact test behind it.

A point has one tile; a box is repeated for the tiles that it touches, so what meets is bounded by the boxes' area and not
by an image's points times its boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import dealt

TILE = 32
SIDES = ("x0", "x1", "y0", "y1")


def whole(x: Column) -> Column:
    """A number without its fraction, towards zero."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def in_boxes(points: DataFrame, boxes: DataFrame, key: list[str], tile: int = TILE) -> DataFrame:
    """Points (key, x, y, ...) with every box (key, x0, x1, y0, y1, ...) that holds them; x1 and y1 are outside."""
    across = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.ceil(F.col(b) / tile) - 1)
    tiles = boxes.filter("x1 > x0 AND y1 > y0").withColumn("_tx", F.explode(across("x0", "x1"))).withColumn("_ty", F.explode(across("y0", "y1")))
    placed = points.withColumn("_tx", F.floor(F.col("x") / tile)).withColumn("_ty", F.floor(F.col("y") / tile))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return placed.join(dealt(tiles), [*key, "_tx", "_ty"]).filter(inside).drop("_tx", "_ty")


def clipped(boxes: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """The boxes cut at the edges of their images (key, width, height)."""
    both = boxes.join(dealt(images.select(*key, F.col("width").alias("_width"), F.col("height").alias("_height"))), key)
    zero = F.lit(0)
    return both.withColumns({"x0": F.greatest("x0", zero), "x1": F.least("x1", "_width"), "y0": F.greatest("y0", zero), "y1": F.least("y1", "_height")}).drop("_width", "_height")


def ring_share(boxes: DataFrame, points: DataFrame, images: DataFrame, key: list[str], box: str = "box_id", least: int = 10) -> DataFrame:
    """key, box and share: how much of the one pixel wide ring of a box is points.

    A ring is the box's four sides, cut at the image's edges; corners belong to two of them. Boxes with a side of under
    `least` pixels, before the cut or after it, have no ring and no row.
    """
    big = lambda: (F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)
    kept = clipped(boxes.filter(big()).select(*key, box, *SIDES), images, key).filter(big())
    x0, x1, y0, y1 = map(F.col, SIDES)
    side = lambda *at: F.struct(*[c.cast("long").alias(n) for c, n in zip(at, SIDES)])
    sides = F.explode(F.array(side(x0, x1, y0, y0 + 1), side(x0, x1, y1 - 1, y1), side(x0, x0 + 1, y0, y1), side(x1 - 1, x1, y0, y1)))
    strips = kept.select(*key, box, sides.alias("s")).select(*key, box, "s.*")
    hits = in_boxes(points.select(*key, "x", "y"), strips, key).groupBy(*key, box).agg(F.count("*").alias("_hits"))
    total = 2 * (x1 - x0 + y1 - y0)
    return kept.join(dealt(hits), [*key, box], "left").select(*key, box, (F.coalesce("_hits", F.lit(0)) / total).alias("share"))
