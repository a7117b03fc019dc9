"""Bounded samples of labelled texts, for fitting classifiers on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bytes of text of a label value after which no more rows are drawn.
FIT_BYTES = 32 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: Column, train: Column, rows: int, size: int = FIT_BYTES) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """(label, text) of whole texts for every label value among the training rows, and the count of each value.

    Rows are drawn in the order of a hash of their id, at most `rows` of a value, until their texts reach `size` bytes (the
    text that does so is drawn too, whatever its length). So the sample is the same on every run; the id decides nothing else.
    """
    pool = labels.select("doc_id", label.cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & train)
    totals = {r["label"]: r["count"] for r in pool.groupBy("label").count().collect()}
    if not totals:
        return [], {}
    # a limit after an order keeps `rows` of each task before anything moves, whatever the share of a label
    placed = pool.withColumn("place", F.xxhash64("doc_id"))
    chosen = reduce(DataFrame.union, [placed.filter(F.col("label") == v).orderBy("place", "doc_id").limit(rows) for v in sorted(totals)])
    # at most rows * len(totals) ids, so they may be broadcast; an id that documents repeat counts each time
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("order", F.xxhash64("text"))
    by_text = Window.partitionBy("label").orderBy("place", "doc_id", "order")
    drawn = found.withColumn("at", F.row_number().over(by_text)).filter(F.col("at") <= rows)
    before = F.coalesce(F.sum(F.octet_length("text")).over(by_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = drawn.withColumn("before", before).filter(F.col("before") < size).select("label", "place", "doc_id", "order", "text").toArrow()
    got = sorted(zip(*(kept[c].to_pylist() for c in ("label", "place", "doc_id", "order", "text"))))
    return [(x[0], x[-1]) for x in got], totals
