"""Choosing among several readings of the same thing: votes, agreement, ranking and margins.

Each is one aggregation or one ranked window per key, with explicit tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.sources.dimensions import GLYPH_MARGIN, GLYPH_SCORE, RESOURCES, small


def vote(votes: DataFrame, key: list[str], value: str = "value", least: int = 2) -> DataFrame:
    """key, value, votes, n_top and winner: the value with the most votes if it is alone at the top and has `least`.

    The built-in mode() hides ties, so votes are counted first; a value's count needs no window.
    """
    counted = votes.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    top = counted.groupBy(*key).agg(F.max("_n").alias("votes"), F.max_by(value, "_n").alias("_v"), F.collect_list("_n").alias("_all"))
    out = top.withColumn("n_top", F.size(F.filter("_all", lambda x: x == F.col("votes"))))
    return out.withColumn("winner", F.when((F.col("n_top") == 1) & (F.col("votes") >= least), F.col("_v"))).drop("_v", "_all")


def expected_resources(votes: DataFrame, key: list[str]) -> DataFrame:
    """key and the resources that got any vote, in the order of the domain."""
    seen = votes.filter("value IS NOT NULL").groupBy(*key).agg(F.collect_set("resource").alias("_s"))
    return seen.withColumn("expected", F.filter(F.array(*map(F.lit, RESOURCES)), lambda r: F.array_contains("_s", r))).drop("_s")


def suffix_of(votes: DataFrame, key: list[str], suffix: str = "suffix") -> DataFrame:
    """key and its commonest suffix; ties go to the first in the alphabet."""
    n = votes.filter(F.col(suffix).isNotNull()).groupBy(*key, suffix).agg(F.count("*").alias("_n"))
    return n.groupBy(*key).agg(F.min_by(suffix, F.struct(-F.col("_n"), F.col(suffix))).alias(suffix))


def share_values(candidates: DataFrame, key: str, fields: tuple[str, ...] = RESOURCES) -> DataFrame:
    """Fills a candidate's NULL fields where all candidates of the key that have a value agree on it.

    A candidate that was filled takes the group's approx flag, and its warning names what is still missing.
    """
    w = Window.partitionBy(key)
    agreed = candidates
    for f in fields:
        low, high = F.min(f).over(w), F.max(f).over(w)
        agreed = agreed.withColumn(f"_{f}", F.when(low == high, low))
    agreed = agreed.withColumn("_any", F.bool_or("rss_approx").over(w))
    filled = F.lit(False)
    for f in fields:
        filled = filled | (F.col(f).isNull() & F.col(f"_{f}").isNotNull())
    agreed = agreed.withColumn("_filled", filled)
    for f in fields:
        agreed = agreed.withColumn(f, F.coalesce(f, f"_{f}"))
    left = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kept = F.filter("warnings", lambda x: ~F.startswith(x, F.lit("Could not read the ")))
    told = F.when(F.size(left) > 0, F.array(F.concat(F.lit("Could not read the "), F.array_join(left, ", "), F.lit(" cost.")))).otherwise(F.array().cast("array<string>"))
    out = agreed.withColumn("warnings", F.when(F.col("_filled"), F.concat(kept, told)).otherwise(F.col("warnings")))
    out = out.withColumn("rss_approx", F.when(F.col("_filled"), F.col("rss_approx") | F.col("_any")).otherwise(F.col("rss_approx")))
    return out.drop("_any", "_filled", *[f"_{f}" for f in fields])


def best_reading(candidates: DataFrame, key: str, ordinal: str = "reading_id") -> DataFrame:
    """One candidate per key.

    Candidates stand in the order of most rows, most measures, then as generated. The first without problems wins;
    failing that, the one that read the total, has the fewest problems and the most rows.
    """
    measures = sum((F.when(F.col(r).isNotNull(), 1).otherwise(0) for r in RESOURCES), F.lit(0))
    fine = F.size("problems") == 0
    first = [F.when(fine, -F.col("n_rows")), F.when(fine, -measures), F.when(fine, F.col(ordinal))]
    rest = [F.col("wounded_current").isNull().cast("int"), F.size("problems"), -F.col("n_rows"), -measures, F.col(ordinal)]
    w = Window.partitionBy(key).orderBy((~fine).cast("int"), *first, *rest)
    return candidates.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def agreement(a: Column, b: Column) -> Column:
    """The share of equal bits of two bitmaps, each an array of longs."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - differ / (64 * F.size(a))


def classify_glyphs(glyphs: DataFrame, templates: DataFrame, key: list[str], score: float = GLYPH_SCORE, margin: float = GLYPH_MARGIN) -> DataFrame:
    """key, class (NULL if unsure), best and second: the class of the most similar template, if similar and clear enough.

    Templates are a small table; every glyph meets every template, as the measure asks.
    """
    pairs = glyphs.select(*key, "bits").join(small(templates.select(F.col("class"), F.col("bits").alias("_b"))), F.size("bits") == F.size("_b"))
    per = pairs.groupBy(*key, "class").agg(F.max(agreement(F.col("bits"), F.col("_b"))).alias("_s"))
    ranked = per.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("_s")).alias("s"), "class"))).alias("r"))
    best, second = -F.get("r", F.lit(0))["s"], F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0))
    out = ranked.select(*key, best.alias("best"), second.alias("second"), F.get("r", F.lit(0))["class"].alias("_c"))
    sure = (F.col("best") >= score) & (F.col("best") - F.col("second") >= margin)
    return out.withColumn("class", F.when(sure, F.col("_c"))).drop("_c")


def longest(reads: DataFrame, key: list[str], text: str = "text", ordinal: str = "pass_id") -> DataFrame:
    """key and the longest text; the first pass wins ties."""
    return reads.filter(F.col(text).isNotNull()).groupBy(*key).agg(F.max_by(text, F.struct(F.length(text), -F.col(ordinal))).alias(text))


def accuracy(truth: DataFrame, read: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """right, wrong (spurious ones too) and blank counts of read values against the truth."""
    both = truth.select(*key, F.col(value).alias("_t")).join(read.select(*key, F.col(value).alias("_r")), key, "full")
    return both.agg(
        F.count_if(F.col("_t") == F.col("_r")).alias("right"),
        F.count_if(F.col("_r").isNotNull() & ~F.col("_t").eqNullSafe(F.col("_r"))).alias("wrong"),
        F.count_if(F.col("_t").isNotNull() & F.col("_r").isNull()).alias("blank"),
    )


def invariant(readings: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key and whether all its readings (at several scales) give the same values."""
    return readings.groupBy(*key).agg((F.count_distinct(F.struct(*values)) == 1).alias("same"))
