"""From tokens with boxes to lines, numbers, totals and counts.

Order-dependent steps are folds over one reading's sorted tokens, built-in higher-order functions all through; a reading
is one screen, so its tokens are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import is_numeric, parse_fraction, parse_number

TOKEN = "struct<text:string,left:int,top:int,right:int,bottom:int>"


def tokens(raw: DataFrame, least: float = 30) -> DataFrame:
    """Tokens with text and a confidence of at least `least`; one without a number for confidence is dropped."""
    return raw.filter((F.trim("text") != "") & (F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) >= least)).withColumn("text", F.trim("text"))


def group_lines(raw: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no, words (left to right), text, top, bottom, left, right.

    A token opens a new line if its top is further from the line's first token's top than 0.6 of that one's height (6 px
    at least).
    """
    sorted_ = raw.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("top", "left", "text", "right", "bottom"))).alias("_t"))
    start = F.expr(f"cast(array() as array<array<{TOKEN}>>)")

    def step(lines: Column, t: Column) -> Column:
        word = F.struct(t["text"].alias("text"), t["left"].alias("left"), t["top"].alias("top"), t["right"].alias("right"), t["bottom"].alias("bottom"))
        last = F.element_at(lines, -1)
        head = F.get(last, F.lit(0))
        limit = F.greatest(0.6 * F.greatest(head["bottom"] - head["top"], F.lit(1)), F.lit(6.0))
        new = F.concat(lines, F.array(F.array(word)))
        return F.when(F.size(lines) == 0, new).when(F.abs(t["top"] - head["top"]) > limit, new).otherwise(F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.array(word)))))

    lines = sorted_.select(*key, F.posexplode(F.aggregate("_t", start, step)).alias("line_no", "_w"))
    by_left = F.transform(F.sort_array(F.transform("_w", lambda w, i: F.struct(w["left"].alias("l"), i.alias("i"), w.alias("w")))), lambda s: s["w"])
    out = lines.withColumn("words", by_left).drop("_w")
    edge = lambda f, c: f(F.transform("words", lambda w: w[c]))
    return out.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " ")).withColumns(
        {"top": edge(F.array_min, "top"), "bottom": edge(F.array_max, "bottom"), "left": edge(F.array_min, "left"), "right": edge(F.array_max, "right")}
    )


def merge_numbers(words: Column) -> Column:
    """The numeric words of a line, those joined that a space split: a small gap and exactly three digits to come."""
    numeric = F.filter(words, lambda w: is_numeric(w["text"]))
    start = F.expr(f"cast(array() as array<{TOKEN}>)")

    def step(done: Column, w: Column) -> Column:
        prev = F.element_at(done, -1)
        gap = w["left"] - prev["right"]
        joins = (gap >= 0) & (gap <= 0.6 * F.greatest(prev["bottom"] - prev["top"], F.lit(1))) & (F.length(F.regexp_replace(w["text"], "[,. ]", "")) == 3)
        both = F.struct(
            F.concat(prev["text"], F.lit(" "), w["text"]).alias("text"), prev["left"].alias("left"), F.least(prev["top"], w["top"]).alias("top"), w["right"].alias("right"), F.greatest(prev["bottom"], w["bottom"]).alias("bottom")
        )
        return F.when(F.size(done) == 0, F.array(w)).when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(w)))

    return F.aggregate(numeric, start, step)


def name_start(words: Column) -> Column:
    """Left edge of the first word with three letters or more; NULL without one."""
    named = F.filter(words, lambda w: F.length(F.regexp_replace(w["text"], r"[^\p{L}]", "")) >= 3)
    return F.get(named, F.lit(0))["left"]


def count_word(words: Column) -> Column:
    """The largest number right of the name (the first of equals), with what is no number last."""
    right = F.filter(merge_numbers(words), lambda w: w["left"] > name_start(words))
    ranked = F.transform(right, lambda w, i: F.struct(F.coalesce(parse_number(w["text"])["value"], F.lit(-1)).alias("v"), (-i).alias("i"), w.alias("w")))
    return F.array_max(ranked)["w"]


def read_totals(lines: DataFrame, key: list[str], order: str = "line_no") -> DataFrame:
    """key and the wounded and ram totals printed in the lines.

    A header names the next line with a "/", which uses it up whether it parses or not. Capacities under 1000 are no
    totals; without a header a capacity of up to 100,000 is the ram zone's. The first of each kind stands.
    """
    flat = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z0-9,./ ]", " "), r"\s+", " ")
    header = F.when(F.contains(flat, F.lit("battering ram zone")), "ram").when(F.contains(flat, F.lit("severely wounded")), "wounded")
    f = parse_fraction(F.col("text"))
    slash = F.contains("text", F.lit("/"))
    small = f["capacity"] < 1000
    # a "/" line that parses, or has too small a capacity, is never a header itself
    ends = slash & (F.coalesce(small, F.lit(False)) | (f["current"].isNotNull() & f["capacity"].isNotNull()))
    seen = lines.select(*key, order, slash.alias("_slash"), F.when(~ends, header).alias("_head"), f["current"].alias("_cur"), f["capacity"].alias("_cap"), F.coalesce(small, F.lit(False)).alias("_small"))
    folded = seen.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, "_slash", "_head", "_cur", "_cap", "_small"))).alias("_l"))
    pair = lambda a, b: F.struct(a.cast("long").alias("current"), b.cast("long").alias("capacity"))
    none = F.lit(None).cast("struct<current:bigint,capacity:bigint>")

    def step(s: Column, x: Column) -> Column:
        label = F.coalesce(F.when(x["_slash"], s["pending"]), F.when(x["_cap"] <= 100_000, "ram").otherwise("wounded"))
        good = x["_slash"] & ~x["_small"] & x["_cur"].isNotNull() & x["_cap"].isNotNull()
        take = lambda name: F.when(s[name].isNull() & good & (label == name), pair(x["_cur"], x["_cap"])).otherwise(s[name]).alias(name)
        return F.struct(F.coalesce(x["_head"], F.when(~x["_slash"], s["pending"])).alias("pending"), take("wounded"), take("ram"))

    state = F.struct(F.lit(None).cast("string").alias("pending"), none.alias("wounded"), none.alias("ram"))
    out = folded.withColumn("_s", F.aggregate("_l", state, step))
    return out.select(*key, *[F.col(f"_s.{z}.{c}").alias(f"{z}_{c}") for z in ("wounded", "ram") for c in ("current", "capacity")])


def bucket_dedupe(numbers: DataFrame, key: list[str], cell: int = 15) -> DataFrame:
    """The widest of the numbers whose corner rounds to the same cell; the first read of equals."""
    by = [*key, F.bround(F.col("left") / cell).alias("_x"), F.bround(F.col("top") / cell).alias("_y")]
    whole = F.struct(*[c for c in numbers.columns if c not in key])
    return numbers.groupBy(*by).agg(F.max_by(whole, F.struct(F.col("right") - F.col("left"), -F.col("pos"))).alias("_v")).select(*key, "_v.*")


def islands(df: DataFrame, key: list[str], x: str, gap: float) -> DataFrame:
    """Adds island: runs of x whose neighbours are at most gap apart, numbered from 0."""
    w = Window.partitionBy(*key).orderBy(x)
    new = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def match_icons(icons: DataFrame, numbers: DataFrame, key: list[str]) -> DataFrame:
    """Icons with the number nearest to their right in the same row, or NULL.

    In the order of the icons each number serves once; an icon whose nearest number is taken gets none, not the next one.
    So of the icons with the same nearest number the first has it: a window, no loop.

    A number stands in an icon's row if its centre is within 0.6 of the icon's height. Boxes are whole pixels, so twice a
    centre is a whole number: each icon is laid on those of its row that hold a number, and there the next number in the
    order of the left edges is an as-of match, one ordered window over icons and numbers together.
    """
    level = lambda: (F.col("top") + F.col("bottom")).cast("long")
    laid = numbers.select(*key, level().alias("_y"), F.col("left").alias("_x"), F.struct(F.col("left").alias("l"), F.col("pos").alias("npos"), "text").alias("_n"))
    reach = 1.2 * (F.col("bottom") - F.col("top"))
    rows = F.sequence(F.floor(level() - reach) + 1, F.ceil(level() + reach) - 1)
    asked = icons.filter(reach > 0).select(*key, "pos", F.col("right").alias("_x"), F.explode(rows).alias("_y")).join(laid.select(*key, "_y").distinct(), [*key, "_y"], "left_semi")
    both = asked.withColumn("_n", F.lit(None).cast(laid.schema["_n"].dataType)).unionByName(laid.withColumn("pos", F.lit(None).cast(icons.schema["pos"].dataType)))
    # from right to left: icons come before numbers at the same edge, and of equal numbers the first one comes last
    ahead = Window.partitionBy(*key, "_y").orderBy(F.col("_x").desc(), F.col("pos").isNotNull().desc(), F.col("_n.npos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_next", F.last("_n", ignorenulls=True).over(ahead)).filter("pos IS NOT NULL AND _next IS NOT NULL")
    best = seen.groupBy(*key, "pos").agg(F.min("_next").alias("_b"))
    first = Window.partitionBy(*key, F.col("_b.npos")).orderBy("pos")
    taken = best.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select(*key, "pos", F.col("_b.text").alias("number"))
    return icons.join(taken, [*key, "pos"], "left")
