"""Column functions that turn read text into numbers, keys and cells. NULL means "not visible" and is never 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters trimmed from a number, the digits that letters are misread for, and what a number looks like.
TRIMMED = "()[]{}<>:;"
MISREAD, DIGITS = "OolI|SB", "0011158"
NUMBER = r"^([0-9][0-9.,]*)\s*([KkMmBb])?$"
_LARGEST = 9.2e18


def strip(x: Column) -> Column:
    """Trim every kind of white space, not spaces alone."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_number(x: Column) -> Column:
    """Trim brackets and colons, drop spaces, and put digits for letters read in their place."""
    bare = F.regexp_replace(strip(x), f"^[{re.escape(TRIMMED)}]+|[{re.escape(TRIMMED)}]+$", "")
    return F.translate(F.replace(bare, F.lit(" "), F.lit("")), MISREAD, DIGITS)


def parse_number(x: Column) -> Column:
    """struct(value, approx): a suffix scales and marks the value as rounded; dots and commas otherwise group thousands."""
    t = clean_number(x)
    digits, suffix = F.regexp_extract(t, NUMBER, 1), F.lower(F.regexp_extract(t, NUMBER, 2))
    scale = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9)
    scaled = F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * scale
    whole = F.regexp_replace(digits, "[.,]", "").try_cast("long")
    value = F.when(digits == "", None).when(suffix != "", F.when(F.abs(scaled) < _LARGEST, F.bround(scaled).cast("long"))).otherwise(whole)
    return F.struct(value.alias("value"), ((suffix != "") & value.isNotNull()).alias("approx"))


def parse_fraction(x: Column) -> Column:
    """struct(current, capacity) of the first "a/b" in x; NULLs without one."""
    t = F.replace(x, F.lit(" "), F.lit(""))
    part = lambda k: parse_number(F.nullif(F.regexp_extract(t, r"([0-9][0-9.,]*[KkMmBb]?)/([0-9][0-9.,]*[KkMmBb]?)", k), F.lit("")))["value"]
    return F.struct(part(1).alias("current"), part(2).alias("capacity"))


def normalise_name(x: Column) -> Column:
    """Lower-case letters and apostrophes with single spaces; other alphabets vanish, so their names share the key ''."""
    t = F.translate(strip(F.lower(x)), "–—’", "--'")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[^a-z' -]", " "), r"[-\s]+", " "))


def extract_key(x: Column) -> Column:
    """The first run of 5 to 12 digits that stands alone, commas between digits aside."""
    return F.nullif(F.regexp_extract(F.regexp_replace(x, r"(?<=[0-9]),(?=[0-9])", ""), r"\b([0-9]{5,12})\b", 1), F.lit(""))


def flat_text(x: Column) -> Column:
    """A line reduced to lower-case letters, digits and ,./ with single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9,./ ]", " "), r"\s+", " "))


def is_numeric(x: Column) -> Column:
    return clean_number(x).rlike(NUMBER)


def trailing_number(x: Column, loose: bool = False) -> Column:
    """The digits, grouped or not, that end x; loose: also grouped by spaces."""
    return F.nullif(F.regexp_extract(x, r"[0-9][0-9,. ]*$" if loose else r"[0-9][0-9,.]*$", 0), F.lit(""))


def strip_fused_digits(x: Column) -> Column:
    """Keep three digits of the group before the first comma: more cannot belong to a grouped number."""
    first = F.substring_index(x, ",", 1)
    return F.when(F.contains(x, F.lit(",")) & (F.char_length(first) > 3), F.concat(F.right(first, F.lit(3)), F.substring(x, F.char_length(first) + 1, F.char_length(x)))).otherwise(x)


def trim_leading_groups(x: Column) -> Column:
    """Keep the last group; if it has no , or . also the bare groups before it, back to the first punctuated one."""
    groups = F.reverse(F.filter(F.split(x, r"\s+"), lambda g: g != ""))
    bare = lambda g: ~(F.contains(g, F.lit(",")) | F.contains(g, F.lit(".")))
    go = F.struct(F.lit(True).alias("go"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, g: Column) -> Column:
        first = F.size(s["kept"]) == 0
        take = s["go"] & (first | bare(g))
        return F.struct((take & bare(g)).alias("go"), F.when(take, F.concat(F.array(g), s["kept"])).otherwise(s["kept"]).alias("kept"))

    return F.when(F.size(groups) == 0, x).otherwise(F.aggregate(groups, go, step, lambda s: F.array_join(s["kept"], " ")))


def report_number(x: Column) -> Column:
    """A cell's whole number, towards zero; 0 if it is none."""
    value = F.replace(strip(x), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(F.when(F.abs(value) < _LARGEST, value.cast("long")), F.lit(0)).cast("long")


def commas(x: Column) -> Column:
    return F.format_number(x, 0)


def cell(x: Column) -> Column:
    """Text for a sheet: NULL is empty, and a text's leading = + - @ is quoted so it is no formula."""
    t = F.coalesce(x.cast("string"), F.lit(""))
    return F.when((F.typeof(x) == "string") & t.rlike("^[=+@-]"), F.concat(F.lit("'"), t)).otherwise(t)


def link(url: Column, label: str) -> Column:
    safe = F.replace(url, F.lit('"'), F.lit("%22"))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(F.lit('=HYPERLINK("'), safe, F.lit(f'", "{label}")')))


def column_letters(n: Column) -> Column:
    """Letters of a sheet's column, A for 1, AA after Z, AAAA after ZZZ."""

    def place(s: Column, _: Column) -> Column:
        m = s["left"] - 1
        more = F.struct(F.call_function("div", m, F.lit(26).cast("long")).alias("left"), F.concat(F.char(m % 26 + 65), s["out"]).alias("out"))
        return F.when(s["left"] > 0, more).otherwise(s)

    most = 14  # places of the largest long
    found = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(n.cast("long").alias("left"), F.lit("").alias("out")), place, lambda s: s["out"])
    return F.when(n.isNotNull(), found)


def is_image(mime: Column, name: Column) -> Column:
    return F.coalesce(F.startswith(mime, F.lit("image/")), F.lit(False)) | F.coalesce(F.lower(name).rlike(r"\.(png|jpg|jpeg|webp)$"), F.lit(False))


def media_type(content: Column) -> Column:
    """MIME type by the first bytes; PNG if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(head, F.lit("FFD8")), "image/jpeg")
        .when(head.rlike("^47494638(37|39)61"), "image/gif")
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .otherwise("image/png")
    )


def archive_name(ts: Column, key: Column, suffix: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("_"), key, suffix)
