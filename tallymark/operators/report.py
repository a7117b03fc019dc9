"""Output records and roll-ups. Column orders and message texts are fixed by the sheets they fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import cell, commas, link, report_number, strip
from tallymark.sources.dimensions import TIERS, TYPES

STAMP = "yyyy-MM-dd HH:mm:ss"
# The columns of the three tables.
SUBMISSIONS = (
    "Updated (UTC)", "Governor ID", "Name", "Discord User", "Total In Hospital", "Wounded", "Ram Zone", "Identified", "Unaccounted", "Food", "Wood", "Stone", "Gold", "RSS Exact?",
    "T4+T5 Troops", "Fill Check", "Fill Note", "Total Power", "Power Is Minimum?", *TIERS, *TYPES, "Tiers", "Types", "Status", "Read By", "Screenshot", "Discord Message", "All Images", "Notes",
)
TROOPS = ("Updated (UTC)", "Governor ID", "Name", "Unit", "Tier", "Type", "Count", "Power Each", "Power Total", "Ram Zone?")
SIEGE_CHECK = (
    "Updated (UTC)", "Governor ID", "Name", "Discord User", "T1 Siege", "T2 Siege", "T3 Siege", "T4 Siege", "T5 Siege", "Total Siege", "Verdict", "Notes", "Screenshot", "Discord Message",
)


def submission_records(submissions: DataFrame, key: str = "gid", name: str = "name") -> DataFrame:
    """The 36 columns of a submission, as cells (text; NULL is empty, formulas are quoted)."""
    open_ = F.coalesce("unaccounted", F.lit(0))
    values = [
        F.date_format("updated_at", STAMP), F.col(key), F.col(name), F.col("user_name"), F.col("total_in_hospital"), F.col("wounded_current"), F.col("ram_current"), F.col("identified"), open_,
        F.col("food"), F.col("wood"), F.col("stone"), F.col("gold"), F.when(F.col("rss_approx"), "No (rounded by game)").otherwise("Yes"),
        F.col("high_tier"), F.col("verdict"), F.col("note"), F.col("total_power"), F.when((open_ != 0) | F.col("power_is_partial"), "Yes").otherwise("No"),
        *[F.col(f"n_{t.lower()}") for t in (*TIERS, *TYPES)],
        F.array_join("tiers_present", ", "), F.array_join("types_present", ", "), F.col("status"), F.array_join(F.array_distinct("sources"), "/"),
        link(F.try_element_at("image_urls", F.lit(-1)), "Open image"), link(F.try_element_at("message_urls", F.lit(-1)), "Go to message"),
        F.array_join(F.array_distinct("image_urls"), "\n"), F.substring(F.array_join(F.array_distinct(F.concat("missing", "notes")), " | "), 1, 1000),
    ]
    return submissions.select(*[cell(v).alias(c) for c, v in zip(SUBMISSIONS, values, strict=True)])


def troop_records(rows: DataFrame, submissions: DataFrame, by: list[str], key: str = "gid", name: str = "name") -> DataFrame:
    """The 10 columns of each merged row, ordered within a key by zone, tier and name."""
    both = rows.drop("event_ts", "seq").join(submissions.select(*by, "updated_at", F.col(name).alias("_name")), by)
    values = [
        F.date_format("updated_at", STAMP), F.col(key), F.col("_name"), F.col("name"), F.coalesce("tier", F.lit("?")), F.coalesce("type", F.lit("?")), F.col("count"), F.col("power_each"),
        F.when(F.col("known"), F.col("power_total")), F.when(F.col("in_ram_zone"), "Yes").otherwise("No"),
    ]
    ordered = both.repartition(F.col(key)).sortWithinPartitions(key, "in_ram_zone", F.coalesce("tier", F.lit("T9")), "name")
    return ordered.select(*[cell(v).alias(c) for c, v in zip(TROOPS, values, strict=True)])


def siege_records(judged: DataFrame, now, key: str = "gid", name: str = "name") -> DataFrame:
    """The 14 columns of a siege check; stamped with the time of writing."""
    counts = [F.col(f"n_{t.lower()}") for t in TIERS]
    values = [
        F.date_format(now, STAMP), F.col(key), F.col(name), F.col("user_name"), *counts, sum(counts[1:], counts[0]), F.col("siege_verdict"), F.array_join("siege_notes", " "),
        link(F.col("image_url"), "Open image"), link(F.col("message_url"), "Go to message"),
    ]
    return judged.select(*[cell(v).alias(c) for c, v in zip(SIEGE_CHECK, values, strict=True)])


def campaign_totals(records: DataFrame, power: str = "Total Power", troops: str = "Total In Hospital", check: str = "Fill Check") -> DataFrame:
    """submissions, power, troops, passed, failed and pending over all rows with any cell filled.

    Columns are found by name in any case; one that is missing counts as zeros, and so does a cell that is no number.
    """
    names = {c.strip().lower(): c for c in records.columns}
    col = lambda c: F.col(f"`{names[c.lower()]}`") if c.lower() in names else F.lit("")
    filled = F.concat_ws("", *[F.trim(F.col(f"`{c}`").cast("string")) for c in records.columns]) != ""
    number = lambda c: F.coalesce(F.sum(report_number(col(c).cast("string"))), F.lit(0)).cast("long")
    verdict = F.lower(strip(col(check).cast("string")))
    out = records.filter(filled).agg(
        F.count("*").alias("submissions"), number(power).alias("power"), number(troops).alias("troops"), F.count_if(verdict == "pass").alias("passed"), F.count_if(verdict == "fail").alias("failed")
    )
    return out.withColumn("pending", F.col("submissions") - F.col("passed") - F.col("failed"))


# The problems that are shown, and the longest field.
FIRST, FIELD = 3, 1024


def shown_problems(problems: Column) -> Column:
    """The first problems as lines."""
    return F.array_join(F.transform(F.slice(problems, F.lit(1), F.lit(FIRST)), lambda p: F.concat(F.lit("- "), p)), "\n")


def display(submissions: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """by, status, verdict, totals, troops and problems: a submission's report as texts, each cut to what a field holds."""
    power = F.when(F.col("known"), commas(F.col("power_total"))).otherwise("?")
    line = F.concat(F.lit("`"), F.lpad(commas(F.col("count")), 6, " "), F.lit("`  "), F.col("name"), F.lit(" - "), F.coalesce("tier", F.lit("??")), F.lit(" "), F.coalesce("type", F.lit("unknown")), F.lit(" - "), power, F.lit(" power"))
    listed = rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("in_ram_zone", F.coalesce("tier", F.lit("T9")).alias("t"), "name", line.alias("v")))), lambda s: s["v"]), "\n").alias("troops"))
    total = F.when(F.col("total_in_hospital").isNotNull(), F.concat(F.lit("**Total in hospital: "), commas(F.col("total_in_hospital")), F.lit("**")))
    both = submissions.join(listed, by, "left")
    return both.select(*by, "status", "verdict", F.coalesce(total, F.lit("")).alias("totals"), F.substring(F.coalesce("troops", F.lit("")), 1, FIELD).alias("troops"), shown_problems(F.col("missing")).alias("problems"))


def siege_display(judged: DataFrame, by: list[str]) -> DataFrame:
    """by, verdict, counts and notes of a siege check as texts."""
    counts = F.concat_ws("\n", *[F.concat(F.lit(f"{t}: "), commas(F.col(f"n_{t.lower()}"))) for t in TIERS])
    return judged.select(*by, F.col("siege_verdict").alias("verdict"), counts.alias("counts"), F.substring(F.array_join("siege_notes", "\n"), 1, FIELD).alias("notes"))
