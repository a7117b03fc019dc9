"""Three-valued verdicts, statuses and their explanations. All are expressions over one row per submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import commas
from tallymark.sources.dimensions import SIEGE_CAPS, SIEGE_ZERO, Rules

from .reconcile import compact, off_by, total


def state_columns(rules: Rules = Rules()) -> list[Column]:
    """Aggregates of a submission's resolved rows that the rules read."""
    high = F.col("tier").isin(*rules.high_tiers)
    names = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("name"))))
    return [
        total(F.col("count")).alias("identified"),
        total(F.col("count"), high).alias("high_tier"),
        total(F.col("count"), F.col("tier").isNull()).alias("unknown_tier"),
        total(F.col("count"), ~F.col("in_ram_zone")).alias("listed"),
        total(F.col("count"), F.col("in_ram_zone")).alias("siege"),
        names(F.col("tier").isNull()).alias("unknown_tier_names"),
        names(~F.col("known")).alias("unknown_names"),
    ]


def judge(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds totals, verdict, note, conflicts, status, missing and display to rows with state_columns and the totals."""
    wounded, ram = F.col("wounded_current"), F.col("ram_current")
    recordable = wounded.isNotNull()
    unaccounted = F.when(recordable, F.greatest(F.lit(0), wounded - F.col("listed")))
    conflicts = compact(
        F.when(F.col("listed") > wounded, off_by(F.col("listed"), wounded, "Wounded", False)),
        F.when(F.col("siege") > ram, off_by(F.col("siege"), ram, "Battering Ram Zone", False)),
        F.when(F.size("unknown_names") > 0, F.concat(F.lit("Unknown unit(s): "), F.array_join("unknown_names", ", "), F.lit(" - an admin can add them with /hospital learn."))),
    )
    out = (
        df.withColumn("recordable", recordable)
        .withColumn("total_in_hospital", F.when(recordable, wounded + F.coalesce(ram, F.lit(0))))
        .withColumn("unaccounted", unaccounted)
        .withColumn("conflicts", conflicts)
    )
    calm = F.size("conflicts") == 0
    complete = F.col("recordable") & calm & (F.col("unaccounted") == 0)
    out = out.withColumn("complete", F.coalesce(complete, F.lit(False)))
    out = out.withColumn("status", F.when(~F.col("recordable"), "Unreadable").when(~calm, "Needs review").when(F.col("complete"), "Complete").otherwise("Totals only"))
    out = out.withColumn("awaiting_more", F.coalesce(F.col("unaccounted") > 0, F.lit(False)) & calm).withColumn("needs_human", ~calm)
    verdict, note = fill_check(rules)
    unread = F.when(~F.col("recordable"), "Haven't read the 'Severely Wounded Units' total yet.")
    rest = F.when(
        F.col("unaccounted") > 0,
        F.concat(commas(F.col("unaccounted")), F.lit(" of "), commas(wounded), F.lit(" wounded troops aren't broken down by unit yet - send a screenshot scrolled to the rest of the list if you want the tier detail.")),
    )
    big = F.coalesce(wounded >= rules.big_enough, F.lit(False))
    return (
        out.withColumn("verdict", verdict)
        .withColumn("note", note)
        .withColumn("missing", F.concat(compact(unread), F.col("conflicts"), compact(rest)))
        .withColumn("big_enough", big)
        .withColumn("display", F.when(F.col("complete") | big, "Recorded").when(F.col("needs_human"), "Needs review").when(F.col("recordable"), "Totals only").otherwise("Could not read"))
        .withColumn("reaction", F.when(F.col("complete") | big, "OK").otherwise("PARTIAL"))
    )


def fill_check(rules: Rules) -> tuple[Column, Column]:
    """Pass if enough high-tier troops are seen, FAIL if even all that is uncertain would not do, else Unconfirmed."""
    if not rules.min_high:
        return F.lit("Unknown"), F.lit("No fill rule configured.")
    need, said = F.lit(rules.min_high), f"{rules.min_high:,}"
    tiers = " or ".join(rules.high_tiers)
    seen, unknown, open_ = F.col("high_tier"), F.col("unknown_tier"), F.coalesce("unaccounted", F.lit(0))
    uncertain = open_ + unknown
    ok, bad = seen >= need, seen + uncertain < need
    verdict = F.when(~F.col("recordable"), "Unknown").when(ok, "Pass").when(bad, "FAIL").otherwise("Unconfirmed")
    reasons = F.array_join(
        compact(
            F.when(unknown > 0, F.concat(commas(unknown), F.lit(" troops are on rows I don't recognise ("), F.array_join("unknown_tier_names", ", "), F.lit(") - an admin can add them with /hospital learn and the check will settle"))),
            F.when(open_ > 0, F.concat(commas(open_), F.lit(" troops aren't broken down yet - send a screenshot scrolled to the rest of the list"))),
        ),
        ". ",
    )
    note = (
        F.when(~F.col("recordable"), "Hospital total not readable.")
        .when(ok, F.concat(commas(seen), F.lit(f" {tiers} troops seen, at or above the {said} required.")))
        .when(
            bad,
            F.concat(F.lit("Only "), commas(seen), F.lit(f" {tiers} troops, and even if all "), commas(uncertain), F.lit(f" unidentified troops were {tiers} the hospital is "), commas(need - seen - uncertain), F.lit(f" short of {said}.")),
        )
        .otherwise(F.concat(commas(seen), F.lit(f" {tiers} troops confirmed so far, "), commas(need - seen), F.lit(f" short of {said}. "), reasons, F.lit(".")))
    )
    return verdict, note


def siege_rules(df: DataFrame) -> DataFrame:
    """Adds siege_verdict and siege_notes (all violations) to rows with the counts n_t1 .. n_t5."""
    notes = compact(
        *[F.when(F.col(f"n_{t.lower()}") != 0, F.concat(F.lit(f"{t} siege must be 0, found "), commas(F.col(f"n_{t.lower()}")), F.lit("."))) for t in SIEGE_ZERO],
        *[F.when(F.col(f"n_{t.lower()}") > cap, F.concat(F.lit(f"{t} siege must be at most {cap:,}, found "), commas(F.col(f"n_{t.lower()}")), F.lit("."))) for t, cap in SIEGE_CAPS.items()],
    )
    out = df.withColumn("siege_notes", notes).withColumn("siege_verdict", F.when(F.size("siege_notes") > 0, "FAIL").otherwise("Pass"))
    return out.withColumn("siege_notes", F.when(F.size("siege_notes") > 0, F.col("siege_notes")).otherwise(F.array(F.lit("All siege tiers within limits."))))
