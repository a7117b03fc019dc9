"""From line rows and printed totals to an evaluated reading: lookups, zones, sums and the list of problems.

Frames: `readings` has one row per key with wounded_current and ram_current (NULL: not read); `rows` has key, pos,
raw_name, count, name_visible, in_ram_zone, tier and troop_type. Dimensions are counted, and broadcast up to a bound. Per
reading everything is one aggregation by the key; nothing is ever repaired to make a sum fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import commas, flat_text, normalise_name, strip
from tallymark.sources.dimensions import RESOURCES, TIERS, TYPES, small

CUT_OFF = "(name cut off)"


def total(x: Column, when: Column | None = None) -> Column:
    """The sum as a long, 0 for no rows."""
    return F.coalesce(F.sum(x if when is None else F.when(when, x)), F.lit(0)).cast("long")


def classify_zones(rows: DataFrame, units: DataFrame) -> DataFrame:
    """in_ram_zone by the row's class, else by its known visible name, else as read."""
    dim = small(units.select(F.col("key").alias("_key"), F.col("type").alias("_type")))
    joined = rows.join(dim, F.col("name_visible") & (normalise_name(F.col("raw_name")) == F.col("_key")), "left")
    zone = F.when(F.col("troop_type").isNotNull(), F.col("troop_type") == "Siege").when(F.col("_key").isNotNull(), F.coalesce(F.col("_type") == "Siege", F.lit(False))).otherwise(F.col("in_ram_zone"))
    return joined.withColumn("in_ram_zone", zone).drop("_key", "_type")


def reconcile_zones(rows: DataFrame, readings: DataFrame, key: str = "reading_id") -> DataFrame:
    """Rows in the ram zone move to the wounded list if that, and only that, makes the wounded sum exact."""
    sums = rows.groupBy(key).agg(total(F.col("count"), ~F.col("in_ram_zone")).alias("_other"), total(F.col("count"), F.col("in_ram_zone")).alias("_siege"))
    flips = sums.join(readings.select(key, "wounded_current"), key).select(key, ((F.col("_other") != F.col("wounded_current")) & (F.col("_other") + F.col("_siege") == F.col("wounded_current"))).alias("_flip"))
    flips = flips.filter("_flip")
    return rows.join(flips, key, "left").withColumn("in_ram_zone", F.col("in_ram_zone") & F.col("_flip").isNull()).drop("_flip")


def resolve(rows: DataFrame, units: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds key_name, name, tier, type, power_each, known and power_total.

    What the row says itself goes before the unit table; a name that is not visible is never looked up.
    """
    key = normalise_name(F.col("raw_name"))
    dim = small(units.select(F.col("key").alias("_key"), F.col("tier").alias("_tier"), F.col("type").alias("_type"), F.col("power").alias("_power")))
    joined = rows.join(dim, F.col("name_visible") & (key == F.col("_key")), "left").withColumn("tier", F.coalesce("tier", "_tier")).withColumn("type", F.coalesce("troop_type", "_type"))
    ranked = joined.join(F.broadcast(tiers.select(F.col("tier").alias("_t"), F.col("power").alias("_tier_power"))), F.col("tier") == F.col("_t"), "left")
    each = F.when(F.col("tier").isNotNull(), F.coalesce("_power", "_tier_power"))
    named = F.when(strip(F.col("raw_name")) == "", CUT_OFF).otherwise(F.coalesce("raw_name", F.lit(CUT_OFF)))
    out = ranked.withColumn("key_name", key).withColumn("name", named).withColumn("power_each", each)
    known = F.col("tier").isNotNull() & F.col("power_each").isNotNull()
    return out.withColumn("known", known).withColumn("power_total", (F.coalesce("power_each", F.lit(0)) * F.col("count")).cast("long")).drop("_key", "_tier", "_type", "_power", "_t", "_tier_power", "troop_type")


def summary_columns(known: Column | None = None) -> list[Column]:
    """Aggregates of resolved rows: totals over all, the breakdown over known rows with every tier and class filled."""
    known = F.col("known") if known is None else known
    return [
        total(F.col("count")).alias("total_troops"),
        total(F.col("power_total"), known).alias("total_power"),
        *[total(F.col("count"), known & (F.col("tier") == t)).alias(f"n_{t.lower()}") for t in TIERS],
        *[total(F.col("count"), known & (F.col("type") == t)).alias(f"n_{t.lower()}") for t in TYPES],
        F.coalesce(F.bool_or(~known), F.lit(False)).alias("power_is_partial"),
    ]


def present(df: DataFrame) -> DataFrame:
    """Adds tiers_present and types_present, in the order of the domains."""
    of = lambda names: F.filter(F.array(*[F.when(F.col(f"n_{t.lower()}") != 0, F.lit(t)) for t in names]), lambda x: x.isNotNull())
    return df.withColumn("tiers_present", of(TIERS)).withColumn("types_present", of(TYPES))


def summarise(resolved: DataFrame, key: str = "reading_id") -> DataFrame:
    return present(resolved.groupBy(key).agg(*summary_columns()))


def compact(*notes: Column) -> Column:
    """The array of the notes that are not NULL, in order."""
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def off_by(listed: Column, said: Column, what: str, difference: bool) -> Column:
    tail = F.concat(F.lit(" (off by "), commas(F.abs(listed - said)), F.lit(").")) if difference else F.lit(".")
    return F.concat(F.lit(f"{what} rows add up to "), commas(listed), F.lit(" but the total says "), commas(said), tail)


def check_totals(readings: DataFrame, rows: DataFrame, key: str = "reading_id") -> DataFrame:
    """key and problems: what in the rows contradicts the totals printed beside them."""
    sums = rows.groupBy(key).agg(
        total(F.col("count"), ~F.col("in_ram_zone")).alias("_wounded"), total(F.col("count"), F.col("in_ram_zone")).alias("_ram"), F.count(F.when(F.col("in_ram_zone"), 1)).alias("_n_ram"), F.count("*").alias("_n")
    )
    both = readings.select(key, "wounded_current", "ram_current").join(sums, key, "left").fillna(0, ["_wounded", "_ram", "_n_ram", "_n"])
    return both.select(key, problems_of_totals(F.col("_wounded"), F.col("_ram"), F.col("_n_ram"), F.col("_n")).alias("problems"))


def problems_of_totals(wounded: Column, ram: Column, n_ram: Column, n: Column) -> Column:
    said, zone = F.col("wounded_current"), F.col("ram_current")
    return compact(
        F.when(said.isNull(), "Could not read the 'Severely Wounded Units' total.").when(wounded != said, off_by(wounded, said, "Wounded", True)),
        F.when(zone.isNull(), F.when(n_ram > 0, "Read siege units but no 'Battering Ram Zone' total.")).when(ram > zone, off_by(ram, zone, "Battering Ram Zone", False)),
        F.when((n == 0) & (F.coalesce(said, F.lit(0)) > 0), "No troop rows were read at all."),
    )


def evaluate(readings: DataFrame, rows: DataFrame, units: DataFrame, tiers: DataFrame, key: str = "reading_id") -> tuple[DataFrame, DataFrame]:
    """(evaluated, resolved): readings with their summary, problems and ok; and the resolved rows."""
    zoned = reconcile_zones(classify_zones(rows, units), readings, key)
    resolved = resolve(zoned, units, tiers)
    unknown = ~F.col("known") & (F.col("count") != 0) & ~F.startswith("name", F.lit("("))
    told = F.concat(F.lit("Unknown unit '"), F.col("name"), F.lit("' - not in the unit table, so its power cannot be scored."))
    in_order = lambda x: F.transform(F.sort_array(F.collect_list(x)), lambda s: s["v"])
    sums = resolved.groupBy(key).agg(
        *summary_columns(),
        total(F.col("count"), ~F.col("in_ram_zone")).alias("_wounded"),
        total(F.col("count"), F.col("in_ram_zone")).alias("_ram"),
        F.count(F.when(F.col("in_ram_zone"), 1)).alias("_n_ram"),
        F.count("*").alias("n_rows"),
        in_order(F.when(unknown, F.struct("pos", told.alias("v")))).alias("_unknown"),
        in_order(F.when(~F.col("name_visible"), F.struct("pos", F.col("count").cast("string").alias("v")))).alias("_cut"),
    )
    zero = [c for c in sums.columns if c not in (key, "power_is_partial", "_unknown", "_cut")]
    both = readings.join(sums, key, "left").fillna(0, zero).fillna(False, ["power_is_partial"])
    none = F.array().cast("array<string>")
    cut = F.coalesce("_cut", none)
    hidden = F.concat(F.size(cut).cast("string"), F.lit(" row(s) had the name scrolled out of view (count: "), F.array_join(cut, ", "), F.lit("). Send a screenshot scrolled to the top of the list."))
    problems = F.concat(problems_of_totals(F.col("_wounded"), F.col("_ram"), F.col("_n_ram"), F.col("n_rows")), F.coalesce("_unknown", none), compact(F.when(F.size(cut) > 0, hidden)))
    out = present(both).withColumn("problems", problems).withColumn("ok", F.size("problems") == 0)
    return out.drop("_wounded", "_ram", "_n_ram", "_unknown", "_cut"), resolved


def pass_roster(keys: DataFrame, roster: DataFrame, available: bool = True, key: str = "gid") -> DataFrame:
    """keys with their roster name ('' if none); with a roster at hand, rows whose name is blank are left out."""
    named = keys.join(small(roster.select(F.col("gid").alias("_gid"), F.col("name").alias("_name"))), F.col(key) == F.col("_gid"), "left")
    out = named.withColumn("roster_name", F.coalesce("_name", F.lit(""))).drop("_gid", "_name")
    return out.filter(F.col("roster_name") != "") if available else out.withColumn("roster_name", F.lit(""))


def match_names(lines: DataFrame, units: DataFrame, key: tuple[str, ...] = ("line_id",), text: str = "text") -> DataFrame:
    """key and unit: the longest known name that stands in a line as whole words.

    A name followed by a word that starts with "zone", or led by a word of four letters or more, does not count; only its first place is tried.
    Candidates are equi-joined on the name's first word.
    """
    flat = F.concat(F.lit(" "), flat_text(F.col(text)), F.lit(" "))
    names = units.select(F.col("key").alias("unit"), F.substring_index("key", " ", 1).alias("_first"), (F.size(F.split("key", " "))).alias("_words")).filter("unit <> ''")
    words = lines.select(*key, flat.alias("_flat")).withColumn("_first", F.explode(F.array_distinct(F.split(F.trim("_flat"), " "))))
    at = F.expr("instr(_flat, concat(' ', unit, ' '))")
    joined = words.join(small(names), "_first").withColumn("_at", at).filter("_at > 0")
    after = F.expr("substring(_flat, _at + length(unit) + 2, 4)")
    before = F.expr("element_at(split(trim(substring(_flat, 1, _at)), ' '), -1)")
    ok = joined.filter((after != "zone") & ~((F.char_length(before) >= 4) & before.rlike("^[a-z]+$")))
    return ok.groupBy(*key).agg(F.max_by("unit", F.struct("_words", F.char_length("unit"), F.col("unit"))).alias("unit"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a row number over the order, of which Spark keeps one per task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rss_map() -> Column:
    """The resources of a reading as a map; an unread one is NULL in it."""
    return F.create_map(*[x for r in RESOURCES for x in (F.lit(r), F.col(r))])


def dry_run(readings: DataFrame, rows: DataFrame, units: DataFrame, tiers: DataFrame, grid: DataFrame | None = None, key: str = "reading_id") -> DataFrame:
    """What a reading alone would come to: evaluated, with no roster, no merge and no sink.

    A reading whose total is unread takes the siege counts of the grid reader (key, total, warnings), if there is one.
    """
    out = evaluate(readings, rows, units, tiers, key)[0]
    if grid is None:
        return out
    other = grid.select(key, F.col("total").alias("siege_total"), F.col("warnings").alias("siege_warnings"))
    both = out.join(other, key, "left")
    unread = F.col("wounded_current").isNull()
    return both.withColumn("siege_total", F.when(unread, F.col("siege_total"))).withColumn("siege_warnings", F.when(unread, F.col("siege_warnings")))
