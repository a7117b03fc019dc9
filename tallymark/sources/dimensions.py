"""Small dimension tables: units, tiers and rules, and the roster. All are of fixed or counted size."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.text import normalise_name, strip

# Ordered domains, power of a tier, the tiers and the minimum of the fill rule, and the siege limits.
TIERS = ("T1", "T2", "T3", "T4", "T5")
TYPES = ("Infantry", "Archer", "Cavalry", "Siege")
RESOURCES = ("food", "wood", "stone", "gold")
TIER_POWER = {"T1": 1, "T2": 2, "T3": 3, "T4": 4, "T5": 10}
HIGH_TIERS = ("T4", "T5")
MIN_HIGH = 100_000
BIG_ENOUGH = 200_000
SIEGE_ZERO = ("T2", "T3")
SIEGE_CAPS = {"T1": 200_000, "T4": 75_000}
GLYPH_SCORE, GLYPH_MARGIN = 0.66, 0.08

# The known units by tier and type.
UNITS = {
    "militia": ("T1", "Infantry"), "spearman": ("T2", "Infantry"), "long swordsman": ("T4", "Infantry"), "sword warrior": ("T4", "Infantry"), "teutonic knight": ("T4", "Cavalry"),
    "legionary": ("T4", "Infantry"), "man-at-arms": ("T4", "Infantry"), "samurai": ("T4", "Infantry"), "hoplite": ("T4", "Infantry"), "landsknecht": ("T5", "Infantry"),
    "imperial guard": ("T5", "Infantry"), "slinger": ("T1", "Archer"), "archer": ("T2", "Archer"), "crossbowman": ("T4", "Archer"), "longbowman": ("T4", "Archer"),
    "chu ko nu": ("T4", "Archer"), "onna-musha": ("T4", "Archer"), "hwarang": ("T4", "Archer"), "musketeer": ("T5", "Archer"), "scout": ("T1", "Cavalry"),
    "light cavalry": ("T2", "Cavalry"), "heavy cavalry": ("T3", "Cavalry"), "cataphract": ("T4", "Cavalry"), "knight": ("T4", "Cavalry"), "conquistador": ("T4", "Cavalry"),
    "keshig": ("T4", "Cavalry"), "cuirassier": ("T5", "Cavalry"), "battering ram": ("T1", "Siege"), "catapult": ("T2", "Siege"), "trebuchet": ("T3", "Siege"),
    "onager": ("T4", "Siege"), "bombard": ("T5", "Siege"), "royal crossbowman": ("T5", "Archer"), "mamluk": ("T4", "Cavalry"),
}

UNIT_SCHEMA = "key string, tier string, type string, power long"


@dataclass(frozen=True)
class Rules:
    """What the verdicts depend on."""

    high_tiers: tuple[str, ...] = HIGH_TIERS
    min_high: int = MIN_HIGH
    big_enough: int = BIG_ENOUGH
    session_minutes: int = 30


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, TIER_POWER[t], i, t in HIGH_TIERS) for i, t in enumerate(TIERS)], "tier string, power long, ordinal int, is_high boolean")


def units(spark: SparkSession) -> DataFrame:
    """The unit table, keyed by the normalised name."""
    raw = spark.createDataFrame([(i, n, t, c) for i, (n, (t, c)) in enumerate(UNITS.items())], "pos int, name string, tier string, type string")
    return keyed_units(raw.withColumn("power", F.lit(None).cast("long")))


def keyed_units(raw: DataFrame) -> DataFrame:
    """(key, tier, type, power) of a table with pos, name, tier, type and power; the later of equal keys stands."""
    last = raw.withColumn("key", normalise_name(F.col("name"))).groupBy("key").agg(F.max_by(F.struct("tier", "type", "power"), "pos").alias("v"))
    return last.select("key", "v.*")


def small(dimension: DataFrame, rows: int = 200_000, size: int = 64 << 20) -> DataFrame:
    """A dimension marked for broadcast if it has at most so many rows, by counting up to one more, and they take at most
    `size` bytes as text; as it is otherwise."""
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dimension.columns])))
    found = dimension.limit(rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("size")).first()
    return F.broadcast(dimension) if found["rows"] <= rows and found["size"] <= size else dimension


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """A unit table from a JSON file {"units": {name: {tier, type, power?}}}."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "units map<string, struct<tier: string, type: string, power: long>>").alias("j"))
    return keyed_units(text.select(F.posexplode("j.units").alias("pos", "name", "v")).select("pos", "name", "v.*"))


def learn(units_table: DataFrame, learned: DataFrame) -> DataFrame:
    """The unit table after entries (pos, name, tier, type, power) replaced whole entries under their normalised keys.

    Entries whose tier or type is outside its domain are not taken: see `rejected`.
    """
    new = keyed_units(_tidy(learned).filter("reason IS NULL").drop("reason"))
    return units_table.join(small(new.select("key")), "key", "left_anti").unionByName(new)


def rejected(learned: DataFrame) -> DataFrame:
    """The entries that `learn` does not take, with a reason."""
    return _tidy(learned).filter("reason IS NOT NULL")


def _tidy(learned: DataFrame) -> DataFrame:
    tidy = learned.withColumn("tier", F.upper(strip(F.col("tier")))).withColumn("type", F.initcap(strip(F.col("type"))))
    key = normalise_name(F.col("name"))
    reason = F.when(key == "", "no name").when(~F.col("tier").isin(*TIERS), "unknown tier").when(~F.col("type").isin(*TYPES), "unknown type")
    return tidy.withColumn("reason", reason)


def roster(grid: DataFrame) -> DataFrame:
    """(gid, name) from a raw grid (pos int, cells array<string>).

    The header is the first of the first five rows with a column named like an id and one named like a name; without one,
    ids are in column 1 and names in column 2 from the first row on. Ids are all digits once commas go; short rows drop;
    the later of repeated ids stands.
    """
    low = F.transform("cells", lambda c: strip(F.lower(c)))
    at = lambda *names: F.coalesce(F.array_min(F.filter(F.array(*[F.array_position(low, n) for n in names]), lambda p: p > 0)), F.lit(0))
    head = grid.filter("pos < 5").select("pos", at("id", "governor id", "governorid").alias("id_at"), at("name", "governor name", "governor").alias("name_at"))
    head = head.filter("id_at > 0 AND name_at > 0").agg(F.min(F.struct("pos", "id_at", "name_at")).alias("h"))
    one = grid.crossJoin(F.broadcast(head))  # head is one row
    ids, names = F.coalesce("h.id_at", F.lit(1)).cast("int"), F.coalesce("h.name_at", F.lit(2)).cast("int")
    rows = one.filter(F.col("pos") > F.coalesce("h.pos", F.lit(-1))).filter(F.size("cells") >= F.greatest(ids, names))
    rows = rows.select("pos", F.replace(strip(F.element_at("cells", ids)), F.lit(","), F.lit("")).alias("gid"), strip(F.element_at("cells", names)).alias("name"))
    return rows.filter(F.col("gid").rlike("^[0-9]+$")).groupBy("gid").agg(F.max_by("name", "pos").alias("name"))


GLYPH = "class string, bits array<bigint>"


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """(class, bits) from a JSON file {"templates": {class: [32 lines of 32 "#" and "."]}}; a missing file is an empty table."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], GLYPH)
    raw = text.select(F.from_json("value", "templates map<string, array<array<string>>>").alias("j")).select(F.explode("j.templates").alias("class", "p")).select("class", F.explode("p").alias("lines"))
    flat = F.array_join("lines", "")
    bit = lambda k: lambda acc, j: acc.bitwiseOR(F.when(F.substring(flat, k * 64 + j + 1, F.lit(1)) == "#", F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    word = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit(k))
    return raw.select("class", F.transform(F.sequence(F.lit(0), F.lit(15)), word).alias("bits"))


def add_glyphs(templates: DataFrame, learned: DataFrame) -> DataFrame:
    """The templates with those of labelled glyphs (class, bits) that are new."""
    return templates.select("class", "bits").union(learned.filter("class IS NOT NULL AND bits IS NOT NULL").select("class", "bits")).distinct()


def write_glyphs(templates: DataFrame, path: str) -> None:
    """Write the templates as one JSON line per class, 32 lines of text to a template."""
    at = lambda y, x: F.get("bits", F.lit((y * 32 + x) // 64)).bitwiseAND(F.lit((1 << ((y * 32 + x) % 64)) - (1 << 64 if (y * 32 + x) % 64 == 63 else 0)))
    line = lambda y: F.concat(*[F.when(at(y, x) != 0, "#").otherwise(".") for x in range(32)])
    drawn = templates.select("class", F.array(*[line(y) for y in range(32)]).alias("lines"))
    # a table of fixed size, so one file
    whole = drawn.groupBy("class").agg(F.sort_array(F.collect_list("lines")).alias("p")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "p")))).alias("templates"))
    whole.select(F.to_json(F.struct("templates")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def sheet_grid(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cells): all rows of a small CSV sheet as strings, in order, each as wide as it is; a blank line has no cells.

    Quoted cells may hold commas, quotes and line ends. A sheet is one file, which one task reads.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline="")))
                yield pd.DataFrame({"pos": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "pos int, cells array<string>")
