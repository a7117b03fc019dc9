"""Changes to the output tables, as plans, and a store that applies them.

Parquet tables have no MERGE, so a change is a new version of the table: an anti-join of what goes and a union of what
comes. The small side of each anti-join is the set of changed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions.text import archive_name, cell, strip
from tallymark.sources.dimensions import Rules

KEY = "Governor ID"
# The fields that may be edited, and those of them that are numbers.
EDITABLE = ("Name", "Total In Hospital", "T4+T5 Troops", "Food", "Wood", "Stone", "Gold", "Fill Check", "Notes")
NUMERIC = ("Total In Hospital", "T4+T5 Troops", "Food", "Wood", "Stone", "Gold")


def _same(a: str, b: str) -> Column:
    return strip(F.col(a)) == strip(F.col(b))


def upsert(target: DataFrame, source: DataFrame, key: str = KEY) -> DataFrame:
    """target with the rows of source in place of those of the same key (keys are trimmed).

    A key that source has more than once is an error, as nothing says which of its rows stands; rows without a key are added.
    """
    trimmed = strip(F.col(f"`{key}`"))
    times = F.count(trimmed).over(Window.partitionBy(trimmed))
    once = F.when(times > 1, F.raise_error(F.concat(F.lit("key more than once: "), trimmed))).otherwise(True)
    new = source.withColumn("_once", once).filter("_once").drop("_once")
    keys = source.select(F.col(f"`{key}`").alias("_k"))
    return target.join(keys, _same(f"`{key}`", "_k"), "left_anti").unionByName(new)


def replace_children(target: DataFrame, keys: DataFrame, children: DataFrame, key: str = KEY) -> DataFrame:
    """target without the rows of any of keys, with the children; a key without children loses its rows."""
    gone = keys.select(F.col(f"`{key}`").alias("_k")).distinct()
    return target.join(gone, _same(f"`{key}`", "_k"), "left_anti").unionByName(children)


def remove(target: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    gone = keys.select(F.col(f"`{key}`").alias("_k")).distinct()
    return target.join(gone, _same(f"`{key}`", "_k"), "left_anti")


def removed(target: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """The rows that `remove` takes."""
    gone = keys.select(F.col(f"`{key}`").alias("_k")).distinct()
    return target.join(gone, _same(f"`{key}`", "_k"), "left_semi")


def cleared(target: DataFrame) -> DataFrame:
    return target.limit(0)


def edit_errors(target: DataFrame, edits: DataFrame, key: str = KEY) -> DataFrame:
    """The edits (key, field, value, editor) that cannot be made, with a reason."""
    known = target.select(F.col(f"`{key}`").alias("_k")).distinct()
    joined = edits.join(known, _same(f"`{key}`", "_k"), "left")
    reason = (
        F.when(~F.col("field").isin(*EDITABLE), F.concat(F.col("field"), F.lit(" is not editable.")))
        .when(F.col("field").isin(*NUMERIC) & _number(F.col("value")).isNull(), F.concat(F.col("field"), F.lit(" needs a number, got '"), F.col("value"), F.lit("'.")))
        .when(F.col("_k").isNull(), F.concat(F.lit("No row for governor "), F.col(f"`{key}`"), F.lit(".")))
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").drop("_k")


def _number(x: Column) -> Column:
    value = F.regexp_replace(x, r"[,\s]", "").try_cast("double")
    return F.when(F.abs(value) < 9.2e18, value.cast("long"))


def edit(target: DataFrame, edits: DataFrame, now: Column, rules: Rules = Rules(), key: str = KEY) -> DataFrame:
    """target after one edit (key, field, value, editor) per key; wrong edits change nothing.

    An edited count of high-tier troops decides the fill check anew, by two values. Notes gain a trail of what was
    edited, by whom and when, within 1000 characters, unless the notes are what was edited.
    """
    good = edits.join(edit_errors(target, edits, key).select(F.col(f"`{key}`").alias("_bad"), F.col("field").alias("_f")), (F.col(f"`{key}`") == F.col("_bad")) & (F.col("field") == F.col("_f")), "left_anti")
    e = good.select(F.col(f"`{key}`").alias("_k"), F.col("field").alias("_field"), F.when(F.col("field").isin(*NUMERIC), _number(F.col("value")).cast("string")).otherwise(F.col("value")).alias("_value"), F.col("editor").alias("_editor"))
    both = target.join(e, _same(f"`{key}`", "_k"), "left")
    hit = F.col("_field").isNotNull()
    before = F.coalesce(*[F.when(F.col("_field") == c, F.nullif(F.col(f"`{c}`"), F.lit(""))) for c in EDITABLE], F.lit("(blank)"))
    seen, recount = F.col("_value").try_cast("long"), F.col("_field") == "T4+T5 Troops"
    verdict = F.when(seen >= rules.min_high, "Pass").otherwise("FAIL")
    by = F.coalesce(F.nullif(F.col("_editor"), F.lit("")), F.lit("an admin"))
    tiers = " or ".join(rules.high_tiers)
    reason = F.concat(F.format_number(seen, 0), F.lit(f" {tiers} troops (set by "), by, F.lit("), "), F.when(verdict == "Pass", "at or above").otherwise("below"), F.lit(f" the {rules.min_high:,} required."))
    told = F.concat(F.col("_field"), F.lit(": "), before, F.lit(" -> "), F.col("_value"), F.when(recount, F.concat(F.lit("; fill check recomputed to "), verdict)).otherwise(""))
    trail = F.concat(F.lit("edited by "), F.coalesce(F.nullif(F.col("_editor"), F.lit("")), F.lit("admin")), F.lit(" "), F.date_format(now, "yyyy-MM-dd HH:mm"), F.lit(": "), told)
    notes = cell(F.substring(F.regexp_replace(F.concat(F.coalesce("Notes", F.lit("")), F.lit(" | "), trail), r"^[ |]+|[ |]+$", ""), 1, 1000))
    out = both.withColumn("_notes", F.when(hit & (F.col("_field") != "Notes"), notes).otherwise(F.col("Notes")))
    out = out.withColumn("_check", F.when(recount, verdict)).withColumn("_reason", F.when(recount, cell(reason)))
    for c in EDITABLE:
        base = F.col("_notes") if c == "Notes" else F.col(f"`{c}`")
        out = out.withColumn(c, F.when(F.col("_field") == c, cell(F.col("_value"))).otherwise(base))
    out = out.withColumn("Fill Check", F.coalesce("_check", F.col("`Fill Check`"))).withColumn("Fill Note", F.coalesce("_reason", F.col("`Fill Note`")))
    return out.select(*[F.col(f"`{c}`") for c in target.columns])


class Store:
    """A table kept as numbered versions in a folder; the highest finished one is current.

    A version is written beside those that plans may still read, so a change can read the table that it replaces, and a
    write that fails leaves the current version as it is. `keep` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...], keep: int = 2) -> None:
        self.spark, self.path, self.columns, self.keep = spark, path.rstrip("/"), columns, keep

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self) -> list[int]:
        jvm, fs, root = self._fs()
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """The current version; an empty table if there is none yet."""
        schema = ", ".join(f"`{c}` string" for c in self.columns)
        have = self.versions()
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{have[-1]}") if have else self.spark.createDataFrame([], schema)

    def write(self, table: DataFrame) -> int:
        have = self.versions()
        number = (have[-1] if have else 0) + 1
        table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in self.columns]).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        jvm, fs, _ = self._fs()
        for old in have[: max(0, len(have) + 1 - self.keep)]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)
        return number

    def count(self) -> int:
        return self.read().count()


def write_submission(facts: Store, children: Store, records: DataFrame, rows: DataFrame, roster: DataFrame | None = None, key: str = KEY) -> None:
    """Upsert the records and replace their rows. A record without a name takes the roster's (gid, name)."""
    if roster is not None:
        named = records.join(roster.select(F.col("gid").alias("_g"), F.col("name").alias("_n")), _same(f"`{key}`", "_g"), "left")
        records = named.withColumn("Name", F.when(F.coalesce("Name", F.lit("")) == "", F.coalesce("_n", F.lit(""))).otherwise(F.col("Name"))).select(*[F.col(f"`{c}`") for c in records.columns])
    facts.write(upsert(facts.read(), records, key))
    children.write(replace_children(children.read(), records.select(F.col(f"`{key}`")), rows, key))


def archive(images: DataFrame, path: str) -> bool:
    """Keep raw images (ts, gid, suffix, content) under their archive names, by day; whether that worked: a failure is no
    reason to lose the reading."""
    named = images.select(archive_name(F.col("ts"), F.col("gid"), F.col("suffix")).alias("file"), F.to_date("ts").alias("day"), "content")
    try:
        named.write.mode("append").partitionBy("day").parquet(path)
    except Exception:
        return False
    return True


def mirror(outcomes: DataFrame, path: str) -> None:
    """Append every outcome (key, outcome, detail) to an audit table, stamped: the second output of a batch."""
    outcomes.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
