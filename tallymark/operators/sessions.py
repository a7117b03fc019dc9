"""Merging a key's readings over time, in batch.

A reading belongs to the key's open session unless more than the timeout has passed since the one before (exactly the
timeout keeps it open). Within a session a changed total starts a new epoch whose rows replace the old; of each unit the
latest row counts; scalars take the last value that was read. Windows and aggregations over (key, time, sequence) do all
of that. Closing a session early depends on what has been merged so far, so `closing_sessions` folds over the readings
between two gaps instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.sources.dimensions import RESOURCES, Rules

from .reconcile import latest, present, summary_columns
from .rules import judge, state_columns

SCALARS = ("wounded_current", "wounded_capacity", "ram_current", "ram_capacity", "food", "wood", "stone", "gold")
ORDER = ("event_ts", "seq")


def gap_sessions(readings: DataFrame, key: str = "gid", minutes: int = 30, ts: str = "event_ts", seq: str = "seq") -> DataFrame:
    """Adds session, from 0 per key. The gap is strict, and exact to the microsecond."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    new = F.coalesce((gap > minutes * 60_000_000).cast("int"), F.lit(0))
    return readings.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def epochs(readings: DataFrame, key: list[str], total: str = "wounded_current", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds previous (the last total read before), changed and epoch, from 0 per key."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = readings.withColumn("previous", F.last(total, ignorenulls=True).over(before))
    out = out.withColumn("changed", F.coalesce(F.col(total) != F.col("previous"), F.lit(False)))
    return out.withColumn("epoch", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def last_read(name: str, order: tuple[str, ...] = ORDER) -> Column:
    """The last value of a column that is not NULL."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*order))).alias(name)


def merge(readings: DataFrame, resolved: DataFrame, rules: Rules = Rules(), key: str = "gid") -> tuple[DataFrame, DataFrame]:
    """(submissions, rows): per key and session the judged submission and its merged rows.

    readings: key, session, event_ts, seq, reading_id, user_name, image_url, message_url, source, warnings, rss_approx,
    expected_resources and the scalars; resolved: the resolved rows by reading_id.
    """
    by = [key, "session"]
    dated = epochs(readings, by)
    scalars = [last_read(c) for c in SCALARS]
    in_order = lambda c, keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(*ORDER, F.col(c).alias("v"))))), lambda s: s["v"])
    url = lambda c: in_order(c, F.coalesce(F.col(c), F.lit("")) != "").alias(c + "s")
    told = F.concat(F.lit("Hospital total changed ("), F.format_number("previous", 0), F.lit(" -> "), F.format_number("wounded_current", 0), F.lit("); earlier screenshots discarded."))
    asks = F.size(F.coalesce("expected_resources", F.array().cast("array<string>"))) > 0
    # what is still unread at the last reading that asks for something, whatever later ones read
    so_far = Window.partitionBy(*by).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    for c in RESOURCES:
        dated = dated.withColumn(f"_{c}", F.last(c, ignorenulls=True).over(so_far))
    lacking = F.exists(F.coalesce("expected_resources", F.array().cast("array<string>")), lambda r: F.coalesce(*[F.when(r == c, F.col(f"_{c}").isNull()) for c in RESOURCES], F.lit(False)))
    dated = dated.withColumn("_lacking", lacking)
    heads = dated.withColumn("_told", F.when(F.col("changed"), told)).groupBy(*by).agg(
        *scalars,
        F.max("epoch").alias("epoch"),
        F.bool_or("rss_approx").alias("rss_approx"),
        F.max_by("user_name", F.struct(*ORDER)).alias("user_name"),
        F.max("event_ts").alias("updated_at"),
        F.min("event_ts").alias("created_at"),
        F.coalesce(F.max_by("_lacking", F.when(asks, F.struct(*ORDER))), F.lit(False)).alias("cost_incomplete"),
        url("image_url"), url("message_url"),
        in_order("source", F.lit(True)).alias("sources"),
        F.flatten(in_order("warnings", F.col("warnings").isNotNull())).alias("notes"),
        in_order("_told", F.col("_told").isNotNull()).alias("merge_notes"),
    )
    of = dated.select(*by, "epoch", "reading_id", *ORDER).join(heads.select(*by, "epoch"), [*by, "epoch"], "left_semi")
    kept = resolved.filter((F.col("count") > 0) & ~F.startswith("name", F.lit("("))).join(of, "reading_id")
    rows = latest(kept, [*by, "key_name"], [*ORDER, "pos"])
    sums = rows.groupBy(*by).agg(*summary_columns(), *state_columns(rules))
    none = F.array().cast("array<string>")
    numbers = [c for c, t in sums.dtypes if t == "bigint"]
    full = heads.join(sums, by, "left").fillna(0, numbers).fillna(False, ["power_is_partial"])
    full = present(full.withColumn("unknown_tier_names", F.coalesce("unknown_tier_names", none)).withColumn("unknown_names", F.coalesce("unknown_names", none)))
    return judge(full, rules), rows


def closing_sessions(readings: DataFrame, key: str = "gid", rules: Rules = Rules()) -> DataFrame:
    """Adds session to readings that carry `rows` (array of key_name, name if any, count, known, in_ram_zone): as
    gap_sessions, but a session also ends after the reading with which it is complete or big enough. Rows without a count
    or with a name in brackets don't count, as in `merge`.

    A gap opens a session whatever came before, so the fold runs inside each session of `gap_sessions` and holds that one's
    readings only. It says for each of them whether it opens a session; a running count numbers them.
    """
    fields = readings.schema["rows"].dataType.elementType.names
    counts = lambda y: (y["count"] > 0) & ~(F.startswith(y["name"], F.lit("(")) if "name" in fields else F.lit(False))
    only = lambda y: F.struct(*[y[c].alias(c) for c in ("key_name", "count", "known", "in_ram_zone")])
    place = Window.partitionBy(key, "_gap").orderBy("event_ts", "seq", "reading_id")
    gaps = gap_sessions(readings, key, rules.session_minutes).withColumnRenamed("session", "_gap").withColumn("_at", F.row_number().over(place))
    item = F.struct("_at", F.col("wounded_current").alias("w"), F.col("ram_current").alias("r"), F.transform(F.filter("rows", counts), only).alias("rows"))
    per = gaps.groupBy(key, "_gap").agg(F.sort_array(F.collect_list(item)).alias("_l"))
    row = "array<struct<key_name:string,count:bigint,known:boolean,in_ram_zone:boolean>>"
    empty = F.expr(f"cast(array() as {row})")
    null = F.lit(None).cast("long")
    state = F.struct(F.lit(False).alias("open"), null.alias("w"), null.alias("r"), empty.alias("rows"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        goes_on = s["open"]
        old_w, old_r = F.when(goes_on, s["w"]), F.when(goes_on, s["r"])
        changed = F.coalesce(x["w"] != old_w, F.lit(False))
        before = F.when(goes_on & ~changed, s["rows"]).otherwise(empty)
        names = F.transform(x["rows"], lambda y: y["key_name"])
        rows = F.concat(F.filter(before, lambda y: ~F.array_contains(names, y["key_name"])), x["rows"])
        w, r = F.coalesce(x["w"], old_w), F.coalesce(x["r"], old_r)
        add = lambda zone: F.aggregate(rows, F.lit(0).cast("long"), lambda a, y: a + F.when(y["in_ram_zone"] == zone, y["count"]).otherwise(0))
        done = w.isNotNull() & ((w >= rules.big_enough) | ((add(False) == w) & (r.isNull() | (add(True) <= r)) & F.forall(rows, lambda y: y["known"])))
        return F.struct(
            (~F.coalesce(done, F.lit(False))).alias("open"), w.alias("w"), r.alias("r"), rows.alias("rows"),
            F.when(goes_on, s["out"]).otherwise(F.concat(s["out"], F.array(x["_at"]))).alias("out"),
        )

    opens = per.select(key, "_gap", F.explode(F.aggregate("_l", state, step, lambda s: s["out"])).alias("_at")).withColumn("_new", F.lit(1))
    w = Window.partitionBy(key).orderBy("event_ts", "seq", "reading_id").rowsBetween(Window.unboundedPreceding, 0)
    return gaps.join(opens, [key, "_gap", "_at"], "left").withColumn("session", (F.count("_new").over(w) - 1).cast("int")).drop("_new", "_gap", "_at")


def open_keys(submissions: DataFrame, now: Column, minutes: int = 30, key: str = "gid") -> DataFrame:
    """Keys whose last session is still open at a time."""
    last = submissions.groupBy(key).agg(F.max("updated_at").alias("updated_at"))
    return last.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp")) <= minutes * 60_000_000).select(key)


def closed_by_hand(submissions: DataFrame, keys: DataFrame, now: Column, minutes: int = 30, key: str = "gid") -> tuple[DataFrame, DataFrame]:
    """(closed, missing): the last submissions of those of keys that are open, and the keys that have none open."""
    opened = open_keys(submissions, now, minutes, key)
    last = latest(submissions, [key], ["updated_at", "session"])
    return last.join(keys.join(opened, key, "left_semi"), key, "left_semi"), keys.join(opened, key, "left_anti")


def status(submissions: DataFrame, now: Column, minutes: int = 30, key: str = "gid") -> DataFrame:
    """The open submissions: key, status, verdict, what is missing and the minutes left before they close."""
    opened = latest(submissions, [key], ["updated_at", "session"]).join(open_keys(submissions, now, minutes, key), key, "left_semi")
    left = minutes - F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 60_000_000)
    return opened.select(key, "session", "status", "verdict", "missing", left.cast("int").alias("minutes_left"))
