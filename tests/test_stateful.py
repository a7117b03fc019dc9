import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import sessions
from tallymark.operators.reconcile import resolve
from tallymark.sources import dimensions as d
from tallymark.streaming import live, stateful
from tests.test_sessions_sink import READING, ROW, T0, reading


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in stateful.PROVIDER}
    for k, v in stateful.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def with_rows(spark, readings, rows):
    raw = spark.createDataFrame([(i, p, n, c, True, n == "Battering Ram", None, None) for i, items in rows.items() for p, (n, c) in enumerate(items)], ROW)
    resolved = resolve(raw, d.units(spark), d.tiers(spark))
    names = ["key_name", *stateful._NAMES]
    per = resolved.groupBy("reading_id").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("l")).select("reading_id", F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in names])).cast(stateful.ROWS).alias("rows"))
    return spark.createDataFrame(readings, READING).join(per, "reading_id", "left"), resolved


def run(spark, frames, orders, path, delay="1 day", rules=d.Rules()):
    """One micro-batch for each frame, with the orders beside the last."""
    frames[0].limit(0).write.parquet(f"{path}/in/0")
    orders.limit(0).write.parquet(f"{path}/orders/0")
    for k, f in enumerate(frames, 1):
        f.coalesce(1).write.parquet(f"{path}/in/{k}")
        if k == len(frames):
            orders.coalesce(1).write.parquet(f"{path}/orders/{k}")
        source = lambda name, df: spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
        out = stateful.run_sessions(source("in", f), source("orders", orders), rules, delay)
        q = live.write_each(out, lambda df, n: df.write.mode("append").parquet(f"{path}/out"), f"{path}/ck", once=True)
        q.awaitTermination(120)
    return spark.read.parquet(f"{path}/out").collect()


def order(spark, *rows):
    return spark.createDataFrame([(g, T0 + dt.timedelta(minutes=m), s) for g, m, s in rows], "gid string, event_ts timestamp, seq long")


def test_closing_by_hand_equals_batch_and_status_is_read_from_state(rocks, tmp_path):
    r = random.Random(3)
    readings, rows = [], {}
    for i in range(60):
        readings.append(reading(i, str(r.randint(1, 6)), r.randint(0, 300), r.choice([None, 1000, 2000]), None, url="x", warnings=["w"] * (i % 2), user=f"u{i}"))
        rows[i] = [(n, r.choice([5, 10])) for n in r.sample(["Knight", "Archer", "Battering Ram", "Nobody"], r.randint(0, 3))]
    frame, resolved = with_rows(rocks, readings, rows)
    keys = ["1", "2", "9"]
    got = run(rocks, [frame], order(rocks, *[(k, 301, 1000 + i) for i, k in enumerate(keys)]), tmp_path)
    now = F.lit(T0 + dt.timedelta(minutes=301))
    batch = sessions.gap_sessions(frame.drop("rows"))
    subs, listed = sessions.merge(batch, resolved)
    closed, missing = sessions.closed_by_hand(subs, rocks.createDataFrame([(k,) for k in keys], "gid string"), now)
    fields = ("session", "wounded_current", "epoch", "user_name", "image_urls", "notes", "merge_notes", "sources", "listed")
    want = {x.gid: tuple(x[c] for c in fields) for x in closed.collect()}
    have = {x.gid: tuple(x[c] for c in fields) for x in got if x.reason == "hand"}
    assert have == want
    assert {x.gid for x in got if x.event == "missing"} == {x.gid for x in missing.collect()}
    units = {(x.gid, x.key_name, x["count"], x.tier) for x in listed.join(closed.select("gid", "session"), ["gid", "session"]).collect()}
    assert {(x.gid, y.key_name, y["count"], y.tier) for x in got if x.reason == "hand" for y in x.rows} == units
    # every session of the batch ended or is open, with the same last state
    ends = {(x.gid, x.session): (x.wounded_current, x.listed, x.siege) for x in got if x.event == "closed"}
    left = {x.gid: (x.wounded_current, x.listed, x.siege) for x in stateful.open_sessions(rocks, str(tmp_path / "ck")).collect()}
    every = {(x.gid, x.session): (x.wounded_current, x.listed, x.siege) for x in subs.collect()}
    last = {g: max(s for a, s in every if a == g) for g, _ in every}
    assert ends == {k: v for k, v in every.items() if last[k[0]] != k[1] or k[0] not in left}
    assert left == {g: every[g, last[g]] for g in left} and set(left) == {g for g in last if g not in want}
    held = {(x.gid, x.key_name) for x in stateful.open_rows(rocks, str(tmp_path / "ck")).collect()}
    assert held == {(x.gid, x.key_name) for x in listed.collect() if x.gid in left and x.session == last[x.gid]}


def test_timers_and_completeness_end_sessions(rocks, tmp_path):
    first, _ = with_rows(rocks, [reading(0, "1", 0, 15), reading(1, "2", 0, 99), reading(2, "3", 1, 250_000)], {0: [("Knight", 15)], 1: [("Knight", 9)]})
    later, _ = with_rows(rocks, [reading(3, "1", 5, 15), reading(4, "4", 200, 7)], {3: [("Knight", 4)]})
    last, _ = with_rows(rocks, [reading(5, "4", 201, 7)], {})
    got = run(rocks, [first, later, last], order(rocks, ("2", 202, 9)), tmp_path, delay="1 minute")
    ends = {(x.gid, x.session): x.reason for x in got if x.event == "closed"}
    assert ends == {("1", 0): "complete", ("2", 0): "timeout", ("3", 0): "big enough", ("1", 1): "timeout"}
    assert [x.gid for x in got if x.event == "missing"] == ["2"]
    assert {(x.gid, x.n_readings) for x in stateful.open_sessions(rocks, str(tmp_path / "ck")).collect()} == {("4", 2)}
