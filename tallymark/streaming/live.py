"""Live sessions with Structured Streaming.

Readings (with their resolved rows as an array) are grouped by key; the open session of a key is its state. A session
ends when event time passes its last reading by more than the timeout, or once a reading makes it complete or big enough.
Every reading puts out the merged submission, so a sink can upsert it. State is checkpointed; readings later than the
watermark are dropped by it. The batch operators give the same sessions from the same readings in order.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymark.operators.sessions import SCALARS
from tallymark.sources.dimensions import Rules

ROWS = "array<struct<key_name:string,name:string,count:bigint,known:boolean,in_ram_zone:boolean>>"
TOLD = "user_name string, image_urls array<string>, message_urls array<string>, sources array<string>, notes array<string>, rss_approx boolean, cost_incomplete boolean"
OUT = "gid string, session_start timestamp, event_ts timestamp, seq long, epoch int, " + ", ".join(f"{c} long" for c in SCALARS) + ", listed long, siege long, n_rows int, complete boolean, closed boolean, " + TOLD


KEPT = tuple(x.split()[0] for x in TOLD.split(", "))


def merge_into(state: dict, reading: dict, rules: Rules) -> dict:
    """The session's state after a reading (both plain dictionaries)."""
    total = reading["wounded_current"]
    if total is not None and state["scalars"]["wounded_current"] not in (None, total):
        state["rows"], state["epoch"] = {}, state["epoch"] + 1
    for row in reading["rows"]:
        if row["count"] > 0 and not row["name"].startswith("("):
            state["rows"][row["key_name"]] = row
    for c in SCALARS:
        if reading[c] is not None:
            state["scalars"][c] = reading[c]
    expected = list(reading.get("expected_resources") or [])
    if expected:
        state["cost_incomplete"] = any(state["scalars"].get(c) is None for c in expected)
    state["rss_approx"] = state["rss_approx"] or bool(reading.get("rss_approx"))
    state["user_name"] = reading.get("user_name")
    for many, one in (("image_urls", "image_url"), ("message_urls", "message_url")):
        state[many] += [reading[one]] if reading.get(one) else []
    state["sources"] += [reading["source"]] if reading.get("source") else []
    state["notes"] += list(reading.get("warnings") or [])
    sums = {zone: sum(r["count"] for r in state["rows"].values() if r["in_ram_zone"] == zone) for zone in (False, True)}
    wounded, ram = state["scalars"]["wounded_current"], state["scalars"]["ram_current"]
    fits = wounded is not None and sums[False] == wounded and (ram is None or sums[True] <= ram)
    state["complete"] = fits and all(r["known"] for r in state["rows"].values())
    state["closed"] = wounded is not None and (state["complete"] or wounded >= rules.big_enough)
    state["listed"], state["siege"] = sums[False], sums[True]
    return state


def _new(start: str) -> dict:
    return {"start": start, "epoch": 0, "rows": {}, "scalars": dict.fromkeys(SCALARS), "updated": None, "closed": False, "user_name": None, "image_urls": [], "message_urls": [], "sources": [], "notes": [], "rss_approx": False, "cost_incomplete": False}


def live_sessions(readings: DataFrame, rules: Rules = Rules(), delay: str = "1 day") -> DataFrame:
    """A row for every reading: the submission as merged so far. readings: gid, event_ts (timestamp), seq, rows, scalars
    and, if there are such columns, user_name, image_url, message_url, source, warnings, rss_approx, expected_resources."""
    limit = rules.session_minutes * 60

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else None
        todo = pd.concat(list(frames)).sort_values(["event_ts", "seq"], kind="stable")
        out = []
        for r in todo.to_dict("records"):
            at = r["event_ts"].value / 1e9
            if state is None or state["closed"] or at - state["updated"] > limit:
                state = _new(r["event_ts"].isoformat())
            plain = {c: None if pd.isna(r[c]) else int(r[c]) for c in SCALARS}
            rows = [{"key_name": x["key_name"], "name": x["name"], "count": int(x["count"]), "known": bool(x["known"]), "in_ram_zone": bool(x["in_ram_zone"])} for x in (r["rows"] if r["rows"] is not None else [])]
            told = {c: v.tolist() if hasattr(v := r.get(c), "tolist") else v for c in ("user_name", "image_url", "message_url", "source", "warnings", "rss_approx", "expected_resources")}
            state = merge_into(state, {**plain, **{c: None if isinstance(v, float) else v for c, v in told.items()}, "rows": rows}, rules)
            state["updated"] = at
            out.append((key[0], pd.Timestamp(state["start"]), r["event_ts"], r["seq"], state["epoch"], *(state["scalars"][c] for c in SCALARS), state["listed"], state["siege"], len(state["rows"]), state["complete"], state["closed"], *(list(v) if isinstance(v := state[c], list) else v for c in KEPT)))
        held.update((json.dumps(state),))
        held.setTimeoutTimestamp(max(int(state["updated"] + limit) * 1000 + 1000, held.getCurrentWatermarkMs() + 1))
        names = ["gid", "session_start", "event_ts", "seq", "epoch", *SCALARS, "listed", "siege", "n_rows", "complete", "closed", *KEPT]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({c: "Int64" for c in SCALARS})

    watched = readings.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", delay)
    return watched.groupBy("gid").applyInPandasWithState(update, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def write_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the stream with apply(batch, id) as its sink; a batch that is run again has the same id."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def newest(batch: DataFrame) -> DataFrame:
    """The last row of each key in a batch, for an upsert."""
    whole = F.struct(*batch.columns)
    return batch.groupBy("gid").agg(F.max_by(whole, F.struct("event_ts", "seq")).alias("_v")).select("_v.*")


def guarded(apply: Callable[[DataFrame, int], None], failed: str) -> Callable[[DataFrame, int], None]:
    """apply, but a batch that it fails on is kept under the folder `failed`, with the reason, and the stream goes on."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            apply(batch, number)
        except Exception as e:
            batch.withColumn("reason", F.lit(f"{type(e).__name__}: {e}"[:1000])).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return run


class Ledger:
    """What has become of each batch, in a shared folder: its rows, numbered, and the parts of them that are done.

    A batch that is run again after a crash finds its rows as they were and skips the parts that were applied, so each part
    is applied once, or again only if the crash came between its application and its mark.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make, make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rows(self, batch: DataFrame, number: int) -> tuple[DataFrame, int]:
        """(the batch's rows with _at from 0, their number), as first written."""
        make, fs = self._fs()
        at = f"{self.path}/rows/batch={number}"
        if not fs.exists(make(f"{at}/_SUCCESS")):
            batch.withColumn("_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(at)
        held = self.spark.read.parquet(at).drop("batch")
        # how many rows each writing task had tells where its numbers begin: one row a task
        part = F.shiftright("_id", 33)
        counts = held.groupBy(part.alias("_p")).count().orderBy("_p").collect()
        begins, total = [], 0
        for r in counts:
            begins.append((r["_p"], total))
            total += r["count"]
        starts = F.broadcast(self.spark.createDataFrame(begins or [(0, 0)], "_p long, _start long"))
        place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
        return held.withColumn("_p", part).join(starts, "_p").withColumn("_at", place).drop("_p", "_start", "_id"), total

    def done(self, number: int, a: int, b: int) -> bool:
        make, fs = self._fs()
        return fs.exists(make(f"{self.path}/done/batch={number}/{a}-{b}"))

    def mark(self, number: int, a: int, b: int) -> None:
        make, fs = self._fs()
        fs.create(make(f"{self.path}/done/batch={number}/{a}-{b}"), True).close()


def isolating(apply: Callable[[DataFrame, int], None], ledger: Ledger, failed: str) -> Callable[[DataFrame, int], None]:
    """apply, but of a batch that it fails on only the rows at fault are kept under `failed`, with the reason; all others are
    applied, once.

    A part that fails is halved until the failing rows stand alone, so r bad rows among n cost some 2 r log n tries. apply
    must leave nothing behind when it fails, as a change by one manifest does.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows, total = ledger.rows(batch, number)
        todo, bad = [(0, total)] if total else [], []
        while todo:
            a, b = todo.pop()
            if ledger.done(number, a, b):
                continue
            try:
                apply(rows.filter((F.col("_at") >= a) & (F.col("_at") < b)).drop("_at"), number)
            except Exception as e:
                if b - a > 1:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                else:
                    bad.append((a, f"{type(e).__name__}: {e}"[:1000]))
                continue
            ledger.mark(number, a, b)
        if bad:
            reasons = F.broadcast(rows.sparkSession.createDataFrame(bad, "_at long, reason string"))
            rows.join(reasons, "_at").drop("_at").write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return run


class Snapshot:
    """A static side (the roster) as a written version, read anew once it is older than `seconds`.

    A new version counts when it has been read and written whole; while that fails, for whatever reason, the one before
    stands, and only without one the failure is the caller's.
    """

    def __init__(self, read: Callable[[], DataFrame], path: str, seconds: float = 300, clock: Callable[[], float] = time.time) -> None:
        self.read, self.path, self.seconds, self.clock = read, path.rstrip("/"), seconds, clock
        self.at: float | None = None
        self.held: DataFrame | None = None

    def get(self, force: bool = False) -> DataFrame:
        if self.held is not None and not force and self.clock() - self.at < self.seconds:
            return self.held
        try:
            new = self.read()
            folder = f"{self.path}/{uuid.uuid4().hex}"
            new.write.parquet(folder)
            self.held, self.at = new.sparkSession.read.schema(new.schema).parquet(folder), self.clock()
        except Exception:
            if self.held is None:
                raise
        return self.held


def with_static(side: Snapshot, apply: Callable[[DataFrame, int, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """apply with a snapshot of the static side."""
    return lambda batch, number: apply(batch, number, side.get())
