"""Live sessions with typed state, timers, orders to close, and a status that is read from the state itself.

Readings and orders are one stream by key and event time. A key's open session is a value (its scalars and running sums),
a map (its rows by unit) and a list (what was told along the way), so a reading touches the rows that it names and no
others. A session ends by its own completeness, by an order, by the next reading after too long a gap, or by a timer once
event time has passed that gap. Needs the RocksDB state store (`PROVIDER`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymark.operators.sessions import SCALARS
from tallymark.sources.dimensions import Rules

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_ROW = ("name string", "count long", "known boolean", "in_ram_zone boolean", "tier string", "type string", "power_each long")
ROWS = "array<struct<key_name:string," + ",".join(x.replace(" ", ":") for x in _ROW) + ">>"
HEAD = "start timestamp, updated timestamp, seq long, epoch int, " + ", ".join(f"{c} long" for c in SCALARS) + ", listed long, siege long, unknown long, n_rows int, n_readings int, user_name string, rss_approx boolean, cost_incomplete boolean"
LISTS = ("image_urls", "message_urls", "sources", "notes", "merge_notes")
OUT = "gid string, session int, event string, reason string, event_ts timestamp, " + HEAD + f", complete boolean, rows {ROWS}, " + ", ".join(f"{c} array<string>" for c in LISTS)
_HEAD = tuple(x.split()[0] for x in HEAD.split(", "))
_NAMES = tuple(x.split()[0] for x in _ROW)
#: What readings may carry beside gid, event_ts, seq, rows and the scalars.
OPTIONAL = "user_name string, image_url string, message_url string, source string, warnings array<string>, rss_approx boolean, expected_resources array<string>"


def _us(t: datetime) -> int:
    whole = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t
    return (whole - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class Sessions(StatefulProcessor):
    """One key's sessions, a row out for every reading, every end and every order that finds nothing open."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.limit = rules, rules.session_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "n int")
        self.head = handle.getValueState("head", HEAD)
        self.rows = handle.getMapState("rows", "key_name string", ", ".join(_ROW))
        self.told = handle.getListState("told", "kind string, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (_us(r["event_ts"]), r["seq"])):
            if self.head.exists() and _us(r["event_ts"]) - _us(Row(*_HEAD)(*self.head.get())["updated"]) > self.limit:
                yield self._close(key[0], "timeout")
            if r["kind"] == "close":
                yield self._close(key[0], "hand", r["event_ts"]) if self.head.exists() else self._out(key[0], "missing", None, r["event_ts"], {})
                continue
            head = self._merge(r)
            done = self._complete(head)
            yield self._out(key[0], "merged", None, r["event_ts"], head)
            if done or (head["wounded_current"] is not None and head["wounded_current"] >= self.rules.big_enough):
                yield self._close(key[0], "complete" if done else "big enough")
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.head.exists():
            due = (_us(self._head()["updated"]) + self.limit) // 1000 + 1
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.head.exists():
            yield self._close(key[0], "timeout")

    def close(self) -> None:
        pass

    def _head(self) -> dict:
        return dict(zip(_HEAD, self.head.get()))

    def _complete(self, head: dict) -> bool:
        w, ram = head["wounded_current"], head["ram_current"]
        return w is not None and head["listed"] == w and (ram is None or head["siege"] <= ram) and not head["unknown"]

    def _merge(self, r: Row) -> dict:
        if self.head.exists():
            head = self._head()
        else:
            self.number.update(((self.number.get()[0] + 1) if self.number.exists() else 0,))
            head = dict.fromkeys(_HEAD) | {"start": r["event_ts"], "epoch": 0, "listed": 0, "siege": 0, "unknown": 0, "n_rows": 0, "n_readings": 0, "rss_approx": False, "cost_incomplete": False}
        total, before = r["wounded_current"], head["wounded_current"]
        if total is not None and before is not None and total != before:
            self.rows.clear()
            head |= {"epoch": head["epoch"] + 1, "listed": 0, "siege": 0, "unknown": 0, "n_rows": 0}
            self.told.appendValue(("merge_notes", f"Hospital total changed ({before:,} -> {total:,}); earlier screenshots discarded."))
        for row in r["rows"] or []:
            if row["count"] is None or row["count"] <= 0 or (row["name"] or "").startswith("("):
                continue
            name = (row["key_name"],)
            if self.rows.containsKey(name):
                self._count(head, dict(zip(_NAMES, self.rows.getValue(name))), -1)
            self._count(head, row, 1)
            self.rows.updateValue(name, tuple(row[c] for c in _NAMES))
        head |= {c: r[c] for c in SCALARS if r[c] is not None}
        if r["expected_resources"]:
            head["cost_incomplete"] = any(head.get(c) is None for c in r["expected_resources"])
        head |= {"updated": r["event_ts"], "seq": r["seq"], "n_readings": head["n_readings"] + 1, "user_name": r["user_name"], "rss_approx": head["rss_approx"] or bool(r["rss_approx"])}
        for kind, values in (("image_urls", [r["image_url"]]), ("message_urls", [r["message_url"]]), ("sources", [r["source"]]), ("notes", r["warnings"] or [])):
            for v in values:
                if v:
                    self.told.appendValue((kind, v))
        self.head.update(tuple(head[c] for c in _HEAD))
        return head

    @staticmethod
    def _count(head: dict, row: Row | dict, sign: int) -> None:
        head["siege" if row["in_ram_zone"] else "listed"] += sign * row["count"]
        head["unknown"] += sign * (not row["known"])
        head["n_rows"] += sign

    def _close(self, gid: str, reason: str, at: datetime | None = None) -> Row:
        head = self._head()
        out = self._out(gid, "closed", reason, at or head["updated"], head)
        for state in (self.head, self.rows, self.told):
            state.clear()
        return out

    def _out(self, gid: str, event: str, reason: str | None, at: datetime, head: dict) -> Row:
        told: dict[str, list[str]] = {c: [] for c in LISTS}
        rows = []
        if head:
            for kind, value in self.told.get():
                told[kind].append(value)
            rows = sorted((Row(key_name=k[0], **dict(zip(_NAMES, v))) for k, v in self.rows.iterator()), key=lambda x: x["key_name"])
        values = {c: head.get(c) for c in _HEAD}
        complete = self._complete(head) if head else None
        session = self.number.get()[0] if head else None
        return Row(gid=gid, session=session, event=event, reason=reason, event_ts=at, **values, complete=complete, rows=rows, **told)


def run_sessions(readings: DataFrame, orders: DataFrame | None = None, rules: Rules = Rules(), delay: str = "1 day") -> DataFrame:
    """OUT for a stream of readings (gid, event_ts, seq, rows as ROWS, the scalars and any of OPTIONAL) and one of orders to
    close (gid, event_ts, seq). Both are late by `delay` at most; later ones are dropped by the watermark."""
    have = readings.columns
    missing = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in OPTIONAL.split(", ") if x.split()[0] not in have}
    stream = readings.withColumns(missing | {"kind": F.lit("reading"), "event_ts": F.col("event_ts").cast("timestamp")})
    if orders is not None:
        stream = stream.unionByName(orders.select("gid", F.col("event_ts").cast("timestamp").alias("event_ts"), "seq", F.lit("close").alias("kind")), allowMissingColumns=True)
    return stream.withWatermark("event_ts", delay).groupBy("gid").transformWithState(Sessions(rules), OUT, "append", "EventTime")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """gid and the head of every session that is open in a query's state, as of its last batch."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "head").load()
    return held.select(F.col("key.gid").alias("gid"), "value.*")


def open_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """gid, key_name and the row of every unit of the open sessions."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").load()
    return held.select(F.col("key.gid").alias("gid"), F.col("user_map_key.key_name").alias("key_name"), "user_map_value.*")
