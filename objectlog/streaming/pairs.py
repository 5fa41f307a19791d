"""Directly-follows pairs of a stream: the last event of each object is state, each new one emits a pair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "otype string, oid string, e1 string, src string, t1 timestamp, e2 string, tgt string, t2 timestamp"
STATE = "eid string, activity string, ts timestamp"


def stream_pairs(events: DataFrame, late: str = "1 hour", forget_s: int = 30 * 86_400) -> DataFrame:
    """Pairs from a stream (otype, oid, eid, activity, ts).

    Rows later than the watermark are dropped. Within a micro-batch an object's events are put in order; an event older
    than the last one seen starts no pair backward, it is left out. An object without events for ``forget_s`` of event time
    loses its state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names = ["eid", "activity", "ts"]
        rows = pd.concat([b[names] for b in batches])
        if state.exists:
            last = pd.DataFrame([state.get], columns=names).astype({"ts": rows["ts"].dtype})
            rows = rows[(rows["ts"] > last["ts"][0]) | ((rows["ts"] == last["ts"][0]) & (rows["eid"] > last["eid"][0]))]
            rows = pd.concat([last, rows])
        rows = rows.sort_values(["ts", "eid"]).drop_duplicates(["ts", "eid"])
        end = rows.iloc[-1]
        state.update((end["eid"], end["activity"], end["ts"].to_pydatetime()))
        state.setTimeoutTimestamp(max(int(end["ts"].timestamp() * 1000), state.getCurrentWatermarkMs()) + forget_s * 1000)
        if len(rows) > 1:
            first, second = rows.iloc[:-1].reset_index(drop=True), rows.iloc[1:].reset_index(drop=True)
            out = pd.concat([first.set_axis(["e1", "src", "t1"], axis=1), second.set_axis(["e2", "tgt", "t2"], axis=1)], axis=1)
            yield out.assign(otype=key[0], oid=key[1])[["otype", "oid", "e1", "src", "t1", "e2", "tgt", "t2"]]

    rows = events.select("otype", "oid", "eid", "activity", "ts").withWatermark("ts", late)
    return rows.groupBy("otype", "oid").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def activity_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by activity and window of time, each window once the watermark has passed it."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "activity").agg(F.count("*").alias("n")).select("w.start", "w.end", "activity", "n")


WAITING = "eid array<string>, activity array<string>, ts array<timestamp>, last boolean"


def ordered_pairs(events: DataFrame, late: str = "1 hour", forget_s: int = 30 * 86_400) -> DataFrame:
    """Pairs from a stream (otype, oid, eid, activity, ts) whose events may come in any order within the watermark.

    An object's state is its events that the watermark has not passed yet, in order, and the last one that it has. A pair
    leaves once the watermark has passed its second event, so an event that comes after a later one is put in its
    place. What comes behind the watermark is dropped, repeated events count once. A timer hands out what is waiting when no more
    events come; an object without events for ``forget_s`` of event time after that loses its state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["eid", "activity", "ts"]
        passed, done = state.getCurrentWatermarkMs(), False
        parts = [] if state.hasTimedOut else [b[names] for b in batches]
        if state.exists:
            *held, done = state.get
            parts.insert(0, pd.DataFrame(dict(zip(names, map(list, held), strict=True))).astype({"ts": "datetime64[us]"}))
        rows = pd.concat([p.assign(ts=p["ts"].astype("datetime64[us]")) for p in parts]).drop_duplicates(["ts", "eid"])
        old = rows.iloc[:1] if done else rows.iloc[:0]  # handed out already, whatever comes before it now
        rest = rows.iloc[len(old) :].sort_values(["ts", "eid"])
        if len(old):
            rest = rest[(rest["ts"] > old["ts"].iloc[0]) | ((rest["ts"] == old["ts"].iloc[0]) & (rest["eid"] > old["eid"].iloc[0]))]
        ready = rest["ts"] < pd.Timestamp(passed, unit="ms")
        out, wait = pd.concat([old, rest[ready]]), rest[~ready]
        if state.hasTimedOut and not len(wait) and not ready.any():
            state.remove()
            return
        kept = pd.concat([out.iloc[-1:], wait])
        state.update((kept["eid"].tolist(), kept["activity"].tolist(), kept["ts"].dt.to_pydatetime().tolist(), bool(len(out))))
        due = int(wait["ts"].iloc[0].timestamp() * 1000) if len(wait) else passed + forget_s * 1000
        state.setTimeoutTimestamp(max(due, passed + 1))
        if len(out) > 1:
            first, second = out.iloc[:-1].reset_index(drop=True), out.iloc[1:].reset_index(drop=True)
            both = pd.concat([first.set_axis(["e1", "src", "t1"], axis=1), second.set_axis(["e2", "tgt", "t2"], axis=1)], axis=1)
            yield both.assign(otype=key[0], oid=key[1])[["otype", "oid", "e1", "src", "t1", "e2", "tgt", "t2"]]

    rows = events.select("otype", "oid", "eid", "activity", "ts").withWatermark("ts", late)
    return rows.groupBy("otype", "oid").applyInPandasWithState(step, OUT, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
