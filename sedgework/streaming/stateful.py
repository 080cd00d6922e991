"""Structured Streaming forms of the event operators.

Event times must be TIMESTAMP (not NTZ).  Keyed state folds sort each micro-batch by ``seq``; state is
a few numbers for each key and ends by time-out.  Windowed forms drop state behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _sorted(parts: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(by, kind="stable")


def clamped_gauge(events: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """(key, seq, gauge) for each event of (key, seq, delta): gauge = max(0, gauge + delta)."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = state.get[0] if state.exists else 0
        rows, out = _sorted(parts, "seq"), []
        for d in rows["delta"]:
            x = max(0, x + int(d))
            out.append(x)
        state.update((x,))
        yield pd.DataFrame({key: k[0], "seq": rows["seq"], "gauge": out})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, gauge long", "gauge long", "append", GroupStateTimeout.NoTimeout)


def latest_state(events: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """Update mode: the last ``state`` of each key by seq, from (key, seq, state)."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, name = state.get if state.exists else (-1, "")
        last = _sorted(parts, "seq").iloc[-1]
        if int(last["seq"]) > seq:
            seq, name = int(last["seq"]), str(last["state"])
        state.update((seq, name))
        yield pd.DataFrame({key: [k[0]], "seq": [seq], "state": [name]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, state string", "seq long, state string", "update", GroupStateTimeout.NoTimeout)


def worker_rows(events: DataFrame) -> DataFrame:
    """Update mode: (worker, doc, events, last_value) since the worker's document changed or it was restarted.

    events: (worker long, seq long, doc long, restart boolean, value double or null).
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        doc, n, value = state.get if state.exists else (None, 0, None)
        rows = _sorted(parts, "seq")
        for d, restart, v in zip(rows["doc"].tolist(), rows["restart"].tolist(), rows["value"].tolist()):
            if n == 0 or restart or d != doc:
                doc, n, value = int(d), 0, None
            n += 1
            value = float(v) if v is not None and v == v else value
        state.update((doc, n, value))
        yield pd.DataFrame({"worker": [k[0]], "doc": [doc], "events": [n], "last_value": [value]})

    return events.groupBy("worker").applyInPandasWithState(step, "worker long, doc long, events long, last_value double", "doc long, events long, last_value double", "update", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, seconds: float = 2.0, size: int = 8 << 20) -> DataFrame:
    """Offsets to persist, as the batch form: events (key long, seq long, t double, offset long, ok boolean)."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_o = state.get if state.exists else (None, None)
        rows, keep = _sorted(parts, "seq"), []
        for t, o, ok in zip(rows["t"], rows["offset"], rows["ok"]):
            if last_o is not None and o < last_o:
                last_o = int(o)
            due = last_t is None or t - last_t >= seconds or o - last_o >= size
            keep.append(bool(due))
            if due and ok:
                last_t, last_o = float(t), int(o)
        state.update((last_t, last_o))
        yield rows[keep][["key", "seq", "offset"]]

    return events.groupBy("key").applyInPandasWithState(step, "key long, seq long, offset long", "t double, o long", "append", GroupStateTimeout.NoTimeout)


def stalls(events: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(key, since) of keys whose last active event the watermark has left behind by ``seconds``.

    events: (key long, ts timestamp, active boolean).
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "since_ms": [since]})
            return
        last = _sorted(parts, "ts").iloc[-1]
        ms = int(last["ts"].timestamp() * 1000)
        if state.exists and state.get[0] > ms:
            return
        if last["active"]:
            state.update((ms,))
            state.setTimeoutTimestamp(max(ms + max(1, seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return events.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, "key long, since_ms long", "ms long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(events: DataFrame, width: str, slide: str | None = None, delay: str = "301 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums, counts and means of ``value`` by window of ``ts``; windows behind the watermark are final and dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.unix_micros("w.start").alias("start_us"), *keys, "total", "n", "mean")


def admitted(events: DataFrame, key: str, delay: str = "10 days") -> DataFrame:
    """First event of each key within the watermark's reach."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def counters(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Complete mode: events by kind."""
    return events.groupBy(kind).agg(F.count("*").alias("n"))
