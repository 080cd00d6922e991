"""The keyed event operators as stateful processors: value and map state, timers, and state that ends.

They need Spark's RocksDB state store (``use_rocksdb``) and event time: a watermark on ``ts``.  Rows of one micro-batch are
put in order by ``seq``; rows of a later one come after them.  A key that nothing came for since ``keep_s`` seconds of
event time loses its state and begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import due


def use_rocksdb(spark: SparkSession) -> None:
    """Chooses the state store that stateful processors need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Keyed(StatefulProcessor):
    """One value state of ``state``, kept until ``keep_s`` seconds after the last event."""

    state = ""
    #: Columns that the processor reads besides seq and ts.
    reads: tuple[str, ...] = ()

    def __init__(self, keep_s: int = 86_400):
        self.keep_ms = max(1, keep_s) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)
        self.last = handle.getValueState("last", "ms long")

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        """The columns that are read, of a key's rows in this micro-batch, by seq."""
        parts = [{c: p[c].to_numpy() for c in ("seq", "ts", *self.reads)} for p in rows if len(p)]
        cols = {c: np.concatenate([p[c] for p in parts]) for c in ("seq", "ts", *self.reads)}
        order = np.argsort(cols["seq"], kind="stable")
        return {c: v[order] for c, v in cols.items()}

    def _keep(self, times: np.ndarray, timers) -> None:
        """Puts the end of the state off to ``keep_s`` after the last event."""
        seen = self.last.get()[0] if self.last.exists() else None
        last = max(int(pd.Series(times).max().timestamp() * 1000), seen or 0)
        if seen is not None and last != seen:
            self.handle.deleteTimer(seen + self.keep_ms)
        if last != seen:
            self.last.update((last,))
        self.handle.registerTimer(max(last + self.keep_ms, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.keep_ms <= timerValues.getCurrentWatermarkInMs():
            self._end()
        return iter(())

    def _end(self) -> None:
        self.value.clear()
        self.last.clear()

    def close(self) -> None:
        pass


class Gauge(_Keyed):
    """O-102: (seq, gauge) of each event (seq, ts, delta), gauge = max(0, gauge + delta)."""

    state, reads, output = "x long", ("delta",), "seq long, gauge long"

    def handleInputRows(self, key, rows, timerValues):
        x = self.value.get()[0] if self.value.exists() else 0
        cols = self._ordered(rows)
        s = np.cumsum(cols["delta"].astype(np.int64))
        gauge = x + s - np.minimum(0, x + np.minimum.accumulate(s))
        self.value.update((int(gauge[-1]),))
        self._keep(cols["ts"], timerValues)
        yield pd.DataFrame({"key": key[0], "seq": cols["seq"], "gauge": gauge})


class FileStates(_Keyed):
    """O-104: (seq, state) of the last event of each file that changes it; a file in a state of ``ends`` is forgotten."""

    state, reads, output = "seq long, state string", ("state",), "seq long, state string"

    def __init__(self, keep_s: int = 86_400, ends: tuple[str, ...] = ("removed",)):
        super().__init__(keep_s)
        self.ends = ends

    def handleInputRows(self, key, rows, timerValues):
        before = self.value.get() if self.value.exists() else (-1, None)
        cols = self._ordered(rows)
        seq, state = int(cols["seq"][-1]), cols["state"][-1]
        if seq <= before[0]:
            return
        if state in self.ends:
            if self.last.exists():
                self.handle.deleteTimer(self.last.get()[0] + self.keep_ms)
            self._end()
        else:
            self.value.update((seq, state))
            self._keep(cols["ts"], timerValues)
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "state": [state]})


class WorkerRows(_Keyed):
    """O-107: (doc, events) and the last known fields since the worker's document changed or it was restarted.

    ``field`` and ``value`` of an event name what it tells (both may be null); the output has a row for each known field, or one
    with a null field where none is known.
    """

    state, reads, output = "doc string, events long", ("doc", "restart", "field", "value"), "doc string, events long, field string, value double"

    def init(self, handle):
        super().init(handle)
        self.fields = handle.getMapState("fields", "field string", "value double")

    def _end(self):
        super()._end()
        self.fields.clear()

    def handleInputRows(self, key, rows, timerValues):
        doc, n = self.value.get() if self.value.exists() else (None, 0)
        cols, known = self._ordered(rows), {}
        for d, restart, field, value in zip(*(cols[c].tolist() for c in self.reads)):
            if n == 0 or restart or d != doc:
                doc, n, known = d, 0, {}
                self.fields.clear()
            n += 1
            if field is not None and value is not None and value == value:
                known[field] = float(value)
        for field, value in known.items():
            self.fields.updateValue((field,), (value,))
        self.value.update((doc, n))
        self._keep(cols["ts"], timerValues)
        told = sorted((f[0], v[0]) for f, v in self.fields.iterator()) or [(None, None)]
        yield pd.DataFrame({"key": key[0], "doc": doc, "events": n, "field": pd.Series([f for f, _ in told], dtype=object), "value": pd.Series([v for _, v in told], dtype=float)})


class Throttle(_Keyed):
    """O-110: (seq, persist, emit) of each report (seq, ts, t, offset, ok), as ``operators.events.progress_marks``."""

    state, reads, output = "t double, offset long, event double", ("t", "offset", "ok"), "seq long, persist boolean, emit boolean"

    def __init__(self, keep_s: int = 86_400, seconds: float = 2.0, size: int = 8 << 20, event_seconds: float = 0.5):
        super().__init__(keep_s)
        self.limits = (seconds, size, event_seconds)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.value.get()) if self.value.exists() else (None, None, None)
        cols = self._ordered(rows)
        marks = []
        for t, offset, ok in zip(*(cols[c].tolist() for c in self.reads)):
            state, persist, emit = due(state, t, offset, ok, *self.limits)
            marks.append((persist, emit))
        self.value.update(state)
        self._keep(cols["ts"], timerValues)
        yield pd.DataFrame({"key": key[0], "seq": cols["seq"], "persist": [m[0] for m in marks], "emit": [m[1] for m in marks]})


class Stalls(_Keyed):
    """O-108: (since_ms) of each key when nothing came for ``seconds`` after an active event; its state ends then."""

    state, reads, output = "active boolean", ("active",), "since_ms long"

    def __init__(self, seconds: int):
        super().__init__(seconds)

    def handleInputRows(self, key, rows, timerValues):
        cols = self._ordered(rows)
        last = int(np.argmax(cols["ts"]))
        ms = int(pd.Timestamp(cols["ts"][last]).timestamp() * 1000)
        if not self.last.exists() or ms >= self.last.get()[0]:
            self.value.update((bool(cols["active"][last]),))
        self._keep(cols["ts"], timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and self.last.get()[0] + self.keep_ms <= timerValues.getCurrentWatermarkInMs():
            since, active = self.last.get()[0], self.value.get()[0]
            self._end()
            if active:
                yield pd.DataFrame({"key": [key[0]], "since_ms": [since]})


def processed(events: DataFrame, key: str, processor: _Keyed, mode: str = "append", delay: str = "0 seconds") -> DataFrame:
    """A stream of events (key, seq, ts, what the processor reads) through a processor: the key, then its output."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(events[key].alias("key"), "seq", "ts", *processor.reads).withWatermark("ts", delay)
    out = rows.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {processor.output}", mode, "EventTime")
    return out.withColumnRenamed("key", key)
