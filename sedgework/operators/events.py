"""Analytics over event logs, in batch: gauges that never fall below zero, high-water marks, state time.

Each takes a table of events with a key and a total order; ties are always broken by an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .scans import BUCKET, after, before, bucketed, carried, within


def clamped_gauge(df: DataFrame, key: list[str], order: list[str], delta: Column, out: str = "gauge") -> DataFrame:
    """x = max(0, x + delta) along the order, without a loop.

    With S the running sum, x = S - least(0, running minimum of S): a step that would fall below zero
    moves the floor, and increments never do.  A bucket's summary is its sum and its least S.
    """
    rows, cut = bucketed(df.withColumn("_d", delta), key, order[0])
    w = within(key, order)
    rows = rows.withColumn("_s", F.sum("_d").over(w))
    floor = F.min("_s").over(w)
    if cut:
        ends = rows.groupBy(*key, BUCKET).agg(F.sum("_d").alias("_sum"), F.min("_s").alias("_low"))
        ends = ends.withColumn("_s0", F.coalesce(F.sum("_sum").over(before(key)), F.lit(0)))
        carry = ends.withColumn("_m0", F.min(F.col("_s0") + F.col("_low")).over(before(key))).select(*key, BUCKET, "_s0", "_m0")
        rows = carried(rows.withColumn("_m", floor), carry, key, ["_s0", "_m0"])
        rows, floor = rows.withColumn("_s", F.col("_s0") + F.col("_s")), F.least("_m0", F.col("_s0") + F.col("_m"))
    return rows.withColumn(out, (F.col("_s") - F.least(F.lit(0), floor)).cast("long")).select(*[c for c in df.columns if c != out], out)


def goodput(df: DataFrame, doc: str, order: list[str], offset: Column, base: Column, useful: Column) -> DataFrame:
    """Adds ``fresh``: the bytes of each event above all that came before for its document."""
    rows, cut = bucketed(df.withColumn("_o", offset).withColumn("_b", base), [doc], order[0])
    rows = rows.withColumn("_m", F.max("_o").over(within([doc], order).rowsBetween(Window.unboundedPreceding, -1)))
    tops = ["_b", "_m"]
    if cut:
        ends = rows.groupBy(doc, BUCKET).agg(F.max("_o").alias("_top"))
        rows = carried(rows, ends.select(doc, BUCKET, F.max("_top").over(before([doc])).alias("_o0")), [doc], ["_o0"])
        tops.append("_o0")
    fresh = F.when(useful, F.greatest(F.lit(0), F.col("_o") - F.greatest(*tops))).otherwise(0)  # what is null counts for nothing
    return rows.withColumn("fresh", fresh.cast("long")).select(*df.columns, "fresh")


def _next_instant(df: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """Adds the microseconds of an event (_at) and of the key's next one (_next, null for the last)."""
    rows, cut = bucketed(df, [key], order[0])
    rows = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    lead = F.lead("_at").over(Window.partitionBy(key, BUCKET).orderBy(*order))
    if cut:  # the last one of a bucket is followed by the first one of the next bucket
        ends = rows.groupBy(key, BUCKET).agg(F.min_by("_at", F.struct(*order)).alias("_first"))
        rows = carried(rows.withColumn("_lead", lead), ends.select(key, BUCKET, F.last("_first").over(after([key])).alias("_then")), [key], ["_then"])
        lead = F.coalesce("_lead", "_then")
    return rows.withColumn("_next", lead).select(*df.columns, "_at", "_next")


def state_time(df: DataFrame, worker: str, ts: str, order: list[str], state: str, step_s: int = 3600) -> DataFrame:
    """(worker, state, slot, micros): each interval between changes, split at multiples of ``step_s`` seconds."""
    step = step_s * 1_000_000
    rows = _next_instant(df, worker, ts, order).select(worker, F.col(state).alias("state"), F.col("_at").alias("_a"), F.col("_next").alias("_z")).filter("_z > _a")
    slots = F.sequence(F.floor(F.col("_a") / step), F.floor((F.col("_z") - 1) / step))
    rows = rows.withColumn("slot", F.explode(slots))
    part = F.least(F.col("_z"), (F.col("slot") + 1) * step) - F.greatest(F.col("_a"), F.col("slot") * step)
    return rows.groupBy(worker, "state", "slot").agg(F.sum(part).cast("long").alias("micros"))


def worker_rows(df: DataFrame, worker: str, order: list[str], doc: str, restart: Column, fields: dict[str, Column]) -> DataFrame:
    """Last known fields of each worker since its document changed or it was restarted.

    Of a bucket only the events since its last change matter, and of a worker the buckets since the last one with a
    change, so both levels are aggregates over few rows.
    """
    rows, cut = bucketed(df, [worker], order[0])
    rows = rows.select(worker, BUCKET, F.struct(*order).alias("_pos"), F.col(doc).alias("_doc"), F.coalesce(restart, F.lit(False)).alias("_restart"), *[c.alias(n) for n, c in fields.items()])
    w = Window.partitionBy(worker, BUCKET).orderBy("_pos")
    lag = F.lag(F.struct("_doc")).over(w)
    if cut:
        ends = rows.groupBy(worker, BUCKET).agg(F.max_by(F.struct("_doc"), "_pos").alias("_end"))
        rows = carried(rows.withColumn("_lag", lag), ends.select(worker, BUCKET, F.last("_end").over(before([worker])).alias("_before")), [worker], ["_before"])
        lag = F.coalesce("_lag", "_before")
    changed = F.col("_restart") | ~F.col("_doc").eqNullSafe(lag["_doc"])
    jobs = rows.withColumn("_changed", changed).withColumn("_job", F.sum(F.col("_changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    values = [F.max(F.when(F.col(n).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(n).alias("v")))).alias(n) for n in fields]
    job = jobs.groupBy(worker, BUCKET, "_job").agg(*values, F.max(F.struct("_pos", "_doc")).alias("_end"), F.count("*").alias("events"), F.max("_changed").alias("_changed"))
    last = job.groupBy(worker, BUCKET).agg(F.max_by(F.struct("events", "_end", *fields), "_job").alias("_r"), F.max("_changed").alias("_changed")).select(worker, BUCKET, "_changed", "_r.*")
    since = F.max(F.when(F.col("_changed"), F.col(BUCKET))).over(Window.partitionBy(worker))
    last = last.withColumn("_since", since).filter(F.col(BUCKET) >= F.coalesce("_since", F.lit(0)))
    out = last.groupBy(worker).agg(F.max("_end").alias("_end"), F.sum("events").alias("events"), *[F.max(n).alias(n) for n in fields])
    return out.select(worker, F.col("_end._doc").alias(doc), "events", *[F.col(n)["v"].alias(n) for n in fields])


def stalls(df: DataFrame, worker: str, order: list[str], ts: str, active: Column, seconds: int) -> DataFrame:
    """Events of active workers after which nothing came for ``seconds`` or more (at least 1)."""
    rows = _next_instant(df, worker, ts, order).withColumn("gap_us", F.col("_next") - F.col("_at")).drop("_at", "_next")
    return rows.filter(active & (F.col("gap_us") >= max(1, seconds) * 1_000_000))


def due(state: tuple, t: float, offset: int, ok: bool, seconds: float, size: int, event_seconds: float) -> tuple[tuple, bool, bool]:
    """The state after a progress report, and whether to persist it and to emit an event.

    ``state`` is the time and offset of the last successful write and the time of the last event, each None before the
    first one.
    """
    last_t, last_o, last_event = state
    if last_o is not None and offset < last_o:
        last_o = offset
    persist = last_t is None or t - last_t >= seconds or offset - last_o >= size
    emit = last_event is None or t - last_event >= event_seconds
    return ((t, offset) if persist and ok else (last_t, last_o)) + (t if emit else last_event,), persist, emit


def progress_marks(df: DataFrame, key: str, seconds: float = 2.0, size: int = 8 << 20, event_seconds: float = 0.5) -> DataFrame:
    """``df`` with persist and emit: what a progress report leads to.

    persist: the first report of a key, then when ``seconds`` passed or ``size`` bytes came since the last successful
    write; an offset that goes back is counted from there.  emit: an event for the first report and then
    after ``event_seconds`` at least.
    A greedy scan in order, which no window can express.  Rows come sorted by (key, seq) and the scan keeps three
    numbers, so a key of any length is read batch by batch.  Null keys are one key.

    df: the key, then seq, t double, offset long, ok boolean.
    """
    schema = StructType([*df.schema.fields, StructField("persist", BooleanType()), StructField("emit", BooleanType())])

    def run(batches):
        at, fresh, state = None, True, (None, None, None)
        for pdf in batches:
            marks = []
            for k, t, o, ok in zip(pdf[key].astype(object).where(pdf[key].notna(), None), pdf["t"], pdf["offset"], pdf["ok"]):
                if fresh or k != at:
                    at, fresh, state = k, False, (None, None, None)
                state, persist, emit = due(state, t, o, ok, seconds, size, event_seconds)
                marks.append((bool(persist), bool(emit)))
            yield pdf.assign(persist=[m[0] for m in marks], emit=[m[1] for m in marks])

    return df.repartition(key).sortWithinPartitions(key, "seq").mapInPandas(run, schema)


def throttle(df: DataFrame, key: str, schema: str, seconds: float = 2.0, size: int = 8 << 20) -> DataFrame:
    """Offsets to persist, see ``progress_marks``.  df: (key, seq, t double, offset long, ok boolean), named in ``schema``."""
    marks = progress_marks(df, key, seconds, size)
    return marks.filter("persist").select(*StructType.fromDDL(schema).names)
