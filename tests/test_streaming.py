import pytest
from pyspark.sql import functions as F

from sedgework.operators import events as E
from sedgework.streaming import stateful as S

SF = "/root/testdata/sf0.001"
DELTA = "case event_type when 'view' then 1 when 'click' then 1 when 'signup' then -1 when 'purchase' then -1 else 0 end"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The events in five files, in order of time."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(5):
        e.filter(f"event_id div 200 = {i}").coalesce(1).write.mode("append").parquet(folder)
    return folder, e


def run(spark, log, make, mode, name):
    folder, e = log
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_clamped_gauge_equals_batch(spark, log):
    make = lambda s: S.clamped_gauge(s.select("user_id", F.col("event_id").alias("seq"), F.expr(DELTA).cast("long").alias("delta")), "user_id")
    got = run(spark, log, make, "append", "gauges")
    want = E.clamped_gauge(log[1], ["user_id"], ["event_id"], F.expr(DELTA)).select("user_id", "event_id", "gauge")
    assert rows(got) == rows(want)


def test_throttle_equals_batch(spark, log):
    pick = lambda s: s.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_seconds("ts").cast("double").alias("t"), (F.col("value") * 100000).cast("long").alias("offset"), (F.col("event_type") != "error").alias("ok"))
    got = run(spark, log, lambda s: S.throttled(pick(s), 100000.0), "append", "throttled")
    want = E.throttle(pick(log[1]), "key", "key long, seq long, t double, offset long, ok boolean", 100000.0).select("key", "seq", "offset")
    assert rows(got) == rows(want) and got.count() < 1000


def test_worker_rows_equal_batch(spark, log):
    pick = lambda s: s.select((F.col("user_id") % 4).alias("worker"), F.col("event_id").alias("seq"), F.floor(F.col("user_id") / 4).alias("doc"), (F.col("event_type") == "signup").alias("restart"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    got = run(spark, log, lambda s: S.worker_rows(pick(s)), "update", "workers")
    want = E.worker_rows(pick(log[1]), "worker", ["seq"], "doc", F.col("restart"), {"last_value": F.col("value")}).select("worker", "doc", "events", "last_value")
    last = {}
    for r in got.collect():
        last[r.worker] = tuple(r)
    assert len(last) == 4
    assert set(map(str, last.values())) <= set(map(str, map(tuple, got.collect())))
    finals = {r.worker: r.events for r in want.collect()}
    assert all(any(r.worker == w and r.events == n for r in got.collect()) for w, n in finals.items())


def test_windows_equal_batch_but_for_open_ones(spark, log):
    got = {r.start_us: r.n for r in run(spark, log, lambda s: S.windowed(s, "1 day", delay="1 hour"), "append", "days").collect()}
    want = {r.start_us: r.n for r in log[1].groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n").collect()}
    assert set(got.items()) <= set(want.items()) and len(want) - len(got) <= 1


def test_latest_state_admission_counters(spark, log):
    e = log[1]
    got = run(spark, log, lambda s: S.latest_state(s.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("state")), "user_id"), "update", "latest")
    last = {r.user_id: r.s for r in e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s")).collect()}
    best = {}
    for r in got.collect():
        best[r.user_id] = max(best.get(r.user_id, (-1, "")), (r.seq, r.state))
    assert {k: v[1] for k, v in best.items()} == last
    first = run(spark, log, lambda s: S.admitted(s, "user_id", "60 days"), "append", "admitted")
    assert first.count() == e.select("user_id").distinct().count()
    n = run(spark, log, lambda s: S.counters(s), "complete", "counters")
    assert rows(n) == rows(e.groupBy("event_type").count())


def test_stalls(spark, log):
    got = run(spark, log, lambda s: S.stalls(s.select(F.col("user_id").alias("key"), "ts", F.lit(True).alias("active")), 86400), "append", "stalled").collect()
    at = {(r.user_id, int(r.ts.timestamp() * 1000)) for r in log[1].select("user_id", "ts").collect()}
    assert got and {(r.key, r.since_ms) for r in got} <= at
