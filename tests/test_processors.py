import datetime

import pytest
from pyspark.sql import functions as F

from sedgework.operators import events as E
from sedgework.streaming import processors as P

SF = "/root/testdata/sf0.001"
DELTA = "case event_type when 'view' then 1 when 'click' then 1 when 'signup' then -1 when 'purchase' then -1 else 0 end"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The events in four files, in order of time; a few keys, so that each has many events in each file."""
    P.use_rocksdb(spark)
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("user_id", F.col("user_id") % 6)
    for i in range(4):
        e.filter(f"event_id div 250 = {i}").coalesce(1).write.mode("append").parquet(folder)
    return folder, e


def run(spark, folder, schema, make, name, mode="append"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    if q.exception():
        raise q.exception()
    return spark.table(name), q


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_gauge_equals_batch(spark, log):
    pick = lambda s: s.select("user_id", F.col("event_id").alias("seq"), "ts", F.expr(DELTA).cast("long").alias("delta"))
    got, _ = run(spark, log[0], log[1].schema, lambda s: P.processed(pick(s), "user_id", P.Gauge(10**9)), "p_gauge")
    want = E.clamped_gauge(log[1], ["user_id"], ["event_id"], F.expr(DELTA)).select("user_id", "event_id", "gauge")
    assert rows(got) == rows(want)


def test_throttle_equals_batch_with_both_rules(spark, log):
    pick = lambda s: s.select("user_id", F.col("event_id").alias("seq"), "ts", F.unix_seconds("ts").cast("double").alias("t"), (F.col("value") * 100000).cast("long").alias("offset"), (F.col("event_type") != "error").alias("ok"))
    got, _ = run(spark, log[0], log[1].schema, lambda s: P.processed(pick(s), "user_id", P.Throttle(10**9, 100_000.0, 8 << 20, 50_000.0)), "p_throttle")
    want = E.progress_marks(pick(log[1]).drop("ts"), "user_id", 100_000.0, 8 << 20, 50_000.0).select("user_id", "seq", "persist", "emit")
    assert rows(got) == rows(want) and 0 < got.filter("emit").count() < 1000


def test_file_states_equal_batch(spark, log):
    state = F.expr("case event_type when 'view' then 'queued' when 'click' then 'running' when 'signup' then 'pending' else 'removed' end")
    pick = lambda s: s.select("user_id", F.col("event_id").alias("seq"), "ts", state.alias("state"))
    got, _ = run(spark, log[0], log[1].schema, lambda s: P.processed(pick(s), "user_id", P.FileStates(10**9), "update"), "p_states", "update")
    last = {}
    for r in sorted(got.collect(), key=lambda r: r.seq):
        last[r.user_id] = (r.seq, r.state)
    assert last == {r.user_id: (r.seq, r.state) for r in pick(log[1]).groupBy("user_id").agg(F.max("seq").alias("seq"), F.max_by("state", "seq").alias("state")).collect()}


def test_worker_rows_equal_batch(spark, log):
    doc = F.floor(F.col("event_id") / 90).cast("string")
    pick = lambda s: s.select("user_id", F.col("event_id").alias("seq"), "ts", doc.alias("doc"), (F.col("event_type") == "signup").alias("restart"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("field"), F.col("value"))
    got, _ = run(spark, log[0], log[1].schema, lambda s: P.processed(pick(s), "user_id", P.WorkerRows(10**9), "update"), "p_workers", "update")
    fields = {k: F.when(F.col("field") == k, F.col("value")) for k in ("view", "click", "purchase", "signup")}
    want = {}
    for r in E.worker_rows(pick(log[1]), "user_id", ["seq"], "doc", F.col("restart"), fields).collect():
        want[r.user_id] = (r.doc, r.events, {k: r[k] for k in fields if r[k] is not None})
    last = {}
    for r in got.collect():
        at = last.setdefault((r.user_id, r.doc, r.events), {})
        if r.field is not None:
            at[r.field] = r.value
    assert all(last.get((u, d, n)) == f for u, (d, n, f) in want.items()) and len(want) == 6


DAY = datetime.datetime(2024, 1, 1)


def timed(spark, folder, batches, kind):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, s, DAY + datetime.timedelta(seconds=t), *rest) for k, s, t, *rest in rows], kind).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame([], kind).schema


def test_state_ends_when_a_key_is_idle(spark, log, tmp_path):
    batches = [[("a", 1, 0, 5), ("b", 2, 0, 5)], [("b", 3, 50, 1)], [("b", 4, 120, 1)], [("b", 5, 200, 1)], [("a", 6, 260, 1), ("b", 7, 260, 1)]]
    schema = timed(spark, f"{tmp_path}/in", batches, "user_id string, seq long, ts timestamp, delta long")
    got, q = run(spark, f"{tmp_path}/in", schema, lambda s: P.processed(s, "user_id", P.Gauge(100)), "p_idle")
    assert {r.seq: r.gauge for r in got.collect()} == {1: 5, 2: 5, 3: 6, 4: 7, 5: 8, 6: 1, 7: 9}  # a begins anew
    assert q.lastProgress is not None


def test_stalls_come_when_the_watermark_passes(spark, log, tmp_path):
    batches = [[("a", 1, 0, True), ("b", 2, 0, True), ("c", 3, 0, False)], [("b", 4, 50, True)], [("d", 5, 120, True)], [("d", 6, 130, False)], [("d", 7, 400, True)]]
    schema = timed(spark, f"{tmp_path}/in", batches, "user_id string, seq long, ts timestamp, active boolean")
    got, _ = run(spark, f"{tmp_path}/in", schema, lambda s: P.processed(s, "user_id", P.Stalls(100)), "p_stalls")
    at = lambda t: int((DAY + datetime.timedelta(seconds=t) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert sorted((r.user_id, r.since_ms) for r in got.collect()) == [("a", at(0)), ("b", at(50))]
