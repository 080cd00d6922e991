import datetime
import random

import pytest
from pyspark.sql import functions as F

from sedgework.operators import events as E
from sedgework.operators import scans

KIND = "worker string, ts timestamp, event_id long, d long, o long, doc long, restart boolean, value double"


def made(n, seed, workers=("hot",) * 8 + ("a", "b", None)):
    r = random.Random(seed)
    at = sorted(r.choice([r.randint(0, 50), r.randint(900, 1000)]) for _ in range(n))  # bursts and ties
    day = datetime.datetime(2024, 1, 1)
    return [(r.choice(workers), day + datetime.timedelta(seconds=t), i, r.choice([1, 1, -1, -2]), r.choice([None, r.randint(0, 5 * i + 1)]), r.choice([None, 1, 1, 1, 2]) if r.random() < 0.05 else 1, r.random() < 0.004, r.choice([None, float(i)])) for i, t in enumerate(at)]


def by_worker(rows):
    out: dict = {}
    for x in rows:
        out.setdefault(x[0], []).append(x)
    return out


@pytest.fixture(params=["whole", "cut"])
def cut(request, monkeypatch):
    if request.param == "cut":
        monkeypatch.setattr(scans, "LEAST", 20)
    return request.param == "cut"


def test_one_worker_is_spread_and_keys_of_few_events_are_not(spark, monkeypatch):
    monkeypatch.setattr(scans, "LEAST", 20)
    df, cut = scans.bucketed(spark.createDataFrame(made(3000, 1), KIND), ["worker"], "ts")
    assert cut
    n = {(r.worker, r[scans.BUCKET]): r.n for r in df.groupBy("worker", scans.BUCKET).agg(F.count("*").alias("n")).collect()}
    hot = [v for (w, _), v in n.items() if w == "hot"]
    assert len(hot) > 30 and max(hot) < 250
    monkeypatch.setattr(scans, "LEAST", 10**6)
    df, cut = scans.bucketed(spark.createDataFrame(made(300, 1), KIND), ["worker"], "ts")
    assert not cut and df.filter(f"{scans.BUCKET} > 0").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_gauge_equals_the_loop(spark, cut, seed):
    rows = made(2000, seed)
    want = {}
    for events in by_worker(rows).values():
        x = 0
        for e in events:
            x = max(0, x + e[3])
            want[e[2]] = x
    got = E.clamped_gauge(spark.createDataFrame(rows, KIND), ["worker"], ["ts", "event_id"], F.col("d"))
    assert {r.event_id: r.gauge for r in got.collect()} == want and got.columns[-1] == "gauge"


def test_goodput_equals_the_loop(spark, cut):
    rows = made(2000, 3)
    want = {}
    for events in by_worker(rows).values():
        high = None
        for e in events:
            useful = e[3] > 0
            top = max([7, *([] if high is None else [high])])
            want[e[2]] = max(0, (e[4] or 0) - top) if useful and e[4] is not None else 0
            high = e[4] if high is None else high if e[4] is None else max(high, e[4])
    got = E.goodput(spark.createDataFrame(rows, KIND), "worker", ["ts", "event_id"], F.col("o"), F.lit(7), F.col("d") > 0)
    assert {r.event_id: r.fresh for r in got.collect()} == want


def test_worker_rows_equal_the_loop(spark, cut):
    rows = made(2500, 4)
    want = {}
    for worker, events in by_worker(rows).items():
        doc, n, value, first = None, 0, None, True
        for e in events:
            if e[6] or e[5] != (None if first else doc):
                n, value = 0, None
            doc, first, n, value = e[5], False, n + 1, e[7] if e[7] is not None else value
        want[worker] = (doc, n, value)
    got = E.worker_rows(spark.createDataFrame(rows, KIND), "worker", ["ts", "event_id"], "doc", F.col("restart"), {"last": F.col("value")})
    assert {r.worker: (r.doc, r.events, r.last) for r in got.collect()} == want


def test_state_time_and_stalls_equal_the_loop(spark, cut):
    rows = made(1500, 5)
    us = lambda e: int((e[1] - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    times: dict = {}
    gaps = {}
    for worker, events in by_worker(rows).items():
        for e, f in zip(events, [*events[1:], None]):
            if f is None:
                continue
            if us(f) - us(e) >= 5_000_000 and e[3] > 0:
                gaps[e[2]] = us(f) - us(e)
            a, z = us(e), us(f)
            while a < z:
                slot = a // 10_000_000
                end = min(z, (slot + 1) * 10_000_000)
                k = (worker, str(e[3]), slot)
                times[k] = times.get(k, 0) + end - a
                a = end
    df = spark.createDataFrame(rows, KIND).withColumn("s", F.col("d").cast("string"))
    got = E.state_time(df, "worker", "ts", ["ts", "event_id"], "s", 10).collect()
    assert {(r.worker, r.state, r.slot): r.micros for r in got} == times
    got = E.stalls(df, "worker", ["ts", "event_id"], "ts", F.col("d") > 0, 5)
    assert {r.event_id: r.gap_us for r in got.collect()} == gaps and len(gaps) > 3 and got.columns == [*df.columns, "gap_us"]


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert E.clamped_gauge(df, ["worker"], ["ts"], F.col("d")).count() == E.goodput(df, "worker", ["ts"], F.col("o"), F.lit(0), F.lit(True)).count() == 0
    assert E.worker_rows(df, "worker", ["ts"], "doc", F.col("restart"), {}).count() == 0
