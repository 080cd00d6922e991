import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgework.llm import negatives as ng

KIND = "vec_id long, label int, embedding array<float>"


def brute_force(rows, every, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        key = (label, np.array(q, "<i2").tobytes())
        if i not in kept or key < kept[i][0]:
            kept[i] = (key, label, q)
    out = []
    for a, (_, la, va) in kept.items():
        if a % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (_, label, v) in kept.items() if i != a)
        for p, pid, _ in [s for s in score if s[2] == la][:positives]:
            window = [s for s in score if s[2] != la and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, every=5, **given):
    df = spark.createDataFrame(rows, KIND).withColumns({"vec": ng.scaled("embedding"), "List": F.lit("x"), "block": F.lit(1), "id": F.lit(2)})
    return sorted(map(tuple, ng.mine(df, every, **given).collect()))


def clustered(n, seed, width=8, centers=6):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centers, width))
    x = c[r.integers(0, centers, n)] + 0.2 * r.normal(size=(n, width))
    return [(int(i), int(l), [float(np.float32(y)) for y in v]) for i, l, v in zip(r.permutation(n), r.integers(0, 4, n), x / np.linalg.norm(x, axis=1)[:, None])]


@pytest.mark.parametrize("sizes", [(1024, 8192, 2), (16, 10, 1), (16, 10, 2)])
def test_equals_brute_force_for_any_lists_blocks_and_waves(spark, monkeypatch, sizes):
    for name, v in zip(("LIST", "BLOCK", "FIRST"), sizes):
        monkeypatch.setattr(ng, name, v)
    monkeypatch.setattr(ng, "GROWTH", 3)
    rows = clustered(400, 1)
    got = mined(spark, rows)
    assert got == brute_force(rows, 5) and len(got) > 300


def test_ties_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(ng, "LIST", 20)
    monkeypatch.setattr(ng, "BLOCK", 16)
    r = random.Random(3)
    same, near = [0.5, 0.5, 0.0], [0.5, 0.25, 0.0]
    rows = [(i, i % 3, same if r.random() < 0.4 else near if r.random() < 0.6 else [r.uniform(-1, 1) for _ in range(3)]) for i in range(200)]
    assert mined(spark, rows) == brute_force(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 2) + [(None, 1, [1.0] * 8), (100, None, [1.0] * 8), (105, 1, None), (110, 1, [None] * 8), (115, 1, [nan] * 8), (120, 1, [inf] + [0.0] * 7), (125, 2, [])]
    rows += [(130, 1, [0.5]), (131, 1, [0.5, 0.5])] + rows[:20] + [(rows[0][0], 3, [0.1] * 8)]
    assert mined(spark, rows) == brute_force(rows, 5)


def test_empty_and_too_large(spark):
    assert mined(spark, []) == mined(spark, [(1, None, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    with pytest.raises(ValueError, match="not exact"):
        mined(spark, [(0, 1, [1e9] * 3)])


def test_bounds_hold_and_skip_lists(spark, monkeypatch):
    monkeypatch.setattr(ng, "LIST", 20)
    df = spark.createDataFrame(clustered(600, 5, centers=12), KIND).withColumn("vec", ng.scaled("embedding"))
    rows, lists = ng.build(df, "vec_id", "label", "vec")
    kept = [(r.block, np.frombuffer(r.vec, lists.kind).astype(float)) for r in rows.collect()]
    for block, v in kept:
        at = int(np.searchsorted(lists.first, block, "right")) - 1
        assert np.linalg.norm(v - lists.centroids[at]) <= lists.radii[at] + 1e-9
    anchors = rows.filter("id % 5 = 0").select("id", "label", "vec", F.expr("array(40000L)").alias("floors"), F.expr("array(70000L)").alias("tops")).withColumn("bars", F.col("floors"))
    ask = anchors.select("id", "label", "vec", "floors", "bars", "tops")
    visits = ask.mapInArrow(ng._visits(lists, 0, 10**6), "block int, id long, label long, vec binary, bars array<long>, tops array<long>")
    assert 0 < visits.count() < 0.5 * anchors.count() * (lists.blocks > 0).sum()


def test_repeated_runs_agree(spark):
    rows = clustered(300, 9)
    assert mined(spark, rows) == mined(spark, random.Random(1).sample(rows, len(rows)))
