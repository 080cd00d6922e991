import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from sedgework.llm import jaccard as op
from sedgework.llm.components import connected_components


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, node string").repartition(3)
    return [(r.doc_id, r.n_shingles, r.component_id) for r in op.components(df, **more).collect()]


def odd(seed, families=12, members=12):
    rnd = random.Random(seed)
    docs = [None, "", "  \n", "One", "one", "one two three", "ONE two  three", "one two three four", "a a a a a a a", "a a a a a"]
    passage = [f"p{i}" for i in range(45)]
    for f in range(families):
        n = rnd.choice([6, 12, 40, 90, 160])
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        for _ in range(rnd.randrange(1, members)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + n // 14)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                w = w[: len(w) - rnd.randrange(len(w) // 8 + 1)]
            docs.append(" ".join(w))
    docs += [" ".join([f"u{i}x{k}" for k in range(60)] + passage) for i in range(25)]
    ids = list(range(len(docs)))
    rnd.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs = odd(seed)
    assert sorted(run(spark, docs)) == sorted((i, *v) for i, v in op.brute_force(docs).items())


def test_large_rooms(spark):
    """Rooms split over several tasks, with chains that leave the pivot's neighbourhood."""
    rnd = random.Random(5)
    w = [f"c{i}" for i in range(120)]
    docs = []
    for i in range(60):  # each differs from the one before in one word, so the ends of the chain don't link
        w = list(w)
        w[i * 2] = f"n{rnd.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, t) for i, t in odd(9)]
    assert sorted(run(spark, docs, room=6)) == sorted((i, *v) for i, v in op.brute_force(docs).items())


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [(r["doc_id"], r["text"]) for r in t]
    assert sorted(run(spark, docs)) == sorted((i, *v) for i, v in op.brute_force(docs).items())


def test_repeated_ids_and_no_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    got = run(spark, [(4, text), (4, text), (None, text), (4, "other"), (None, "alone here"), (None, None)])
    assert sorted(map(str, got)) == sorted(map(str, [(4, 27, 4), (4, 27, 4), (None, 27, 4), (4, 1, 4), (None, 1, None), (None, 0, None)]))
    assert op.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_representatives(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(4, text, "a"), (2, text, "b"), (2, text, "b"), (9, "other words", "d"), (10, None, "e"), (11, "", "f"), (None, text, "g"), (None, "p q", "h"), (None, "r s", "i")]
    got = op.representatives(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got if r.text is not None), key=str) == sorted([(2, text), (9, "other words"), (11, ""), (None, "p q"), (None, "r s")], key=str)
    assert sorted(str(r.doc_id) for r in got) == ["10", "11", "2", "9", "None", "None"]


@pytest.mark.parametrize("percent", [85])
def test_pairs_meet(percent):
    """Every pair at the threshold shares a key, for sizes from one to hundreds."""
    rng = np.random.default_rng(3)
    classes = op.Classes(2000)
    for _ in range(400):
        n = int(rng.choice([1, 2, 5, 7, 13, 30, 60, 200, 600]))
        d = int(n * 0.16)
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(d):
            k = rng.random()
            if k < 0.4 and len(b) > 1:
                b = np.delete(b, rng.integers(len(b)))
            elif k < 0.6:
                b = np.append(b, rng.integers(1, 2**63, dtype=np.uint64))
            else:
                b[rng.integers(len(b))] = rng.integers(1, 2**63, dtype=np.uint64)
        b = np.unique(b)
        if op.linked(a, b):
            row, key = op.part_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), classes)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_tree_finds_all_links():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.integers(1, 2**63, 100, dtype=np.uint64)
        for _ in range(10):
            s = base.copy()
            s[rng.integers(0, 100, 5)] = rng.integers(1, 2**63, 5, dtype=np.uint64)
            sets.append(np.unique(s))
    points, sizes = np.stack([op.counts_of(s) for s in sets]), np.array([len(s) for s in sets])
    tree = op.RTree(points, sizes)
    assert len(tree.levels) >= 1
    pruned = 0
    for i, s in enumerate(sets):
        near = set(tree.search(points[i], int(sizes[i])).tolist())
        pruned += len(sets) - len(near)
        assert {j for j, t in enumerate(sets) if op.linked(s, t)} <= near
    assert pruned > 0.5 * len(sets) ** 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300), (-5, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: -5, 200: -5, 150: -5}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def replaced_passages(words=200):
    """Pairs whose copies differ in one passage; the longer passages link by five words and 80 % only."""
    docs = []
    for i in range(24):
        w = [f"r{i}x{k}" for k in range(words)]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:50], *[f"s{i}x{k}" for k in range(i)], *w[50 + i :]]))]
    return docs


@pytest.mark.parametrize("shingle, percent", [(5, 80), (3, 70)])
def test_other_shingles_and_thresholds(spark, shingle, percent):
    docs = replaced_passages()
    docs += [(100 + i, t) for i, t in odd(2)]
    want = op.brute_force(docs, shingle, percent)
    assert want != op.brute_force(docs)
    for room in (op.ROOM, 6):
        assert sorted(run(spark, docs, room=room, shingle=shingle, percent=percent)) == sorted((i, *v) for i, v in want.items())
    kept = op.representatives(spark.createDataFrame(docs, "doc_id long, text string"), shingle=shingle, percent=percent).filter("text is not null").collect()
    texts = dict(docs)
    assert {r.doc_id for r in kept} == {c for _, c in want.values() if texts[c] is not None}
