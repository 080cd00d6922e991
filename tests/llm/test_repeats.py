import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sedgework.llm import hashing as H
from sedgework.llm import repeats as op


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, kept string").repartition(3)
    return [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in op.dedup(df, **more).collect()]


def odd(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(30)]
    passage = [rnd.choice(vocab) for _ in range(55)]
    docs = []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(90))]
        if i % 3 == 0:
            a = rnd.randrange(20)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage[a : a + rnd.randrange(15, 40)]
        docs.append((i * 7 % 60 + 100, rnd.choice(" \n\t\x0b").join(w)))
    docs += [(1, "a " * 300), (2, "a b " * 60), (3, None), (4, ""), (5, " ".join(passage)), (6, " ".join(passage[:20])), (7, " ".join(passage[:19])), (0, "a " * 10)]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 900)
    docs = odd(seed)
    assert sorted(run(spark, docs, groups=5)) == sorted((i, *v) for i, v in op.brute_force(docs).items())


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [(r["doc_id"], r["text"]) for r in t]
    assert sorted(run(spark, docs)) == sorted((i, *v) for i, v in op.brute_force(docs).items())


def test_repeated_ids_and_no_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    got = run(spark, [(1, text), (1, text), (None, text), (1, "other " + text)])
    assert sorted(((str(g[0]), g[2]) for g in got)) == [("1", 0), ("1", 0), ("1", 30), ("None", 30)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.dedup(df).count() == 0


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["a bb  ccc\n", "", "ccc", " é bb", "x" * 100, "a"]
    h, n = H.words([t.encode() for t in texts])
    assert n.tolist() == [3, 0, 1, 2, 1, 1]
    alone = np.concatenate([H.words([w.encode()])[0] for t in texts for w in t.split()])
    assert (h == alone).all() and len(set(h.tolist())) == 5  # a, bb, ccc, é, x...
    assert (H.words([b"ABC d"], lower=True)[0] == H.words([b"abc D"], lower=True)[0]).all()
    x = np.array([5, 3, 3, 9, 1, 7, 1], np.uint64)
    least, at = H.window_min(x, 3)
    assert least.tolist() == [3, 3, 1, 1, 1] and at.tolist() == [1, 1, 4, 4, 4]


def test_windows_that_share_a_prefix_and_40_bits_stay_apart(monkeypatch):
    """All windows hold the same least gram, and their hashes differ above 40 bits only."""
    texts = [" ".join([*[f"a{i}x{k}" for k in range(8)], "p", "q", "r", "s", *[f"b{i}x{k}" for k in range(8)]]) for i in range(4)]
    suffixes = op._suffixes

    def alike(*args):
        prefix, window, row, start, offset = suffixes(*args)
        return np.zeros_like(prefix), (window & H.U(0xFFFFFF0000000000)) | H.U(7), row, start, offset

    monkeypatch.setattr(op, "_suffixes", alike)
    run = op._pack(1)
    sent = [b for i, t in enumerate(texts) for b in run([pa.record_batch([pa.array([i]), pa.array([i]), pa.array([t])], names=["doc", "tag", "text"])])]
    assert len(sent) == 4
    assert list(op._subtrees(sent)) == []
    again = list(op._subtrees([*sent, *run([pa.record_batch([pa.array([9]), pa.array([9]), pa.array([texts[2]])], names=["doc", "tag", "text"])])]))
    assert [b.to_pylist() for b in again] == [[{"doc": 9, "tag": 9, "start": 0, "n": 1}]]


@pytest.mark.parametrize("groups", [1, 7])
def test_lengthened_prefixes_change_no_result(spark, groups):
    """``hot`` of 0 lengthens the prefix of every suffix: equal windows still meet, within and between texts."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(45))
    docs = [(i, " ".join([*(rng.choice("abc") for _ in range(rng.randint(0, 40))), passage, *(f"w{i}x{k}" for k in range(20))])) for i in range(30)] + [(40, None), (41, "")]
    want = sorted((i, *v) for i, v in op.brute_force(docs).items())
    assert sorted(run(spark, docs, hot=0, groups=groups)) == want == sorted(run(spark, docs, groups=groups))


def test_a_frequent_gram_is_spread_over_groups(spark):
    """All windows hold one gram, the least of all, and differ: counted as too many, they leave its group."""
    pool = [f"p{k}" for k in range(100_000)]
    grams = H.grams(H.words([" ".join(pool).encode()])[0], op.SEED)
    at = int(np.argmin(grams))
    texts = [" ".join([*(f"a{i}x{k}" for k in range(16)), *pool[at : at + 4], *(f"b{i}x{k}" for k in range(16))]) for i in range(400)]
    bucket, windows = int(op._bucket(grams[at : at + 1])[0]), 400 * 17
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    size, longer = op.long_prefixes(df, windows - 1)
    assert size == sum(len(t.encode()) for t in texts) and np.flatnonzero(longer).tolist() == [bucket]
    assert not op.long_prefixes(df, windows)[1].any()

    def groups(longer):
        batch = pa.record_batch([pa.array(range(400)), pa.array([0] * 400), pa.array(texts)], names=["doc", "tag", "text"])
        (out,) = op._pack(50, longer)([batch])
        return [len(w) // 8 for w in out.column("windows").to_pylist()]

    assert groups(None) == [windows]
    spread = groups(longer)
    assert sum(spread) == windows and len(spread) == 50 and max(spread) < 2 * windows / 50
