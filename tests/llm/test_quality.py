import re
from collections import Counter

import pyarrow.parquet as pq

from sedgework.llm import quality as op

ODD = [None, "", " \n\t", "a", "a a a a a", "x\nx\n x\n\n\nx", "a b c a b c b c a", "#*$%&|<> é#", "A B C!", "w " * 3000, "a\x0bb\x0cc\rd", "one two three\n" * 100, "a b c d"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(spark):
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _w string")
    got = {r.doc_id: tuple(r[1:6]) for r in op.statistics(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)
    assert op.statistics(df.limit(0)).count() == 0


def test_learns_a_threshold_and_spares_clean_rows(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{i}x{k}" + ("###" if bad and k % 2 else "") for k in range(60 + i % 30)]
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(None, "short"), (1000, None), (5, rows[5][1])]
    labels += [(None, 0, 0), (5, 1, 0), (9, None, 0), (99999, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op.judge(docs, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert r.kept == (r.doc_id % 4 != 0) and not r.base_failed
        else:
            assert r.base_failed and not r.kept
    assert all(r.kept != r.base_failed for r in op.judge(docs, lab.limit(0)).collect())


def test_held_out_accuracy(spark):
    """Rules learned from one half of the labels agree with the other half where they reject."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = op.judge(docs, labels.filter("doc_id % 2 = 0"))
    held = judged.join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").filter("not base_failed")
    n, clean, clean_kept, bad, bad_dropped = held.selectExpr("count(*)", "sum(quality)", "sum(int(quality = 1 and kept))", "sum(1 - quality)", "sum(int(quality = 0 and not kept))").first()
    print("held out:", n, clean, clean_kept, bad, bad_dropped)
    assert clean_kept >= 0.97 * clean and bad_dropped >= 0.5 * bad
