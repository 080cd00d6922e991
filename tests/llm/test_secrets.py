import pyarrow.parquet as pq

from sedgework.llm import secrets as op

ODD = [
    None, "", "password=abc", "PassWord\"  : 'abcdef'", "toKen=abcdefgh", "api_key=abcdef apikey:ABCDEF1", "AKIA" + "A" * 15, "xAKIA" + "A" * 16 + "b",
    "deadbeef" * 3, "deadbee" * 3, "token=" + "0123456789abcdef" * 2, "é😀 secret: zzzzzz.", "token = x token=yyyyyy", "token token=abcdefghi", "passwordpassword=====", "f" * 100_000,
]


def test_equals_brute_force(spark):
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, texts[3], "a", "b"), (None, texts[3], "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string, findings string")
    got = op.scan(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), op.brute_force(t)[4]) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), ",".join(f"{f.kind}:{f.start}:{f.end}" for f in r.findings)) for r in got) == want
    assert op.scan(df.limit(0), ["doc_id"]).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", 1, "token=abcdefg"), ("b", 1, "token=abcdefg"), ("c", 1, "x")], "path string, version int, text string")
    op.update_ledger(first, ledger)
    assert op.read_ledger(spark, ledger).count() == 2
    more = first.union(spark.createDataFrame([("a", 2, "y"), ("d", 1, "x")], first.schema))
    got = op.scan(more, ["path", "version"], ledger=ledger).collect()
    assert op.read_ledger(spark, ledger).count() == 3 and len(got) == 5
    assert {(r.path, r.version) for r in got if r.findings} == {("a", 1), ("b", 1)}
    op.update_ledger(more, ledger, rules="next")
    assert op.read_ledger(spark, ledger).count() == 6


def test_redact(spark):
    rows = [(1, "é token=abcdefg end AKIA" + "Z" * 16), (2, None), (3, "clean"), (4, "token=" + "0123456789abcdef" * 2 + "!")]
    got = {r.doc_id: r.text for r in op.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "é [SECRET] end [SECRET]", 2: None, 3: "clean", 4: "[SECRET]!"}


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "token=abcdefg", "mine", 7, "b"), (1, "token=abcdefg", "mine", 7, "b")], "doc_id long, text string, _blob string, _FOUND int, blob string")
    got = op.redact(df).collect()
    assert [tuple(r) for r in got] == [(1, "[SECRET]", "mine", 7, "b")] * 2 and op.redact(df).columns == df.columns


def test_a_second_run_scans_nothing(spark, tmp_path):
    """Several versions of a path, and copies of them: only unseen pairs of blob and rule version are scanned."""
    ledger = str(tmp_path / "ledger")
    rows = [(f"p{i % 5}", i // 5, f"token=secret{i % 7}" if i % 3 else "clean") for i in range(40)]
    df = spark.createDataFrame(rows, "path string, version int, text string")
    first = op.scan(df, ["path", "version"], ledger=ledger).collect()
    blobs = op.read_ledger(spark, ledger).count()
    again = op.scan(df.union(df), ["path", "version"], ledger=ledger).collect()
    assert op.read_ledger(spark, ledger).count() == blobs == len({t for *_, t in rows})
    assert sorted(map(str, again)) == sorted(map(str, first * 2))
    assert all(bool(r.findings) == (t != "clean") for r in first for p, v, t in rows if (p, v) == (r.path, r.version))
