import random

import pytest
from pyspark.sql import functions as F

from sedgework.operators import ledger as L
from sedgework.sources.logtable import LogTable, last, written

NAMES = [f.split(" ")[0] for f in L.UPDATE.split(", ")]


def update(filename, seq, status, **given):
    row = dict.fromkeys(["filename", "seq", "ts", "status", "url", "size", "reason", "candidate", "document_attempt", "request_attempt", "completed", "retry_after_seconds", "validation_status", "technical_error_type", "technical_error_message"])
    return tuple((row | {"filename": filename, "seq": seq, "ts": 1000 + seq, "status": status} | given).values())


def candidate(**given):
    return tuple((dict.fromkeys(["document_id", "title", "query", "run_id", "mirrors", "stage1_status", "stage1_score", "source_page", "source_item"]) | given).values())


def simulated(updates):
    """The rules of a ledger transition, one update after the other."""
    state = {}
    for f, seq, ts, status, url, size, reason, cand, attempt, _, completed, wait, validation, kind, message in sorted(updates, key=lambda u: (u[0], u[1])):
        e = state.setdefault(f, {"bytes": 0, "began": cand is not None, "stage1": None, "progress": None, "noted": None, "validation": None, "error": None, "wait": None, "completed": None, "title": None, "url": "", "attempt": 0})
        e["status"], e["url"] = status, url or e["url"]
        if size is not None:
            e["progress"] = ts if size > e["bytes"] else e["progress"]
            e["bytes"] = size
        if completed is not None:
            e["completed"] = completed
        elif status.upper() == "COMPLETED":
            e["completed"] = True
        elif status.upper() in L.UNFINISHED:
            e["completed"] = False
        if wait is not None:
            e["wait"] = ts + max(0.0, wait)
        elif status.upper() == "COMPLETED":
            e["wait"] = None
        e["reason"], e["noted"] = reason or None, reason or e["noted"]
        e["validation"] = validation or e["validation"]
        e["attempt"] = e["attempt"] if attempt is None else attempt
        if kind:
            e["error"] = (kind[:80], (message or "")[:240], ts)
        if cand:
            e["title"], e["stage1"] = cand[1] or e["title"] or f, cand[5] or e["stage1"]
    out = {}
    for f, e in state.items():
        stage1, stage2 = e["stage1"] or ("APPROVED" if e["began"] else "PENDING"), e["validation"] or "PENDING"
        final = "ACCEPTED" if stage2 == "APPROVED" else stage2 if stage2 in ("REJECTED", "PDF_INVALID") else "STAGE1_REJECTED" if stage1 == "REJECTED" else "DOWNLOAD_FAILED" if e["status"].upper() == "PERMANENTLY_FAILED" else "IN_PROGRESS"
        out[f] = (e["status"], e["url"], e["bytes"], e["progress"], e["reason"], e["noted"], e["wait"], e["completed"], e["validation"], e["error"], e["title"], e["attempt"], stage1, final)
    return out


def view(rows):
    got = L.ledger_entries(rows).select("filename", "status", "url", "bytes_downloaded", "last_progress_time", "reason", "lifecycle.download.last_error", "retry_after_until", "completed", "validation_status", "technical_error", "title", "lifecycle.download.document_attempt", "lifecycle.stage1.status", "lifecycle.final_status").collect()
    return {r[0]: tuple(tuple(x) if isinstance(x, tuple) else x for x in r[1:]) for r in got}


def random_updates(n, seed):
    r, out = random.Random(seed), []
    for seq in range(n):
        given = {}
        for k, make in {"url": lambda: r.choice(["", "http://x/1"]), "size": lambda: r.randint(0, 20), "reason": lambda: r.choice(["", "bad"]), "candidate": lambda: candidate(title=r.choice([None, "", "t1", "t2"]), stage1_status=r.choice([None, None, "REJECTED", "APPROVED"]), mirrors=["m"]), "document_attempt": lambda: r.randint(1, 5), "completed": lambda: r.random() < 0.5, "retry_after_seconds": lambda: float(r.randint(-5, 9)), "validation_status": lambda: r.choice(["APPROVED", "REJECTED", "PDF_INVALID"]), "technical_error_type": lambda: "k" * r.randint(0, 100)}.items():
            if r.random() < 0.3:
                given[k] = make()
        if "technical_error_type" in given:
            given["technical_error_message"] = "m" * r.randint(0, 300)
        out.append(update(f"f{r.randint(0, 12)}", seq, r.choice(["QUEUED", "downloading", "Completed", "PERMANENTLY_FAILED", "odd"]), **given))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_in_batches_with_compactions_equals_one_update_after_the_other(spark, tmp_path, seed):
    updates = random_updates(240, seed)
    want = simulated(updates)
    whole = L.ledger_rows(spark.createDataFrame(updates, L.UPDATE))
    assert view(L.merged_ledger(whole)) == want
    table = L.ledger_table(spark, f"{tmp_path}/t")
    for k in range(3):
        assert table.append(L.ledger_rows(spark.createDataFrame(updates[80 * k : 80 * k + 80], L.UPDATE)), "w", k)
        if k == 1:
            table.compact("f1", "f5")
    assert view(table.rows()) == want
    assert not table.append(L.ledger_rows(spark.createDataFrame(updates[80:160], L.UPDATE)), "w", 1)
    table.compact()
    assert view(table.rows()) == want and table.version() == 5
    assert view(table.rows(1)) == simulated(updates[:80])
    assert view(table.rows(2)) == view(table.rows(3)) == simulated(updates[:160])
    assert set(view(table.rows(part=F.col("filename") == "f3"))) == {"f3"}


SIMPLE = "k string, v struct<seq:long,value:string>"


def simple(spark, folder):
    return LogTable(spark, str(folder), "k", SIMPLE, lambda rows: rows.groupBy("k").agg(last("v")))


def put(spark, table, rows, *batch):
    df = spark.createDataFrame(rows, "k string, seq long, x string")
    return table.append(df.select("k", written(F.col("x"), F.col("seq"), F.lit(True)).alias("v")), *batch)


def read(table, *version):
    return {r.k: r.v.value for r in table.rows(*version).collect()}


def test_empty_table_nulls_and_versions(spark, tmp_path):
    t = simple(spark, tmp_path / "t")
    assert t.version() == 0 and read(t) == {}
    put(spark, t, [(None, 1, "a"), ("b", 2, "b"), ("b", 3, None), ("", 4, "e")])
    assert read(t) == {None: "a", "b": None, "": "e"}
    t.compact(None, "b")
    t.compact("b")
    assert read(t) == {None: "a", "b": None, "": "e"}
    put(spark, t, [])
    assert t.version() == 4 and read(t, 1) == read(t)
    with pytest.raises(ValueError, match="no version"):
        t.rows(9)


def test_late_changes_lose_and_repeated_rows_do_no_harm(spark, tmp_path):
    t = simple(spark, tmp_path / "t")
    put(spark, t, [("a", 5, "new")] * 3)
    t.compact()
    put(spark, t, [("a", 4, "late"), ("c", 1, "c")])
    assert read(t) == {"a": "new", "c": "c"}


def test_hot_key_leaves_one_row_for_each_commit(spark, tmp_path):
    t = simple(spark, tmp_path / "t")
    put(spark, t, [("hot", i, str(i)) for i in range(5000)])
    put(spark, t, [("hot", 5000, "end")])
    assert t._live(None).count() == 2 and read(t) == {"hot": "end"}


def test_compacted_range_hides_only_itself_and_rows_without_a_commit_are_not_seen(spark, tmp_path):
    t = simple(spark, tmp_path / "t")
    put(spark, t, [(k, 1, k) for k in "abcdef"])
    put(spark, t, [(k, 2, k * 2) for k in "ace"])
    t.compact("b", "e")
    assert t._live(None).count() == 8 and read(t) == {k: k * 2 if k in "ace" else k for k in "abcdef"}
    spark.createDataFrame([("z", (9, "lost"))], SIMPLE).write.parquet(f"{tmp_path}/t/rows/half")  # a job that never committed
    assert "z" not in read(t)


def test_stream_that_starts_again_changes_nothing(spark, tmp_path):
    source, t = f"{tmp_path}/in", simple(spark, tmp_path / "t")
    prepare = lambda df: df.select("k", written(F.col("x"), F.col("seq")).alias("v"))

    def run(checkpoint):
        s = spark.readStream.schema("k string, seq long, x string").option("maxFilesPerTrigger", 1).parquet(source)
        q = s.writeStream.foreachBatch(t.sink("stream", prepare)).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    for i in range(3):
        spark.createDataFrame([("a", i, f"a{i}"), (f"k{i}", i, "x")], "k string, seq long, x string").coalesce(1).write.mode("append").parquet(source)
    run("c1")
    before, version = read(t), t.version()
    run("c1")  # nothing new
    run("c2")  # all batches again, as after a lost checkpoint
    assert read(t) == before == {"a": "a2", "k0": "x", "k1": "x", "k2": "x"} and t.version() == version == 3


def test_documents_keep_the_first_title_and_merge_metadata(spark, tmp_path):
    kind = "key string, seq long, title string, filename string, metadata map<string,string>"
    rows = [("d", 1, "", "f1", {"a": "1"}), ("d", 2, "first", "f2", {"b": "1"}), ("d", 3, "second", "f3", {"mirrors": "m", "a": "2"}), ("d", 4, None, "f4", None), ("e", 5, None, None, {})]
    t = L.documents_table(spark, f"{tmp_path}/t")
    for part in (rows[2:], rows[:2]):  # in any order
        t.append(L.document_rows(spark.createDataFrame(part, kind)))
    t.compact()
    got = {r.key: (r.title, r.filename, r.metadata) for r in L.document_entries(t.rows()).collect()}
    assert got == {"d": ("first", "f3", {"a": "2", "b": "1", "mirrors": "m"}), "e": ("", None, {})}
