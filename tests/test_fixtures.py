"""Small fixtures of the operators that SQL can't express, and edge cases of those that it can."""

import json

from pyspark.sql import functions as F

from sedgework.functions import html as H
from sedgework.functions import scheduling, text, urls, verdicts
from sedgework.functions import filters as P
from sedgework.operators import events, evidence, ledger, recovery
from sedgework.operators.dedup import content_duplicates
from sedgework.sources import files as S

A, B = "a" * 32, "b" * 32
PAGE = f"""<nav><a href="/home">Home</a></nav><table><tr><th>Title</th></tr>
<tr><td><a href="edition.php?id=5">Handbook</a> <a href="/ads.php?md5={A}">[1]</a><a href="http://lib.example/main/{A}">[2]</a>
<a href="http://other.example/book/123">3</a><a href="http://other.example/book/123#duplicate">[3]</a><a href="/file/9">4</a>
<a href="/?req=author">Author</a><a href="javascript:x()">[5]</a><a href="#top">[6]</a></td></tr>
<tr><td><a href="edition.php?id=6">Handbook</a><a href="/ads.php?md5={B}">[1]</a><a href="http://unrelated.example/x">mirror</a></td></tr></table>"""


def test_mirror_rows():
    rows = H.mirror_rows(PAGE, "http://site.example/search", ("lib.example",), ("site.example",))
    assert len(rows) == 2
    a = rows[0]["mirrors"]
    assert a[0] == f"http://lib.example/main/{A}" and len(a) == len(set(a)) == 5
    assert not any(x in link for link in a for x in ("req=", "javascript", "#", "/home"))
    nested = f"<table><tr><td>{PAGE}</td></tr></table>"
    assert H.mirror_rows(nested, "http://site.example/search", ("lib.example",), ("site.example",)) == rows
    assert H.mirror_rows("", "") == H.mirror_rows(None, "") == []


def test_document_rows_take_the_next_link_if_the_first_is_taken():
    page = "<table><tr><td><a href='/a'>First</a></td></tr><tr><td><a href='/a'>Again</a><a href='/b'>7</a></td></tr><tr><td><a href='/?req=1'>n</a></td></tr></table>"
    got = H.document_rows(page, "http://h.example/")
    assert [(d["title"], d["link"]) for d in got] == [("First", "http://h.example/a"), ("Again 7", "http://h.example/b")]


def test_linearize_and_download_links():
    assert H.linearize("<table><tr><th>A</th><td>x <a href='/l'>go</a></td></tr></table><script>no</script>") == "A | x go go (/l)"
    assert H.linearize("<p>only <b>text</b></p><style>s</style>") == "only text"
    base = "http://h.example/p"
    assert H.download_links("<a href='x.pdf'>paper</a><a href='?md5=1'>m</a>", base) == ["http://h.example/x.pdf"]
    assert H.download_links("<a href='?md5=1'>m</a><a href='/o'>o</a>", base) == ["http://h.example/p?md5=1"]
    assert H.download_links("""<a href='/o'>o</a><button onclick="go('/download/1')">b</button>""", base) == ["http://h.example/download/1"]


def test_tables_of_pages(spark):
    df = spark.createDataFrame([(1, PAGE, "http://site.example/"), (2, None, None)], "id long, html string, base_url string")
    got = H.extract_mirror_rows(df, ["id"], first_hosts=("lib.example",), own_hosts=("site.example",)).collect()
    assert [(r.id, r.row_no) for r in got] == [(1, 0), (1, 1)]
    assert H.extract_document_rows(df, ["id"]).count() == 2
    assert [r[0] for r in df.select(H.linear_text("html")).collect()][1] == ""


def test_urls(spark):
    cases = [("http://h.example/a/b?x=1#f", "c"), ("http://h.example", "c?d#e"), ("http://h.example/a/", "//o.example/z"), ("http://h.example/a/b?q", "?r"), ("http://h.example/a", "/root"), ("http://h.example/a", "HTTPS://x.example/")]
    df = spark.createDataFrame(cases, "base string, href string").select(urls.absolutize(F.col("base"), F.col("href")))
    assert [r[0] for r in df.collect()] == ["http://h.example/a/c", "http://h.example/c?d", "http://o.example/z", "http://h.example/a/b?r", "http://h.example/root", "HTTPS://x.example/"]
    pairs = [("http://H.example/p?b=2&a=1&utm_source=x&ts=3#f", "http://h.example/p?a=1&b=2"), ("http://h.example/p", "http://h.example/p"), ("http://u:p@h.example:80/p?_=1", "http://h.example:80/p")]
    df = spark.createDataFrame(pairs, "u string, want string").select(urls.route_key(F.col("u")), "want")
    assert all(r[0] == r[1] for r in df.collect())
    none = F.expr("cast(array() as array<string>)")
    ids = spark.createDataFrame([(f"http://a.example/get?md5={A.upper()}", "t1"), (f"http://b.example/main/{A}", "t2"), ("http://c.example/x?b=1&a=2&e=#z", "My  Title"), ("HTTP://C.example/x?a=2&b=1", " my title ")], "u string, t string")
    got = [r[0] for r in ids.select(urls.document_identity(F.col("u"), none, F.col("t"))).collect()]
    assert got[0] == got[1] == f"md5:{A}" and got[2] == got[3] and got[2].startswith("source-sha256:") and len(got[2]) == 46


def test_json_of_responses(spark):
    body = '{"a": 1}'
    raw = [body, f"```json\n{body}\n```", f"x ```JSON {body}```", f"```\r\n{body}\r\n```", f"```text\nno\n```\n```json\n{body}\n```", "```json\n{bad\n```\n```\n{}\n```", "prose", None, ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", verdicts.clean_json(F.col("r")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == [body] * 5 + [None] * 4
    f = verdicts.first_value
    assert json.loads(f('x [1] [{"a": [1, {"b": "]"}]}] y', list)) == [{"a": [1, {"b": "]"}]}]
    assert f("[{bad}] then []", list) == "[]" and f("nothing", list) == "[]" and f(None, list) == "[]"
    assert json.loads(f('[1, {"x": "`}`"}] {', dict)) == {"x": "`}`"} and f("[]", dict) is None


def test_verdict_table(spark):
    rows = [(True, 93, "good", False, None, None, "APPROVED"), (True, 20, "good", False, None, None, "PENDING"), (False, 20, "good", False, None, None, "REJECTED"), (False, 20, "weak", False, None, None, "PENDING"), (False, 90, "good", False, None, None, "PENDING"),
            (True, 93, "good", True, True, True, "APPROVED"), (True, 93, "good", True, False, True, "REJECTED"), (True, 93, "good", True, True, None, "PENDING")]
    df = spark.createDataFrame(rows, "a boolean, s int, q string, req boolean, i boolean, r boolean, want string")
    c = F.col
    got = df.select(verdicts.status_of(c("a"), c("s"), F.lit(None).cast("boolean"), c("q"), F.lit("HIGH"), c("req"), c("i"), c("r")), "want").collect()
    assert all(r[0] == r[1] for r in got)
    scores = spark.createDataFrame([("93.7",), ("-4",), ("400",), ("x",), (None,)], "s string").select(verdicts.clamp_score(F.col("s")))
    assert [r[0] for r in scores.collect()] == [93, 0, 100, 0, 0]


def test_relevance(spark):
    args = ("owner", ("90.1", "15"), ("fundamentals",), ("heat", "pump", "owner"))
    rows = [("", "x" * 60, False), ("Standard 90.1", "owner " + "x" * 60, True), ("", None, True), ("", "short", True), ("standard-15.pdf", "owner " + "y" * 60, True), ("Owner Handbook Fundamentals", "z" * 60, True), ("", "owner heat " + "z" * 60, True), ("", "owner " + "z" * 60, False)]
    df = spark.createDataFrame(rows, "t string, x string, want boolean").select(P.relevant(F.col("t"), F.col("x"), *args), "want")
    assert all(r[0] == r[1] for r in df.collect())


def test_names(spark):
    df = spark.createDataFrame([("  A/B: c  d. ",), ("???",), ("x" * 300,)], "t string").select(text.safe_filename(F.col("t"), F.lit(3), F.lit(12)))
    got = [r[0] for r in df.collect()]
    assert got[:2] == ["page_003_012_A_B__c_d.pdf", "page_003_012_document.pdf"] and len(got[2]) == 13 + 100 + 4
    p = spark.createDataFrame([("page_004_005_x.pdf", None), ("other.pdf", None), ("page_004_005_x.pdf", 9)], "f string, p int").select(text.provenance(F.col("p"), F.lit(None).cast("int"), F.col("f")).alias("s")).select("s.*")
    assert [tuple(r) for r in p.collect()] == [(4, 5), (None, None), (4, 5)]  # both from one place


def test_states_of_a_job(spark):
    """A job that always fails with bytes: two hand-offs, then the next attempt, and so to the end."""
    seen, a, h = [], 1, 0
    for _ in range(4):
        df = spark.createDataFrame([(a, h)], "a int, h int").select(scheduling.next_state(F.lit("failed"), F.lit(True), F.col("a"), F.col("h"), F.lit(False)).alias("n")).select("n.*")
        state, a, h = df.first()
        seen.append((state, a, h))
    assert seen == [("HANDOFF_READY", 1, 1), ("HANDOFF_READY", 1, 2), ("RECOVERY_READY", 2, 0), ("HANDOFF_READY", 2, 1)]


def test_recovery_limits(spark):
    jobs = spark.createDataFrame([(1, "PARTIAL", 10, 5, 2), (2, "QUEUED", 0, 9, 1), (3, "FAILED", 99, 1, 5), (4, "DOWNLOADING", 50, 1, 5)], "o_orderkey long, status string, part long, updated long, attempt int")
    assert [(r.o_orderkey, r.next_attempt) for r in recovery.recovery_plan(jobs, 10).collect()] == [(4, 5), (1, 3), (2, 1)]
    assert recovery.recovery_plan(jobs, 0).count() == 0 and [r.o_orderkey for r in recovery.exhausted(jobs).collect()] == [3]


def test_evidence_of_a_late_page(spark):
    pages = "front matter " * 4000 + " geothermal cooling report"
    df = spark.createDataFrame([(1, pages), (2, ""), (3, None)], "doc_id long, text string")
    got = evidence.evidence(df, {"q": ("geothermal", "cooling")}).collect()
    assert len(got) == 1 and "geothermal" in got[0].evidence[:1500] and len(got[0].evidence) <= 12000


def test_dedup_has_no_cycles(spark):
    df = spark.createDataFrame([(i, "same") for i in range(5)] + [(9, None), (10, None)], "doc_id long, text string")
    got = {r.doc_id: (r.canonical_id, r.is_duplicate) for r in content_duplicates(df.filter("text is not null"), "doc_id", "text").collect()}
    assert got == {0: (0, False)} | {i: (0, True) for i in range(1, 5)}


def test_ledger_merge_and_lifecycle(spark):
    log = [("f", 1, "QUEUED", None, "slow", False), ("f", 2, None, 10, None, False), ("f", 3, "COMPLETED", None, None, True), ("g", 1, "PARTIAL", 5, "x", False)]
    df = spark.createDataFrame(log, "k string, seq int, status string, bytes long, reason string, clears boolean")
    got = {r.k: tuple(r)[1:] for r in ledger.current(df, "k", ["seq"], ["status", "bytes", "reason"], {"reason": "clears"}).collect()}
    assert got == {"f": ("COMPLETED", 10, None), "g": ("PARTIAL", 5, "x")}


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "approved").mkdir()
    for name in ("d/B.pdf", "d/a.pdf", "approved/c.pdf", "d/n.txt"):
        (tmp_path / name).write_bytes(b"%PDF-" + b"x" * 300)
    files = S.list_files(spark, str(tmp_path))
    reports = spark.createDataFrame([(files.filter("path like '%a.pdf'").first().path, None, True)], "filepath string, stored_path string, stage2_completed boolean")
    todo = S.files_to_validate(files, reports).collect()
    assert [r.path.rsplit("/", 1)[1] for r in todo] == ["B.pdf"] and todo[0].size == 305
    book = {"downloads": {"f.pdf": {"status": "COMPLETED", "size": 3, "candidate": {"title": "T", "mirrors": ["m"]}}, "g.pdf": {"status": "PARTIAL"}}}
    (tmp_path / "ledger.json").write_text(json.dumps(book))
    (tmp_path / "broken.json").write_text("{nope")
    got = {r.filename: r for r in S.read_ledger(spark, str(tmp_path / "ledger.json")).collect()}
    assert got["f.pdf"].candidate.title == "T" and got["g.pdf"].status == "PARTIAL" and S.read_ledger(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "proxies.txt").write_text("# c\n\n http://p:1 \nhttp://q:2\n")
    assert [r.line for r in S.read_lines(spark, str(tmp_path / "proxies.txt")).collect()] == ["http://p:1", "http://q:2"]
    S.write_reports(spark.createDataFrame([("f.pdf", "q1", True), ("g.pdf", "q2", False)], "filename string, query string, approved boolean"), str(tmp_path / "reports"))
    assert [r.filename for r in spark.read.schema(S.REPORT).json(str(tmp_path / "reports")).filter("query = 'q1'").collect()] == ["f.pdf"]


def test_page_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    pages = spark.createDataFrame([("u1", "x" * 300), ("u2", "Access Denied" + "x" * 300), ("u3", "short")], "url string, html string")
    S.write_page_cache(pages, folder)
    S.write_page_cache(spark.createDataFrame([("u1", "y" * 300)], pages.schema), folder)
    got = S.read_page_cache(spark, folder).collect()
    assert [(r.url, r.html[0]) for r in got] == [("u1", "y")]
    assert S.read_page_cache(spark, folder, pages.filter("url = 'u2'").select("url")).count() == 0


def test_settings():
    s = S.Settings.parse("network:\n  max_workers: 50 # many\n  window_s: 1\n  stall_s: soon\n  min_pacing_s: 9\n")
    assert (s.max_workers, s.window_s, s.stall_s, s.min_pacing_s, s.max_pacing_s) == (5, 60, 60.0, 9.0, 9.0)
    assert S.check_run(0, 1, 5, 10, 60, 4, 300) == [] and len(S.check_run(3, 2, 50, 10, 15, 9, 10)) == 5


def test_queue_decisions(spark):
    from sedgework.operators.flows import queue_decisions

    row = lambda i, title: f"<tr><td><a href='/main/{i * 32}'>{title}</a></td><td>{'filler ' * 10}</td></tr>"
    page = "<table>" + row("a", "Heat pumps") + row("b", "Cooking") + row("a", "Heat pumps again") + row("c", "Heat known") + row("d", "Heat judged") + "</table>"
    df = spark.createDataFrame([(1, "http://h.example/s", page), (2, "http://h.example/s", page), (3, "http://h.example/s", "captcha " + page)], "page long, url string, html string")
    ids = lambda c: spark.createDataFrame([(f"md5:{c * 32}",)], "document_id string")
    got = queue_decisions(df, F.lower("title").contains("heat"), ids("d"), ids("c")).orderBy("item").collect()
    assert [(r.page, r.item, r.decision) for r in got] == [(1, 1, "QUEUE"), (1, 2, "STAGE1_REJECTED"), (1, 3, "STORED")]
    assert got[0].filename == "page_001_001_Heat_pumps.pdf"


def test_parser_and_event_stream(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"p1|p2")), ("b", bytearray(b""))], "path string, content binary")
    got = S.parse_documents(files, lambda c: [{"page": i, "text": t} for i, t in enumerate(bytes(c).decode().split("|")) if t], "page int, text string").collect()
    assert sorted(map(tuple, got)) == [("a", 0, "p1"), ("a", 1, "p2")]
    S.emit_events(spark.createDataFrame([("x", -3), ("y", None)], "kind string, count int"), str(tmp_path / "e"))
    q = S.event_stream(spark, str(tmp_path / "e"), "kind string, count int").writeStream.format("memory").queryName("emitted").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("emitted").collect())) == [("x", 0), ("y", 0)]


def test_deep_pages_are_read():
    deep = "<div>" * 50_000 + "<table><tr><td><a href='/main/x'>[1]</a> text</td></tr></table>" + "</div>" * 50_000
    assert H.tree(deep).text() == "[1] text"
    assert len(H.mirror_rows(deep, "http://h.example/")) == 1 and H.document_rows(deep, "http://h.example/")[0]["link"] == "http://h.example/main/x"
    assert H.download_links(deep, "http://h.example/") == ["http://h.example/main/x"]


def test_values_in_prose():
    f = verdicts.first_value
    assert f('{"a": [{"x": 1}]}', list) == "[]" and f('note {"a": [{"x": 1}]}', list) == '[{"x": 1}]'
    assert f('x {"a": "}"} y', dict) == '{"a": "}"}' and f("{bad} {}", dict) == "{}" and f("none", dict) is None
    assert verdicts.json_part("```json5\n5```") is None and verdicts.json_part("a ```[1]``` b") == "[1]" and verdicts.json_part(None) is None


def test_evidence_is_row_local(spark):
    """Documents are ranked inside their rows: no exchange; ties go to earlier chunks; characters outside the BMP count as one."""
    df = spark.createDataFrame([(1, "\U0001f600" * 1400 + "heat " * 300), (1, "heat"), (2, None), (3, "")], "doc_id long, text string")
    for op in (evidence.topk_in_rows, evidence.evidence):
        assert "Exchange" not in op(df, {"q": ("heat",)})._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.rank, r.chunk_no, r.score, len(r.chunk)) for r in evidence.topk_in_rows(df, {"q": ("heat",)}, k=2).collect())
    assert got == [(1, 1, 0, 1.0, 4), (1, 1, 1, 1.0, 1400), (1, 2, 2, 1.0, 100)]


def test_preview_rules(spark):
    """Short pages are listed, add nothing and don't end the sampling; the limit does; contents pages are marked."""
    long, short = "x" * 1300, " y "
    docs = {
        "late": [long, long, short, short, "Contents " + long, long],
        "full": ["x" * 12000, short, "table of contents " + long, long],
        "many": [short] * 12,
        "mark": ["x" * 400 + " contents", "x" * 400 + " Table of Contents", None],
    }
    rows = [(k, i + 1, t) for k, ts in docs.items() for i, t in enumerate(ts)]
    got = {r.k: tuple(r)[1:] for r in evidence.preview(spark.createDataFrame(rows, "k string, page int, body string"), "k", "page", "body").collect()}
    assert got == {
        "late": (3909, 3, "1,2,3,4,5", "5", "good"),
        "full": (12000, 1, "1,2,3", "3", "weak"),
        "many": (0, 0, "1,2,3,4,5,6,7,8,9,10", "", "empty"),
        "mark": (827, 2, "1,2,3", "2", "weak"),
    }


def test_progress_marks_over_batches(spark):
    """A key spread over many batches keeps its state; null keys are one key; events have a rule of their own."""
    mb = 1 << 20
    rows = [(1, 1, 0.0, 0, True), (1, 2, 0.4, mb, True), (1, 3, 0.6, 9 * mb, False), (1, 4, 0.7, 9 * mb, True), (1, 5, 1.2, 2 * mb, True), (1, 6, 1.3, 10 * mb, True), (1, 7, 3.4, 10 * mb, True), (None, 1, 5.0, 0, True), (None, 2, 5.1, 0, True)]
    df = spark.createDataFrame(rows, "k long, seq long, t double, offset long, ok boolean")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r.k, r.seq): (r.persist, r.emit) for r in events.progress_marks(df, "k").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [got[1, s] for s in range(1, 8)] == [(True, True), (False, False), (True, True), (True, False), (False, True), (True, False), (True, True)]
    assert got[None, 1] == (True, True) and got[None, 2] == (False, False)


def test_next_job_deadlines(spark):
    """A deferral counts no failure and waits 0.05 s, a recovery doubles its delay, given deadlines are kept."""
    rows = [("deferred", 1, 0, 7, None), ("failed", 2, 2, 3, None), ("failed", 2, 2, 3, 500.0), ("failed", 5, 2, 0, 500.0), ("success", 1, 0, 2, 9.0)]
    df = spark.createDataFrame(rows, "o string, a int, h int, f int, u double").coalesce(1)
    n = scheduling.next_job(F.col("o"), F.lit(True), F.col("a"), F.col("h"), F.lit(False), F.col("f"), F.col("u"), F.lit(100.0), F.lit(None).cast("string"))
    got = [(r.state, r.attempt, r.failures, r.not_before) for r in df.select(n.alias("n")).select("n.*").collect()]
    assert got == [("DEFERRED_ROUTE", 1, 7, 100.05), ("RECOVERY_READY", 3, 4, 140.0), ("RECOVERY_READY", 3, 4, 500.0), ("PERMANENTLY_FAILED", 5, 1, 0.0), (None, 1, 2, None)]
