import html as entities
import re

import pyarrow.parquet as pq

from sedgework.llm import htmltext as op


def expected(page):
    """The pages' template read by hand: h1 and paragraphs of the article."""
    art = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"<h1>|</h1>|<p>|</p>", art)
    parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<br>", " ", p).replace("<b>", "").replace("</b>", ""))).strip() for p in parts]
    return "\n".join(p for p in parts if p)


def test_pages(spark):
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    want = {r["page_id"]: expected(r["html"]) for r in rows}
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = op.extract(df).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def text(page):
    return "\n".join(op.main_blocks(page)[0])


def test_structure():
    assert text("<article><h1>A &amp; B</h1><p>x<br>y <b>z</b>w<p>next<div class='ad-box'>buy<p>now</div>tail<ul><li>1<li>2</ul></article>") == "A & B\nx y zw\nnext\ntail\n1\n2"
    assert text("<body><nav>m</nav><main><h1>T</h1><aside>s</aside><p>q</main><p>out</body>") == "T\nq"
    assert text("<main>m<article>a<section id=comments><p>c</section><!-- x <p>y --></article></main>") == "a"
    assert text("<article>a<script>if (a</p>b) {}</script>b<style>x</style>c</article>") == "abc"
    assert text("<article>1 < 2 &lt; 3 &#233;&nbsp;x</article>") == "1 < 2 < 3 é x"
    assert text("<article><p>cut off<b") == "cut off"
    assert text("<article><p>open <script>never closed") == "open"
    assert text("<p class=notice>n<p>kept") == "kept"
    assert text("<article><p>a</b></span></p></div>b</article>after") == "a\nb"
    assert op.main_blocks(None) == ([], False) and op.main_blocks("<nav>x</nav>") == ([], False)
    assert text("<form>a</form><table><tr><td>c1<td>c2<tr><td>c3</table>") == "c1\nc2\nc3"
    assert text("<a title='>x'>k</a>") == "k"
    assert len(text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_host_suffix_array(spark):
    menu = "<div>Home About Products Contact</div><div>Latest news from our great town every day</div>"
    legal = "<div>All rights reserved by the owners of this fine site since long ago</div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{menu}<p>unique story number{i} with words w{i}a w{i}b w{i}c.</p>{legal}</body></html>") for i in range(9)]
    rows += [(20, "http://other.example/", f"<body>{menu}<p>elsewhere</p></body>"), (21, None, f"<body>{menu}</body>"), (22, "http://h.example/22", None), (23, "x", "")]
    rows += [(30 + k, "http://copy.example/", "<p>the same whole page in two copies is not boilerplate at all</p>") for k in range(2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    for groups in (5000, 2):
        got = {r.page_id: r.text for r in op.extract(df, group_pages=groups).collect()}
        for i in range(9):
            assert got[i] == f"unique story number{i} with words w{i}a w{i}b w{i}c."
        assert got[20] == "Home About Products Contact\nLatest news from our great town every day\nelsewhere"
        assert got[22] == got[23] == "" and got[30] == got[31] and got[30].startswith("the same")
        assert len(got) == len(rows)
    assert op.extract(df.limit(0)).count() == 0


def test_near_copies_keep_their_text(spark):
    menu = "<div>Home About Products Contact and the latest news from our great town</div>"
    story = " ".join(f"word{k}" for k in range(60))
    pages = [story, story.replace("word30", "changed"), *(" ".join(f"p{i}x{k}" for k in range(60)) for i in range(3))]
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}<p>{t}</p></body>") for i, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for groups in (5000, 2):
        assert {r.page_id: r.text for r in op.extract(df, group_pages=groups).collect()} == dict(enumerate(pages))


def test_pages_without_an_article_by_labels(spark):
    """Pages whose blocks are labelled: of those without a bounding element exactly the stories stay."""
    import random

    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(400)) for _ in range(n))
    rows, want = [], {}
    for h in range(4):
        menu, foot, quote = say(12), say(25), say(15)
        for i in range(12):
            k, story = len(rows), [say(rnd.randrange(20, 60)) for _ in range(2)]
            if h == 3:  # only three streams show the menu: two in navigation of pages with an article, one without
                bound = i != 5
                chrome = menu if i in (3, 4, 5) else say(12)
            else:
                bound, chrome = i % 3 == 0, menu
            if i < 5:
                story.insert(1, quote)  # quoted in articles too, so it is text
            body = "".join(f"<p>{s}</p>" for s in story)
            page = f"<nav>{chrome}</nav><article>{body}</article><footer>{foot}</footer>" if bound else f"<div>{chrome}</div>{body}<div>{foot}</div>"
            rows.append((k, f"http://h{h}.example/{i}", page))
            want[k] = "\n".join(story)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for groups in (5000, 3):
        assert {r.page_id: r.text for r in op.extract(df, group_pages=groups).collect()} == want


def test_brute_force_of_repeated_runs():
    import random

    rnd = random.Random(3)
    streams = [[rnd.choice("ab") for _ in range(rnd.randrange(5, 40))] for _ in range(12)]
    rows, whose = [], {}
    for r, t in enumerate(streams):
        main = r == 11
        for i in range(len(t) - op.RUN + 1):
            whose.setdefault(tuple(t[i : i + op.RUN]), []).append((r, i, main))
    want = {(r, i) for found in whose.values() if len({tuple(streams[r]) for r, _, _ in found}) >= op.STREAMS and not any(m for *_, m in found) for r, i, _ in found}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * 12), pa.array([1] * 12), pa.array([None if r == 11 else r for r in range(12)], pa.int64()), pa.array([r == 11 for r in range(12)]), pa.array([None] * 12, pa.int64()), pa.array([[" ".join(t)] for t in streams])], names=["host", "groups", "row", "main", "whole", "blocks"])
    got = [(r["row"], r["place"]) for b in op._sort(op._suffixes([batch])) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and want


def test_malformed_markup_takes_linear_time():
    import time

    began = time.time()
    for page in ("<a" * 50_000, '<a ">" ' * 20_000, "<div>" * 50_000 + "x" + "</span>" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<i>" * 25_000 + "<b>" * 25_000 + "</i>" * 25_000, "</" * 100_000, "<" * 100_000):
        op.blocks(page)
    assert time.time() - began < 20
