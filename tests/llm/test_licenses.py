import random

import pyarrow.parquet as pq

from sedgework.llm import licenses as op


def near(seed):
    rnd = random.Random(seed)
    out = []
    for t in op.TEMPLATES.values():
        for _ in range(12):
            w = t.split()
            for _ in range(rnd.randrange(3)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randrange(2)] = ["changed"] * rnd.randrange(3)
            around = [f"x{rnd.randrange(999)}" for _ in range(rnd.randrange(150))]
            at = rnd.randrange(len(around) + 1)
            out.append(" ".join(around[:at] + w + around[at:]))
    return out


def test_equals_brute_force(spark):
    texts = [None, "", "license", "Released under the MIT", "RELEASED under-the\nMIT   license!", *op.TEMPLATES.values(), " ".join(op.TEMPLATES.values()), "license " * 3000, *near(1)]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[4], "x", 1), (4, texts[4], "x", 1)], "doc_id long, text string, licenses string, _w int")
    got = op.scan(df).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: list(r.licenses) for r in got}
    for i, t in enumerate(texts):
        assert by[i] == op.brute_force(t), t
    assert by[None] == ["mit"]
    assert op.scan(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = op.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Arrow" not in plan


def test_cues_cover_matches():
    cues = set(op.cue_words(op.TEMPLATES))
    for t in op.TEMPLATES.values():
        w = op.words_of(t)
        sh = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert 100 * sum(not cues & set(s) for s in sh) < 80 * len(sh)


def test_recall_of_license_lines(spark):
    """Lines are found by plain words and not by the templates."""
    said = {"gpl-3.0": "GNU General Public", "mit": "MIT License", "apache-2.0": "Apache License", "cc-by-nc-4.0-short": "CC BY-NC 4.0"}
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()
    lined = [(t, [x for x in t.split("\n") if "icense" in x]) for t in texts if t and "icense" in t]
    got = op.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lined)], "doc_id long, text string")).collect()
    assert len(lined) > 200
    for r in got:
        for line in lined[r.doc_id][1]:
            (want,) = [name for name, words in said.items() if words in line]
            assert want in r.licenses, line


def test_forms_are_told_apart(spark):
    names = sorted(op.TEMPLATES)
    got = op.scan(spark.createDataFrame([(i, op.TEMPLATES[n]) for i, n in enumerate(names)], "doc_id long, text string")).collect()
    for r in got:
        # the header begins with the short notice
        assert list(r.licenses) == (["apache-2.0", names[r.doc_id]] if names[r.doc_id] == "apache-2.0-header" else [names[r.doc_id]])


def test_short_templates_are_retrieved_at_every_place(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(20_000):
        around = [f"x{rnd.randrange(10**6)}" for _ in range(60)]
        at = rnd.randrange(len(around) + 1)
        texts.append(" ".join([*around[:at], "Released under the MIT License.", *around[at:]]))
    got = op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("licenses != array('mit')")
    assert got.count() == 0


def test_short_templates_and_many_blocks(spark):
    known = {"two": "MIT License", **{f"t{i}": f"granted under license number{i} of the year number{i} to all" for i in range(30)}}
    rows = [(i, f"x y granted under license number{i} of the year number{i} to all z MIT License") for i in range(30)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (500, 7):
        got = {r.doc_id: r.licenses for r in op.scan(df, known, block=block).collect()}
        assert got == {i: op.brute_force(t, known) for i, t in rows} and got[3] == ["t3"] and got[100] == []
    assert op.scan(df, {"two": "MIT License"}).filter("size(licenses) > 0").count() == 0
