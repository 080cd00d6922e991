import hashlib
import re
from collections import Counter, defaultdict

import sentencepiece as spm

import corpus_pipeline as cp
from sedgework.llm import jaccard, mixing, quality, secrets, sentencepiece
from sedgework.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_python(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in quality.op7_quality_rules(spark, d).collect() if r.kept}
    seen = []
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, d), "test-stage")
        seen.append((docs.collect(), out.collect()))
        if name != cp.STAGES[-1][0]:
            assert out.columns == COLUMNS
        docs = out
    before, after = seen[0]
    assert {r.doc_id for r in after} == kept and set(after) <= set(before)
    before, after = seen[1]
    comp = jaccard.brute_force([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in comp.values()})
    before, after = seen[2]
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        hits = secrets.brute_force(texts[r.doc_id])[4]
        assert (r.text == texts[r.doc_id]) == (not hits) and r.n_chars == len(r.text)
        for _, a, b in (h.split(":") for h in hits.split(",") if h):
            assert texts[r.doc_id][int(a) : int(b)] not in r.text
    before, after = seen[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    have, taken = defaultdict(int), defaultdict(int)
    for r in before:
        have[r.source] += size(r.text)
    for r in after:
        taken[r.source] += size(r.text)
    times = Counter(r.doc_id for r in after)
    assert max(times.values()) <= 3 and set(after) <= set(before)
    total = sum(have.values())
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(have))}
    for s in have:
        fair = total * weight[s] / sum(weight.values())
        if fair < 3 * have[s]:
            assert taken[s] > 0.8 * fair
    before, after = seen[4]
    lib = spm.SentencePieceProcessor(model_file=sentencepiece.model_path())
    want = Counter((r.doc_id, len(i := lib.encode(r.text)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r in before)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == want


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "short", "en", None, 5), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 0), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == [3]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
