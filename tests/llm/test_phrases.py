import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgework.llm import phrases as ph

KIND = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, longest=5, top=2000):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found(spark, rows, least, **given):
    df = spark.createDataFrame(rows, KIND).withColumns({"phrase": F.lit("x"), "N": F.lit(1), "words": F.lit("w")})
    return sorted(map(tuple, ph.collocations(df, least=least, **given).collect()))


def texts(n, seed, vocabulary=12):
    r = random.Random(seed)
    words = ["a", "B", "cé", "b\x01", "中", "x-y", "Dé", "e" * 30][: vocabulary] + [f"w{i}" for i in range(max(0, vocabulary - 8))]
    seps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "!? ", "\r\n", ";:"]
    return [(i, "".join(r.choice(words) + r.choice(seps) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("least", [1, 4, 15])
def test_equals_brute_force(spark, least):
    rows = texts(60 if least == 1 else 200, least, 6 if least > 4 else 12)
    got = found(spark, rows, least, top=50)
    assert got == brute_force(rows, least, top=50) and len(got) > 20


def test_hot_passage_and_repeated_rows(spark):
    passage = "one two three four five six seven"
    rows = [(i, f"{passage}. x{i % 3} {passage} {passage}", "en") for i in range(40)] + texts(50, 8)
    rows += rows[:20]
    assert found(spark, rows, 30) == brute_force(rows, 30)


def test_odd_rows(spark):
    long = " ".join(random.Random(1).choice("abc") for _ in range(60_000))
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "z" * 400_000, "en"), (None, long, "en"), (5, "q q q q q q", ""), (6, "..,,", "en")]
    got = found(spark, rows, 3)
    assert got == brute_force(rows, 3) and {x[0] for x in got} == {"en", ""}
    assert found(spark, [], 3) == found(spark, rows[:4], 3) == []


def test_ranges_that_end_inside_a_prefix(spark):
    """A task's first and last paths are returned below the threshold, so that parts add up."""
    rows = sorted((["a", "b", "c", *tail], n) for tail, n in ((["d"], 3), (["d", "e"], 2), (["f"], 1), ([], 4)))
    rows += [(["a", "c", "d"], 1), (["a", "d", "d"], 7), (["b", "b", "b", "b"], 2)]
    import pyarrow as pa

    def grow(part):
        batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(part)), pa.array([w for w, _ in part], pa.list_(pa.string())), pa.array([n for _, n in part])], names=["lang", "words", "n"])
        c = Counter()
        for b in ph._grow(5)([batch]):
            for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                c[p] += n
        return c

    whole = {p: n for p, n in grow(rows).items() if n >= 5}
    assert whole == {"a b c": 10, "a b c d": 5, "a d d": 7}
    for cut in range(len(rows) + 1):
        both = grow(rows[:cut]) + grow(rows[cut:])
        assert {p: n for p, n in both.items() if n >= 5} == whole


def test_large_counts_are_exact(spark):
    big = 9 * 10**15
    df = spark.createDataFrame([("en", None, big)] + [("en", p, n) for p, n in (("a", big // 7), ("b", big // 11), ("a b", big // 13))], "lang string, phrase string, n long")
    got = ph._scored(df, 10).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big // 13, big // 7, big // 11, big, 1000 * (big // 13) * big // ((big // 7) * (big // 11)))]


def test_filter_lets_all_members_through(spark):
    rows = [(lang, f"w{i} é") for lang in ("en", "中") for i in range(500)]
    bits = ph._filter(spark.createDataFrame(rows, "lang string, phrase string"))
    for lang in ("en", "中"):
        assert ph._may(bits, lang, [p.encode() for x, p in rows if x == lang]).all()
    assert ph._may(bits, "fr", [f"w{i} é".encode() for i in range(500)]).sum() < 5


@pytest.mark.parametrize("name", ["WORDS", "BYTES"])
def test_words_that_are_too_many_for_a_dictionary(spark, monkeypatch, name):
    monkeypatch.setattr(ph, name, 3)
    rows = texts(80, 4)
    assert found(spark, rows, 6) == brute_force(rows, 6)


def test_words_that_share_a_bit_of_the_filter_are_told_apart(spark, monkeypatch):
    """All words and pairs pass the filters: only work grows."""
    monkeypatch.setattr(ph, "_filter", lambda phrases: np.full(ph.BITS // 64, 2**64 - 1, np.uint64))
    rows = texts(80, 5)
    assert found(spark, rows, 6) == brute_force(rows, 6)
