import hashlib

import pyarrow.parquet as pq
import pytest
import sentencepiece as spm

from sedgework.llm import sentencepiece as op

ODD = [None, "", " ", "   ", "a", "▁a b", " ▁ ▁▁", "<s> </s> <unk> <0x41>", "tab\there\nline\r\n", "日本語 😀 \u0000 x", "a  b   c    d " * 50, "ﬁ Å é", "x" * 5000, "  lead", "trail  "]


@pytest.fixture(scope="module")
def lib():
    return spm.SentencePieceProcessor(model_file=op.model_path())


def test_equals_library(lib):
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    m = op.load(op.model_path())
    for t in texts:
        want = lib.encode(t or "")
        assert m.encode(t) == want, t
        assert m.decode(want) == lib.decode(want)


def test_spans_cover_the_source():
    m = op.load(op.model_path())
    for t in ["hello big world", "é 日本 x", "a  b"]:
        spans = m.spans(t)
        assert [s[0] for s in spans] == m.encode(t)
        raw = t.encode()
        covered = set()
        for _, _, a, b in spans:
            covered |= set(range(a, b))
        assert covered == set(range(len(raw)))


def _trie(mapping):
    """A compiled map made by hand for single-byte keys and one two-byte key, by trying offsets."""
    import struct

    pool, units, at = b"", {}, {}
    for k, v in mapping.items():
        at[k] = len(pool)
        pool += v + b"\0"
    size = 4096
    root_off = 1024
    units[0] = root_off << 10
    free = 2048
    for c in {k[:1] for k in mapping}:
        node = root_off ^ c[0]
        leaf = c in mapping
        off = node ^ free
        units[node] = (off << 10) | (256 if leaf else 0) | c[0]
        if leaf:
            units[free] = 0x80000000 | at[c]
        for k in mapping:
            if len(k) == 2 and k[:1] == c:
                n2 = free ^ k[1]
                f2 = free + 256
                units[n2] = ((n2 ^ f2) << 10) | 256 | k[1]
                units[f2] = 0x80000000 | at[k]
        free += 512
    out = [units.get(i, 0) for i in range(size)]
    return struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *out) + pool


def test_longest_prefix_of_character_map():
    cm = op.CharMap(_trie({b"a": b"1", b"ab": b"long", b"z": b""}))
    assert cm.longest(b"abc", 0) == (2, b"long")
    assert cm.longest(b"ac", 0) == (1, b"1")
    assert cm.longest(b"zz", 1) == (1, b"")
    assert cm.longest(b"q", 0) is None
    m = op.Model(ids={}, scores=[], surface=[], byte_id=[], byte_of={}, kinds=[], charmap=cm, dummy_prefix=True, squeeze=True)
    normal, starts, ends = m.normalize("xab  z ac ")
    assert normal == "▁xlong▁1c"
    assert starts == [0, 0, 1, 1, 1, 1, 3, 7, 8]
    assert ends == [0, 1, 3, 3, 3, 3, 4, 8, 9]


def test_query(spark, lib):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, "   ", "again"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = op.digests(df, op.model_path()).collect()
    assert len(got) == len(rows)
    want = {t or "": lib.encode(t or "") for _, t, _ in rows}
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        ids = want[t or ""]
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    full = op.encode(df, op.model_path()).collect()
    assert {r.doc_id: list(r.ids) for r in full}[9] == want[ODD[9]]
    assert op.digests(df.limit(0), op.model_path()).count() == 0
