import hashlib
import zlib

import pytest

from sedgework.llm import matroska as mk


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1152, 576 * 8, 576 * 64 + 5, 400_000])
def test_round_trip(n):
    text = "aé" * (n // 3) + "b" * (n % 3)
    raw, payload = mk.padded(text)
    assert raw == len(text.encode()) and len(payload) % 576 == 0 and payload
    found, cues = mk.parse(mk.wrap(payload))
    media = mk.wrap(payload)
    assert b"".join(media[s:e] for _, _, s, e, _ in found) == payload
    assert [p[1] for p in found[::8]] == [i * 72 for i in range(0, len(found), 8)]
    assert len(cues) == -(-len(payload) // (576 * 64))
    assert all(media[at : at + 4] == mk.CLUSTER.to_bytes(4, "big") for _, _, at in cues)


@pytest.mark.parametrize("lacing", [mk.XIPH, mk.EBML_LACING])
@pytest.mark.parametrize("number", [mk.SIMPLE_BLOCK, mk.BLOCK])
def test_lacing(lacing, number):
    frames = [b"a" * 700, b"b" * 3, b"c" * 255, b"", b"d" * 90, b"e" * 1000]
    blk = mk.block(2, -5, frames, lacing, number)
    if number == mk.BLOCK:
        blk = mk._element(mk.BLOCK_GROUP, blk)
    body = mk._uint(mk.TIMESTAMP, 100) + blk
    for cluster in (mk._element(mk.CLUSTER, body), mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body):
        media = mk._HEAD + mk.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster
        found, _ = mk.parse(media)
        assert [media[s:e] for _, _, s, e, _ in found] == frames
        assert {(t, at) for t, at, *_ in found} == {(2, 95)}


def test_broken_containers():
    media = mk.wrap(mk.padded("x" * 5000)[1])
    for cut in range(0, len(media), 97):
        mk.parse(media[:cut])
    assert mk.parse(b"") == ([], []) and mk.parse(b"\0" * 50) == ([], [])


def test_query(spark):
    rows = [(1, "same", "c"), (2, "same", "c"), (3, None, "c"), (4, "", "c"), (5, "é" * 288, "c"), (None, "z", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in mk.digests(df).collect()}
    assert got[1][1:] == got[2][1:] and got[3][1:] == got[4][1:]
    assert got[5].n_bytes == got[5].payload_bytes == 576 and got[3].n_bytes == 0 and got[3].payload_bytes == 576
    pad = b"same" + b"\xff" * 572
    assert got[1].payload_sha256 == hashlib.sha256(pad).hexdigest() and got[1].tail_crc32 == zlib.crc32(pad[-32:])
    media = mk.store(df)
    table = mk.packets(media, "doc_id", "media")
    assert table.count() == 6 and {r.cue_ms for r in table.collect()} == {0}
    assert mk.digests(df.limit(0)).count() == 0


def test_times_of_laced_frames():
    media = mk.wrap(mk.padded("x" * 576 * 70)[1])
    assert [p[1] for p in mk.parse(media)[0]] == [i * 72 for i in range(70)]
    # a scale of 0.5 ms, no frame duration: the block's duration is shared
    blk = mk._element(mk.BLOCK_GROUP, mk.block(1, 20, [b"a", b"b", b"c", b"d"], mk.FIXED, mk.BLOCK) + mk._uint(mk.DURATION, 80))
    seg = mk._element(mk.INFO, mk._uint(mk.SCALE, 500_000)) + mk._element(mk.CLUSTER, mk._uint(mk.TIMESTAMP, 100) + blk)
    assert [p[1] for p in mk.parse(mk._HEAD + mk._element(mk.SEGMENT, seg))[0]] == [60, 70, 80, 90]
