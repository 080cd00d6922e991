import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedgework.llm import tokenfiles as tf

PATH = tf.tokenizer_path()
LIB = Tokenizer.from_file(PATH)
KIND = "doc_id long, text string"


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, tf.END]


def written(spark, tmp_path, rows, **given):
    folder = f"{tmp_path}/tokens"
    return folder, tf.write(spark.createDataFrame(rows, KIND).withColumns({"ID": F.lit("x"), "file": F.lit(1)}), folder, PATH, **given)


def test_encoder_equals_the_library_on_random_texts():
    r, made = random.Random(5), tf.Encoder(PATH)
    letters = "aAzZ09.,;:!?'\"<|>- \t\n\x0b\x1f\u0085 cČ̸éÉßΣςİıK中𝒳#$%&sSdDﬁ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["<|endoftext|>A.", "x<|endoftext|", "It's J̌ H̱. THE END...", "", "a" * 50_000, "it. " * 20_000, "İ.ß,K;"]
    ids, n = made.encode([t.encode() for t in texts])
    want = [LIB.encode(t, add_special_tokens=False).ids for t in texts]
    assert made.splits and n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_forgetting_and_unknown_rules(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN", 5)
    made = tf.Encoder(PATH)
    for text in ("one two three four five six", "seven one", "two, two"):
        assert made.encode([text.encode()])[0].tolist() == ids_of(text)[:-1]
    made.splits = False
    ids, n = made.encode([b"one two", b"", b"three"])
    assert n.tolist() == [2, 0, 1] and ids.tolist() == LIB.encode("one two three").ids
    assert not tf._splits({"model": {"type": "BPE"}, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}})


def test_documents_span_frames_and_are_read_alone(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "Zyq,", "1999", "é"]) for _ in range(r.randint(0, 400)))) for i in r.sample(range(1000), 60)]
    folder, index = written(spark, tmp_path, rows)
    want, start = {}, 0
    for i, t in sorted(rows):
        want[i] = (start, ids_of(t))
        start += len(want[i][1])
    assert {x.id: (x.start, x.ids) for x in tf.read(spark, folder).collect()} == want
    some = spark.createDataFrame([(rows[0][0],), (rows[5][0],), (rows[5][0],), (-1,)], "id int")
    assert {x.id: x.ids for x in tf.read(spark, folder, some).collect()} == {i: want[i][1] for i in (rows[0][0], rows[5][0])}
    assert {x.id: x.crc for x in tf.checksums(spark, folder).collect()} == {i: zlib.crc32(np.array(w, "<u4").tobytes()) for i, (_, w) in want.items()}


def test_odd_rows(spark, tmp_path):
    rows = [(3, None), (None, "null id"), (1, ""), (2, "same"), (2, "same"), (2, "other"), (5, "long word " * 50_000)]
    folder, _ = written(spark, tmp_path, rows)
    got = tf.read(spark, folder).orderBy("start").collect()
    assert [x.id for x in got] == [None, 1, 2, 2, 2, 3, 5]
    assert [x.start for x in got] == np.cumsum([0, *(x.n for x in got)])[:-1].tolist()
    assert sorted(x.ids for x in got if x.id == 2) == sorted(map(ids_of, ["same", "same", "other"]))
    assert got[5].ids == [tf.END] and got[-1].ids == ids_of("long word " * 50_000)


def test_empty_table(spark, tmp_path):
    folder, index = written(spark, tmp_path, [])
    assert index.count() == tf.checksums(spark, folder).count() == tf.read(spark, folder).count() == 0


class Sink:
    def __init__(self):
        self.data = b""

    def write(self, b):
        self.data += b

    def close(self):
        pass


def test_file_format_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "FRAME", 100)
    sink, ids = Sink(), np.arange(1050, dtype=np.uint32) * 7919
    w = tf.Writer(sink)
    for part in np.split(ids, [3, 3, 250, 900]):
        w.write(part)
    w.close()
    assert zstandard.ZstdDecompressor().stream_reader(sink.data, read_across_frames=True).read() == ids.astype("<u4").tobytes()  # any reader can
    path = tmp_path / "f"

    def reader(data):
        path.write_bytes(data)
        return tf.Reader(pafs.LocalFileSystem().open_input_file(str(path)), "f")

    r = reader(sink.data)
    assert len(r.packed) == 11 and r.first[-1] == 1050
    assert np.concatenate(list(r.ids(420, 30))).tolist() == ids[420:450].tolist() and r.frames_read == 1
    assert np.concatenate(list(r.ids(99, 102))).tolist() == ids[99:201].tolist() and r.frames_read == 4
    assert list(r.ids(5, 0)) == []
    with pytest.raises(ValueError, match="holds 1050"):
        list(r.ids(1000, 51))
    broken = bytearray(sink.data)
    broken[int(r.place[4]) + 20] ^= 1
    bad = reader(bytes(broken))
    assert np.concatenate(list(bad.ids(0, 300))).tolist() == ids[:300].tolist()
    with pytest.raises(ValueError, match="frame 4 of f"):
        list(bad.ids(410, 5))
    for cut in (sink.data[:-1], b"", sink.data[:200], sink.data[50:]):
        with pytest.raises(ValueError, match="seek table"):
            reader(cut)


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, tf.op12_token_files(spark, d).collect()))
    want, start = [], 0
    for i, t in sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()):
        ids = ids_of(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
