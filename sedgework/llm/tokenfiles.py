"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds the ids of a run of documents, in ascending order of id, as little-endian unsigned 32-bit integers, cut into
frames of ``FRAME`` ids that are compressed on their own.  Its last frame is a skippable one with the seek table: for
each frame its compressed and plain size and a checksum of the plain bytes, then the number of frames, a flag byte and
a magic number.  Frames also carry zstandard's own checksum.  An index table beside the files tells each document's
file, first id and number of ids, so a reader fetches the seek table and decompresses only the frames that the wanted
documents touch; a damaged frame is an error that names it.

Documents are dealt to files by ranges of their id, and tasks write their file under a name of their own and move it
into place, so a task that runs again leaves the same file.  A task holds one slice of texts and one frame.

Encoding is the tokenizers library's.  Where the tokenizer's own rules show that stretches between white space, and a
letter or digit and the punctuation after it, never share a token (``_splits``), each distinct stretch is encoded once and
remembered (at most ``KNOWN`` of them, then the table starts anew); other tokenizers, and texts that may hold a special
token, are encoded whole.

Cases: null text counts as empty and holds the end id alone; null ids come first; repeated ids and rows are documents of
their own, in the order of a hash of their text; texts of any length are encoded whole and may span frames; an empty
table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, shared_dir, slices, table, text_or_empty

#: Ids of a frame; frames that one reading task takes in a row; bytes of text encoded at once; stretches remembered.
FRAME, GROUP, SLICE, KNOWN = 1 << 16, 64, 4 << 20, 1_000_000
LEVEL, END = 3, 1
# The public seekable format of zstandard (fixed values).
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOT = struct.Struct("<III"), struct.Struct("<IBI")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- encoding ----

# What a tokenizer must be for its texts to be cut (fixed values): the normaliser works on neighbouring characters only,
# and words are runs of letters, single digits or runs of other characters, without white space.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BEFORE, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_BEFORE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_MARK[list(b".,;:!?")] = True
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _splits(rules: dict) -> bool:
    """Whether texts may be cut at ASCII white space, and between an ASCII letter or digit and ``.,;:!?``."""
    normal, pre = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    spaces = [n for n in normal.get("normalizers", []) if n["type"] == "Replace"]
    parts = pre.get("pretokenizers", [])
    return (
        kinds == _NORMAL and spaces[0]["pattern"] == {"Regex": r"\s+"} and spaces[0]["content"] == " "
        and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _PATTERN} and parts[0]["invert"] and parts[0]["behavior"] == "Removed"
        and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"] and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")
        and all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
    )


class Encoder:
    """Ids of texts, equal to the library's for each whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            self.splits = _splits(json.load(f))
        self.lib = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 1000):
            got = self.lib.encode([w.decode("utf-8", "replace") for w in words[i : i + 1000]], is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(words[i : i + 1000]))
            self.flat = np.append(self.flat, np.array(got.ids, np.uint32))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(counts))

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.lib.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if not self.splits:
            parts = [self._whole(t) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        if len(self.codes) > KNOWN:
            self._forget()
        whole = {k: self._whole(t) for k, t in enumerate(texts) if b"<|" in t}  # perhaps a special token
        # accents (all begin with one byte) may join with small letters only
        rest = [b"" if k in whole else t if b"\xcc" in t else t.translate(_LOW) for k, t in enumerate(texts)]
        words, sizes = _stretches(rest)
        start = len(self.codes)
        at = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        self._learn(list(itertools.islice(self.codes, start, None)))
        n = np.diff(self.ends)[at]
        ids = self.flat[np.repeat(self.ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if not whole:
            return ids, np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(sizes))])
        cuts = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(sizes))]
        parts = [whole.get(k, ids[cuts[k] : cuts[k + 1]]) for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


class _Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        code = self[key] = len(self)
        return code


def _stretches(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The stretches of all texts in a row, and their number in each text."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.flatnonzero(_BEFORE[data[:-1]] & _MARK[data[1:]]) + 1
    at = at[~np.isin(at, ends)]
    cut = np.insert(data, at, 32).tobytes()
    ends = ends + np.searchsorted(at, ends)
    found = [cut[i:e].split() for i, e in zip([0, *ends.tolist()], ends.tolist())]
    return list(itertools.chain.from_iterable(found)), np.array([len(f) for f in found], np.int64)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# ---- files ----


class Writer:
    """Writes ids to a stream, frame by frame, and the seek table at the end."""

    def __init__(self, out):
        self.out, self.rest, self.entries = out, np.zeros(0, "<u4"), []
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def write(self, ids: np.ndarray) -> None:
        self.rest = np.append(self.rest, ids).astype("<u4")
        while len(self.rest) >= FRAME:
            self._frame(self.rest[:FRAME])
            self.rest = self.rest[FRAME:]

    def _frame(self, ids: np.ndarray) -> None:
        plain = ids.tobytes()
        packed = self.press.compress(plain)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.out.write(packed)

    def close(self) -> None:
        if len(self.rest):
            self._frame(self.rest)
        rows = b"".join(_ENTRY.pack(*e) for e in self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + _FOOT.size) + rows + _FOOT.pack(len(self.entries), CHECKED, SEEKABLE))
        self.out.close()


class Reader:
    """Reads ranges of ids from a file, decompressing only the frames that they touch."""

    def __init__(self, file, name: str):
        self.file, self.name, self.frames_read, self._kept = file, name, 0, (None, None)
        size = file.size()
        n, flag, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size)) if size >= _FOOT.size + 8 else (0, 0, 0)
        rows = n * _ENTRY.size
        if magic != SEEKABLE or not flag & CHECKED or size < rows + _FOOT.size + 8 or struct.unpack("<II", self._at(size - rows - _FOOT.size - 8, 8)) != (SKIPPABLE, rows + _FOOT.size):
            raise ValueError(f"{name} has no seek table")
        entries = np.frombuffer(self._at(size - rows - _FOOT.size, rows), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = (entries[:, k] for k in range(3))
        self.place, self.first = np.append(0, np.cumsum(self.packed)), np.append(0, np.cumsum(self.plain // 4))
        if self.place[-1] != size - rows - _FOOT.size - 8:
            raise ValueError(f"the seek table of {name} doesn't fit its frames")

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(int(place))
        return self.file.read(int(n))

    def frame(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            try:
                plain = zstandard.ZstdDecompressor().decompress(self._at(self.place[k], self.packed[k]))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame {k} of {self.name} is damaged") from e
            if len(plain) != self.plain[k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} of {self.name} is damaged")
            self._kept = (k, np.frombuffer(plain, "<u4"))
            self.frames_read += 1
        return self._kept[1]

    def ids(self, at: int, n: int):
        """The ids at to at + n, in parts of a frame at most."""
        if at < 0 or n < 0 or at + n > self.first[-1]:
            raise ValueError(f"{self.name} holds {self.first[-1]} ids, not {at + n}")
        k = int(np.searchsorted(self.first, at, "right")) - 1
        while n:
            part = self.frame(k)[at - self.first[k] :][:n]
            yield part
            at, n, k = at + len(part), n - len(part), k + 1


def _named(folder: str, number: int) -> str:
    return f"{folder}/tokens-{number:06d}.zst"


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Writes the documents' ids, each document's end id included, to files in ``folder`` with an index beside them.

    -> the index: id, file, at (first id in the file), n, start (ids of all documents before it).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})  # a repeated row may stand in several files
    dealt = keyed.repartitionByRange("id", "hash", "row").sortWithinPartitions("id", "hash", "row").select("id", "text")

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        number, at, out = TaskContext.get().partitionId(), 0, None
        own = f"{root}/.{number:06d}-{uuid.uuid4().hex}"
        for b in batches:
            for i, e in slices(pc.binary_length(b.column(1)).to_pylist(), SLICE):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = Writer(fs.open_output_stream(own))
                ids, n = _encoder(tokenizer).encode(b.column(1).slice(i, e - i).cast(pa.binary()).to_pylist())
                out.write(np.insert(ids, np.cumsum(n), np.uint32(end)))
                n = n + 1
                starts = at + np.cumsum(n) - n
                at = int(starts[-1] + n[-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, e - i), pa.array(np.full(e - i, number, np.int32)), pa.array(starts), pa.array(n)], names=["id", "file", "at", "n"])
        if out is not None:
            out.close()
            fs.move(own, _named(root, number))

    dealt.mapInArrow(frugal(run), "id long, file int, at long, n long").write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder, with ``start`` counted over all files in their order."""
    rows = spark.read.schema("id long, file int, at long, n long").parquet(f"{folder}/index")
    sizes = sorted(rows.groupBy("file").agg(F.sum("n")).collect())  # a row for each file
    before = itertools.accumulate((n for _, n in sizes), initial=0)
    starts = spark.createDataFrame([(f, s) for (f, _), s in zip(sizes, before)], "file int, before long")
    return rows.join(F.broadcast(starts), "file").select("id", "file", "at", "n", (F.col("before") + F.col("at")).alias("start"))


def _over(folder: str, found, names: list[str]):
    """Reads the ids of index rows (id, file, at, n, start); ``found`` makes the result's columns of a batch and its rows' ids."""

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        opened: tuple = (None, None)
        for b in batches:
            values = []
            for file, at, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                if opened[0] != file:
                    opened = (file, Reader(fs.open_input_file(_named(root, file)), _named(root, file)))
                values.append(found(opened[1].ids(at, n)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(3), pa.array(values, names[1])], names=["id", "start", "n", names[0]])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Index rows so that those of neighbouring frames come to one task, in the order of their ids."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("id", "file", "at", "n", "start").repartition(n, "file", F.expr(f"at div {FRAME * GROUP}")).sortWithinPartitions("file", "at")


def _checksum(parts) -> int:
    crc = 0
    for p in parts:
        crc = zlib.crc32(p.tobytes(), crc)
    return crc


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, start, n, ids) of the documents whose id stands in ``wanted`` (a column ``id``), or of all."""
    rows = index(spark, folder)
    if wanted is not None:
        rows = rows.join(wanted.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
    got = lambda parts: np.concatenate([np.zeros(0, "<u4"), *parts]).astype(np.int64)
    return _dealt(rows).mapInArrow(frugal(_over(folder, got, ["ids", pa.list_(pa.int64())])), "id long, start long, n long, ids array<bigint>")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n, crc) of all documents, read back from the files a frame at a time."""
    return _dealt(index(spark, folder)).mapInArrow(frugal(_over(folder, _checksum, ["crc", pa.int64()])), "id long, start long, n long, crc long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return checksums(spark, folder).select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
