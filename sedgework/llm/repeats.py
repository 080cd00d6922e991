"""Substring dedup by window hashes that stand in for prefix-partitioned suffix trees.

A word position starts a suffix, and a text is repeated where two suffixes share their first WINDOW words: in a suffix
tree they would meet in a node of that depth.  No tree is built, as the result needs that one depth only: the suffixes are
dealt to groups by a variable-length prefix, and within a group sorted by the hash of their window, which lists the leaves
of such nodes in a row.  The prefix of a suffix ends with the least hash among the SEED-word grams of its first WINDOW
words (a minimizer).  That place depends on the words alone, so suffixes that share WINDOW words have equal prefixes and land in
one group, while neighbouring suffixes that end in the same place travel as one record (about nine suffixes each).
Groups go to as many tasks as memory asks for.

A first pass over all texts counts the suffixes of each prefix, by BUCKETS buckets of its hash, whatever the size
of the input.  Where a bucket holds more than memory allows, its prefixes are lengthened to the full depth: each
suffix then travels alone and goes to the group that its own window names, so that the different
windows around one frequent gram spread over all groups, while equal windows still meet.

A task sorts its suffixes by (prefix, hash of the window).  Of each run of equal entries the earliest (smallest
document, then place) stays, all others are repeats; chains of repeats are the maximal ones.  Labels
are hashes: 64 bits of the prefix and 64 of the window.  Windows around one frequent gram share
their prefix, so only the bits of the window tell those apart: 2**-64 for each pair.

Hot passages are combined on the map side: of equal windows in one chunk of texts only the
earliest is sent, so a passage of a third of all documents is a row for each chunk.

Cases: null text has no words; rows with equal ids count as one document for "earlier" (equal places
do not precede each other); rows without an id come last; texts of any length are read whole, texts
shorter than WINDOW words keep all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import frugal, slices, table

WINDOW, SEED = 20, 4
#: Bytes of text whose suffixes are combined before they are sent, and of text for each group of subtrees.
#: Groups are dealt to at most TASKS tasks, which sort them and take one after the other.
CHUNK, GROUP, TASKS = 8 << 20, 16 << 20, 20_000
#: Buckets of prefix hashes that are counted, and the suffixes (and multiple of the mean) above which one is lengthened.
BUCKETS, HOT, UNEVEN = 1 << 18, 1 << 20, 8
_LAST = 2**63 - 1
_DTYPE = np.dtype([("prefix", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("count", "<u1")])


def _suffixes(ids: np.ndarray, tags: np.ndarray, texts: list[bytes]):
    """Suffixes of a chunk: prefix and window hashes, row, start; in order of (id, start)."""
    parts = []
    for a, b in slices([len(t) for t in texts], H.SLICE):
        h, counts = H.words(texts[a:b])
        if len(h) < WINDOW:
            continue
        row = np.repeat(np.arange(a, b), counts)
        begin = np.repeat(np.cumsum(counts) - counts, counts)
        n = len(h) - WINDOW + 1
        least, at = H.window_min(H.grams(h, SEED), WINDOW - SEED + 1)
        whole = row[:n] == row[WINDOW - 1 :]
        window = H.grams(h, WINDOW)
        i = np.flatnonzero(whole)
        parts.append((least[:n][i], window[i], row[i], (i - begin[i]).astype(np.int64), at[:n][i] - i))
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def _not_first(order: np.ndarray, same: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks entries that have an earlier equal; ``order`` sorts them, ``same`` tells who equals the one before."""
    out = np.zeros(len(order), bool)
    if not same.any():
        return out
    near = same.copy()
    near[:-1] |= same[1:]
    at = np.flatnonzero(near)
    order, head = order[at], np.flatnonzero(~same[at])
    d, s = doc[order], start[order]
    size = np.diff(np.append(head, len(at)))
    first_doc = np.repeat(np.minimum.reduceat(d, head), size)
    first_start = np.repeat(np.minimum.reduceat(np.where(d == first_doc, s, _LAST), head), size)
    out[order] = (d != first_doc) | (s != first_start)
    return out


def _runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merges neighbouring places of one row: (doc, tag, start, count)."""
    o = np.lexsort((start, tag, doc))
    doc, tag, start = doc[o], tag[o], start[o]
    if len(o):
        keep = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1))
        at = np.flatnonzero(keep)
        last = np.append(at[1:], len(o)) - 1
        return doc[at], tag[at], start[at], start[last] - start[at] + 1
    return doc, tag, start, start


def _bucket(prefix: np.ndarray) -> np.ndarray:
    return (prefix >> H.U(40)).astype(np.int64) % BUCKETS


def _count(batches):
    """(bucket, n): suffixes of each bucket of prefixes in a task's texts; bucket -1 holds the bytes of text."""
    total, size = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        texts = [(x.as_py() or "").encode("utf-8") for x in b.column(0)]
        size += sum(map(len, texts))
        for lo, hi in slices([len(t) for t in texts], H.SLICE):
            h, counts = H.words(texts[lo:hi])
            if len(h) >= WINDOW:
                row = np.repeat(np.arange(len(counts)), counts)
                whole = row[: len(h) - WINDOW + 1] == row[WINDOW - 1 :]
                least, _ = H.window_min(H.grams(h, SEED), WINDOW - SEED + 1)
                total += np.bincount(_bucket(least[: len(whole)][whole]), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], size), pa.int64())], names=["bucket", "n"])


def long_prefixes(texts: DataFrame, hot: int = HOT) -> tuple[int, np.ndarray]:
    """Bytes of all texts (one column), and of each bucket whether its prefixes are lengthened; both of bounded size."""
    n = texts.mapInArrow(frugal(_count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    real = F.col("bucket") >= 0
    got = n.agg(F.sum(F.when(~real, F.col("n"))).alias("size"), F.sum(F.when(real, F.col("n"))).alias("total"), F.collect_list(F.when(real & (F.col("n") > hot), F.struct("bucket", "n"))).alias("large")).first()
    longer = np.zeros(BUCKETS, bool)
    longer[[r["bucket"] for r in got["large"] if r["n"] > UNEVEN * got["total"] / BUCKETS]] = True
    return got["size"] or 0, longer


def _pack(groups: int, longer: np.ndarray | None = None):
    longer = np.packbits(np.zeros(BUCKETS, bool) if longer is None else longer)
    names = ["grp", "body", "windows"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=names)

    def chunk(ids, tags, texts):
        o = np.argsort(ids, kind="stable")
        ids, tags, texts = ids[o], tags[o], [texts[i] for i in o]
        found = _suffixes(ids, tags, texts)
        if found is None:
            return
        prefix, window, row, start, offset = found
        doc = ids[row]
        order = np.argsort(window, kind="stable")
        w = window[order]
        same = np.append(False, (w[1:] == w[:-1]) & (prefix[order][1:] == prefix[order][:-1]))
        late = _not_first(order, same, doc, start)
        rows = []
        if late.any():
            d, t, s, n = _runs(doc[late], tags[row[late]].astype(np.int64), start[late])
            rec = np.zeros(len(d), _DTYPE)
            rec["doc"], rec["tag"], rec["start"] = d, t, s
            # places already known as repeats; the count may exceed a byte, so it travels in the prefix field
            rec["prefix"] = n
            rows.append((int(d[0] % groups), rec.tobytes(), None))
        live = np.flatnonzero(~late)
        prefix, window, row, start, anchor = prefix[live], window[live], row[live], start[live], (start + offset)[live]
        if len(live):
            bucket = _bucket(prefix)
            alone = (longer[bucket >> 3] >> (7 - (bucket & 7))) & 1 == 1
            new = alone | np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))
            head = np.flatnonzero(new)
            rec = np.zeros(len(head), _DTYPE)
            rec["prefix"], rec["doc"], rec["tag"], rec["start"] = prefix[head], ids[row[head]], tags[row[head]], start[head]
            rec["count"] = np.diff(np.append(head, len(live)))
            grp = np.where(alone[head], H.mix(window[head]), rec["prefix"] >> H.U(20)) % H.U(groups)
            order = np.argsort(grp, kind="stable")
            rec = rec[order]
            count = rec["count"].astype(np.int64)
            # windows in the order of their records
            src = np.repeat(head[order] - (np.cumsum(count) - count), count) + np.arange(len(live))
            full = window.astype("<u8")[src]
            grp = grp[order]
            edge, at = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])), np.append(0, np.cumsum(count))
            ends = np.append(edge[1:], len(grp))
            rows += [(int(grp[a]), rec[a:b].tobytes(), full[at[a] : at[b]].tobytes()) for a, b in zip(edge.tolist(), ends.tolist())]
        yield out(rows)

    def run(batches):
        ids, tags, texts, size = [], [], [], 0
        for b in batches:
            for i, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = (x.as_py() or "").encode("utf-8")
                if texts and size + len(raw) > CHUNK:
                    yield from chunk(np.array(ids, np.int64), np.array(tags, np.uint32), texts)
                    ids, tags, texts, size = [], [], [], 0
                ids.append(i)
                tags.append(t)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield from chunk(np.array(ids, np.int64), np.array(tags, np.uint32), texts)

    return run


def _subtrees(batches):
    """The groups of a task, whose rows are neighbours, one after the other."""
    at, recs, labels = None, [], []
    for b in batches:
        for grp, body, windows in zip(b.column("grp").to_pylist(), b.column("body"), b.column("windows")):
            if grp != at:
                if recs:
                    yield from _subtree(recs, labels)
                at, recs, labels = grp, [], []
            rec = np.frombuffer(body.as_py(), _DTYPE)
            if windows.is_valid:
                recs.append(rec)
                labels.append(windows.as_py())
            else:
                yield _result(rec["doc"], rec["tag"].astype(np.int64), rec["start"].astype(np.int64), rec["prefix"].astype(np.int64))
    if recs:
        yield from _subtree(recs, labels)


def _subtree(recs: list, labels: list):
    """Sorted leaves, equal neighbours, repeats as (doc, tag, start, n)."""
    rec = np.concatenate(recs)
    window = np.frombuffer(b"".join(labels), "<u8")
    recs.clear()
    labels.clear()
    # leaves of prefixes with one record can't meet another
    o = np.argsort(rec["prefix"], kind="stable")
    p = rec["prefix"][o]
    eq = p[1:] == p[:-1]
    shared = np.zeros(len(rec), bool)
    shared[o] = np.append(False, eq) | np.append(eq, False)
    count = rec["count"].astype(np.int64)
    take = np.repeat(shared, count)
    rec, window = rec[shared], window[take]
    count = rec["count"].astype(np.int64)
    if not len(rec):
        return
    prefix = np.repeat(rec["prefix"], count)
    doc = np.repeat(rec["doc"], count)
    start = np.repeat(rec["start"].astype(np.int64) - (np.cumsum(count) - count), count) + np.arange(len(prefix))
    order = np.argsort(H.mix(prefix + window * H.U(0x9E3779B97F4A7C15)), kind="stable")
    pw, ww = prefix[order], window[order]
    same = np.append(False, (pw[1:] == pw[:-1]) & (ww[1:] == ww[:-1]))
    late = _not_first(order, same, doc, start)
    tag = np.repeat(rec["tag"].astype(np.int64), count)
    if late.any():
        yield _result(*_runs(doc[late], tag[late], start[late]))


def _result(doc, tag, start, n):
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["doc", "tag", "start", "n"])


def repeated_places(keyed: DataFrame, groups: int, longer: np.ndarray) -> DataFrame:
    """(doc, tag, start, n): windows at start .. start + n - 1 also start earlier.  keyed: (doc, tag, text)."""
    packed = keyed.mapInArrow(frugal(_pack(groups, longer)), "grp int, body binary, windows binary")
    tasks = min(groups, TASKS)
    # dealt by number and not by hash, so that no task gets several groups while others get none
    dealt = packed.repartitionById(tasks, F.pmod("grp", F.lit(tasks)).cast("int")).sortWithinPartitions("grp")
    return dealt.mapInArrow(frugal(_subtrees), "doc long, tag long, start long, n long")


def split_words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _kept(batches):
    for b in batches:
        n, gone, kept = [], [], []
        for t, runs in zip(b.column("text"), b.column("runs")):
            w = split_words(t.as_py() or "")
            n.append(len(w))
            total = len(w)
            if runs.is_valid:
                hit = np.zeros(len(w) + 1, np.int64)
                for r in runs.as_py():
                    hit[r["start"]] += 1
                    hit[r["start"] + r["n"] - 1 + WINDOW] -= 1
                stay = np.cumsum(hit[:-1]) == 0
                w = [x for x, s in zip(w, stay.tolist()) if s]
            gone.append(total - len(w))
            kept.append(" ".join(w))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None, hot: int = HOT) -> DataFrame:
    """Per row: id, n_words, n_removed and kept, the words that stay joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key = [F.coalesce("id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag")]
    size, longer = long_prefixes(rows.select("text"), hot)
    groups = groups or max(8, -(-size // GROUP))
    found = repeated_places(rows.select(*key, "text"), groups, longer)
    runs = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    out = rows.select("id", "text", *key).join(runs, ["doc", "tag"], "left").select("id", "text", "runs")
    kept = out.mapInArrow(frugal(_kept), "id long, n_words long, n_removed long, kept string")
    return kept.withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op2_substring_dedup": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 win as (select doc_id, unnest(range(0, len(w) - 19)) as s, unnest(list_transform(range(0, len(w) - 19), lambda i: array_to_string(w[i + 1 : i + 20], ' '))) as key from d where len(w) >= 20),
 late as (select doc_id, s from (select doc_id, s, row_number() over (partition by key order by doc_id, s) as rn from win) where rn > 1),
 gone as (select distinct doc_id, unnest(range(s, s + 20)) as pos from late),
 words as (select doc_id, unnest(range(0, len(w))) as pos, unnest(w) as word from d),
 kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as t from words anti join gone using (doc_id, pos) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
}


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The contract over a list of (id, text), for tests."""
    seen, out = {}, {}
    for i, t in sorted(docs):
        w = split_words(t or "")
        cut = set()
        for s in range(len(w) - WINDOW + 1):
            if seen.setdefault(tuple(w[s : s + WINDOW]), (i, s)) != (i, s):
                cut |= set(range(s, s + WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in cut)
        out[i] = len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()
    return out
