"""Self-join of documents on the Jaccard similarity of their word shingles, with a count-vector R-tree.

Two sets of sizes a <= b link when 100 * overlap >= PERCENT * union; then overlap >= PERCENT (a + b) /
(100 + PERCENT) and at most D = (a + b) (100 - PERCENT) / (100 + PERCENT) shingles differ.

1. Nodes.  A document's set is a node, named by a 64-bit fingerprint; equal sets are one node.
2. Meeting.  Shingles are dealt by hash into K = D + 1 + E parts, D that of the largest pair of a size
   class; a set joins in at its own class and the one below.  At least E + 1 parts of a linked pair hold no
   difference.  Empty parts would bring together sets that share
   nothing; a set with at most E of them (else it sends all parts) leaves them out, and of the others it sends
   the first D + 1 in the order of: not only popular shingles, most shingles, key.  It leaves out E parts in
   all, so one of the E + 1 equal parts is sent, by both, as equal parts have equal shingles and so the same
   place in that order.  Popular shingles (in passages that many documents share) are counted over all documents,
   by those that a chunk of texts shows POPULAR_HERE times; they only decide the order, and at most
   POPULAR of them are sent to the tasks.
   Of the nodes that meet, each task
   unites those whose group counts (32 or FINE groups, by the set's size) leave room for a link by the
   bound below, and
   emits a spanning forest, never the pairs.  The components of all forests are the rooms: linked
   nodes are always in one room.
3. Search.  Within a room, shingles are hashed into GROUPS groups; the group counts are a point in
   an R-tree.  The overlap of a point with all below a tree node is at most the sum over groups of
   min(point, node's maximum), and for a leaf entry the sum of coordinate minima; where that is too
   little, the branch or the pair is left out.  Surviving pairs are verified on their shingles unless
   they are connected already, so a group of copies takes about one comparison for each member.
4. Large rooms.  A room of more than ROOM nodes is dealt by hash to several tasks, each with the room's
   pivot (its least node).  Nodes that a task does not connect to the pivot are searched in a second
   round against all tasks of the room, and the links found there are joined by components.  A room has
   at most PARTS tasks until these are LARGE times as large, so a node is copied PARTS times at most
   below 32 million nodes.

Cases: null text and texts without words have no shingles and link with nothing; fewer words than a
shingle count as one shingle; repeated rows and ids are fine, rows without an id take part and a
component of such rows has a null id; texts of any length are read whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import WORD_CLASS, frugal, materialize, slices, table
from .components import connected_components

SHINGLE, PERCENT, GROUPS = 4, 85, 64
CHUNK, ROWS, BUCKET, TASKS, ROOM, LEAF = 4 << 20, 100_000, 16 << 20, 20_000, 500, 32
PARTS, LARGE = 64, 1000
POPULAR_HERE, POPULAR_TOTAL, POPULAR = 3, 12, 200_000
_LAST = 2**63 - 1


# -- sets ------------------------------------------------------------------------------------
def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of (text, hash), their texts, and the set size of each text."""
    parts, rows = [], []
    for a, b in slices([len(t) for t in texts], H.SLICE):
        h, counts = H.words(texts[a:b], lower=True)
        row = np.repeat(np.arange(a, b), counts)
        g = H.grams(h, k)
        keep = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
        g, r = g[keep], row[: len(g)][keep]
        begin = np.cumsum(counts) - counts
        for n in range(1, k):  # whole short texts; the length takes part, so that they equal no longer shingle
            at = np.flatnonzero(counts == n)
            if len(at):
                whole = H.mix(H.grams(h, n)[begin[at]] + H.U(n))
                g, r = np.append(g, whole), np.append(r, at + a)
        o = np.lexsort((g, r))
        g, r = g[o], r[o]
        if len(g):
            new = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))
            parts.append(g[new])
            rows.append(r[new])
    g = np.concatenate(parts) if parts else np.empty(0, H.U)
    r = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return g, r, np.bincount(r, minlength=len(texts))


def node_names(g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprint of each set; 0 for empty ones."""
    total = np.append(H.U(0), np.cumsum(H.mix(g ^ H.U(0x5851F42D4C957F2D))))
    end = np.cumsum(sizes)
    name = H.mix((total[end] - total[end - sizes]) * H.U(0x9E3779B97F4A7C15) + sizes.astype(H.U))
    name[sizes == 0] = 0
    return name.view(np.int64)


# -- meeting ---------------------------------------------------------------------------------
class Classes:
    """Size classes: ``first`` is the least size of each; levels have ``parts`` (K) and ``spare`` (E)."""

    def __init__(self, largest: int, percent: int = PERCENT):
        self.first = [1]
        while self.first[-1] <= largest:
            self.first.append(max(self.first[-1] + 1, 100 * (self.first[-1] - 1) // percent + 1) if len(self.first) > 1 else 2)
        parts, spare = [], []
        for high in [*self.first[1:], self.first[-1] * 2]:
            a = high - 1
            d = (100 - percent) * (a + 100 * a // percent) // (100 + percent)
            e = 2 + 2 * d // 5 if d else 0
            k = d + 1 + e
            parts.append(k)
            spare.append(e)
        self.first, self.parts, self.spare = (np.array(x, np.int64) for x in (self.first, parts, spare))


def part_keys(g: np.ndarray, sizes: np.ndarray, classes: Classes, popular: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all parts in which sets take part, in order of row; ``popular`` is sorted."""
    rare = np.ones(len(g), bool)
    if popular is not None and len(popular):
        rare = popular[np.minimum(np.searchsorted(popular, g), len(popular) - 1)] != g
    own = np.searchsorted(classes.first, sizes, side="right") - 1
    spread = H.mix(g + H.U(0x632BE59BD9B4E019))
    lo, hi = (spread & H.U(0xFFFFFFFF)).astype(np.float64), (spread >> H.U(32)).astype(np.float64)
    pick = H.mix(spread)
    out_rows, out_keys = [], []
    for down in (0, 1):
        level = np.maximum(own - down, 0)
        use = (sizes > 0) & (own >= down)
        parts = np.where(use, classes.parts[level], 0)
        begin = np.cumsum(parts) - parts
        total = int(parts.sum())
        if not total:
            continue
        takes = np.repeat(use, sizes)
        k = np.repeat(parts, sizes)[takes].astype(H.U)
        at = np.repeat(begin, sizes)[takes] + (pick[takes] % k).astype(np.int64)
        sums = np.bincount(at, lo[takes], total).astype(H.U) + (np.bincount(at, hi[takes], total).astype(H.U) << H.U(32))
        count = np.bincount(at, minlength=total)
        known = np.bincount(at, rare[takes], total) == 0  # only popular shingles
        row = np.repeat(np.arange(len(sizes)), parts)
        j = np.arange(total) - np.repeat(begin, parts)
        lv = level[row]
        thin = count == 0
        many = np.bincount(row[thin], minlength=len(sizes)) > classes.spare[level]
        keep = np.flatnonzero(~thin | many[row])
        where = H.mix((lv * (1 << 32) + j).astype(H.U))
        key = H.mix(sums * H.U(0x9E3779B97F4A7C15) + where)[keep]
        row, count = row[keep], np.minimum(count[keep], 255) + 256 * ~known[keep]
        new = np.append(True, row[1:] != row[:-1])
        number = np.cumsum(new) - 1
        o = np.argsort((number.astype(H.U) << H.U(40)) | ((511 - count).astype(H.U) << H.U(31)) | (key >> H.U(33)), kind="stable")
        place = np.arange(len(row)) - np.flatnonzero(new)[number]
        send = (place < (classes.parts - classes.spare)[level[row]]) | many[row]
        out_rows.append(row[send])
        out_keys.append(key[o][send])
    if not out_rows:
        return np.empty(0, np.int64), np.empty(0, H.U)
    row, key = np.concatenate(out_rows), np.concatenate(out_keys)
    o = np.argsort(row, kind="stable")
    return row[o], key[o]


def _chunks(batches, limit: int = CHUNK):
    """Texts as bytes with the columns before them, up to ``limit`` bytes at once."""
    rows, texts, size = [], [], 0
    for b in batches:
        for *head, t in zip(*[b.column(i) for i in range(b.num_columns)]):
            raw = (t.as_py() or "").encode("utf-8")
            if texts and (size + len(raw) > limit or len(texts) >= ROWS):
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append([x.as_py() for x in head])
            texts.append(raw)
            size += len(raw)
    if texts:
        yield rows, texts


#: A node of a chunk in a bucket: its name, keys in the bucket and set size.
_HEAD = np.dtype([("node", "<i8"), ("count", "<u2"), ("size", "<u2")])
#: Group counts travel in four bits, 15 for all above 14 (UNKNOWN when read); sets of up to SMALL shingles have 32 of
#: them, larger ones FINE.
SMALL, FINE, UNKNOWN = 2000, 64, 255
_FULL = 65535


def small_counts(g: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed group counts of the sets one after the other, and the number of bytes of each."""
    width = np.where(sizes > SMALL, FINE // 2, 16)
    out = np.zeros(int(width.sum()), np.uint8)
    begin = np.cumsum(width) - width
    row = np.repeat(np.arange(len(sizes)), sizes)
    for groups, mine in ((32, sizes <= SMALL), (FINE, sizes > SMALL)):
        at = np.cumsum(mine) - 1
        here = mine[row]
        n = int(mine.sum())
        place = H.mix(g[here]) >> H.U(64 - groups.bit_length() + 1)
        counts = np.minimum(np.bincount(at[row[here]] * groups + place.astype(np.int64), minlength=groups * n), 15).astype(np.uint8).reshape(n, groups)
        out[(begin[mine][:, None] + np.arange(groups // 2)).ravel()] = (counts[:, ::2] | counts[:, 1::2] << 4).ravel()
    return out, width


class Points:
    """Group counts of nodes, read from packed ones: 32 of every node, and FINE ones of the larger sets."""

    def __init__(self, packed: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.coarse = np.zeros((len(sizes), 32), np.uint8)
        big = sizes > SMALL
        self.number = np.where(big, np.cumsum(big) - 1, -1)
        self.coarse[~big] = self._read(packed, begin[~big], 32)
        self.fine = self._read(packed, begin[big], FINE)
        if len(self.fine):
            four = self.fine.reshape(-1, 32, FINE // 32)
            self.coarse[big] = np.where((four == UNKNOWN).any(axis=2), UNKNOWN, np.minimum(four.sum(axis=2, dtype=np.int64), 254))

    @staticmethod
    def _read(packed: np.ndarray, begin: np.ndarray, groups: int) -> np.ndarray:
        raw = packed[begin[:, None] + np.arange(groups // 2)]
        out = np.empty((len(begin), groups), np.uint8)
        out[:, ::2], out[:, 1::2] = raw & 15, raw >> 4
        out[out == 15] = UNKNOWN
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Whether the summed coordinate minima leave room for links of nodes i and j."""
        na, nb = self.sizes[i], self.sizes[j]
        full = (na == _FULL) | (nb == _FULL)
        out = full | (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        for table, number in ((self.coarse, np.arange(len(self.sizes))), (self.fine, self.number)):
            for a in range(0, len(i), 1 << 16):
                k = a + np.flatnonzero(out[a : a + (1 << 16)] & ~full[a : a + (1 << 16)])
                x, y = number[i[k]], number[j[k]]
                k, x, y = (z[(x >= 0) & (y >= 0)] for z in (k, x, y))
                out[k] = overlap_bound(table[x], table[y], na[k], nb[k]) * (100 + percent) >= percent * (na[k] + nb[k])
        return out


def overlap_bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most shingles that sets of these counts share: coordinate minima, and where a count is unknown what the
    known ones leave of either set."""
    known = (a != UNKNOWN) & (b != UNKNOWN)
    least = np.minimum(a, b).sum(axis=1, where=known, dtype=np.int64)
    rest = np.minimum(na - a.sum(axis=1, where=known, dtype=np.int64), nb - b.sum(axis=1, where=known, dtype=np.int64))
    return least + np.where(known.all(axis=1), 0, rest)


def _meet(buckets: int, shingle: int = SHINGLE, percent: int = PERCENT, popular: np.ndarray | None = None):
    def run(batches):
        classes = Classes(1024, percent)
        for _, texts in _chunks(batches):
            g, _, sizes = shingle_sets(texts, shingle)
            if len(sizes) and sizes.max() >= classes.first[-1]:
                classes = Classes(int(sizes.max()) * 2, percent)
            names = node_names(g, sizes)
            packed, width = small_counts(g, sizes)
            begin = np.cumsum(width) - width
            full = np.minimum(sizes, _FULL)
            # equal sets of the chunk take part once
            _, once = np.unique(names, return_index=True)
            drop = np.ones(len(names), bool)
            drop[once] = False
            g, sizes = g[~np.repeat(drop, sizes)], np.where(drop, 0, sizes)
            row, key = part_keys(g, sizes, classes, popular)
            if not len(row):
                continue
            bucket = ((key >> H.U(40)) % H.U(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            row, key, bucket = row[o], key[o], bucket[o]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out = []
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist()):
                at = np.flatnonzero(np.append(True, row[a + 1 : b] != row[a : b - 1]))
                count = np.diff(np.append(at, b - a))
                if count.max() > _FULL:  # a longer run becomes several heads
                    at = np.concatenate([np.arange(x, x + n, _FULL) for x, n in zip(at, count)])
                    count = np.diff(np.append(at, b - a))
                r = row[a:b][at]
                head = np.zeros(len(r), _HEAD)
                head["node"], head["count"], head["size"] = names[r], count, full[r]
                w = width[r]
                counts = packed[np.repeat(begin[r] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))]
                out.append((int(bucket[a]), head.tobytes(), counts.tobytes(), key[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], names=["bucket", "nodes", "counts", "keys"])

    return run


def _local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least reachable number for each of 0 .. n-1 in a graph of edges u, v."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not (root == root[root]).all():
            root = root[root]


def _unite(batches, percent: int = PERCENT):
    """The buckets of a task, whose rows are neighbours, one after the other."""
    at, found = None, ([], [], [])
    for b in batches:
        for bucket, *parts in zip(b.column("bucket").to_pylist(), b.column("nodes"), b.column("counts"), b.column("keys")):
            if bucket != at:
                if found[0]:
                    yield from _unite_bucket(*found, percent)
                at, found = bucket, ([], [], [])
            for x, y in zip(found, parts):
                x.append(y.as_py())
    if found[0]:
        yield from _unite_bucket(*found, percent)


def _unite_bucket(heads: list, counts: list, keys: list, percent: int = PERCENT):
    """Nodes that share a key in this bucket, as (u, v) with v the least node of their local component."""
    head = np.frombuffer(b"".join(heads), _HEAD)
    packed = np.frombuffer(b"".join(counts), np.uint8)
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 5)
    for x in (heads, counts, keys):
        x.clear()
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    key = wide.view("<u8").ravel()
    del wide, raw
    names, first, number = np.unique(head["node"], return_index=True, return_inverse=True)
    width = np.where(head["size"] > SMALL, FINE // 2, 16)
    points = Points(packed, (np.cumsum(width) - width)[first], head["size"][first].astype(np.int64))
    who = np.repeat(number, head["count"].astype(np.int64))
    o = np.argsort(key, kind="stable")
    k, w = key[o], who[o]
    # blocks of equal keys that hold different nodes
    edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(edge, len(k)))
    two = edge[size == 2]
    pairs = np.unique(np.stack([np.minimum(w[two], w[two + 1]), np.maximum(w[two], w[two + 1])], axis=1), axis=0) if len(two) else np.empty((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = pairs[points.may_link(pairs[:, 0], pairs[:, 1], percent)]
    root = _local_roots(len(names), pairs[:, 0], pairs[:, 1])
    seen = set()
    for a, n in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
        block = np.unique(w[a : a + n])
        if (same := block.tobytes()) not in seen:  # copies and passages meet in many parts alike
            seen.add(same)
            _unite_block(block, root, points, percent)
    while not (root == root[root]).all():
        root = root[root]
    u = np.flatnonzero(root != np.arange(len(names)))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(names[u], pa.int64()), pa.array(names[root[u]], pa.int64())], names=["u", "v"])


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = int(root[i])
    return i


def _unite_block(block: np.ndarray, root: np.ndarray, points: Points, percent: int = PERCENT) -> None:
    """Unites the nodes of a block that may link.  Nodes of one component are not compared again, so a
    group of copies takes one comparison for each member."""
    found = np.array([_find(root, int(i)) for i in block])
    if (found == found[0]).all():
        return
    rest = np.arange(len(block))
    while len(rest) > 1:
        # all nodes of the first one's component, then what they reach, leave together
        now, out = rest[found[rest] == found[rest[0]]], rest[found[rest] != found[rest[0]]]
        queue = list(now)
        while queue and len(out):
            i = queue.pop()
            near = out[points.may_link(block[out], np.full(len(out), block[i]), percent)]
            if len(near):
                joined = np.isin(found[out], found[near])
                for r in np.unique(found[near]):
                    a, b = _find(root, int(r)), _find(root, int(found[i]))
                    root[max(a, b)] = min(a, b)
                queue += list(out[joined])
                out = out[~joined]
        rest = out


# -- searching -------------------------------------------------------------------------------
class RTree:
    """Points of group counts, packed bottom-up; each tree node knows its greatest coordinates and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, least = self.points, self.sizes
        while len(top) > LEAF:
            cut = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(least, cut)
            self.levels.append((top, least))

    def search(self, point: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Numbers of the points that may link with ``point``."""
        at = None
        for top, least in [*self.levels[::-1], (self.points, self.sizes)]:
            if at is None:
                at = np.arange(len(top))
            else:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(top)]
            bound = np.minimum(top[at], point).sum(axis=1, dtype=np.int64)
            at = at[bound * (100 + percent) >= percent * (size + least[at])]
        return self.order[at]


def counts_of(s: np.ndarray) -> np.ndarray:
    return np.bincount((H.mix(s) >> H.U(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int((b[at] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def unite_sets(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Root (least number) of each set's component under the link relation."""
    n = len(sets)
    root = np.arange(n)
    if n < 2:
        return root
    points = np.stack([counts_of(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = RTree(points, sizes)
    for i in range(n):
        near = tree.search(points[i], int(sizes[i]), percent)
        near = np.sort(near[near > i])
        near = near[root[near] != root[i]]
        while len(near):
            j = near[0]
            if linked(sets[i], sets[j], percent):
                low, high = min(root[i], root[j]), max(root[i], root[j])
                root[root == high] = low
                near = near[root[near] != root[i]]
            else:
                near = near[1:]
    return root


def _sets(batches, shingle: int = SHINGLE):
    """Sets of the rows (room, parts, node, text)."""
    for rows, texts in _chunks(batches):
        g, _, sizes = shingle_sets(texts, shingle)
        edge = np.append(0, np.cumsum(sizes))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array([g[edge[i] : edge[i + 1]].tobytes() for i in range(len(sizes))], pa.binary())],
            names=["room", "parts", "node", "body"],
        )


def _rooms(batches):
    """Groups of neighbouring rows of one (room, part): nodes (each once), asking flags and sets."""
    at, nodes = None, {}
    for b in batches:
        for room, part, node, asks, body in zip(*(b.column(c) for c in ("room", "part", "node", "asks", "body"))):
            here = room.as_py(), part.as_py()
            if here != at:
                if nodes:
                    yield at, nodes
                at, nodes = here, {}
            nodes[node.as_py(), asks.as_py()] = body.as_py()
    if nodes:
        yield at, nodes


def _pairs(u, v):
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _connect(batches, percent: int = PERCENT):
    """(node, root) for every node of a part of a room; the root is the pivot's name where it is reached.

    Nodes are in order of name, so that the pivot, the room's least node, is the root of its component.
    """
    for _, nodes in _rooms(batches):
        names = sorted(n for n, _ in nodes)
        root = unite_sets([np.frombuffer(nodes[n, False], H.U) for n in names], percent)
        yield _pairs(names, [names[r] for r in root])


def _ask(batches, percent: int = PERCENT):
    """A spanning forest of the links between the asking nodes and the others of a part."""
    for _, nodes in _rooms(batches):
        own = sorted(n for n, asks in nodes if not asks)
        sets = [np.frombuffer(nodes[n, False], H.U) for n in own]
        if not own:
            continue
        tree = RTree(np.stack([counts_of(s) for s in sets]), np.array([len(s) for s in sets]))
        asking = sorted(n for n, asks in nodes if asks)
        names = sorted({*own, *asking})
        at = {n: k for k, n in enumerate(names)}
        root, places = np.arange(len(names)), np.array([at[n] for n in own])
        u, v = [], []
        for n in asking:
            s = np.frombuffer(nodes[n, True], H.U)
            near = tree.search(counts_of(s), len(s), percent)
            near = near[root[places[near]] != root[at[n]]]
            while len(near):  # what is connected already is not compared
                j = near[0]
                if linked(s, sets[j], percent):
                    low, high = sorted((root[at[n]], root[places[j]]))
                    root[root == high] = low
                    u.append(n)
                    v.append(own[j])
                    near = near[root[places[near]] != root[at[n]]]
                else:
                    near = near[1:]
        if u:
            yield _pairs(u, v)


# -- the join --------------------------------------------------------------------------------
def _names(batches, shingle: int = SHINGLE):
    """(id, tag, node, n_shingles) of each row; with n_shingles -1 a shingle (as node) and how many sets of a chunk hold it (as tag)."""
    for rows, texts in _chunks(batches):
        g, _, sizes = shingle_sets(texts, shingle)
        cols = list(zip(*rows))
        names = node_names(g, sizes)
        once = np.zeros(len(names), bool)
        once[np.unique(names, return_index=True)[1]] = True
        each, times = np.unique(g[np.repeat(once, sizes)], return_counts=True)
        each, times = each[times >= POPULAR_HERE], times[times >= POPULAR_HERE]
        if len(each):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(each), pa.int64()), pa.array(times, pa.int64()), pa.array(each.view(np.int64)), pa.array(np.full(len(each), -1), pa.int64())], names=["id", "tag", "node", "n_shingles"])
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "tag", "node", "n_shingles"])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: id, tag (a hash of the text), n_shingles, root (the component's name) and component_id, its least id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    nodes = materialize(rows.mapInArrow(frugal(partial(_names, shingle=shingle)), "id long, tag long, node long, n_shingles long"), "jaccard-nodes")
    often = nodes.filter("n_shingles < 0").groupBy("node").agg(F.sum("tag").alias("n")).filter(F.col("n") >= POPULAR_TOTAL)
    popular = np.sort(often.orderBy(F.desc("n"), "node").limit(POPULAR).select("node").toArrow().column(0).to_numpy().view(H.U))
    nodes = nodes.filter("n_shingles >= 0")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET))
    met = rows.select("text").mapInArrow(frugal(_meet(buckets, shingle, percent, popular)), "bucket int, nodes binary, counts binary, keys binary").repartition(min(buckets, TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(partial(_unite, percent=percent)), "u long, v long")
    rooms = connected_components(met)
    rooms = rooms.unionByName(rooms.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "room")
    counts = rooms.groupBy("room").agg(F.count("*").alias("n"))
    rooms = rooms.join(counts, "room").select("node", "room", F.greatest(F.least(F.ceil(F.col("n") / room), F.lit(PARTS)), F.ceil(F.col("n") / (room * LARGE))).cast("int").alias("parts"))
    # one text for each node
    owner = nodes.groupBy("node").agg(F.min(F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), "tag")).alias("o"))
    places = materialize(rooms.join(owner, "node").select("node", "room", "parts", "o.id", "o.tag"), "jaccard-places")
    # Their sets, read from the texts once.  The merge hint keeps one way of joining at all sizes.
    keyed = rows.select(F.coalesce("id", F.lit(_LAST)).alias("id"), "tag", "text").join(places.hint("merge"), ["id", "tag"])
    sets = materialize(keyed.select("room", "parts", "node", "text").mapInArrow(frugal(partial(_sets, shingle=shingle)), "room long, parts int, node long, body binary"), "jaccard-sets")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)

    def grouped(members: DataFrame, run) -> DataFrame:
        """members: (room, part, node, asks, body); those of a part come together in a task."""
        return members.repartition(min(buckets, TASKS), "room", "part").sortWithinPartitions("room", "part").mapInArrow(frugal(partial(run, percent=percent)), "u long, v long")

    def members(rows: DataFrame, parts, asks: bool) -> DataFrame:
        return rows.select("room", parts.alias("part"), "node", F.lit(asks).alias("asks"), "body")

    to = F.when(F.col("node") == F.col("room"), every).otherwise(F.array(part))
    found = materialize(grouped(members(sets, F.explode(to), False), _connect), "jaccard-found")
    labels = found.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # large rooms: what wasn't connected to the pivot asks all parts of its room
    split = places.filter("parts > 1").select("node", "room")
    if split.limit(1).count():
        lost = materialize(split.join(labels, "node").filter("root <> room").select("node", "room"), "jaccard-lost")
        if lost.limit(1).count():
            wide = sets.filter("parts > 1")
            own = members(wide.join(lost.select("room").distinct(), "room", "left_semi"), part, False)
            ask = members(wide.join(lost.select("node"), "node", "left_semi"), F.explode(every), True)
            labels = connected_components(found.unionByName(grouped(own.unionByName(ask), _ask)))
    labels = labels.groupBy("node").agg(F.min("root").alias("root"))
    # least id of each node, then of each component
    least = nodes.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("id")).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = least.groupBy("root").agg(F.min("id").alias("component_id"))
    named = least.join(best, "root").select("node", "root", "component_id")
    out = nodes.join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), "tag", "n_shingles", "root", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component (the least id; of equal ids the least text hash).

    Rows without words are in no component and stay, repeated ones too.
    """
    found = components(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, shingle=shingle, percent=percent)
    first = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    chosen = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(first.alias("id"), "tag")).alias("o")).select(F.col("o.id").alias("_id"), F.col("o.tag").alias("_tag"))
    worded = F.coalesce(F.col(text_col).rlike(WORD_CLASS), F.lit(False))
    row = F.struct(*[F.col(c) for c in docs.columns])
    keyed = docs.filter(worded).select(first.alias("_id"), F.xxhash64(text_col).alias("_tag"), row.alias("_row"))
    # the join has brought equal keys together, so the aggregate needs no shuffle of its own
    kept = keyed.join(chosen.hint("merge"), ["_id", "_tag"], "left_semi").groupBy("_id", "_tag").agg(F.first("_row").alias("_row")).select("_row.*")
    return kept.unionByName(docs.filter(~worded))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = {
    "op9_ngram_jaccard": r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 s as (select distinct doc_id, unnest(list_transform(range(0, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) as g from d where len(w) > 0),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as same from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 85 * (x.n + y.n - same)),
 e as (select a as u, b as v from l union select b, a from l),
 r as (select doc_id as u, doc_id as v from d union select r.u, e.v from r join e on e.u = r.v)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, min(v) as component_id from d left join n using (doc_id) join r on r.u = d.doc_id group by d.doc_id, n""",
}


def brute_force(docs: list[tuple[int, str | None]], shingle: int = SHINGLE, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The contract over a list of (id, text), for tests: sizes and least reachable ids."""
    import re

    sets = {}
    for i, t in docs:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where: dict = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    overlap: dict = {}
    for found in where.values():
        for x in range(len(found)):
            for y in found[x + 1 :]:
                overlap[found[x], y] = overlap.get((found[x], y), 0) + 1
    for (i, j), same in overlap.items():
        if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}
