"""Hard negatives by K-means inverted lists with stored centroid radii.

Vectors are turned into whole numbers, dealt to the list of their nearest centroid, and written.  Each list keeps its
radius r, the largest distance of a member from the centroid c, so by Cauchy and Schwarz a member's inner product
with an anchor a lies within a·c ± |a|·r.  An anchor visits lists by falling upper bound, skips those that lie
outside all of its score windows, and stops where the bound is strictly below its kth score so far.  Visits go in
waves (the first ``FIRST`` lists, then ``GROWTH`` times as many, and so on): within a wave blocks are scored in
parallel, between waves the kth scores rise and the rest of the lists is held against them.  The result is exact
whatever the centroids are; they only decide how much is skipped.

A list is stored in blocks of about ``BLOCK`` rows, so no task holds more than one block and one batch of anchors.
Centroids (at most ``MAX_LISTS``) are learned from a bounded sample (the ``SAMPLE`` rows with the least hash of their
id); every row is indexed.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part; rows that share an id
count once, as the one with the least label, then the least stored vector; ties go to the smaller id; missing
components of shorter vectors count as zero, an empty vector has the score 0 with all; an anchor without other rows
of its label, or a positive without a row in its window, gives no rows; an empty table gives an empty result; extra
columns are ignored.  Products that could pass 2**53 raise an error, as scores could no longer be exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialize, table

#: Rows of a list that the number of centroids aims at, their most, the sample that they are learned from, and rounds.
LIST, MAX_LISTS, SAMPLE, ROUNDS = 1024, 1024, 32_768, 8
#: Rows of a block, about; lists of the first wave; growth of waves; anchors that are scored at once.
BLOCK, FIRST, GROWTH, SLICE = 8192, 2, 16, 512
#: The contract's numbers: an anchor's positives, negatives of a positive, and the window in percent of its score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
_NONE = -(2**62)


@dataclass
class Lists:
    """How vectors are stored and, for each list: its centroid, radius, first block and number of blocks."""

    width: int
    kind: str  # numpy type of the stored vectors
    score: str  # numpy type in which inner products are exact
    centroids: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    blocks: np.ndarray


def scaled(col: str, scale: int = 256) -> Column:
    """floor(scale * x) for each component, as longs; null where the vector or a component is null or not finite."""
    x = F.col(col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def _matrix(col, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), width)


def _dense(col, width: int) -> np.ndarray:
    """A list<long> column as a matrix, short rows filled with zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = col.flatten().to_numpy()
    return out


def learn(sample: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids with whole-numbered components, by Lloyd's rounds from a fixed draw."""
    x = np.unique(sample, axis=0).astype(float)
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + 4096] @ c.T - (c * c).sum(1) / 2).argmax(1) for i in range(0, len(x), 4096)])
        order, n = np.argsort(near, kind="stable"), np.bincount(near, minlength=len(c))
        sums = np.add.reduceat(x[order], np.flatnonzero(np.diff(near[order], prepend=-1)), axis=0)
        c[n > 0] = sums / n[n > 0, None]
    return np.unique(np.rint(c).astype(np.int64), axis=0)


def build(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> tuple[DataFrame, Lists] | None:
    """Rows (block, id, label, vec) that take part, and their lists; ``vec_col`` holds longs (see ``scaled``).  None without rows."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).dropna()
    most = F.coalesce(F.greatest(F.array_max("v"), -F.array_min("v")), F.lit(0))
    n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(most)).first()
    if not n:
        return None
    width, bound = max(1, width), max(1, width) * (top + 1) ** 2
    if bound >= 2**53:
        raise ValueError(f"inner products of {width} components up to {top} are not exact")
    kind = "<i2" if top < 2**15 else "<i4"
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    centroids = learn(_dense(drawn, width), max(1, min(MAX_LISTS, -(-n // LIST))))
    half, exact = (centroids * centroids).sum(1) / 2, centroids.astype(float).T

    def deal(batches):
        for b in batches:
            x = _dense(b.column(2), width)
            near = np.concatenate([np.zeros(0, np.int64), *((x[i : i + 4096] @ exact - half).argmax(1) for i in range(0, len(x), 4096))])
            far = ((x - centroids[near]) ** 2).sum(1)
            data = x.astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in data], pa.binary()), pa.array(near, pa.int32()), pa.array(far, pa.int64())], names=["id", "label", "vec", "list", "far"])

    dealt = rows.mapInArrow(frugal(deal), "id long, label long, vec binary, list int, far long")
    one = dealt.groupBy("id").agg(F.min(F.struct("label", "vec", "list", "far")).alias("r")).select("id", "r.*")
    one = materialize(one, "negatives-lists")
    radii, blocks = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in one.groupBy("list").agg(F.max("far"), F.count("*")).collect():  # a row for each centroid
        radii[r[0]], blocks[r[0]] = np.sqrt(float(r[1])), -(-r[2] // BLOCK)
    first = np.cumsum(blocks) - blocks
    places = spark.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(first, blocks)) if b], "list int, first int, blocks int")
    placed = one.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"), "id", "label", "vec")
    return placed, Lists(width, kind, "f4" if bound < 2**24 else "f8", centroids, radii, first, blocks)


def _visits(lists: Lists, begin: int, end: int):
    """Rows (block, anchor, label, vec, bars, tops) for the lists that come begin-th to end-th for an anchor and aren't ruled out."""

    def run(batches):
        full = np.flatnonzero(lists.blocks)
        c, radii = lists.centroids[full].astype(float).T, lists.radii[full]
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                b = batch.slice(i, SLICE)
                a = _matrix(b.column(2), lists.width, lists.kind).astype(float)
                mid = a @ c
                room = np.sqrt((a * a).sum(1))[:, None] * radii * (1 + 1e-9) + 1
                high, low = mid + room, mid - room
                may, open_ = np.zeros(mid.shape, bool), np.zeros(mid.shape, bool)
                for row, (floors, bars, tops) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5)))):
                    for f, bar, top in zip(floors, bars, tops):
                        fits = low[row] <= top
                        may[row] |= fits & (high[row] >= f)
                        open_[row] |= fits & (high[row] >= bar)
                order = np.argsort(np.where(may, -high, np.inf), axis=1, kind="stable")[:, begin:end]
                row, at = np.nonzero(np.take_along_axis(may & open_, order, 1))
                where = full[order[row, at]]
                reps = lists.blocks[where]
                row = np.repeat(row, reps)
                block = np.repeat(lists.first[where], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(b.column(k).take(take) for k in (0, 1, 2, 4, 5))], names=["block", "id", "label", "vec", "bars", "tops"])

    return run


def _best(x, labels, ids, a, own, anchor, bars, tops, same: bool, k: int):
    """For each anchor and window its first k rows of one block: (anchor row, window, row of the block, score).

    x, labels and ids are sorted by (label, id); a is the anchors' matrix; bars and tops have a column for each window.
    """
    parts = []
    groups = [(np.flatnonzero(own == v), slice(*np.searchsorted(labels, [v, v + 1]))) for v in np.unique(own)] if same else [(np.arange(len(a)), slice(0, len(x)))]
    for rows, cut in groups:
        if cut.start == cut.stop:
            continue
        s = a[rows] @ x[cut].T
        r, c = np.nonzero((s >= bars[rows].min(1)[:, None]) & (s <= tops[rows].max(1)[:, None]))
        score, at, r = s[r, c].astype(np.int64), c + cut.start, rows[r]
        keep = (ids[at] != anchor[r]) if same else (labels[at] != own[r])
        parts.append((r[keep], at[keep], score[keep]))
    if not parts:
        return
    r, at, score = map(np.concatenate, zip(*parts))
    order = np.lexsort((ids[at], -score, r))
    r, at, score = r[order], at[order], score[order]
    for j in range(bars.shape[1]):
        fit = np.flatnonzero((score >= bars[r, j]) & (score <= tops[r, j]))
        begin = np.searchsorted(r[fit], r[fit])
        fit = fit[np.arange(len(fit)) - begin < k]
        yield r[fit], j, at[fit], score[fit]


def _score(lists: Lists, same: bool, k: int):
    """Over rows sorted by block, a block's own rows before its visits: the first k rows of each visit and window."""

    def run(batches):
        block, held, ready = None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for i, e in zip(edges, [*edges[1:], batch.num_rows]):
                b = batch.slice(i, e - i)
                if blocks[i] != block:
                    block, held, ready = blocks[i], [], None
                if not kinds[i]:
                    held.append((b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4), lists.width, lists.kind)))
                    continue
                if ready is None:
                    ids, labels, x = map(np.concatenate, zip(*held))
                    order = np.lexsort((ids, labels))
                    ready, held = (x[order].astype(lists.score), labels[order], ids[order]), []
                x, labels, ids = ready
                for p in range(0, b.num_rows, SLICE):
                    v = b.slice(p, SLICE)
                    anchor, own = v.column(2).to_numpy(), v.column(3).to_numpy()
                    a = _matrix(v.column(4), lists.width, lists.kind).astype(lists.score)
                    bars, tops = v.column(5).to_pylist(), v.column(6).to_pylist()
                    n = max(map(len, bars))
                    bars = np.array([[*y, *[2**62] * (n - len(y))] for y in bars])  # a window that no score fits
                    tops = np.array([[*y, *[_NONE] * (n - len(y))] for y in tops])
                    for r, j, at, s in _best(x, labels, ids, a, own, anchor, bars, tops, same, k):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[r]), pa.array(np.full(len(r), j, np.int32)), pa.array(ids[at]), pa.array(s)], names=["id", "window", "other", "score"])

    return run


def search(stored: DataFrame, lists: Lists, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """anchors: (id, label, vec, floors, tops), the last two with a score for each window -> (id, window, other, score, rank).

    The first k rows by (score falling, id) of the anchor's own label but itself (``same``), or of all other labels,
    with floor <= score <= top.
    """
    spark, n = anchors.sparkSession, len(lists.blocks[lists.blocks > 0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, int(lists.blocks.sum())))
    rows = stored.select("block", F.lit(0).alias("kind"), "id", "label", "vec", F.lit(None).cast("array<long>").alias("bars"), F.lit(None).cast("array<long>").alias("tops"))
    first = Window.partitionBy("id", "window").orderBy(F.desc("score"), "other")
    kind, found, begin, size = "block int, id long, label long, vec binary, bars array<long>, tops array<long>", None, 0, FIRST
    while begin < n:
        bars = F.col("floors")
        asking = anchors
        if found is not None:
            kth = found.filter(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
            asking = anchors.join(kth, "id", "left")
            bars = F.transform("floors", lambda f, j: F.coalesce(F.col("kth")[j], f))
        ask = asking.select("id", "label", "vec", "floors", bars.alias("bars"), "tops")
        visits = ask.mapInArrow(frugal(_visits(lists, begin, begin + size)), kind).select("block", F.lit(1).alias("kind"), "id", "label", "vec", "bars", "tops")
        met = rows.unionByName(visits).repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(frugal(_score(lists, same, k)), "id long, window int, other long, score long")
        if found is not None:
            met = found.drop("rank").unionByName(met)
        found = materialize(met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k), "negatives-found")
        begin, size = begin + size, size * GROWTH
    return found


def _part(x: Column, percent: int, up: bool) -> Column:
    """percent / 100 of a whole number, rounded down or up."""
    y = x * (-percent if up else percent)
    down = (y - F.pmod(y, F.lit(100))) / 100
    return (-down if up else down).cast("long")


def mine(df: DataFrame, every: int, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vec", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows whose id ``every`` divides; ``vec_col`` holds longs.

    -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Negatives of a positive with score
    p score from ``low`` to ``high`` percent of p, which a negative p leaves empty.
    """
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    built = build(df, id_col, label_col, vec_col)
    if built is None:
        return df.sparkSession.createDataFrame([], names)
    rows, lists = built
    anchors = rows.filter(F.col("id") % every == 0).select("id", "label", "vec")
    near = search(rows, lists, anchors.withColumns({"floors": F.array(F.lit(_NONE)), "tops": F.array(F.lit(-_NONE))}), True, positives)
    near = near.select("id", (F.col("rank") - 1).alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    near = near.withColumns({"f": _part(F.col("positive_score"), low, True), "t": _part(F.col("positive_score"), high, False)}).filter("f <= t")
    # positives come by falling score, so those with an open window are the first ones and windows keep their numbers
    spans = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("window", "f", "t"))).alias("w"))
    asking = anchors.join(spans, "id").select("id", "label", "vec", F.col("w.f").alias("floors"), F.col("w.t").alias("tops"))
    found = search(rows, lists, asking, False, negatives)
    out = found.join(near, ["id", "window"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), scaled("embedding").alias("vec")), 50)


SQL = {
    "op11_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
pos as (
  select anchor_id, other as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, q.other as negative_id, p.positive_score, q.score as negative_score
from pos p join pairs q on p.anchor_id = q.anchor_id and not q.same and 50 * p.positive_score <= 100 * q.score and 100 * q.score <= 95 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by q.score desc, q.other)
qualify row_number() over w <= 3""",
}
