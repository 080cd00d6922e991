"""Mixing sources to target weights by entropy balancing.

Base rates are one copy of each document.  Among all rates r of documents, the mix is the one of least
relative entropy  sum (r log r - r + 1)  that meets the token constraint  sum size * r = target  of each
source with r <= CAP.  The dual has one variable for each source, and the rate of a document is the tilt

    r(document) = min(CAP, exp(lambda[source] * size / mean size of the source)).

So a source that is cut keeps its short documents rather than its long ones, and one that is repeated
repeats the long ones first.  Each Newton step is a Spark aggregate over the documents, grouped by
(source, size) as such documents have equal tilts: the tilted tokens m and their slope h of each source
(combined before the shuffle, so a hot source is no hot task), then lambda + (target - m) / h.  A step that
leaves the interval in which the solution is known to lie is replaced by its middle; for a start, the
interval follows from the source's least size.  Iterations end when all sources are within TOLERANCE
of their target; if that takes more than NEWTON_STEPS, an error is raised.

Rates are then rounded into whole copies.  How many copies the documents of a (source, size) get comes
from systematic rounding of the running sum of the parts below one, in order of size, which keeps a source
within its largest size of the target as long as its rates allow.  What is missing then, or too much, is first filled by the
largest sizes where it is more than one copy (FILLS rounds); then a copy is added, taken back or exchanged for one of another size while that
brings a source nearer to its target (MOVES rounds).  Both keep each document's copies at its rate rounded down or up;
sources that still miss their target by more than half a word go on with none to CAP copies.  Each source's words
are returned, and whether it missed its target by more than half of its largest size, which sizes may force.  All sums
that decide something are of whole numbers or decimals, so reruns agree bit by bit.  These steps see the distinct sizes
of a source, at most sqrt(2 x its words) rows.  Which
documents get the copy is decided by their rank in hash order, from a rank within (source, size, salt)
and counts of these groups; salts are ranges of the hash, as many as keep SALT_ROWS documents in a group
even if all have one size, and documents are dealt by them from the start.

Cases: null text has size 0; a null source is a source of its own, the last; empty tables give an
empty result; documents of size 0 take nothing; repeated rows are documents of their own; rows
without an id stay; extra columns are ignored, whatever their names; a source with no words has target 0;
a source whose target is CAP times its size repeats every document CAP times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, n_words, table

WEIGHTS, CAP, NEWTON_STEPS, TOLERANCE, SALT_ROWS, FILLS, MOVES = (1, 2, 3), 3, 100, 1e-7, 1000, 3, 6


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to rows that hold source and source_size.

    Sources are filled in order of cap / weight: those that the water level passes stop at their cap,
    the others share what is left by weight.  One row for each source goes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
    rows = rows.withColumn("sharing", F.sum("weight").over(after))
    rows = rows.withColumn("stops", cap * F.col("source_size") * F.col("sharing") <= F.col("left") * F.col("weight"))
    rows = rows.withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("left").alias("left"), F.col("sharing").alias("sharing")))).over(Window.partitionBy()))
    share = F.col("weight") * F.col("level.left") / F.col("level.sharing")
    rows = rows.withColumn("target", F.when(F.col("stops"), (cap * F.col("source_size")).cast("double")).otherwise(share))
    return rows.select(*sources.columns, "target")


def _rate(cap: int, lam: str = "lam") -> Column:
    """Tilt of a document; ``fixed`` holds the rate where the constraint leaves no choice."""
    return F.coalesce(F.col("fixed"), F.least(F.lit(float(cap)), F.exp(F.col(lam) * F.col("size") / F.col("mean"))))


def _exact(x: Column) -> Column:
    """A sum of doubles that doesn't depend on their order: of decimals with nine places."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def tilts(cells: DataFrame, sources: DataFrame, cap: int = CAP, steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Newton on the dual: (key, source_size, target, mean, fixed, lam) for each source.

    cells: (key, size, n); sources: (key, source_size, target, docs, least), docs and least over sizes above 0.
    """
    all_equal = F.col("target") >= cap * F.col("source_size")
    fixed = F.when(F.coalesce(F.col("source_size"), F.lit(0)) == 0, 0.0).when(all_equal, float(cap))
    edge = lambda x: F.log(x) / (F.col("least") / F.col("mean"))  # noqa: E731  the shortest documents' tilt is x there
    state = sources.withColumn("mean", F.col("source_size") / F.col("docs")).withColumn("fixed", fixed)
    state = state.withColumn("lo", F.least(F.lit(0.0), edge(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))))).withColumn("hi", F.greatest(F.lit(0.0), F.when(F.col("target") > F.col("source_size"), edge(F.lit(float(cap))))))
    state = materialize(state.withColumn("lam", F.lit(0.0)).drop("docs", "least"), "mix-dual")
    for _ in range(steps):
        tilt, rate = F.exp(F.col("lam") * F.col("size") / F.col("mean")), _rate(cap)
        tokens = F.col("n") * F.col("size")
        open_ = state.filter("fixed is null and not coalesce(done, false)") if "done" in state.columns else state.filter("fixed is null")
        moments = cells.join(open_.select("key", "mean", "fixed", "lam"), "key").groupBy("key").agg(_exact(tokens * rate).alias("m"), _exact(F.when(tilt < cap, tokens * F.col("size") / F.col("mean") * tilt)).alias("h"))
        new = state.join(moments, "key", "left")
        short = F.col("target") - F.col("m")
        lo, hi = F.when(short > 0, F.col("lam")).otherwise(F.col("lo")), F.when(short < 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") + short / F.nullif(F.col("h"), F.lit(0.0))
        to = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        # a source whose interval is down to the last bits can't come nearer
        done = F.col("m").isNull() | (F.abs(short) <= tolerance * F.col("target")) | (hi - lo <= 1e-14 * F.greatest(F.abs(lo), F.abs(hi)))
        old = [F.col(c) for c in ("key", "source_size", "target", "mean", "fixed")]
        state = materialize(new.select(*old, F.when(F.col("m").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("m").isNull(), F.col("hi")).otherwise(hi).alias("hi"), F.when(done, F.col("lam")).otherwise(to).alias("lam"), done.alias("done")), "mix-dual")
        if not state.filter("not done").limit(1).count():
            return state.drop("lo", "hi", "done")
    raise RuntimeError(f"the token constraints aren't met after {steps} Newton steps")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, order_col: str | None = None) -> DataFrame:
    """Rows (id, size, source, source_size, target, copies, source_taken, missed).  ``order_col`` (the id) decides between equal sizes."""
    order = F.conv(F.substring(F.md5(F.coalesce(F.col(order_col or id_col).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    named = F.col(source_col).cast("string")
    # the key is the source without nulls, so that it can be joined and dealt by as it is
    sized = docs.select(F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("size"), F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("key"), order.alias("h"))
    sized = materialize(sized, "mix-sizes")
    cells = materialize(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-cells")
    own = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    sources = targets(own.withColumn("source", _source()), weights, cap).drop("source")
    rates = tilts(cells, sources, cap)
    total = cells.agg(F.sum("n")).first()[0] or 0
    salts = max(1, -(-total // SALT_ROWS))

    extras = materialize(_extras(cells, rates, cap), "mix-extras")
    dealt = sized.withColumn("salt", F.floor(F.col("h") / F.lit(2**48 / salts)).cast("long"))
    group = ["key", "size", "salt"]
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("h", F.col("id").asc_nulls_first())))
    groups = dealt.groupBy(*group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    takes = groups.withColumn("before", before).join(extras, ["key", "size"]).select(*group, "source_size", "target", "source_taken", "missed", "whole", (F.col("extra") - F.col("before")).alias("more"))
    out = ranked.join(takes, group)
    copies = F.col("whole") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), "size", _source().alias("source"), "source_size", "target", copies.cast("long").alias("copies"), "source_taken", "missed")


def _source() -> Column:
    return F.when(F.col("key") != "", F.expr("substring(key, 2)"))


def _extras(cells: DataFrame, rates: DataFrame, cap: int) -> DataFrame:
    """(key, size, source_size, target, whole, extra): copies of each document, and how many documents get one more.

    All windows are over one source, so its rows are dealt and sorted once.
    """
    every = Window.partitionBy("key")
    upto = every.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.when(F.col("size") == 0, 0.0).otherwise(_rate(cap))
    rows = cells.join(rates, "key").withColumn("rate", rate).withColumn("whole", F.least(F.floor("rate"), F.lit(cap)).cast("long"))
    rows = rows.withColumn("part", F.when(F.col("whole") >= cap, 0.0).otherwise((F.col("rate") - F.col("whole")) * F.col("n")))
    rows = rows.withColumn("sum", F.sum("part").over(upto))
    whole = lambda x: F.floor(x + 0.5)
    rows = rows.withColumn("extra", F.least(F.col("n"), F.greatest(F.lit(0), whole(F.col("sum")) - whole(F.col("sum") - F.col("part")))).cast("long"))
    worded = F.col("size") > 0
    rows = rows.withColumn("u", F.when(worded, F.col("n") * F.col("whole") + F.col("extra")).otherwise(0))
    rows = rows.withColumns({"low": F.when(worded, F.col("n") * F.col("whole")).otherwise(0), "high": F.when(worded, F.col("n") * F.least(F.col("whole") + 1, F.lit(cap))).otherwise(0)})
    rows = _nearer(rows.select("key", "size", "n", "source_size", "target", "u", "low", "high"), 1)
    wide = F.abs(F.col("target") - F.sum(F.col("size") * F.col("u")).over(every)) > 0.5
    rows = materialize(rows.withColumn("wide", wide), "mix-cells")
    if rows.filter("wide").limit(1).count():
        free = rows.withColumns({"low": F.when(F.col("wide"), 0).otherwise(F.col("u")), "high": F.when(F.col("wide") & worded, F.col("n") * cap).otherwise(F.col("u"))})
        rows = _nearer(free.drop("wide"), 0)
    words = F.sum(F.col("size") * F.col("u")).over(every)
    largest = F.max(F.when(F.col("n") > 0, F.col("size"))).over(every)
    rows = rows.withColumn("source_taken", words).withColumn("missed", F.abs(F.col("target") - words) > largest / 2)
    return rows.select("key", "size", "source_size", "target", "source_taken", "missed", F.expr("u div n").alias("whole"), F.expr("u % n").alias("extra"))


def _nearer(rows: DataFrame, beyond: int) -> DataFrame:
    """``rows`` (key, size, n, target, u, low, high, ...) with the copies ``u`` of each size changed, from low to high, so that sources come
    nearer to their targets; sizes are filled up where more than ``beyond`` copies of the largest are missing."""
    every = Window.partitionBy("key")
    cols = rows.columns
    for _ in range(FILLS):
        rows = rows.withColumn("lack", F.col("target") - F.sum(F.col("size") * F.col("u")).over(every))
        room = F.when(F.col("lack") > 0, F.col("high") - F.col("u")).otherwise(F.col("u") - F.col("low"))
        far = F.abs("lack") > beyond * F.max("size").over(every)
        rows = rows.withColumn("room", F.when(far & (F.col("size") <= F.abs("lack")), room).otherwise(0))
        larger = F.coalesce(F.sum(F.col("room") * F.col("size")).over(every.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.greatest(F.lit(0.0), F.abs("lack") - larger)
        rows = rows.withColumn("u", F.col("u") + F.signum("lack").cast("long") * F.least("room", F.floor(left / F.greatest(F.col("size"), F.lit(1))).cast("long")))
    rows = materialize(rows.select(*cols), "mix-cells")
    for _ in range(MOVES):
        moved = rows.join(_moves(rows), "key", "left")
        step = F.when(F.col("size") == F.col("put"), 1).otherwise(0) - F.when(F.col("size") == F.col("taken"), 1).otherwise(0)
        rows = materialize(moved.withColumn("u", F.col("u") + F.when(F.col("size") > 0, step).otherwise(0)).select(*cols, F.col("put").isNotNull().alias("better")), "mix-cells")
        better = rows.filter("better").limit(1).count()
        rows = rows.drop("better")
        if not better:
            break
    return rows


def _moves(rows: DataFrame) -> DataFrame:
    """(key, taken, put) for each source that comes nearer to its target by it: a copy of size ``taken`` goes and one of size
    ``put`` comes, where size 0 stands for none.

    For each size that may go, the sizes that may come next below and above the wanted one are found by sorting both
    together; of all the pairs of a source the nearest one is taken.
    """
    lack = rows.groupBy("key").agg((F.max("target") - F.sum(F.col("size") * F.col("u"))).alias("lack"))
    none = lack.select("key", F.lit(0).cast("long").alias("size"))
    go = rows.filter("u > low").select("key", "size").unionByName(none).join(lack, "key")
    come = rows.filter("u < high").select("key", "size").unionByName(none)
    both = go.select("key", (F.col("size") + F.col("lack")).alias("at"), F.col("size").alias("taken"), "lack", F.lit(None).cast("long").alias("put"))
    both = both.unionByName(come.select("key", F.col("size").cast("double").alias("at"), F.lit(None).cast("long").alias("taken"), F.lit(None).cast("double").alias("lack"), F.col("size").alias("put")))
    near = lambda at: F.last("put", ignorenulls=True).over(Window.partitionBy("key").orderBy(at, F.col("put").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumns({"below": near(F.asc("at")), "above": near(F.desc("at"))}).filter("taken is not null")
    pairs = found.select("key", "taken", "lack", "at", F.explode(F.array("below", "above")).alias("put")).filter("put is not null")
    best = pairs.groupBy("key").agg(F.min(F.struct(F.abs(F.col("at") - F.col("put")).alias("miss"), "taken", "put")).alias("m"), F.max("lack").alias("lack"))
    return best.filter("m.miss < abs(lack) - 1e-6").select("key", "m.taken", "m.put")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its rate was rounded to, with its columns."""
    row, times = fresh(docs, "row"), fresh(docs, "times")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(rows, row, text_col, source_col, order_col=id_col).filter(F.col("copies") > 0).select(row, F.sequence(F.lit(1), F.col("copies")).alias(times))
    return rows.join(taken, row).select(*[F.col(c) for c in docs.columns], F.explode(times).alias(times)).drop(times)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source_taken", "missed")
