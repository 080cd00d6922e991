"""Quality rules: text statistics and a decision list learned by sequential covering.

Statistics of a text are column expressions.  Repeated three-word windows are found without a
shuffle: each window is hashed, and only where a text has equal hashes are (hash, place) pairs
sorted to mark the places of equal neighbours.

The list is learned from labelled rows.  Features are cut at quantiles of the labelled rows.  A rule
grows on two thirds of them: Spark counts good and bad rows by (feature, bin) among those the rule
still covers, and the condition with the best gain of information is added.  It is pruned on the
last third: trailing conditions go while that helps.  Rows that a rule covers leave, and the next
rule is grown, until no rule reaches MIN_PRECISION on the third that it was not grown on.  Only
counts by (feature, bin) come to the driver: at most FEATURES x (BINS + 1) rows for each step.
The list becomes one ordered Spark conditional expression.

Cases: null text has no words; texts without words fail the base rules; labels without a document,
null labels and repeated labels do no harm; without labels the list is empty; repeated rows get a
row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, materialize, table, text_or_empty

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 40, 8, 3, 0.9, 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_marks")
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Rows (id, STATS, MORE), all long; with ``carry`` also the whole row as the struct ``_row``."""
    without = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("_row")] if carry else []
    df = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"), *row)
    df = df.withColumns(
        {
            "_w": F.filter(F.split("_t", f"{SPACE_CLASS}+"), lambda w: w != ""),
            "_l": F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
            "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
            "n_symbols": without(SYMBOLS).cast("long"),
            "n_upper": without(UPPER).cast("long"),
            "n_marks": without("!?").cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_g": F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, _w[i + 1], _w[i + 2]))"),
        }
    ).drop("_w", "_l", "_t")
    df = df.withColumn("_g", F.expr("if(size(array_distinct(_g)) = size(_g), cast(null as array<bigint>), _g)"))
    df = df.withColumn("_z", F.expr("sort_array(transform(_g, (h, i) -> struct(h as h, i as i)))")).drop("_g")
    df = df.withColumn("_d", F.expr("sort_array(transform(filter(_z, (e, k) -> e.h <=> get(_z, k - 1).h or e.h <=> get(_z, k + 1).h), e -> e.i))")).drop("_z")
    covered = F.expr("aggregate(_d, struct(-3 as last, 0L as n), (s, i) -> struct(i as last, s.n + least(3, i - s.last) as n), s -> s.n)")
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.select(F.col("_id").alias(id_col), *STATS, *MORE, *(["_row"] if carry else []))


@dataclass(frozen=True)
class Condition:
    """feature >= cut, or feature < cut."""

    feature: str
    at_least: bool
    cut: float
    bin: int

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<'} {self.cut!r}D"

    def binned(self) -> str:
        return f"_b_{self.feature} {'>=' if self.at_least else '<'} {self.bin}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule) -> str:
    return " and ".join(c.binned() for c in rule) or "true"


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Adds the condition of the best gain while that leaves fewer good rows covered."""
    rule: list[Condition] = []
    pairs = ", ".join(f"'{f}', _b_{f}" for f in FEATURES)
    while len(rule) < MAX_CONDITIONS:
        counts = rows.filter(_covers(tuple(rule))).selectExpr(f"stack({len(FEATURES)}, {pairs}) as (f, b)", "bad").groupBy("f", "b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r.f, {})[r.b] = (r.p, r.n)
        best, found = 1e-9, None
        for f in sorted(by):
            p0, n0 = map(sum, zip(*by[f].values()))
            if not p0 or not n0:
                return tuple(rule)
            p = n = 0
            for b in range(len(cuts[f])):
                x, y = by[f].get(b, (0, 0))
                p, n = p + x, n + y
                for at_least, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                    if q >= MIN_COVER and m < n0 and (g := _gain(p0, n0, q, m)) > best:
                        best, found = g, Condition(f, at_least, cuts[f][b], b + 1)
        if found is None:
            break
        rule.append(found)
    return tuple(rule)


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of ``rule`` of the best (bad - good) / covered on rows it wasn't grown on, and its counts."""
    if not rule:
        return (), 0, 0
    stats = rows.agg(*[F.sum(F.when(F.expr(_covers(rule[:k])), F.col("bad") if bad else 1 - F.col("bad")).otherwise(0)).alias(f"{'p' if bad else 'n'}{k}") for k in range(1, len(rule) + 1) for bad in (True, False)]).first()
    scored = [((stats[f"p{k}"] or 0), (stats[f"n{k}"] or 0), k) for k in range(1, len(rule) + 1)]
    p, n, k = max(scored, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), -x[2]))
    return rule[:k], p, n


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Ordered rules for bad rows (label 0), from statistics and labels."""
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_id is not null and _y is not null")
    rows = stats.withColumnRenamed(id_col, "_id").join(named, "_id").selectExpr("_id", "cast(_y = 0 as int) as bad", *[f"{e} as {f}" for f, e in FEATURES.items()])
    rows = materialize(rows, "quality-rows")
    ranks = [i / BINS for i in range(1, BINS)]
    both = rows.agg(*[F.percentile_approx(f, ranks, 10_000).alias(f"a_{f}") for f in FEATURES], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), ranks, 10_000).alias(f"b_{f}") for f in FEATURES]).first()
    cuts = {f: sorted({*(both[f"a_{f}"] or []), *(both[f"b_{f}"] or [])}) for f in FEATURES}
    # bin k holds values with exactly k cuts at or below them
    bins = [F.expr(" + ".join([f"int({f} >= {c!r}D)" for c in cuts[f]]) or "0").alias(f"_b_{f}") for f in FEATURES]
    rows = materialize(rows.select("bad", (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("held"), *bins), "quality-bins")
    rules: list[Rule] = []
    rest = rows
    while len(rules) < MAX_RULES:
        rule, p, n = _prune(rest.filter("held"), _grow(rest.filter("not held"), cuts))
        if not rule or p + n < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        rest = rest.filter(f"not ({_covers(rule)})")
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for rows to keep: the first rule that holds rejects, else the default keeps."""
    out = None
    for rule in rules:
        holds = F.expr(" and ".join(c.sql() for c in rule))
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of all rows with base_failed and kept."""
    stats = materialize(statistics(docs, id_col, text_col), "quality-stats")
    failed = F.expr(BASE_FAILED)
    return stats.withColumn("kept", ~failed & verdict(learn(stats, labels, id_col))).withColumn("base_failed", failed)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep."""
    stats = materialize(statistics(docs, id_col, text_col, carry=True), "quality-rows")
    rules = learn(stats.select(id_col, *STATS, *MORE), labels, id_col)
    return stats.filter(~F.expr(BASE_FAILED) & verdict(rules)).select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *STATS, "base_failed", "kept")
