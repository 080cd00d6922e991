"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these are the seeds.  An
occurrence of an identifier-like token, or of a run of neighbouring number tokens ('(555) 123-4567'),
gives an edge between its lexical pattern (the two words before it) and the instance.  Over the graph of patterns and instances Spark then scores in turn

    pattern:  conf(p, kind) = sum of its instances' scores for kind / (number of its instances + SMOOTH)
    instance: score(i, kind) = 1 for a seed, else 1 - product over its patterns of (1 - conf(p, kind))

for ROUNDS rounds.  Patterns with enough distinct seeds and confidence at least MIN_CONF mark the
unseen identifiers in their contexts; base spans always stay, and added ones never overlap them.
The tokens of a run are no instances of the graph, but where the run as a whole isn't of the trusted
kind (IP and e-mail addresses hold no blanks; too many digits), they are marked by their own patterns.

Only identifier-like tokens (with a digit or an at sign) enter the graph, so its size follows the
identifiers in the corpus and not the text.  Everything is joined on a row key written once.

Cases: null text counts as empty; repeated rows get a row each; rows without an id stay; an empty
table gives an empty result; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialize, table

KINDS = ("email", "ip", "card", "phone")
# Patterns of the contract (fixed values); look-behinds only skip places where no match can begin.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile("[0-9@]")
#: A token of a run, and what may stand between two of them.
_NUMBER = re.compile(r"\+?[0-9](?:[().-]*[0-9])*")
_GAP = re.compile(r"\)?\x20+(?:-\x20+)?\(?")
_EDGE = "\"'`.,;:!?()[]{}<>#$%&*|="

ROUNDS, SMOOTH, MIN_CONF, MIN_SEEDS = 3, 1.0, 0.8, 3
#: Most digits of a run of tokens, by kind as in the base patterns; the other kinds hold no blanks.
RUN_DIGITS = {"card": 19, "phone": 15}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match begins where the run of local characters before an at sign begins, or where the last match ended."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and _LOCAL.match(text, start - 1):
                start -= 1
        if m and start < at:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shape(kind: str, value: str) -> bool:
    """Whether a token may be an identifier of this kind that the base pattern does not describe."""
    digits = sum("0" <= c <= "9" for c in value)
    if kind == "email":
        return "@" in value[1:-1]
    return {"ip": digits >= 4, "card": digits >= 10, "phone": digits >= 6}[kind]


class Before:
    """The two words before places of a text, asked for in order of place.

    A place inside a run of non-space characters has the part of the run before it as a word; an earlier place's
    span in the same run ends that part and counts as a word of its own.  So no part is read twice.
    """

    def __init__(self, text: str):
        self.text, self.spans = text, [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]
        self.ends: list[int] = []

    def _piece(self, a: int, b: int) -> list[str]:
        w = self.text[a:b].lower().strip(_EDGE)
        return [w] if w else []

    def words(self, a: int, b: int) -> list[str]:
        k = bisect_right(self.starts, a) - 1
        out: list[str] = []  # the nearest first
        if k >= 0 and self.spans[k][1] > a:
            begin = self.spans[k][0]
            earlier = [e for e in self.ends if begin < e <= a]
            out = self._piece(max(earlier, default=begin), a) + ["0"] * min(len(earlier), 2)
            k -= 1
        while k >= 0 and len(out) < 2:
            out += self._piece(*self.spans[k])
            k -= 1
        self.ends = [*self.ends[-3:], b]
        return out[1::-1] if len(out) > 1 else out


def tokens(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens without the marks around them; none overlaps the sorted spans in ``taken``."""
    out, at = [], 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        if not _MARK.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        # spans of different kinds may nest, so the few that follow are looked at as well
        if a < b and not any(x < b and a < y for x, y in taken[max(0, at - 4) : at + 4]):
            out.append((a, b))
    return out


def runs(text: str, found: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The tokens in maximal runs of number tokens; runs with more digits than any kind has are left as tokens."""
    out: list[list[tuple[int, int]]] = []
    for a, b in found:
        number = _NUMBER.fullmatch(text, a, b)
        if number and out and out[-1][-1][2] and text[a] != "+" and _GAP.fullmatch(text, out[-1][-1][1], a):
            out[-1].append((a, b, True))
        else:
            out.append([(a, b, bool(number))])
    whole = []
    for run in out:
        spans = [(a, b) for a, b, _ in run]
        digits = sum(text[i] in "0123456789" for i in range(spans[0][0], spans[-1][1])) if len(run) > 1 else 0
        whole += [spans] if digits <= max(RUN_DIGITS.values()) else [[x] for x in spans]
    return whole


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Identifier-like tokens, runs of them and base spans, with the words before them.  kind is that of a base span;
    part is 0 for a single token, 1 for a run and 2 for a token of a run; unit names the run."""
    found = [(a, b, k, 0, a) for k, a, b in base]
    for run in runs(text, tokens(text, sorted((a, b) for _, a, b in base))):
        a, b = run[0][0], run[-1][1]
        if len(run) == 1:
            found.append((a, b, None, 0, a))
        else:
            opened = a and text[a - 1] == "(" and ")" in text[a:b]
            found.append((a - 1 if opened else a, b, None, 1, a))
            found += [(x, y, None, 2, a) for x, y in run]
    out, before = [], Before(text)
    for a, b, k, part, unit in sorted(found, key=lambda x: (x[0], x[3])):
        words = ["0" if _MARK.search(w) else w for w in before.words(a, b)]
        out.append({"start": a, "end": b, "kind": k, "pattern": " ".join(words), "value": text[a:b].lower(), "part": part, "unit": unit})
    return out


_CAND = "array<struct<start:int,end:int,kind:string,pattern:string,value:string,part:int,unit:int>>"


def _extract(batches):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pattern", pa.string()), ("value", pa.string()), ("part", pa.int32()), ("unit", pa.int32())]))
    for b in batches:
        base, more = [], []
        for t in b.column(1):
            text = t.as_py() or ""
            spans = base_spans(text) if re.search("[0-9@]", text) else []
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            more.append(candidates(text, spans) if re.search("[0-9@]", text) else [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(more, cand)], names=["_id", "base", "found"])


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS, min_conf: float = MIN_CONF, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind) pairs to trust, from edges (pattern, value, kind or null)."""
    links = edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed"))
    links = materialize(links.filter(F.col("pattern") != ""), "pii-links")
    seeds = links.filter(F.col("seed").isNotNull()).select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n"))
    scores, conf = seeds, None
    for i in range(rounds):
        conf = links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count_if(F.col("score") == 1.0).alias("seeds"))
        conf = conf.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + SMOOTH)).alias("conf"), "seeds").filter(F.col("seeds") >= min_seeds)
        conf = materialize(conf, "pii-patterns")
        if i + 1 < rounds:
            unseen = links.join(conf, "pattern").join(seeds.select("value", F.lit(True).alias("known")).distinct(), "value", "left").filter(F.col("known").isNull())
            scores = seeds.unionByName(unseen.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))))).alias("score")))
    best = conf.filter(F.col("conf") >= min_conf).groupBy("pattern").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    return best


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, base spans and added spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(_extract), f"_id {kind}, base array<struct<kind:string,start:int,end:int>>, found {_CAND}")
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "pii-base")
    cand = base.select("_row", F.explode("found").alias("c")).select("_row", "c.*")
    best = trusted_patterns(cand.filter("part < 2").select("pattern", "value", "kind"))
    fits = F.lit(False)
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    for k, rule in (("email", F.col("value").rlike(r"^.+@.+$")), ("ip", digits >= 4), ("card", digits >= 10), ("phone", digits >= 6)):
        most = RUN_DIGITS.get(k)
        rule = F.when(F.col("part") == 1, rule & (digits <= most) if most else F.lit(False)).otherwise(rule)
        fits = F.when(F.col("kind") == k, rule).otherwise(fits)
    new = cand.filter(F.col("kind").isNull()).drop("kind").join(best, "pattern").filter(fits)
    # a run that is marked takes the place of its tokens
    new = new.groupBy("_row", "unit").agg(F.collect_list(F.struct("kind", "start", "end")).alias("all"), F.max_by(F.struct("kind", "start", "end"), F.col("part") == 1).alias("run"), F.max(F.col("part") == 1).alias("whole"))
    new = new.groupBy("_row").agg(F.flatten(F.collect_list(F.when(F.col("whole"), F.array("run")).otherwise(F.col("all")))).alias("added"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("x.kind"))
    out = base.select("_row", "_id", "base").join(new, "_row", "left")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return out.select(F.col("_id").alias(id_col), "base", F.coalesce("added", none).alias("added"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    count = lambda kind: F.size(F.filter("base", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(keyed)).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(keyed).cast("long").alias("n_spans"))


def brute_force(text: str | None) -> tuple:
    """The contract with plain patterns, for tests."""
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and luhn(d) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", *m.span())] if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in out)
    return *(sum(x[0] == k for x in out) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest()
