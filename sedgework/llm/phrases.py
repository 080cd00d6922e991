"""Phrase collocations by growing contiguous patterns to the right, prefix by prefix.

Frequent words and frequent pairs are counted first.  Every occurrence of a pair is then a pointer whose right context
(up to five words, cut where a pair isn't frequent) is projected onto it; equal contexts are added up, so a passage
that a third of all documents share is one row.  Contexts are dealt by ranges of prefixes: a task walks the prefixes
of its range depth-first, keeps the pointers' counts of the open ones only, and grows a prefix while it stays
frequent.  A range may begin or end inside a prefix, so one prefix of any size is split over tasks: those on a task's
first and last path are returned whatever their count, and the parts are added.

Pairs are counted by the numbers of their words where the frequent words make a dictionary of at most ``WORDS`` entries and
``BYTES`` bytes, which every task then gets, and as they are spelled where it would be larger.  What else is frequent
reaches the tasks as bit filters of a fixed size (``BITS``): they let a few others through, which costs work and no
exactness, as counts are always of the words themselves.  Scores are decimals of up
to 38 digits: exact for counts below 10**16.

Cases: null text counts as empty, a null language as ``und``; texts and words of any length are read whole; repeated
rows count as often as they stand; ties in the score go to more occurrences, then to the phrase in UTF-8 byte order;
without frequent phrases, and for an empty table, the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialize, slices, table, text_or_empty, tidy

#: The contract's numbers: occurrences of a candidate, its most words, and phrases of a language in the result.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of a filter (a power of two), and bytes of text that are read at once (a longer text stands alone).
BITS, SLICE = 1 << 24, 2 << 20
#: The largest dictionary of frequent words that is sent to the tasks: words, and bytes of them.
WORDS, BYTES = 400_000, 8 << 20
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_COUNTED = "lang string, phrase string, n long"


class _Codes(dict):
    """Numbers words by their first occurrence; an empty word (between two blanks) is -2, the end of a piece -1."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) - 2
        return code


def _read(batches):
    """(lang, codes of all words with -1 at the ends of pieces, the words) for slices of a batch's texts, by language."""
    for b in batches:
        for i, e in slices(pc.binary_length(b.column(1)).to_pylist(), SLICE):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).slice(i, e - i).to_pylist(), b.column(1).slice(i, e - i).cast(pa.binary()).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                seen = _Codes()
                parts = b"\n".join(texts).translate(_MAP).replace(b"\n", b" \n ").split(b" ")
                codes = np.fromiter(map(seen.__getitem__, parts), np.int64, len(parts))
                yield lang, codes[codes > -2], list(seen)[2:]


def _text(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _counted(lang: str, phrases: pa.Array, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrases)), phrases, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _words(batches):
    for lang, codes, words in _read(batches):
        n = np.bincount(codes[codes >= 0], minlength=len(words))
        yield _counted(lang, _text(words), n)
        yield _counted(lang, pa.array([None], pa.string()), [int(n.sum())])


def _may(bits: np.ndarray, lang: str, phrases: list[bytes]) -> np.ndarray:
    seed, digest = xxhash.xxh64_intdigest(lang.encode(), 42), xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, seed) for p in phrases), np.uint64, len(phrases)) & np.uint64(BITS - 1)
    return (bits[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def _frequent_pairs(codes: np.ndarray, words: list[bytes], lang: str, bits: np.ndarray):
    """Places whose word and next word (in the same piece) may both be frequent, and the pairs there as numbers."""
    may = np.append(_may(bits, lang, words), False)[codes]
    at = np.flatnonzero(may[:-1] & may[1:])
    return at, codes[at] * len(words) + codes[at + 1]


def _spelled(pairs: np.ndarray, words: list[bytes]) -> list[bytes]:
    return [words[a] + b" " + words[b] for a, b in zip(*(x.tolist() for x in divmod(pairs, max(1, len(words)))))]


def _pairs(bits: np.ndarray):
    """(lang, phrase, n) of pairs, spelled."""

    def run(batches):
        for lang, codes, words in _read(batches):
            found, n = np.unique(_frequent_pairs(codes, words, lang, bits)[1], return_counts=True)
            yield _counted(lang, _text(_spelled(found, words)), n)

    return run


def _numbered_pairs(numbers: dict[str, dict[bytes, int]]):
    """(left, right, n) of pairs of words that have a number."""

    def run(batches):
        for lang, codes, words in _read(batches):
            known = numbers.get(lang, {})
            ids = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            ids = np.append(ids, -1)[codes]  # the end of a piece has none
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            found, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], names=["pair", "n"])

    return run


def _contexts(bits: np.ndarray, pair_bits: np.ndarray, longest: int):
    """Rows (lang, words, n): right contexts of three words and more, each pair of which may be frequent."""

    def run(batches):
        for lang, codes, words in _read(batches):
            at, pair = _frequent_pairs(codes, words, lang, bits)
            found, which = np.unique(pair, return_inverse=True)
            at = at[_may(pair_bits, lang, _spelled(found, words))[which]]
            good = np.zeros(len(codes) + longest, bool)
            good[at] = True
            size, going = np.full(len(at), 2), np.ones(len(at), bool)
            for d in range(1, longest - 1):
                going &= good[at + d]
                size += going
            at, size = at[size > 2], size[size > 2]
            ext = np.append(codes, np.full(longest, -1))
            key = np.zeros(len(at), np.int64)
            for d in range(longest):
                key = np.unique(key * (len(words) + 1) + np.where(size > d, ext[at + d], -1) + 1, return_inverse=True)[1]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            at, size = at[first], size[first]
            inside = np.arange(longest) < size[:, None]
            spelled = _text(words).take(pa.array(ext[(at[:, None] + np.arange(longest))[inside]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), spelled)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), lists, pa.array(n, pa.int64())], names=["lang", "words", "n"])

    return run


def _grow(least: int):
    """Over sorted contexts: the prefixes of three words and more with their counts, depth-first; only open ones are held."""

    def run(batches):
        lang, path, sums, first, out = None, [], [], None, []

        def close(depth: int, ends: bool = False):
            while len(path) > depth:
                n = sums.pop()
                if len(path) > 2 and (n >= least or ends or (lang, path) == (first[0], first[1][: len(path)])):
                    out.append((lang, " ".join(path), n))
                path.pop()

        def batch():
            cols = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "phrase", "n"])

        for b in batches:
            for code, words, n in zip(*(c.to_pylist() for c in b.columns)):
                first = first or (code, words)
                same = 0
                if code == lang:
                    while same < min(len(path), len(words)) and path[same] == words[same]:
                        same += 1
                close(same)
                lang = code
                path += words[same:]
                sums += [0] * (len(words) - same)
                sums[2:] = [s + n for s in sums[2:]]
            yield batch()
        close(0, True)
        yield batch()

    return run


def _filter(phrases: DataFrame) -> np.ndarray:
    """A bit filter of the rows' (lang, phrase): at most BITS / 64 rows come to the driver."""
    bit = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(BITS - 1))
    cells = phrases.withColumn("b", bit).selectExpr("shiftright(b, 6) as cell", "shiftleft(1L, cast(b & 63L as int)) as bit")
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _added(counted: DataFrame, least: int) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull())


def frequent(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n): all phrases of up to ``longest`` words that occur ``least`` times, and a null phrase with the number of words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    words = materialize(_added(texts.mapInArrow(frugal(_words), _COUNTED), least), "phrases-words")
    bits = _filter(words.dropna())
    n, size = words.dropna().agg(F.count("*"), F.sum(F.octet_length("phrase"))).first()
    if n <= WORDS and (size or 0) <= BYTES:
        numbers: dict[str, dict[bytes, int]] = {}
        rows = [(i, r.lang, r.phrase) for i, r in enumerate(words.dropna().select("lang", "phrase").collect())]
        for i, lang, phrase in rows:
            numbers.setdefault(lang, {})[phrase.encode()] = i
        pairs = texts.mapInArrow(frugal(_numbered_pairs(numbers)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        named = spark.createDataFrame(rows, "id long, lang string, word string")
        left, right = (named.select(F.col("id").alias(k), *more) for k, *more in (("l", "lang", F.col("word").alias("a")), ("r", F.col("word").alias("b"))))
        pairs = pairs.withColumns({"l": F.shiftright("pair", 32), "r": F.col("pair").bitwiseAND(F.lit(2**32 - 1))}).join(left, "l").join(right, "r")
        pairs = pairs.select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), "n")
    else:
        pairs = _added(texts.mapInArrow(frugal(_pairs(bits)), _COUNTED), least)
    pairs = materialize(pairs, "phrases-pairs")
    met = texts.mapInArrow(frugal(_contexts(bits, _filter(pairs), longest)), "lang string, words array<string>, n long")
    met = materialize(met.groupBy("lang", "words").agg(F.sum("n").alias("n")), "phrases-contexts")
    grown = met.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words").mapInArrow(frugal(_grow(least)), _COUNTED)
    return materialize(words.unionByName(pairs).unionByName(_added(grown, least)), "phrases-frequent")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    A phrase's score is that of its worst cut, ``floor(1000 * a * n / (l * r))``; phrases that stand only inside a longer
    frequent one go.
    """
    with tidy(docs.sparkSession):
        found = frequent(docs, lang_col, text_col, least, longest)
    return _scored(found, top)


def _scored(found: DataFrame, top: int) -> DataFrame:
    """The ranked rows of all frequent phrases, see ``frequent``."""
    totals = found.filter("phrase is null").select("lang", F.col("n").alias("n"))
    counts = found.dropna().select("lang", "phrase", F.col("n").alias("a"))
    phrases = counts.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    halves = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda begin, size: F.concat_ws(" ", F.slice("w", begin, size))
    halves = halves.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    halves = halves.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    halves = halves.join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    exact = "cast(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0))) as bigint)"
    worst = halves.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase that is inside any longer candidate of its count is inside one of a word more
    shorter = phrases.filter(F.size("w") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    inside = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = worst.join(inside, ["lang", "phrase"], "left").filter("around is null or around < a")
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op13_phrases": """
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
grams as (
  select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, range(1, 6) t(m) where len(w) >= m)),
f as (select lang, phrase, any_value(m) as m, count(*) as a from grams group by lang, phrase having count(*) >= 100),
total as (select lang, sum(len(w)) as n from words group by lang),
cand as (select *, string_split(phrase, ' ') as w from f where m > 1),
cuts as (
  select c.lang, c.phrase, c.a, k, l.a as l, r.a as r, t.n,
    cast((1000::hugeint * c.a::hugeint * t.n::hugeint) // (l.a::hugeint * r.a::hugeint) as bigint) as score
  from cand c join range(1, 5) g(k) on k < c.m
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')
  join total t on t.lang = c.lang),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select distinct s.lang, s.phrase from cand s join cand q on s.lang = q.lang and q.m > s.m and 100 * q.a >= 100 * s.a
    and contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ')),
kept as (select * from worst anti join inner_ using (lang, phrase))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score
from kept qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
}
