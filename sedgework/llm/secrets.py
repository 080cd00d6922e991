"""Secret scans with an incremental ledger of blobs.

Every historical version of a text is addressed by the SHA-256 of its content.  A ledger of
(blob, rule version) keeps the findings of what was scanned before; a run scans only the distinct
pairs that the ledger lacks, appends them, and joins findings back to every path that holds the blob.

Distinct blobs are found with a grouped aggregate, which Spark combines before the shuffle: thousands
of copies leave a map task as one row.  The last join has one ledger row for a blob, so a hot blob
is split by the adaptive skew join.

Cases: null text counts as empty and has no findings; repeated rows get a row each; rows without a
path or id stay; texts of any length are scanned whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, frugal, shared_dir, table, text_or_empty

# Patterns of the contract (fixed values), in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex")
_CUES = ("passw", "secret", "token", "api")

#: Version of the rules above; a new one makes every blob unseen again.
RULES = "base-1"
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(c in low for c in _CUES) or "passw" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py() or "")] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["blob", "findings"])


def blob_of(text: str) -> Column:
    return F.sha2(text_or_empty(text).cast("binary"), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """What was scanned before; a ledger that does not exist yet is empty."""
    schema = f"blob string, findings {FINDINGS}, rules string"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(ledger) if there else spark.createDataFrame([], schema)


def update_ledger(versions: DataFrame, ledger: str, text_col: str = "text", rules: str = RULES) -> None:
    """Scan the blobs of ``versions`` that ``ledger`` lacks under ``rules``, and append their findings."""
    spark = versions.sparkSession
    seen = read_ledger(spark, ledger).filter(F.col("rules") == rules).select("blob")
    blobs = versions.select(blob_of(text_col).alias("blob"), text_or_empty(text_col).alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    fresh = blobs.join(seen, "blob", "left_anti").mapInArrow(frugal(_scan), f"blob string, findings {FINDINGS}")
    fresh.withColumn("rules", F.lit(rules)).write.mode("append").parquet(ledger)


def findings_of(versions: DataFrame, ledger: str, keys: list[str], text_col: str = "text", rules: str = RULES) -> DataFrame:
    """``keys`` and findings of every version; only blobs with findings take part in the join."""
    hits = read_ledger(versions.sparkSession, ledger).filter((F.col("rules") == rules) & (F.size("findings") > 0))
    hits = hits.select("blob", "findings").dropDuplicates(["blob"])
    paths = versions.select(*[F.col(k) for k in keys], blob_of(text_col).alias("blob"))
    return paths.join(hits, "blob", "left").select(*keys, "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))


def scan(versions: DataFrame, keys: list[str], text_col: str = "text", ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """Bring ``ledger`` up to date with ``versions`` and return findings for all of them."""
    ledger = ledger or shared_dir(versions.sparkSession, "ledger")
    update_ledger(versions, ledger, text_col, rules)
    return findings_of(versions, ledger, keys, text_col, rules)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ledger: str | None = None) -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; overlapping findings are replaced as one."""
    ledger = ledger or shared_dir(docs.sparkSession, "ledger")
    update_ledger(docs, ledger, text_col)
    blob, found = fresh(docs, "blob"), fresh(docs, "found")
    hits = read_ledger(docs.sparkSession, ledger).filter((F.col("rules") == RULES) & (F.size("findings") > 0)).select(F.col("blob").alias(blob), F.col("findings").alias(found)).dropDuplicates([blob])
    text = F.col(text_col)
    # Walks the findings in order of start; holds the text so far and the end of what is replaced.
    state = F.aggregate(
        found,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, f: F.struct(
            F.when(f["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, f["start"] - s["at"]), F.lit(mark))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], f["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    joined = docs.withColumn(blob, blob_of(text_col)).join(hits, blob, "left")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(state)).select(*docs.columns)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str, str]:
    """The contract read word by word, for tests."""
    text, out = text or "", []
    for m in re.finditer(ASSIGN.pattern, text, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, m.end())] if len(m[0]) >= 20 else []
    for m in re.finditer("[0-9a-f]+", text):
        out += [(m.start(), 2, m.end())] if len(m[0]) >= 24 else []
    spans = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return *(sum(k == n for _, k, _ in out) for n in range(3)), hashlib.sha256(spans.encode()).hexdigest(), spans
