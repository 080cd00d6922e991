"""Sources and sinks: page cache, ledger, reports, file listings, word and proxy lists, settings.

All reads name their schema.  Sinks append or overwrite whole folders; a folder is never overwritten
while it is being read.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logtable import LogTable

LEDGER_ENTRY = "struct<status:string,size:long,bytes_downloaded:long,document_attempt:int,completed:boolean,query:string,sha256:string,duplicate_of:string,validation_status:string,last_error:string,candidate:struct<title:string,document_id:string,source_url:string,mirrors:array<string>,stage1_score:int>>"
REPORT = "filename string, filepath string, stored_path string, source string, status string, query string, approved boolean, stage2_completed boolean, score int, confidence string, identity boolean, relevant boolean"


_PAGE = "key string, page struct<version:long,url:string,html:string>"


def page_cache(spark: SparkSession, folder: str) -> LogTable:
    """Pages by the hash of their url; a page that is written again takes the place of its older version alone.  Of the
    versions of one write the greatest html stays."""
    return LogTable(spark, folder, "key", _PAGE, lambda rows: rows.groupBy("key").agg(F.max("page").alias("page")))


def write_page_cache(pages: DataFrame, folder: str, url: str = "url", html: str = "html") -> None:
    """Adds pages to the cache, or replaces them; others stay."""
    cache = page_cache(pages.sparkSession, folder)
    page = F.struct(F.lit(cache.version() + 1).cast("long").alias("version"), F.col(url).alias("url"), F.col(html).alias("html"))
    cache.append(pages.select(F.sha2(url, 256).alias("key"), page.alias("page")))


def read_page_cache(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, url, html) of cached pages that are usable; with ``wanted`` (url) only those."""
    from ..functions.text import usable_page

    keys = None if wanted is None else wanted.select(F.sha2("url", 256).alias("key"))
    return page_cache(spark, folder).rows(keys=keys).select("key", "page.url", "page.html").filter(usable_page(F.col("html")))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; in local mode without one, a temporary folder."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not (conf.get("spark.master") or "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sedgework-")
    return f"{base.rstrip('/')}/sedgework/{name}-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(filename, entry fields) of ledger documents {"downloads": {filename: entry}}, one in a file or one in each of
    its ``lines``; a malformed one is empty."""
    raw = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").schema(f"downloads map<string,{LEDGER_ENTRY}>, _corrupt_record string").json(path)
    return raw.select(F.explode("downloads").alias("filename", "e")).select("filename", "e.*")


def append_ledger(events: DataFrame, folder: str) -> None:
    events.write.mode("append").parquet(folder)


def read_reports(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    rows = spark.read.option("multiLine", True).schema(REPORT).json(path)
    return rows.filter(F.col("query") == query) if query is not None else rows


def write_reports(reports: DataFrame, folder: str) -> None:
    reports.write.mode("append").json(folder)


def reports_of_paths(reports: DataFrame, paths: DataFrame) -> DataFrame:
    """Reports whose file path or stored path is among ``paths`` (path), each once.

    Both columns become rows of one, so the lookup is an equi-join.
    """
    both = reports.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.explode(F.array_distinct(F.array("filepath", "stored_path"))))
    return both.join(paths.select(F.col("path").alias("_p")).distinct(), "_p", "left_semi").drop("_p").dropDuplicates(["_id"]).drop("_id")


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, size, created, signature) of files below a folder, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    signature = F.concat(F.col("length").cast("string"), F.lit(":"), F.unix_micros("modificationTime").cast("string"))
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("created"), signature.alias("signature"))


def files_to_validate(files: DataFrame, reports: DataFrame, excluded: tuple[str, ...] = ("approved", "rejected")) -> DataFrame:
    """Files outside the result folders that no completed report names, by lower-case path."""
    done = reports.filter(F.coalesce("stage2_completed", F.lit(False))).select(F.explode(F.array("filepath", "stored_path")).alias("path")).filter("path is not null").distinct()
    inside = F.col("path").rlike("/(" + "|".join(excluded) + ")/")
    return files.filter(~inside).join(done, "path", "left_anti").orderBy(F.lower("path"))


def library_index(listing: DataFrame, index: DataFrame, parse=None) -> DataFrame:
    """(path, signature, title): titles of unchanged files are reused, only others go to ``parse`` (DataFrame -> DataFrame)."""
    known = index.select("path", F.col("signature").alias("_sig"), F.col("title").alias("_title"))
    both = listing.select("path", "signature").join(known, "path", "left")
    same = F.col("_sig").eqNullSafe(F.col("signature"))
    kept = both.filter(same).select("path", "signature", F.col("_title").alias("title"))
    changed = both.filter(~same).select("path", "signature")
    if parse is None:
        from ..functions.text import normalized_title

        parsed = changed.withColumn("title", normalized_title(F.regexp_extract("path", "([^/]*)$", 1)))
    else:
        parsed = parse(changed)
    return kept.unionByName(parsed)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file that are neither blank nor comments."""
    rows = spark.read.text(path).select(F.trim("value").alias("line"))
    return rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def verified_objects(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """Wanted (key, size, sha) with whether a stored object has that size and content."""
    there = objects.select("key", F.length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"))
    return wanted.join(there, "key", "left").withColumn("verified", F.coalesce((F.col("size") == F.col("_size")) & (F.col("sha") == F.col("_sha")), F.lit(False))).drop("_size", "_sha")


@dataclass(frozen=True)
class Settings:
    """Settings of a run; values out of range are brought into it, values that are no numbers are left at the default."""

    max_workers: int = 5
    retry_limit: int = 3
    window_s: int = 300
    stall_s: float = 60.0
    min_pacing_s: float = 0.5
    max_pacing_s: float = 2.0

    LIMITS = {"max_workers": (1, 5), "retry_limit": (1, 20), "window_s": (60, 86400), "stall_s": (1, 3600), "min_pacing_s": (0, 60), "max_pacing_s": (0, 60)}

    @classmethod
    def parse(cls, text: str) -> Settings:
        """From "section:" and "key: value" lines with # comments."""
        found, known = {}, {f.name: f for f in fields(cls)}
        for line in text.splitlines():
            key, sep, value = line.split("#")[0].partition(":")
            key, value = key.strip(), value.strip().strip("'\"")
            if not sep or key not in known or not value:
                continue
            try:
                number = float(value)
            except ValueError:
                continue
            low, high = cls.LIMITS[key]
            number = min(high, max(low, number))
            found[key] = int(number) if isinstance(known[key].default, int) else number
        s = cls(**found)
        return s if s.min_pacing_s <= s.max_pacing_s else cls(**found | {"max_pacing_s": s.min_pacing_s})


def check_run(shard: int, shards: int, progress_s: float, heartbeat_s: float, lease_s: float, pool: int, checkpoint_s: float) -> list[str]:
    """What is wrong with the settings of a shared run."""
    rules = {
        "shard must be in 0 .. shards - 1": 0 <= shard < shards,
        "progress interval must not exceed the heartbeat": 0 < progress_s <= heartbeat_s,
        "heartbeat must be below half the lease": heartbeat_s < lease_s / 2,
        "pool must be in 1 .. 8": 1 <= pool <= 8,
        "checkpoint interval must be 300 s or more": checkpoint_s >= 300,
    }
    return [text for text, ok in rules.items() if not ok]


def parse_documents(files: DataFrame, parser, schema: str) -> DataFrame:
    """Rows that ``parser`` (bytes -> list of dicts) makes of each file's ``content``, with its ``path``.

    The engine holds no parser of its own; ``schema`` names the columns that the given one returns.
    """
    import pandas as pd

    names = [f.split()[0] for f in schema.split(",")]

    def run(parts):
        for pdf in parts:
            rows = [(p, *(d.get(n) for n in names)) for p, c in zip(pdf["path"], pdf["content"]) for d in parser(c)]
            yield pd.DataFrame(rows, columns=["path", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def event_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A folder that event files are added to, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def emit_events(events: DataFrame, folder: str) -> None:
    """Appends events to such a folder; negative counts count as 0."""
    rows = events.withColumn("count", F.greatest(F.lit(0), F.coalesce(F.col("count"), F.lit(0)))) if "count" in events.columns else events
    rows.write.mode("append").parquet(folder)
