"""The ledger of documents as an append-only event log, its current state and views of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.logtable import LogTable, first, last, merged_maps, written


def final_status(validation: Column, stage1: Column, transfer: Column) -> Column:
    """ACCEPTED, REJECTED, PDF_INVALID, STAGE1_REJECTED, DOWNLOAD_FAILED or IN_PROGRESS, the first that holds."""
    v, d = F.upper(F.coalesce(validation, F.lit(""))), F.upper(F.coalesce(transfer, F.lit("")))
    return (
        F.when(v == "APPROVED", "ACCEPTED").when(v == "REJECTED", "REJECTED").when(v == "PDF_INVALID", "PDF_INVALID")
        .when((F.upper(F.coalesce(stage1, F.lit(""))) == "REJECTED") | (d == "STAGE1_REJECTED"), "STAGE1_REJECTED").when(d == "PERMANENTLY_FAILED", "DOWNLOAD_FAILED").otherwise("IN_PROGRESS")
    )


def current(log: DataFrame, key: str, seq: list[str], fields: list[str], cleared: dict[str, str] | None = None) -> DataFrame:
    """Field-wise merge of a log: the last value written of each field.

    Null means "not written", unless ``cleared`` names a boolean column that marks a written null.
    One aggregate that combines before the shuffle; no window, no sort.
    """
    order = F.struct(*seq)
    aggs = []
    for f in fields:
        written = F.col(f).isNotNull() | (F.coalesce(F.col(cleared[f]), F.lit(False)) if cleared and f in cleared else F.lit(False))
        # the value in a struct, as max_by leaves rows with a null ordering out
        aggs.append(F.max_by(F.struct(F.col(f)), F.when(written, order)).getField(f).alias(f))
    return log.groupBy(key).agg(*aggs)


#: Statuses that say that a document isn't complete; longest error type and message that are kept (fixed values).
UNFINISHED = ("QUEUED", "DOWNLOADING", "FAILED_FOR_ROUND", "RECOVERING", "PERMANENTLY_FAILED", "STAGE1_REJECTED")
ERROR_TYPE, ERROR_MESSAGE = 80, 240
_CANDIDATE = "struct<document_id:string,title:string,query:string,run_id:string,mirrors:array<string>,stage1_status:string,stage1_score:int,source_page:int,source_item:int>"
_ERROR = "struct<error_type:string,error_message:string,timestamp:long>"
#: An update of one document; all but filename, seq, ts and status may be null, which leaves a field as it is.
UPDATE = f"filename string, seq long, ts long, status string, url string, size long, reason string, candidate {_CANDIDATE}, document_attempt int, request_attempt int, completed boolean, retry_after_seconds double, validation_status string, technical_error_type string, technical_error_message string"
_FIELDS = {
    "status": "string", "url": "string", "updated_at": "long", "completed": "boolean", "reason": "string", "retry_after_until": "double", "validation_status": "string", "technical_error": _ERROR, "document_attempt": "int",
    "request_attempt": "int", "candidate": _CANDIDATE, "document_id": "string", "title": "string", "query": "string", "run_id": "string", "last_progress_time": "long",
    "noted_error": "string", "stage1_status": "string", "stage1_score": "int", "source_page": "int", "source_item": "int",
}
LEDGER = "filename string, began struct<seq:long,value:boolean>, begin struct<seq:long,size:long,ts:long>, end struct<seq:long,size:long>, " + ", ".join(f"{n} struct<seq:long,value:{t}>" for n, t in _FIELDS.items())


def ledger_rows(updates: DataFrame) -> DataFrame:
    """Rows of a ledger log from updates (columns as in UPDATE): what each of them writes.

    The reason is written by every update, and so cleared by one without; completion ends a waiting time; an update
    with a candidate names the document, after its file where the candidate doesn't.
    """
    seq, c, done = F.col("seq"), F.col("candidate"), F.upper("status") == "COMPLETED"
    fill = lambda x: F.nullif(x, F.lit(""))
    complete = F.coalesce("completed", F.when(done, True).when(F.upper("status").isin(*UNFINISHED), False))
    error = F.when(fill(F.col("technical_error_type")).isNotNull(), F.struct(F.substring("technical_error_type", 1, ERROR_TYPE).alias("error_type"), F.substring(F.coalesce("technical_error_message", F.lit("")), 1, ERROR_MESSAGE).alias("error_message"), F.col("ts").alias("timestamp")))
    until = F.when(F.col("retry_after_seconds").isNotNull(), F.col("ts") + F.greatest(F.lit(0.0), F.col("retry_after_seconds")))
    sized = lambda *more: F.when(F.col("size").isNotNull(), F.struct(seq.alias("seq"), F.col("size").alias("size"), *more))
    always = F.lit(True)
    fields = {
        "status": written(F.col("status"), seq), "url": written(fill(F.col("url")), seq), "updated_at": written(F.col("ts"), seq), "completed": written(complete, seq),
        "reason": written(fill(F.col("reason")), seq, always), "noted_error": written(fill(F.col("reason")), seq), "retry_after_until": written(until.cast("double"), seq, until.isNotNull() | done),
        "validation_status": written(F.col("validation_status"), seq), "technical_error": written(error, seq), "document_attempt": written(F.col("document_attempt"), seq), "request_attempt": written(F.col("request_attempt"), seq),
        "candidate": written(c, seq), "document_id": written(F.when(c.isNotNull(), F.coalesce(fill(c["document_id"]), "filename")), seq),
        **{n: written(fill(c[n]), seq) for n in ("title", "query", "run_id")}, **{n: written(c[n], seq) for n in ("stage1_status", "stage1_score", "source_page", "source_item")},
        "last_progress_time": written(F.lit(None).cast("long"), seq),
    }
    rows = updates.select("filename", written(c.isNotNull(), seq).alias("began"), sized(F.col("ts").alias("ts")).alias("begin"), sized().alias("end"), *[v.alias(k) for k, v in fields.items()])
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in updates.sparkSession.createDataFrame([], LEDGER).schema])


def merged_ledger(rows: DataFrame) -> DataFrame:
    """One row for each file: fields by their last write, and the last time that the size grew from one update to the next.

    A row stands for a stretch of updates (its first and last size); growth from a stretch to the next one is found
    here, growth within one is kept.  Stretches of a file must not interleave, which batches in order never do.
    """
    w = Window.partitionBy("filename").orderBy("begin.seq", "end.seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("end", ignorenulls=True).over(w)["size"], F.lit(0))
    grew = F.when(F.col("begin.size") > before, F.struct(F.col("begin.seq").alias("seq"), F.col("begin.ts").alias("value")))
    known = F.col("last_progress_time")
    # what a stretch knows of its own first update was judged without the ones before it
    rows = rows.withColumn("last_progress_time", F.when(known["seq"] > F.col("begin.seq"), known).otherwise(grew))
    return rows.groupBy("filename").agg(first("began"), F.min_by("begin", F.col("begin.seq")).alias("begin"), F.max_by("end", F.col("end.seq")).alias("end"), *[last(n) for n in _FIELDS])


def ledger_table(spark: SparkSession, folder: str) -> LogTable:
    """A ledger of documents by filename as a log table; rows come from ``ledger_rows``, its view is ``ledger_entries``."""
    return LogTable(spark, folder, "filename", LEDGER, merged_ledger)


def ledger_entries(rows: DataFrame) -> DataFrame:
    """The entries that merged ledger rows stand for, with source_metadata and the nested lifecycle."""
    plain = rows.select("filename", F.col("began")["value"].alias("began"), F.coalesce("end.size", F.lit(0)).alias("bytes_downloaded"), *[F.col(n)["value"].alias(n) for n in _FIELDS])
    title = F.coalesce("title", F.when(F.col("candidate").isNotNull(), F.col("filename")))
    texts = {n: F.coalesce(n, F.when(F.col("candidate").isNotNull(), "")) for n in ("query", "run_id")}
    plain = plain.withColumns({"title": title, **texts, "url": F.coalesce("url", F.lit("")), "last_error": F.col("reason")})
    mirrors = F.coalesce(F.col("candidate")["mirrors"], F.expr("cast(array() as array<string>)"))
    source = F.struct(F.col("url").alias("source_url"), mirrors.alias("mirrors"), F.coalesce("title", "filename").alias("title"))
    return plain.withColumns({"source_metadata": source, "lifecycle": _nested()}).drop("began", "noted_error")


def _nested() -> Column:
    """The lifecycle of an entry.

    Stage 1 is what a candidate last said; where none did it is APPROVED if the first update came with a candidate, else
    PENDING.  Stage 2 is the last validation status, else PENDING.  Other fields are the last ones that were known,
    errors that have been cleared since included.
    """
    n = lambda c: F.nullif(F.col(c), F.lit(""))
    stage1 = F.coalesce(n("stage1_status"), F.when(F.col("began"), "APPROVED").otherwise("PENDING"))
    stage2 = F.coalesce(n("validation_status"), F.lit("PENDING"))
    return F.struct(
        F.struct(F.lit("DISCOVERED").alias("status"), F.col("source_page"), F.col("source_item")).alias("discovery"),
        F.struct(stage1.alias("status"), F.col("stage1_score").alias("score"), stage1.isin("APPROVED", "REJECTED").alias("completed")).alias("stage1"),
        F.struct(F.upper("status").alias("status"), F.coalesce("document_attempt", F.lit(0)).alias("document_attempt"), F.col("bytes_downloaded"), F.col("noted_error").alias("last_error")).alias("download"),
        F.struct(F.upper(stage2).alias("status"), F.upper(stage2).isin("APPROVED", "REJECTED", "PDF_INVALID").alias("completed"), F.col("technical_error")).alias("stage2"),
        F.when(stage2.isin("APPROVED"), "ACCEPTED").when(stage2.isin("REJECTED", "PDF_INVALID"), stage2).when(stage1 == "REJECTED", "STAGE1_REJECTED").when(F.upper("status") == "PERMANENTLY_FAILED", "DOWNLOAD_FAILED").otherwise("IN_PROGRESS").alias("final_status"),
    )


DOCUMENTS = "key string, title struct<seq:long,value:string>, filename struct<seq:long,value:string>, began struct<seq:long,value:string>, metadata map<string,struct<seq:long,value:string>>"


def document_rows(candidates: DataFrame) -> DataFrame:
    """Rows of a documents log from (key, seq, title, filename, metadata map): the first title that isn't empty stays, metadata is
    merged name by name, the first file name holds until one comes whose metadata has mirrors."""
    seq, meta = F.col("seq"), F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    named = written(F.col("filename"), seq, F.map_contains_key(meta, "mirrors"))
    marked = F.transform_values(meta, lambda k, v: F.struct(seq.alias("seq"), v.alias("value")))
    return candidates.select("key", written(F.nullif("title", F.lit("")), seq).alias("title"), named.alias("filename"), written(F.col("filename"), seq, F.lit(True)).alias("began"), marked.alias("metadata"))


def merged_documents(rows: DataFrame) -> DataFrame:
    one = rows.groupBy("key").agg(first("title"), last("filename"), first("began"))
    maps = merged_maps(rows, ["key"], "metadata")
    empty = F.expr("cast(map() as map<string,struct<seq:long,value:string>>)")
    return one.join(maps, "key", "left").withColumn("metadata", F.coalesce("metadata", empty))


def documents_table(spark: SparkSession, folder: str) -> LogTable:
    """Keyed documents as a log table; rows come from ``document_rows``, its view is ``document_entries``."""
    return LogTable(spark, folder, "key", DOCUMENTS, merged_documents)


def document_entries(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("filename"), F.col("began"))["value"]
    return rows.select("key", F.coalesce(F.col("title")["value"], F.lit("")).alias("title"), name.alias("filename"), F.transform_values("metadata", lambda k, v: v["value"]).alias("metadata"))


VERDICTS = "key string, query_hash string, document_id string, verdict struct<seq:long,value:struct<stage1_status:string,prompt_version:string>>"


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    """Rows of a verdict log from (query_hash, document_id, seq, stage1_status, prompt_version): the last one of a pair stands."""
    value = F.struct("stage1_status", "prompt_version")
    return verdicts.select(F.concat_ws("|", "query_hash", "document_id").alias("key"), "query_hash", "document_id", F.struct(F.col("seq").alias("seq"), value.alias("value")).alias("verdict"))


def verdicts_table(spark: SparkSession, folder: str) -> LogTable:
    return LogTable(spark, folder, "key", VERDICTS, lambda rows: rows.groupBy("key", "query_hash", "document_id").agg(last("verdict")))


def lifecycle(rows: DataFrame) -> DataFrame:
    """The nested view of ledger rows (filename, title, stage1, transfer, bytes, attempt, validation)."""
    done = F.upper("transfer") == "COMPLETED"
    return rows.select(
        "filename",
        F.struct(F.lit("DISCOVERED").alias("status"), F.col("title")).alias("discovery"),
        F.struct(F.coalesce(F.upper("stage1"), F.lit("PENDING")).alias("status"), F.col("stage1").isNotNull().alias("completed")).alias("stage1"),
        F.struct(F.upper("transfer").alias("status"), F.col("bytes"), F.col("attempt"), F.coalesce(done, F.lit(False)).alias("completed")).alias("download"),
        F.struct(F.coalesce(F.upper("validation"), F.lit("PENDING")).alias("status"), F.coalesce(F.upper("validation").isin("APPROVED", "REJECTED", "PDF_INVALID"), F.lit(False)).alias("completed")).alias("stage2"),
        final_status(F.col("validation"), F.col("stage1"), F.col("transfer")).alias("final_status"),
    )


def reconciled(listing: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Files that are there but not COMPLETED in the ledger become so; ledger rows without a file keep their status."""
    there = listing.select(F.col(key), F.lit(True).alias("_there"))
    both = there.join(ledger.select(key, "status"), key, "full_outer")
    return both.select(key, F.when(F.col("_there"), "COMPLETED").otherwise(F.upper("status")).alias("status"))


def upsert_documents(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert of (key, title, filename, metadata): the first non-empty title stays, metadata is merged with the new on top, the file name is replaced only if the new metadata has mirrors."""
    o, n = old.alias("o"), new.alias("n")
    keep = lambda c: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"n.{c}"))
    has = F.coalesce(F.map_contains_key(F.col("n.metadata"), "mirrors"), F.lit(False))
    empty = F.expr("cast(map() as map<string,string>)")
    om, nm = F.coalesce(F.col("o.metadata"), empty), F.coalesce(F.col("n.metadata"), empty)
    merged = F.map_concat(F.map_filter(om, lambda k, v: ~F.map_contains_key(nm, k)), nm)
    file = F.when(F.col(f"o.{key}").isNull() | has, F.coalesce("n.filename", "o.filename")).otherwise(F.col("o.filename"))
    return o.join(n, key, "full_outer").select(key, keep("title").alias("title"), file.alias("filename"), merged.alias("metadata"))
