"""Integrity of stored files and admission to validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import integrity as I
from .registry import query


def _content():
    m = F.col("doc_id") % 6
    body = F.concat(F.lit("%PDF-1.7 "), F.col("text"), F.repeat(F.lit("x"), 200), F.lit(" %%EOF"))
    text = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, "").when(m == 2, "%PDF- short").when(m == 3, F.concat(F.lit("HTML"), body)).when(m == 4, F.concat(F.lit("%PDF-1.7 "), F.col("text"), F.repeat(F.lit("x"), 2000))).otherwise(body)
    return text.cast("binary")


_ERR = "case doc_id % 6 when 0 then 'PDF_MISSING' when 1 then 'EMPTY_PDF' when 2 then 'PDF_TRUNCATED' when 3 then 'INVALID_PDF_HEADER' when 4 then 'PDF_TRUNCATED' end"


@query("o160_structure", f"select doc_id, doc_id % 6 = 5 as valid, {_ERR} as error_type from documents")
def o160(t):
    c = _content()
    return t.documents.select("doc_id", I.structure(c, F.octet_length(c)).alias("s")).select("doc_id", "s.*")


@query("o161_finalization", "select doc_id, case when n_chars < 2048 then 'DISCARDED' when n_chars < 2500 then 'INCOMPLETE' else 'FINAL' end as state from documents")
def o161(t):
    return t.documents.select("doc_id", I.finalization(F.col("n_chars"), F.lit(2500)).alias("state"))


@query("o162_promotion", f"with e as (select doc_id, {_ERR} as e, doc_id % 4 = 0 as p from documents where doc_id % 6 > 0) select doc_id, case when e is null then 'COMPLETED' when p or e = 'PDF_TRUNCATED' then 'PARTIAL' else 'FAILED_FOR_ROUND' end as status, case when e is null then 'VALID' else 'INVALID' end as integrity, case when e is null then 'keep' when e = 'PDF_TRUNCATED' and not p then 'becomes partial' else 'quarantine' end as action from e")
def o162(t):
    c = _content()
    s = t.documents.filter("doc_id % 6 > 0").select("doc_id", I.structure(c, F.octet_length(c)).alias("s"))
    return s.select("doc_id", I.promotion(F.col("s.valid"), F.coalesce("s.error_type", F.lit("")), F.col("doc_id") % 4 == 0).alias("p")).select("doc_id", "p.*")


@query("o163_admission", "with r as (select o_orderkey, o_custkey, case when o_custkey % 9 = 0 then 'MISSING' when o_orderstatus = 'F' then 'DONE' when o_custkey % 7 = 0 then 'PDF_INVALID' end as s, o_totalprice from orders), q as (select *, row_number() over (partition by o_custkey, s is null order by o_orderkey) as rn from r) select o_orderkey, coalesce(s, case when rn <= 3 then 'QUEUED' else 'PENDING' end) as decision from q")
def o163(t):
    c = F.col("o_custkey")
    known = F.when(c % 9 == 0, "MISSING").when(F.col("o_orderstatus") == "F", "DONE").when(c % 7 == 0, "PDF_INVALID")
    rn = F.row_number().over(Window.partitionBy("o_custkey", known.isNull()).orderBy("o_orderkey"))
    rows = t.orders.withColumn("running", rn - 1)
    status = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("PENDING")
    return rows.select("o_orderkey", I.validation_admission(c % 9 != 0, status, c % 7 != 0, F.col("running"), 3).alias("decision"))


@query("o164_restore_pending", "select d.doc_id from documents d left join labels l on l.doc_id = d.doc_id where l.doc_id is null or (quality = 1 and toxic = 1)")
def o164(t):
    from ..operators.dedup import label_status

    rows = t.documents.select("doc_id").join(label_status(t.labels), "doc_id", "left")
    return rows.filter(~F.coalesce("status", F.lit("PENDING")).isin("APPROVED", "REJECTED", "DUPLICATE_PENDING", "PDF_INVALID")).select("doc_id")


@query("o165_cache_hits", "select d.doc_id, l.doc_id is not null and lang = 'en' and n_chars % 2 = 0 as hit from documents d left join labels l on l.doc_id = d.doc_id")
def o165(t):
    reports = t.labels.select("doc_id", F.lit("en").alias("query"))
    rows = t.documents.join(reports, "doc_id", "left")
    return rows.select("doc_id", F.coalesce((F.col("query") == F.col("lang")) & (F.col("n_chars") % 2 == 0), F.lit(False)).alias("hit"))


@query("o167_new_routes", "select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size < 20)")
def o167(t):
    tried = t.part.filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_partkey").join(tried, "l_partkey", "left_anti").distinct()


@query("o11_verified_objects", "select doc_id, doc_id % 3 = 0 as verified from documents")
def o11(t):
    from ..sources.files import verified_objects

    i = F.col("doc_id")
    stored = t.documents.select(i.alias("key"), F.when(i % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content")).filter(i % 3 != 2)
    wanted = t.documents.select(i.alias("key"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha"))
    return verified_objects(wanted, stored).select(F.col("key").alias("doc_id"), "verified")
