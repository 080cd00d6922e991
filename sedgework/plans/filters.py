"""Filters, classifiers and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import filters as P
from ..functions.text import usable_page
from ..operators.rows import top_per_key
from .registry import query

_WORDS = "['the','of','and','is','in']"


@query("o20_usable_page", "select page_id, length(trim(html)) >= 200 and not regexp_matches(lower(html), 'access denied|captcha|temporarily unavailable|error 502|error 503') as usable from pages")
def o20(t):
    return t.pages.select("page_id", usable_page(F.col("html")).alias("usable"))


_RELEVANT = f"""select doc_id, case when length(trim(lower(x))) < 50 then true when not contains(lower(ti), 'th') and not contains(lower(x), 'th') then false
 when regexp_matches(lower(ti), '\\b(standard|st|std)[\\s/_-]*(90.1|15)\\b') or regexp_matches(lower(x), '\\b(standard|st|std)[\\s/_-]*(90.1|15)\\b') then true
 when contains(lower(ti), 'handbook') and regexp_matches(lower(ti), 'systems|refrigeration') then true
 else len(list_filter({_WORDS}, lambda w: contains(lower(x), w))) >= 2 end as relevant from (select doc_id, case when doc_id % 11 = 0 then 'x' when doc_id % 7 = 0 then 'th standard-15 ' || text else text end as x, case when doc_id % 5 = 0 then 'Handbook Systems Th' else '' end as ti from documents)"""


def _relevant(t):
    x = F.when(F.col("doc_id") % 11 == 0, "x").when(F.col("doc_id") % 7 == 0, F.concat(F.lit("th standard-15 "), F.col("text"))).otherwise(F.col("text"))
    title = F.when(F.col("doc_id") % 5 == 0, "Handbook Systems Th").otherwise("")
    return t.documents.select("doc_id", P.relevant(title, x, "th", ("90.1", "15"), ("systems", "refrigeration"), ("the", "of", "and", "is", "in")).alias("relevant"))


@query("o50_relevance", _RELEVANT)
def o50(t):
    return _relevant(t)


@query("o51_rejection_route", f"with r as ({_RELEVANT}) select doc_id, 'rejected/' || (doc_id % 20) || case when n = 0 then '' else '_' || n end || '.pdf' as target from (select doc_id, row_number() over (partition by doc_id % 20 order by doc_id) - 1 as n from r where not relevant)")
def o51(t):
    rows = _relevant(t).filter("not relevant").withColumn("dir", F.col("doc_id") % 20)
    n = F.row_number().over(Window.partitionBy("dir").orderBy("doc_id")) - 1
    return rows.withColumn("n", n).select("doc_id", F.concat(F.lit("rejected/"), F.col("dir").cast("string"), F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("_"), F.col("n").cast("string"))), F.lit(".pdf")).alias("target"))


@query("o52_keyword_match", "select p_partkey, contains(lower(p_name), 'ring') or contains(lower(p_name), 'small') or contains(lower(p_name), 'blue') as hit from part")
def o52(t):
    return t.part.select("p_partkey", P.keyword_match(F.col("p_name"), "Ring, a SMALL", ("blue",)).alias("hit"))


@query(
    "o53_bulk_candidates",
    "with m as (select o_orderkey, o_custkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')), f as (select o_custkey, min(o_orderkey) as item from m group by 1) select item, o_custkey from f where o_custkey not in (select c_custkey from customer where c_acctbal < 0) order by item limit 200",
)
def o53(t):
    m = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    first = m.groupBy("o_custkey").agg(F.min("o_orderkey").alias("item"))
    stored = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return first.join(stored, "o_custkey", "left_anti").orderBy("item").limit(200).select("item", "o_custkey")


@query("o53_skipped", "select count(distinct o_custkey) as skipped from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def o53b(t):
    m = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return m.join(t.customer.filter("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count_distinct("o_custkey").alias("skipped"))


@query(
    "o57_row_association",
    """with r as (select l_orderkey as row_id, l_partkey as link from lineitem), d as (select p_partkey as doc from part), m as (select doc, count(distinct row_id) as n, min(row_id) as row_id from d join r on r.link = d.doc group by doc)
    select d.doc, case when n = 1 then (select string_agg(distinct cast(link as varchar), ',' order by cast(link as varchar)) from r where r.row_id = m.row_id) else cast(d.doc as varchar) end as mirrors from d left join m using (doc)""",
)
def o57(t):
    from ..operators.association import associate

    rows = t.lineitem.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("link"))
    return associate(t.part.select(F.col("p_partkey").alias("doc")), rows)


@query("o58_response_class", "select event_id, case event_id % 8 when 0 then 'RETRY' when 1 then 'RESTART' when 2 then 'DEFER' when 3 then 'FAIL' when 4 then 'CHALLENGE' when 5 then 'ACCEPT' when 6 then 'FAIL' else 'FAIL' end as cls from events")
def o58(t):
    m = F.col("event_id") % 8
    status = F.element_at(F.array(*map(F.lit, (503, 416, 429, 404, 200, 206, 200, 416))), (m + 1).cast("int"))
    kind = F.when(m == 4, "text/HTML; charset=x").when(m == 5, "application/pdf").when(m == 6, "image/png")
    return t.events.select("event_id", P.response_class(status, kind, m == 1).alias("cls"))


#: (name, message, transfer had started, bytes there, whether temporary)
_FAILURES = (
    ("ReadTimeout", "x", False, 0, True),
    ("DNSError", "x", False, 0, True),
    ("SocketError", None, False, 0, True),
    ("ConnectionResetError", "x", False, 0, True),
    ("ValueError", "HTTP/2 stream 3 was not closed", False, 0, True),
    ("ValueError", "Connection reset by peer", False, 0, True),
    ("ValueError", "bad", True, 0, True),
    ("ValueError", "bad", False, 7, True),
    ("ValueError", "HTTP 503", False, 0, False),
    ("ValueError", "429 or timed out, temporarily", False, 0, False),
    ("ChunkedEncodingError", None, False, 0, False),
)


@query("o59_temporary_failure", "select event_id, event_id % 11 < 8 as temporary from events")
def o59(t):
    pick = lambda k: F.element_at(F.array(*[F.lit(row[k]) for row in _FAILURES]), (F.col("event_id") % 11 + 1).cast("int"))
    return t.events.select("event_id", P.temporary_failure(*map(pick, range(4))).alias("temporary"))


@query("o59b_verified_download", "select o_orderkey, o_orderstatus = 'F' and o_custkey % 4 = 1 as verified from orders")
def o59b(t):
    m = F.col("o_custkey") % 4
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("PARTIAL")
    signature = F.when(m == 3, F.lit(None).cast("string")).otherwise("1:2")
    return t.orders.select("o_orderkey", P.verified_download(status, F.when(m == 2, "PENDING").otherwise("VALID"), F.lit("a"), F.when(m == 0, "b").otherwise("a"), signature, F.lit("1:2")).alias("verified"))


@query("o26_evaluator_context", "select page_id, 'Title: ' || regexp_extract(html, '<title>([^<]*)', 1) || chr(10) || 'Source URL: ' || url || chr(10) || 'Search-result text: ' || substr(html, 1, 1200) as context from pages")
def o26(t):
    return t.pages.select("page_id", F.concat_ws("\n", F.concat(F.lit("Title: "), F.regexp_extract("html", "<title>([^<]*)", 1)), F.concat(F.lit("Source URL: "), F.col("url")), F.concat(F.lit("Search-result text: "), F.substring("html", 1, 1200))).alias("context"))


@query("o76_queue_decision", "with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) select o_orderkey, case when o_custkey in (select c_custkey from customer where c_nationkey = 1) then 'STORED' when rn > 1 then 'ALREADY_SCHEDULED' when o_custkey % 10 = 0 then 'MISSING_LINK' else 'QUEUE' end as decision from r")
def o76(t):
    stored = t.customer.filter("c_nationkey = 1").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_stored"))
    first = top_per_key(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", F.lit(True).alias("_first"))
    rows = t.orders.select("o_orderkey", "o_custkey").join(stored, "o_custkey", "left").join(first, "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(F.col("_stored"), "STORED").when(F.col("_first").isNull(), "ALREADY_SCHEDULED").when(F.col("o_custkey") % 10 == 0, "MISSING_LINK").otherwise("QUEUE").alias("decision"))
