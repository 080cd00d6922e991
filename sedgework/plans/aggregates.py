"""Aggregations: summaries, counters, scores, dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.dashboard import fill_workers, reconcile
from .registry import query

_COUNTS = "count(*) filter (where {0})"


def _status():
    return F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "APPROVED").when(F.col("quality") == 0, "REJECTED").otherwise("PENDING")


_S = "case when quality = 1 and toxic = 0 then 'APPROVED' when quality = 0 then 'REJECTED' else 'PENDING' end"


@query("o81_validation_summary", f"select source, count(*) filter (where s = 'APPROVED') as approved, count(*) filter (where s = 'REJECTED') as rejected, count(*) filter (where s = 'PENDING') as pending from (select source, {_S} as s from labels l join documents d on d.doc_id = l.doc_id) group by source")
def o81(t):
    rows = t.labels.withColumn("s", _status()).join(t.documents.select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(*[F.count_if(F.col("s") == k).alias(k.lower()) for k in ("APPROVED", "REJECTED", "PENDING")])


@query("o82_existing_scan", f"select count(*) as found, count(l.doc_id) as processed, count(*) filter (where s = 'APPROVED') as approved, count(*) filter (where s = 'REJECTED') as rejected, count(*) filter (where coalesce(s, 'PENDING') = 'PENDING') as pending from documents d left join (select doc_id, {_S} as s from labels) l on l.doc_id = d.doc_id")
def o82(t):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", _status().alias("s")), "doc_id", "left")
    n = lambda k: F.count_if(F.coalesce("s", F.lit("PENDING")) == k)
    return rows.agg(F.count("*").alias("found"), F.count("s").alias("processed"), n("APPROVED").alias("approved"), n("REJECTED").alias("rejected"), n("PENDING").alias("pending"))


@query("o83_global_counters", "select count(*) as total, count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus = 'O') as ready, count(*) filter (where o_orderpriority = '1-URGENT' and c_acctbal > 0) as approved, count(*) filter (where c_acctbal <= 0) as failed from orders join customer on o_custkey = c_custkey")
def o83(t):
    rows = t.orders.join(t.customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "O").alias("ready"), F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("c_acctbal") > 0)).alias("approved"), F.count_if(F.col("c_acctbal") <= 0).alias("failed"))


@query("o84_pages_completed", "select count(*) as pages from orders where o_orderstatus = 'F'")
def o84(t):
    return t.orders.filter("o_orderstatus = 'F'").agg(F.count("*").alias("pages"))


@query("o85_live_goodput", "select coalesce(sum(cast(json_extract_string(props, '$.k') as double)), 0) as goodput from events where epoch_us(ts) >= (select max(epoch_us(ts)) from events) - 86400000000")
def o85(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    now = t.events.agg(F.max(us).alias("now"))
    live = t.events.select("props", us.alias("us")).crossJoin(F.broadcast(now)).filter("us >= now - 86400000000")
    return live.agg(F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("double")), F.lit(0.0)).alias("goodput"))


@query("o86_acceptance_gate", "with a as (select c_nationkey, count(*) as n from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by 1) select o_orderkey from orders join customer on o_custkey = c_custkey join a using (c_nationkey) where o_orderstatus = 'O' and n < 300")
def o86(t):
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    open_ = rows.filter("o_orderstatus = 'F'").groupBy("c_nationkey").agg(F.count("*").alias("n")).filter("n < 300")
    return rows.filter("o_orderstatus = 'O'").join(open_, "c_nationkey", "left_semi").select("o_orderkey")


@query("o87_report_counts", "select source, count(*) filter (where toxic = 0) as identified, count(*) filter (where quality = 1) as relevant, count(*) as reports from labels l join documents d on d.doc_id = l.doc_id group by source")
def o87(t):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    yes = lambda c: F.count_if(c.eqNullSafe(F.lit(True)))
    return rows.groupBy("source").agg(yes(F.col("toxic") == 0).alias("identified"), yes(F.col("quality") == 1).alias("relevant"), F.count("*").alias("reports"))


@query(
    "o88_gateway_score",
    "with e as (select *, case event_type when 'purchase' then 10 when 'click' then 5 when 'error' then -20 when 'signup' then -30 else 0 end as pts, event_type in ('purchase', 'click') as ok from events), l as (select user_id, max(event_id) filter (where ok) as last_ok from e group by 1) select e.user_id, sum(pts) as score, count(*) filter (where ok) as successes, count(*) filter (where not ok) as failures, max(epoch_us(ts)) filter (where not ok) as last_failure, count(*) filter (where not ok and (last_ok is null or event_id > last_ok)) as consecutive from e join l using (user_id) group by e.user_id",
)
def o88(t):
    ok = F.col("event_type").isin("purchase", "click")
    pts = F.expr("case event_type when 'purchase' then 10 when 'click' then 5 when 'error' then -20 when 'signup' then -30 else 0 end")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # two aggregates that combine before the shuffle; only failures are sent as rows, for the join in between
    sums = t.events.groupBy("user_id").agg(F.sum(pts).alias("score"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.max(F.when(~ok, us)).alias("last_failure"), F.max(F.when(ok, F.col("event_id"))).alias("_last_ok"))
    since = t.events.filter(~ok).select("user_id", "event_id").join(sums.select("user_id", "_last_ok"), "user_id").filter("_last_ok is null or event_id > _last_ok")
    run = since.groupBy("user_id").agg(F.count("*").alias("_run"))
    return sums.join(run, "user_id", "left").select("user_id", "score", "successes", "failures", "last_failure", F.coalesce("_run", F.lit(0)).alias("consecutive"))


@query("o89_metric_totals", "with h as (select max(ts) as m from events), s as (select event_type, sum(value) as now, sum(value) filter (where ts < m - interval 1 day) as before from events, h group by 1) select event_type, round(now, 4) as total, round(now - coalesce(before, 0), 4) as delta, round(now - coalesce(before, 0), 4) / 1048576.0::double / 86400.0::double as rate from s")
def o89(t):
    now = t.events.agg(F.max("ts").alias("m"))
    s = t.events.crossJoin(F.broadcast(now)).groupBy("event_type").agg(F.sum("value").alias("total"), F.sum(F.when(F.col("ts") < F.col("m") - F.expr("interval 1 day"), F.col("value"))).alias("b"))
    delta = F.round(F.col("total") - F.coalesce("b", F.lit(0.0)), 4)
    return s.select("event_type", F.round("total", 4).alias("total"), delta.alias("delta"), F.try_divide(delta / 1048576.0, F.lit(86400.0)).alias("rate"))


@query("o91_run_summary", "select (select count(*) from pages) as pages, (select count(*) from documents) as documents, (select count(*) from labels where quality = 1) as approved, (select count(*) from orders where o_orderstatus = 'F') as completed, (select count(*) from events where event_type = 'error') as failed")
def o91(t):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(t.pages, "pages")
    for part in (n(t.documents, "documents"), n(t.labels.filter("quality = 1"), "approved"), n(t.orders.filter("o_orderstatus = 'F'"), "completed"), n(t.events.filter("event_type = 'error'"), "failed")):
        out = out.crossJoin(part)  # one row each
    return out


@query("o92_page_summary", "select o_custkey // 25 as page, count(*) filter (where o_orderstatus = 'O') as queued, count(*) filter (where o_orderstatus = 'F') as stored, count(*) filter (where o_orderstatus = 'P') as recovery from orders group by 1")
def o92(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy(F.floor(F.col("o_custkey") / 25).alias("page")).agg(n("O").alias("queued"), n("F").alias("stored"), n("P").alias("recovery"))


_W = "with w as (select user_id as worker, arg_max(event_type, event_id) as e from events where user_id < 60 group by 1), s as (select worker, case when e in ('view', 'click') then 'DOWNLOADING' else 'IDLE' end as state from w), r as (select *, row_number() over (partition by state order by worker) as rn, count(*) filter (where state <> 'IDLE') over () as active from s)"


def _workers(t):
    last = t.events.filter("user_id < 60").groupBy(F.col("user_id").alias("worker")).agg(F.max_by("event_type", "event_id").alias("e"))
    return last.select("worker", F.when(F.col("e").isin("view", "click"), "DOWNLOADING").otherwise("IDLE").alias("state"))


@query("o93_snapshot_surplus", f"{_W} select worker, case when state <> 'IDLE' and rn > 10 then 'IDLE' when state = 'IDLE' and rn <= greatest(0, 10 - active) then 'STARTING' else state end as state from r")
def o93(t):
    return reconcile(_workers(t), "worker", "state", 10)


@query("o93_snapshot_deficit", f"{_W} select worker, case when state <> 'IDLE' and rn > 40 then 'IDLE' when state = 'IDLE' and rn <= greatest(0, 40 - active) then 'STARTING' else state end as state from r")
def o93b(t):
    return reconcile(_workers(t), "worker", "state", 40)


@query("o93_recovery_backlog", "select count(*) as backlog, count(*) filter (where o_custkey % 6 + 1 >= 4) as near_limit from orders where o_orderstatus = 'P'")
def o93c(t):
    return t.orders.filter("o_orderstatus = 'P'").agg(F.count("*").alias("backlog"), F.count_if(F.col("o_custkey") % 6 + 1 >= 4).alias("near_limit"))


@query("o94_worker_fill", f"{_W} select i as worker, coalesce(state, 'IDLE') as state from range(1, 81) g(i) left join s on s.worker = i")
def o94(t):
    return fill_workers(_workers(t), "worker", "state", 80)


@query("o95_page_details", "select o_orderkey, l_linenumber, l_returnflag from orders left join (select l_orderkey, l_linenumber, l_returnflag from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber desc, l_returnflag desc, l_partkey desc) = 1) on l_orderkey = o_orderkey")
def o95(t):
    last = t.lineitem.groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_returnflag")).alias("m")).select("l_orderkey", "m.l_linenumber", "m.l_returnflag")
    return t.orders.select("o_orderkey").join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_returnflag")


@query("o96_active_validations", "select o_orderkey from orders where o_orderstatus = 'P' order by o_orderkey limit 5")
def o96(t):
    return t.orders.filter("o_orderstatus = 'P'").orderBy("o_orderkey").limit(5).select("o_orderkey")


@query("o186_evaluation_telemetry", "select source, count(*) as document_count, cast(least(12000, sum(length(text))) as bigint) as characters, count(*) filter (where quality = 1) as approved from documents d left join labels l on l.doc_id = d.doc_id group by source")
def o186(t):
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("document_count"), F.least(F.lit(12000), F.sum(F.length("text"))).cast("long").alias("characters"), F.count_if(F.col("quality") == 1).alias("approved"))


@query("o188_bulk_results", "select case when o_orderstatus = 'F' then 'completed' when o_totalprice > 200000 then 'partial' else 'failed' end as status, count(*) as n from orders group by 1")
def o188(t):
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_totalprice") > 200000, "partial").otherwise("failed")
    return t.orders.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("o190_benchmark_summary", "select min(value) as first_done, max(value) as last_done, round(sum(value) / (5 * max(value)) * 100, 6) as busy from events where event_type = 'purchase'")
def o190(t):
    return t.events.filter("event_type = 'purchase'").agg(F.min("value").alias("first_done"), F.max("value").alias("last_done"), F.round(F.sum("value") / (5 * F.max("value")) * 100, 6).alias("busy"))


@query("o15_reports_of_query", "select lang, count(*) as reports, count(*) filter (where quality = 1) as approved from documents d join labels l on l.doc_id = d.doc_id where lang = 'en' group by lang")
def o15(t):
    rows = t.documents.filter("lang = 'en'").select("doc_id", "lang").join(t.labels, "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("reports"), F.count_if(F.col("quality") == 1).alias("approved"))
