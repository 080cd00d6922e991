"""Scheduling decisions as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scheduling as S
from ..operators import recovery as R
from .registry import query

_KIND = "case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'primary' when o_orderpriority = '5-LOW' then 'recovery' else 'handoff' end"


@query("o121_backlog", "select o_custkey, max(o_orderkey % 5 + 1) + 1 as attempt, max(epoch_us(o_orderdate)) as not_before from orders group by 1 having max(o_orderkey % 5 + 1) + 1 <= 5")
def o121(t):
    jobs = t.orders.select("o_custkey", (F.col("o_orderkey") % 5 + 2).alias("attempt"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("not_before"))
    return R.backlog(jobs, "o_custkey", "attempt").filter("attempt <= 5")


@query("o122_backlog_restored", "select o_custkey, min(o_orderkey % 5 + 1) as attempt, max(epoch_us(o_orderdate)) as not_before from orders group by 1")
def o122(t):
    jobs = t.orders.select("o_custkey", (F.col("o_orderkey") % 5 + 1).alias("attempt"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("not_before"))
    return R.backlog(jobs, "o_custkey", "attempt", "lowest")


@query("o123_round", "select o_orderkey, o_custkey % 8 as attempt from orders where o_custkey % 8 between 1 and 5")
def o123(t):
    return t.orders.select("o_orderkey", (F.col("o_custkey") % 8).alias("attempt")).filter("attempt between 1 and 5")


@query("o124_eligibility", "select o_orderkey, greatest(epoch_us(o_orderdate), max(epoch_us(l_shipdate))) as deadline from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate")
def o124(t):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    waits = t.lineitem.groupBy("l_orderkey").agg(F.max(us("l_shipdate")).alias("w"))
    return t.orders.join(waits, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.greatest(us("o_orderdate"), F.col("w")).alias("deadline"))


@query(
    "o125_cycle_order",
    f"with k as (select o_orderkey, o_custkey, {_KIND} as kind from orders), r as (select *, row_number() over (partition by o_custkey, kind order by o_orderkey) - 1 as k from k) select o_orderkey, kind, cast(case kind when 'primary' then k // 3 * 5 + [0, 1, 3][k % 3 + 1] when 'handoff' then k * 5 + 2 else k * 5 + 4 end as bigint) as slot from r",
)
def o125(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.expr(_KIND).alias("kind"))
    rank = F.row_number().over(Window.partitionBy("o_custkey", "kind").orderBy("o_orderkey"))
    return rows.withColumn("r", rank).select("o_orderkey", "kind", S.slot(F.col("kind"), F.col("r")).alias("slot"))


_OUT = "case user_id % 4 when 0 then 'success' when 1 then 'deferred' else 'failed' end"


@query(
    "o126_next_state",
    f"""with e as (select event_id, user_id, {_OUT} as outcome, event_id % 3 = 0 as part, cast(event_id % 5 + 1 as int) as a, cast(event_id % 4 as int) as h, event_type = 'error' as perm, cast(event_id % 9 as int) as f,
   case when event_id % 2 = 0 then cast(user_id % 700 as double) end as until, 100.0::double as now, event_id % 6 = 1 as slow, case when event_id % 7 = 0 then 'DEFERRED_HOST' end as class, case when event_id % 8 > 0 then 'r' || event_id % 8 end as why from events),
 k as (select *, case when outcome = 'success' then 'none' when outcome = 'deferred' then 'later' when part and not perm and h < 2 then 'handoff' when perm or a >= 5 then 'end' else 'again' end as k from e),
 w as (select *, case k when 'later' then now + 0.05::double when 'handoff' then now + 1.0::double else now + least(300.0::double, 5.0::double * pow(2, least(f, 6))) end as soon from k)
 select event_id, case k when 'none' then null when 'later' then coalesce(class, case when slow then 'DEFERRED_RATE_LIMIT' else 'DEFERRED_ROUTE' end) when 'handoff' then 'HANDOFF_READY' when 'end' then 'PERMANENTLY_FAILED' else 'RECOVERY_READY' end as state,
 case when k = 'again' then a + 1 else a end as attempt, case k when 'handoff' then h + 1 when 'again' then 0 else h end as handoffs, case when k in ('none', 'later') then f else f + 1 end as failures,
 case when k = 'none' then null when k = 'end' then 0.0::double else greatest(coalesce(until, soon), soon) end as not_before, case when k <> 'none' then coalesce(why, case when k = 'later' then 'Admission deferred' else 'Transfer did not complete' end) end as reason from w""",
)
def o126(t):
    i = F.col("event_id")
    until, why = F.when(i % 2 == 0, (F.col("user_id") % 700).cast("double")), F.when(i % 8 > 0, F.concat(F.lit("r"), (i % 8).cast("string")))
    n = S.next_job(
        F.expr(_OUT), i % 3 == 0, (i % 5 + 1).cast("int"), (i % 4).cast("int"), F.col("event_type") == "error", (i % 9).cast("int"), until, F.lit(100.0),
        why, F.when(i % 7 == 0, "DEFERRED_HOST"), i % 6 == 1,
    )
    return t.events.select("event_id", n.alias("n")).select("event_id", "n.*")


@query("o127_backoff", "select event_id, least(300.0::double, 2.0::double * pow(2, least(user_id % 12, 6))) as base_wait, least(40.0::double, 5 * pow(2, user_id % 6)) as request_wait, case when user_id % 12 >= 3 then least(300.0::double, 30.0 * (user_id % 12)) else 0 end as route_wait from events")
def o127(t):
    u = F.col("user_id")
    return t.events.select("event_id", S.backoff(F.lit(2.0), u % 12 + 1).alias("base_wait"), S.request_backoff(u % 6 + 1).alias("request_wait"), S.route_wait(u % 12).alias("route_wait"))


@query("o128_rate_limit", "select user_id, max(case event_id % 3 when 0 then event_id % 50 when 1 then 90 else 60 end)::double as wait from events group by 1")
def o128(t):
    m = F.col("event_id") % 3
    header = F.when(m == 0, (F.col("event_id") % 50).cast("string")).when(m == 1, "Mon, 01 Jan 2024 00:01:30 GMT").otherwise("soon")
    now = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t.events.groupBy("user_id").agg(F.max(S.retry_after(header, now)).alias("wait"))


@query("o129_request_deadline", "select event_id, greatest(user_id % 7, event_id % 7) as deadline, case when user_id % 7 >= event_id % 7 then 'rate-limit' else 'route' end as label from events")
def o129(t):
    return t.events.select("event_id", S.request_deadline(F.col("user_id") % 7, F.col("event_id") % 7).alias("d")).select("event_id", "d.*")


@query("o130_queue_stats", f"select {_KIND} as kind, count(*) as jobs, count(*) filter (where o_totalprice < 200000) as ready from orders group by 1")
def o130(t):
    return t.orders.groupBy(F.expr(_KIND).alias("kind")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_totalprice") < 200000).alias("ready"))


@query("o131_starving", f"select {_KIND} as kind, min(epoch_us(o_orderdate)) filter (where o_totalprice < 200000) <= (select max(epoch_us(o_orderdate)) from orders) - 250000 as starving from orders group by 1")
def o131(t):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    now = t.orders.agg(F.max(us).alias("now"))
    rows = t.orders.groupBy(F.expr(_KIND).alias("kind")).agg(F.min(F.when(F.col("o_totalprice") < 200000, us)).alias("since"))
    return rows.crossJoin(F.broadcast(now)).select("kind", (F.col("since") <= F.col("now") - 250000).alias("starving"))


@query("o132_proxy_pick", "select user_id % 10 as grp, arg_min(user_id, (last_used, user_id)) as pick from (select user_id, max(epoch_us(ts)) as last_used, count(*) filter (where event_type = 'error') as fails from events group by 1) where fails < 15 group by 1")
def o132(t):
    p = t.events.groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_used"), F.count_if(F.col("event_type") == "error").alias("fails"))
    return p.filter("fails < 15").groupBy((F.col("user_id") % 10).alias("grp")).agg(F.min_by("user_id", F.struct("last_used", "user_id")).alias("pick"))


@query("o133_recovery_snapshot", f"select o_orderkey from orders where {_KIND} <> 'primary' or o_orderstatus = 'P'")
def o133(t):
    return t.orders.filter((F.expr(_KIND) != "primary") | (F.col("o_orderstatus") == "P")).select("o_orderkey")


@query("o134_route_diagnostics", "select l_suppkey, count(*) as active, min(epoch_us(l_shipdate)) as earliest from lineitem where l_shipdate > timestamp '1998-06-01' group by 1")
def o134(t):
    rows = t.lineitem.filter(F.col("l_shipdate") > F.expr("timestamp_ntz '1998-06-01'"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("active"), F.min(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("earliest"))


@query("o166_attempt_guard", "select o_orderkey, greatest(1, least(5, o_custkey % 8)) as attempt, case when o_custkey % 8 between 1 and 5 then 'DOWNLOADING' else 'PERMANENTLY_FAILED' end as status from orders")
def o166(t):
    return t.orders.select("o_orderkey", S.attempt_guard(F.col("o_custkey") % 8).alias("g")).select("o_orderkey", "g.*")


@query("o172_paced_starts", "select o_orderkey, 1000 + 250 * row_number() over (partition by o_custkey order by o_orderkey) as start_ms from orders")
def o172(t):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_orderkey", (1000 + 250 * rn.cast("long")).alias("start_ms"))


@query("o173_route_admission", "select event_id, case when user_id % 9 > 4 then 'DEFERRED' else 'CONNECTING' end as state, case when user_id % 9 > 4 then user_id % 9 end as not_before, case when user_id % 9 > 4 then event_type end as kind, event_id % 5 as attempt from events")
def o173(t):
    return t.events.select("event_id", S.admission(F.col("user_id") % 9, F.lit(4), F.col("event_type"), F.col("event_id") % 5).alias("a")).select("event_id", "a.*")


@query("o174_outcome_drain", "select case when event_type = 'purchase' then 'success' when event_type = 'error' and user_id % 3 = 0 then 'permanent' else 'retryable' end as outcome, count(*) as n from events group by 1")
def o174(t):
    o = F.when(F.col("event_type") == "purchase", "success").when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "permanent").otherwise("retryable")
    return t.events.groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query("o175_queue_gauges", "select o_custkey, count(*) filter (where o_orderstatus = 'P') as active, count(*) filter (where o_orderstatus = 'O') as pending, count(*) filter (where o_orderstatus in ('O', 'P')) = 0 as idle from orders group by 1")
def o175(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_custkey").agg(n("P").alias("active"), n("O").alias("pending"), ((n("P") + n("O")) == 0).alias("idle"))


@query("o176_error_outcomes", "select event_id, event_id % 5 + 1 as attempt, case when event_type = 'error' then 'failed' else 'success' end as outcome, false as permanent from events")
def o176(t):
    return t.events.select("event_id", (F.col("event_id") % 5 + 1).alias("attempt"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("outcome"), F.lit(False).alias("permanent"))


@query("o177_backlog_keys", "select key, count(*) as n from (select case when o_custkey % 3 = 0 then cast(o_custkey as varchar) when o_custkey % 3 = 1 then o_orderpriority else '' end as key from orders) group by key")
def o177(t):
    m = F.col("o_custkey") % 3
    doc, name = F.when(m == 0, F.col("o_custkey").cast("string")).otherwise(""), F.when(m == 1, F.col("o_orderpriority"))
    key = F.coalesce(F.nullif(doc, F.lit("")), F.nullif(name, F.lit("")), F.lit(""))
    return t.orders.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("o183_distributed_admission", "select o_orderkey, case when o_orderkey % 97 = 0 then 'wait' when o_orderkey % 7 = 0 then 'stop' when o_orderstatus = 'F' and o_custkey % 2 = 0 then 'reuse' when o_orderstatus = 'F' then 'invalidate' when o_orderkey % 5 = 0 then 'wait' when o_orderstatus = 'P' and o_custkey % 3 = 0 then 'stop' when o_orderstatus = 'P' then 'wait' else 'run' end as action, case when o_orderkey % 97 = 0 then 20 when o_orderkey % 7 = 0 or o_orderstatus = 'F' then 0 when o_orderkey % 5 = 0 then 1 when o_orderstatus = 'P' and o_custkey % 3 <> 0 then 5 else 0 end as delay from orders")
def o183(t):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", S.distributed_admission(k % 7 == 0, s == "F", c % 2 == 0, k % 5 != 0, s != "P", c % 3 == 0, k % 97 == 0).alias("a")).select("o_orderkey", "a.*")


@query("o187_enqueue", "select o_orderkey, case when o_custkey % 6 > 0 then 'RECOVERING' else 'QUEUED' end as status, 'a=1' as kept from orders")
def o187(t):
    entry = F.create_map(F.lit("a"), F.lit("1"), F.lit("_route"), F.lit("x"))
    kept = F.map_filter(entry, lambda k, v: ~k.startswith("_"))
    shown = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 6 > 0, "RECOVERING").otherwise("QUEUED").alias("status"), shown.alias("kept"))
