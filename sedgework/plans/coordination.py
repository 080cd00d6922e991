"""Coordination queries of shared runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coordination as C
from .registry import query


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("o140_register_insert", "select distinct o_custkey as k from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0)")
def o140(t):
    runs = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("pages"))
    return C.register(runs, t.orders.select(F.col("o_custkey").alias("k"), F.lit(1).alias("pages")).distinct(), "k", ["pages"])[0].select("k")


@query("o140_register_mismatch", "select c_custkey as k from customer where c_nationkey is distinct from 3 and c_custkey % 2 = 0")
def o140b(t):
    runs = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("shards"))
    return C.register(runs, t.customer.select(F.col("c_custkey").alias("k"), F.lit(3).alias("shards")), "k", ["shards"])[1]


@query("o141_page_shards", "select page_id, cast(page_id % 3 as int) as shard from pages")
def o141(t):
    return C.page_shards(t.pages.select("page_id"), F.col("page_id") + 1, 3).select("page_id", "shard")


_NOW = "(select max(epoch_us(o_orderdate)) from orders) - 86400000000 * 400"


def _orders(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", _us("o_orderdate").alias("us"), "o_totalprice")
    return o.crossJoin(F.broadcast(t.orders.agg((F.max(_us("o_orderdate")) - 86_400_000_000 * 400).alias("now"))))


@query("o142_claim", f"select o_orderkey, o_orderkey % 10 + 1 as token, o_custkey % 6 + 1 as attempt from orders, (select {_NOW} as now) where o_orderstatus <> 'F' and o_custkey % 6 < 5 and epoch_us(o_orderdate) <= now and (o_custkey % 4 = 0 or epoch_us(o_orderdate) + 86400000000 * 100 < now)")
def o142(t):
    o = _orders(t)
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("ready")
    ok = C.claimable(status, F.col("o_custkey") % 6, F.col("us"), F.when(F.col("o_custkey") % 4 != 0, "w"), F.col("us") + 86_400_000_000 * 100, F.col("now"))
    return o.filter(ok).select("o_orderkey", (F.col("o_orderkey") % 10 + 1).alias("token"), (F.col("o_custkey") % 6 + 1).alias("attempt"))


@query("o143_fenced_finish", f"select o_orderkey, case when o_orderkey % 2 = 0 then 'COMPLETED' else 'RECOVERY_READY' end as status, greatest(0, o_custkey % 6 - 1) as attempt from orders, (select {_NOW} as now) where o_orderkey % 3 = 0 and o_custkey % 5 = 0 and epoch_us(o_orderdate) >= now")
def o143(t):
    o = _orders(t)
    cur = o.select("o_orderkey", F.lit("a").alias("owner"), F.lit(1).alias("token"), F.col("us").alias("lease"), "now", (F.col("o_custkey") % 6).alias("attempt"))
    upd = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("owner"), F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0).alias("token"), F.when(F.col("o_orderkey") % 2 == 0, "COMPLETED").otherwise("RECOVERY_READY").alias("status"))
    return C.fenced(cur, upd, "o_orderkey", F.col("c.now")).select("o_orderkey", "status", F.greatest(F.lit(0), F.col("attempt") - 1).alias("attempt"))


@query("o144_recovery_candidates", "select o_orderkey from orders join customer on o_custkey = c_custkey where c_acctbal > 0 and o_orderstatus <> 'F' and o_custkey % 6 < 5 order by o_orderdate, o_orderkey limit 50")
def o144(t):
    ok = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.filter("o_orderstatus <> 'F' and o_custkey % 6 < 5").join(ok, "o_custkey", "left_semi")
    return rows.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("o144_exhausted", "select o_orderkey, 'PERMANENTLY_FAILED' as status from orders where o_orderstatus <> 'F' and o_custkey % 6 >= 5")
def o144b(t):
    return t.orders.filter("o_orderstatus <> 'F' and o_custkey % 6 >= 5").select("o_orderkey", F.lit("PERMANENTLY_FAILED").alias("status"))


@query("o145_page_claim", f"select o_orderkey from orders, (select {_NOW} as now) where (o_orderkey % 4 = 1 or epoch_us(o_orderdate) < now) and o_orderstatus = 'O'")
def o145(t):
    return _orders(t).filter("(o_orderkey % 4 = 1 or us < now) and o_orderstatus = 'O'").select("o_orderkey")


@query("o146_heartbeat", f"select o_orderkey, case when o_custkey % 5 = 0 and epoch_us(o_orderdate) >= now then now else epoch_us(o_orderdate) end as heartbeat from orders, (select {_NOW} as now)")
def o146(t):
    live = (F.col("o_custkey") % 5 == 0) & (F.col("us") >= F.col("now"))
    return _orders(t).select("o_orderkey", F.when(live, F.col("now")).otherwise(F.col("us")).alias("heartbeat"))


_LS = "select doc_id, case when quality = 1 and toxic = 0 then 'APPROVED' when quality = 0 then 'REJECTED' else 'PENDING' end as s from labels"


@query("o147_cached_verdicts", f"select d.doc_id, case s when 'APPROVED' then 'REUSE' when 'REJECTED' then 'DROP' else 'FRESH' end as decision from documents d left join ({_LS}) l on l.doc_id = d.doc_id")
def o147(t):
    from ..operators.dedup import label_status

    return C.cached_verdicts(t.documents.select("doc_id"), label_status(t.labels), ["doc_id"]).select("doc_id", "decision")


@query("o148_cached_validations", f"select d.doc_id, s as status from documents d join ({_LS}) l on l.doc_id = d.doc_id where s <> 'PENDING' and lang = 'en'")
def o148(t):
    from ..operators.dedup import label_status

    cache = label_status(t.labels).join(t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("sha")), "doc_id").filter(F.col("status").isin("APPROVED", "REJECTED", "PDF_INVALID"))
    keyed = t.documents.filter("lang = 'en'").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    return keyed.join(cache, ["lang", "doc_id", "sha"]).select("doc_id", "status")


@query("o149_identity_propagation", "select d.doc_id, max(toxic = 0) as identity from documents d join (select text, toxic from documents join labels using (doc_id)) l on l.text = d.text group by d.doc_id")
def o149(t):
    sha = F.sha2("text", 256).alias("sha")
    known = t.documents.select("doc_id", sha).join(t.labels, "doc_id").groupBy("sha").agg(F.max(F.col("toxic") == 0).alias("identity"))
    return t.documents.select("doc_id", sha).join(known, "sha").select("doc_id", "identity")


@query("o150_host_limits", "with h as (select l_suppkey, max(epoch_us(l_shipdate)) as not_before, min(epoch_us(l_shipdate)) as next_start from lineitem group by 1), n as (select max(epoch_us(l_shipdate)) - 86400000000 * 30 as now from lineitem) select l_suppkey, case when not_before > now then not_before end as wait_until, not_before <= now and next_start <= now as reservable from h, n")
def o150(t):
    us = _us("l_shipdate")
    h = t.lineitem.groupBy("l_suppkey").agg(F.max(us).alias("not_before"), F.min(us).alias("next_start"))
    h = h.crossJoin(F.broadcast(t.lineitem.agg((F.max(us) - 86_400_000_000 * 30).alias("now"))))
    return h.select("l_suppkey", F.when(F.col("not_before") > F.col("now"), F.col("not_before")).alias("wait_until"), ((F.col("not_before") <= F.col("now")) & (F.col("next_start") <= F.col("now"))).alias("reservable"))


@query("o151_missing_objects", "select o_orderkey, 'READY' as status from orders where o_orderstatus = 'F' and o_custkey not in (select c_custkey from customer where c_nationkey < 12) and o_orderkey % 3 <> 0")
def o151(t):
    there = t.customer.filter("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.filter("o_orderstatus = 'F' and o_orderkey % 3 <> 0").join(there, "o_custkey", "left_anti").select("o_orderkey", F.lit("READY").alias("status"))


@query("o152_validation_lease", f"select o_orderkey, o_orderkey % 10 + 1 as token from orders, (select {_NOW} as now) where o_custkey % 4 = 0 or epoch_us(o_orderdate) < now")
def o152(t):
    return _orders(t).filter("o_custkey % 4 = 0 or us < now").select("o_orderkey", (F.col("o_orderkey") % 10 + 1).alias("token"))


@query("o182_recovery_projection", "select c_custkey, c_custkey % 5 + 1 as attempt, 'c=' || c_custkey || ';document_id=' || c_custkey || ';filename=' || c_name as meta from customer")
def o182(t):
    i = F.col("c_custkey").cast("string")
    old = F.create_map(F.lit("c"), i, F.lit("local_path"), F.lit("/tmp/x"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: k != "local_path"), F.create_map(F.lit("document_id"), i, F.lit("filename"), F.col("c_name")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.customer.select("c_custkey", (F.col("c_custkey") % 5 + 1).alias("attempt"), shown.alias("meta"))


@query("o185_lease_liveness", f"select o_orderkey, not (o_orderkey % 11 = 0 or now >= epoch_us(o_orderdate) - 5000000) as live from orders, (select {_NOW} as now)")
def o185(t):
    return _orders(t).select("o_orderkey", (~((F.col("o_orderkey") % 11 == 0) | (F.col("now") >= F.col("us") - 5_000_000))).alias("live"))


@query("o192_page_results", f"select o_orderkey, case when o_totalprice > 100000 then 'found' else 'failed' end as result from orders, (select {_NOW} as now) where o_orderkey % 3 = 0 or epoch_us(o_orderdate) < now")
def o192(t):
    return _orders(t).filter("o_orderkey % 3 = 0 or us < now").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "found").otherwise("failed").alias("result"))
