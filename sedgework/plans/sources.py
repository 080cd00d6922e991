"""Sources and sinks: what is written is read again, from a new folder in the shared one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.integrity import file_signature
from ..sources import files as S
from ..sources import keyed_json
from .registry import query

_USABLE = "length(trim(html)) >= 200 and not regexp_matches(lower(html), 'access denied|captcha|temporarily unavailable|error 502|error 503')"


@query("o02_page_cache_sink", f"select sha256(url) as key, any_value(html) as html from pages where {_USABLE} group by url having count(distinct html) = 1")
def o02(t):
    once = t.pages.groupBy("url").agg(F.min("html").alias("html"), F.max("html").alias("_other")).filter("html = _other").drop("_other")
    folder = S.work_folder(t.spark, "page-cache")
    S.write_page_cache(once.withColumn("html", F.lit("old")), folder)
    S.write_page_cache(once, folder)  # the same keys again
    return S.read_page_cache(t.spark, folder).select("key", "html")


@query("o02_page_cache_replace", "select sha256(url) as key, page_id % 3 = 0 as fresh from (select url, min(page_id) as page_id from pages group by url)")
def o02b(t):
    """A third of the pages is written again: the others of their buckets stay as they were."""
    once = t.pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    folder = S.work_folder(t.spark, "page-cache")
    S.write_page_cache(once.withColumn("html", F.lit("old page " * 30)), folder)
    S.write_page_cache(once.filter("page_id % 3 = 0").withColumn("html", F.lit("new page " * 30)), folder)
    return S.read_page_cache(t.spark, folder).select("key", F.col("html").startswith("new").alias("fresh"))


@query(
    "o03_ledger_scan",
    "select 'f' || o_orderkey || '.pdf' as filename, case when o_orderstatus = 'F' then 'COMPLETED' else 'PARTIAL' end as status, cast(o_custkey as bigint) as size, case when o_orderkey % 2 = 0 then 'md5:' || o_custkey end as document_id from orders",
)
def o03(t):
    candidate = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("md5:"), F.col("o_custkey").cast("string"))).alias("document_id"))
    entry = F.struct(F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("PARTIAL").alias("status"), F.col("o_custkey").cast("long").alias("size"), candidate.alias("candidate"))
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    folder = S.work_folder(t.spark, "ledger")
    # a ledger document for each customer's entries
    parts = t.orders.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(name, entry))).alias("downloads"))
    parts.select(F.to_json(F.struct("downloads")).alias("value")).write.text(folder)
    return S.read_ledger(t.spark, folder, lines=True).select("filename", "status", "size", "candidate.document_id")


@query(
    "o12_settings",
    "select user_id, least(5, greatest(1, user_id % 9)) as max_workers, least(20, greatest(1, user_id % 30 - 3)) as retry_limit, 60.0 + user_id % 7 as stall_s from (select distinct user_id from events)",
)
def o12(t):
    u = F.col("user_id")
    text = F.format_string("run:\n  max_workers: %d # at once\n  retry_limit: '%d'\n  window_s: soon\nunknown: 3\n  stall_s: %d.0\n", (u % 9).cast("int"), (u % 30 - 3).cast("int"), (60 + u % 7).cast("int"))

    def parse(parts):
        import pandas as pd

        for pdf in parts:
            found = [S.Settings.parse(x) for x in pdf["text"]]
            yield pd.DataFrame({"user_id": pdf["user_id"], "max_workers": [s.max_workers for s in found], "retry_limit": [s.retry_limit for s in found], "stall_s": [s.stall_s for s in found]})

    return t.events.select("user_id").distinct().withColumn("text", text).mapInPandas(parse, "user_id long, max_workers long, retry_limit long, stall_s double")


@query("o09_atomic_documents", "select 'nation/' || n_nationkey as key, n_name as name, count(c_custkey) as customers, coalesce(max(c_custkey), 0) as last from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name")
def o09(t):
    """A document for each nation, written over an older one and read back."""
    keyed_json.register(t.spark)
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("customers"), F.coalesce(F.max("c_custkey"), F.lit(0)).alias("last"))
    key = F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("key")
    folder = S.work_folder(t.spark, "documents")
    for body in (F.struct(F.lit("old").alias("name")), F.struct(F.col("n_name").alias("name"), "customers", "last")):
        rows.select(key, F.to_json(body).alias("document")).write.format("keyed_json").mode("append").save(folder)
    read = t.spark.read.format("keyed_json").load(folder)
    return read.select("key", F.from_json("document", "name string, customers long, last long").alias("d")).select("key", "d.*")


@query("o100_event_emit", "select event_id, event_type, cast(greatest(0, event_id % 7 - 2) as bigint) as \"count\" from events")
def o100(t):
    folder = S.work_folder(t.spark, "events")
    rows = t.events.select("event_id", "event_type", (F.col("event_id") % 7 - 2).cast("long").alias("count"))
    S.emit_events(rows.filter("event_id % 2 = 0"), folder)
    S.emit_events(rows.filter("event_id % 2 = 1"), folder)
    return t.spark.read.schema(rows.schema).parquet(folder)


@query("o179_file_signature", "select o_orderkey, case when o_orderkey % 3 > 0 then [cast(o_custkey as bigint), cast(o_orderkey as bigint) * 1000000007] end as signature, o_orderkey % 3 = 1 as verified from orders")
def o179(t):
    k = F.col("o_orderkey") % 3
    size, time = F.when(k > 0, F.col("o_custkey").cast("long")), F.when(k > 0, F.col("o_orderkey").cast("long") * F.lit(1000000007))
    stored = F.when(k == 1, F.array(size, time)).when(k == 2, F.array(size + 1, time))
    now = file_signature(size, time)
    return t.orders.select("o_orderkey", now.alias("signature"), F.coalesce(stored == now, F.lit(False)).alias("verified"))


@query(
    "o181_config_constraints",
    "select user_id, cast((user_id % 5 >= 4)::int + (user_id % 7 > 3)::int + (3 >= (user_id % 4 + 5) / 2.0)::int + (user_id % 10 not between 1 and 8)::int + (user_id % 2 = 0)::int as bigint) as n_errors from (select distinct user_id from events)",
)
def o181(t):
    def check(parts):
        import pandas as pd

        for pdf in parts:
            n = [len(S.check_run(u % 5, 4, u % 7 or 0.5, 3, u % 4 + 5, u % 10, 299 + u % 2)) for u in pdf["user_id"].tolist()]
            yield pd.DataFrame({"user_id": pdf["user_id"], "n_errors": n})

    return t.events.select("user_id").distinct().mapInPandas(check, "user_id long, n_errors long")
