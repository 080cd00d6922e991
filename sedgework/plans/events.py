"""Event streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.rows import latest, zero_filled
from .registry import query

_DELTA = "case event_type when 'view' then 1 when 'click' then 1 when 'signup' then -1 when 'purchase' then -1 else 0 end"
_ORDER = ["ts", "event_id"]


def _delta():
    return F.expr(_DELTA)


def _us(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _now(t):
    """The last moment of the log, which stands for now."""
    return t.events.agg(F.max(_us()).alias("now"))


@query("o101_run_drain", "select event_id, user_id from events where user_id in (0, 7)")
def o101(t):
    return t.events.filter(F.col("user_id").isin(0, 7)).select("event_id", "user_id")


_GAUGE = f"with s as (select *, sum({_DELTA}) over (partition by user_id order by ts, event_id) as s from events), m as (select *, min(s) over (partition by user_id order by ts, event_id) as m from s)"


@query("o102_clamped_gauge", f"{_GAUGE} select event_id, user_id, cast(s - least(0, m) as bigint) as gauge from m")
def o102(t):
    return E.clamped_gauge(t.events, ["user_id"], _ORDER, _delta()).select("event_id", "user_id", "gauge")


@query("o103_counters", "select count(*) filter (where event_type = 'view') as discovered, count(*) filter (where event_type = 'click') as queued, count(*) filter (where event_type = 'purchase') as completed, count(*) filter (where event_type = 'error') as failed, count(*) as event_count from events")
def o103(t):
    n = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.agg(n("view").alias("discovered"), n("click").alias("queued"), n("purchase").alias("completed"), n("error").alias("failed"), F.count("*").alias("event_count"))


_STATE = "case event_type when 'view' then 'queued' when 'click' then 'running' when 'signup' then 'pending' else 'removed' end"


@query("o104_file_states", f"select state, count(*) as files from (select user_id, {_STATE} as state, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1 and state <> 'removed' group by state")
def o104(t):
    last = latest(t.events.withColumn("state", F.expr(_STATE)), ["user_id"], _ORDER, ["state"])
    return last.filter("state <> 'removed'").groupBy("state").agg(F.count("*").alias("files"))


@query("o105_total_downloaded", "select 2 + count(*) filter (where event_type = 'purchase') as total from events")
def o105(t):
    return t.events.agg((F.lit(2) + F.count_if(F.col("event_type") == "purchase")).alias("total"))


@query("o106_summary", "select 'Scraping complete ' || count(*) filter (where event_type = 'purchase') || '/' || count(*) || ', failed ' || count(*) filter (where event_type = 'error') as summary from events")
def o106(t):
    n = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.agg(F.format_string("Scraping complete %d/%d, failed %d", n("purchase"), F.count("*"), n("error")).alias("summary"))


@query(
    "o107_worker_rows",
    """with e as (select *, user_id % 8 as worker, user_id // 8 as doc from events), c as (select *, case when event_type = 'signup' or doc is distinct from lag(doc) over (partition by worker order by ts, event_id) then 1 else 0 end as ch from e),
 j as (select *, sum(ch) over (partition by worker order by ts, event_id rows unbounded preceding) as job from c), l as (select * from j qualify job = max(job) over (partition by worker))
 select worker, arg_max(doc, event_id) as doc, count(*) as events, arg_max(case when event_type <> 'error' then value end, case when event_type <> 'error' then event_id end) as last_value from l group by worker""",
)
def o107(t):
    e = t.events.withColumn("worker", F.col("user_id") % 8).withColumn("doc", F.floor(F.col("user_id") / 8))
    return E.worker_rows(e, "worker", _ORDER, "doc", F.col("event_type") == "signup", {"last_value": F.when(F.col("event_type") != "error", F.col("value"))})


@query("o108_stalls", "select event_id, gap_us from (select *, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as gap_us from events) where event_type in ('view', 'click') and gap_us >= 36000000000")
def o108(t):
    return E.stalls(t.events, "user_id", _ORDER, "ts", F.col("event_type").isin("view", "click"), 36000).select("event_id", "gap_us")


@query("o109_activity", "select event_id, case when event_type in ('view', 'purchase') then 'activity' else 'debug' end as stream, substr(replace(props || chr(10) || event_type, chr(10), ' · '), 1, 220) as message from events")
def o109(t):
    m = F.substring(F.replace(F.concat_ws("\n", "props", "event_type"), F.lit("\n"), F.lit(" · ")), 1, 220)
    return t.events.select("event_id", F.when(F.col("event_type").isin("view", "purchase"), "activity").otherwise("debug").alias("stream"), m.alias("message"))


_MARKS = """with recursive e as (select user_id, event_id as seq, epoch_us(ts) / 1e6 as t, cast(floor(value * 100000) as bigint) as "offset", event_type <> 'error' as ok, row_number() over (partition by user_id order by event_id) as n from events),
 s as (select *, true as persist, true as emit, case when ok then t end as lt, case when ok then "offset" end as lo, t as le from e where n = 1
  union all select x.* exclude (p_lt, p_lo, p_le), case when persist and ok then t else p_lt end, case when persist and ok then "offset" else p_lo end, case when emit then t else p_le end
  from (select e.*, s.lt as p_lt, least(s.lo, e."offset") as p_lo, s.le as p_le, s.lt is null or e.t - s.lt >= 100000 or e."offset" - least(s.lo, e."offset") >= 8388608 as persist, e.t - s.le >= 3600 as emit from s join e on e.user_id = s.user_id and e.n = s.n + 1) x)"""


def _reports(t):
    return t.events.select("user_id", F.col("event_id").alias("seq"), (_us() / 1e6).alias("t"), F.floor(F.col("value") * 100_000).cast("long").alias("offset"), (F.col("event_type") != "error").alias("ok"))


@query("o110_throttled_progress", _MARKS + ' select user_id, seq, t, "offset", ok from s where persist')
def o110(t):
    return E.throttle(_reports(t), "user_id", "user_id long, seq long, t double, offset long, ok boolean", 100_000.0, 8 << 20)


@query("o110_progress_marks", _MARKS + " select user_id, seq, persist, emit from s")
def o110b(t):
    return E.progress_marks(_reports(t), "user_id", 100_000.0, 8 << 20, 3600.0).select("user_id", "seq", "persist", "emit")


_FRESH = "with o as (select *, cast(floor(value * 100) as bigint) as o, user_id * 10 as b from events), h as (select *, max(o) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as h from o), f as (select *, case when event_type <> 'error' then greatest(0, o - greatest(b, coalesce(h, b))) else 0 end as fresh from h)"


def _fresh(t):
    return E.goodput(t.events, "user_id", _ORDER, F.floor(F.col("value") * 100).cast("long"), F.col("user_id") * 10, F.col("event_type") != "error")


@query("o111_goodput", f"{_FRESH} select event_id, user_id, cast(fresh as bigint) as fresh from f")
def o111(t):
    return _fresh(t).select("event_id", "user_id", "fresh")


@query(
    "o112_trailing_windows",
    f"{_FRESH}, n as (select max(epoch_us(ts)) as now, min(epoch_us(ts)) as began from events), w as (select unnest([21600, 86400, 604800]) as s) select s as window_s, cast(coalesce(sum(fresh) filter (where epoch_us(ts) > now - s * 1000000::bigint), 0) as bigint) as bytes, round(coalesce(sum(fresh) filter (where epoch_us(ts) > now - s * 1000000::bigint), 0) / least(s, (now - began) / 1e6) / 1048576.0::double, 9) as mib_per_s, count(*) filter (where event_type = 'purchase' and epoch_us(ts) > now - s * 1000000::bigint) as completions from f, n, w group by s, now, began",
)
def o112(t):
    rows = _fresh(t).select("fresh", "event_type", _us().alias("us"))
    span = t.events.agg(F.max(_us()).alias("now"), F.min(_us()).alias("began"))
    windows = (21600, 86400, 604800)
    in_window = lambda s: F.col("us") > F.col("now") - s * 1_000_000
    one = rows.crossJoin(F.broadcast(span)).agg(
        F.max("now").alias("now"), F.min("began").alias("began"),
        *[F.coalesce(F.sum(F.when(in_window(s), F.col("fresh"))), F.lit(0)).alias(f"b{s}") for s in windows],
        *[F.count_if(in_window(s) & (F.col("event_type") == "purchase")).alias(f"c{s}") for s in windows],
    )
    out = F.explode(F.array(*[F.struct(F.lit(s).alias("window_s"), F.col(f"b{s}").alias("bytes"), F.round(F.col(f"b{s}") / F.least(F.lit(float(s)), (F.col("now") - F.col("began")) / 1e6) / 1048576.0, 9).alias("mib_per_s"), F.col(f"c{s}").alias("completions")) for s in windows]))
    return one.select(out.alias("w")).select("w.*")


@query("o113_trend", "select epoch_us(time_bucket(interval 5 minutes, ts)) as start_us, round(sum(value), 4) as total, count(*) as n from events group by 1")
def o113(t):
    w = t.events.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))
    return w.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "total", "n")


@query(
    "o114_state_time",
    """with i as (select user_id, event_type as state, epoch_us(ts) as a, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) as z from events), s as (select *, unnest(range(a // 86400000000, (z - 1) // 86400000000 + 1)) as slot from i where z > a)
 select user_id, state, slot, cast(sum(least(z, (slot + 1) * 86400000000) - greatest(a, slot * 86400000000)) as bigint) as micros from s group by all""",
)
def o114(t):
    return E.state_time(t.events, "user_id", "ts", _ORDER, "event_type", 86400)


@query("o115_stall_states", "with l as (select user_id, max(epoch_us(ts)) as last from events where event_type <> 'error' group by 1), n as (select max(epoch_us(ts)) as now from events) select user_id, case when user_id % 2 = 0 and now - last >= 3600000000 then 'STALL' when user_id % 2 = 0 then 'RECEIVING_BYTES' else 'IDLE' end as state from l, n")
def o115(t):
    last = t.events.filter("event_type <> 'error'").groupBy("user_id").agg(F.max(_us()).alias("last")).crossJoin(F.broadcast(_now(t)))
    return last.select("user_id", F.when((F.col("user_id") % 2 == 0) & (F.col("now") - F.col("last") >= 3_600_000_000), "STALL").when(F.col("user_id") % 2 == 0, "RECEIVING_BYTES").otherwise("IDLE").alias("state"))


@query("o116_ratios", "select user_id, round(avg(value) filter (where event_type = 'click'), 6) as avg_connection, round(coalesce(sum(value) filter (where event_type in ('view', 'purchase')) / nullif(sum(value), 0), 0), 6) as useful_ratio from events group by user_id")
def o116(t):
    useful = F.sum(F.when(F.col("event_type").isin("view", "purchase"), F.col("value")))
    return t.events.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 6).alias("avg_connection"), F.round(F.coalesce(F.try_divide(useful, F.sum("value")), F.lit(0.0)), 6).alias("useful_ratio"))


@query("o117_kept_buckets", "select epoch_us(date_trunc('second', ts)) as bucket_us, count(*) as n from events where epoch_us(date_trunc('second', ts)) >= (select max(epoch_us(ts)) from events) - 86400000000 group by 1")
def o117(t):
    b = F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp")))
    rows = t.events.select(b.alias("bucket_us")).crossJoin(F.broadcast(_now(t))).filter("bucket_us >= now - 86400000000")
    return rows.groupBy("bucket_us").agg(F.count("*").alias("n"))


@query("o118_sampled_gauges", f"{_GAUGE} select epoch_us(time_bucket(interval 1 day, ts)) as day_us, round(avg(s - least(0, m)), 6) as mean_gauge from m group by 1")
def o118(t):
    g = E.clamped_gauge(t.events, ["user_id"], _ORDER, _delta())
    w = g.groupBy(F.window("ts", "1 day").alias("w")).agg(F.round(F.avg("gauge"), 6).alias("mean_gauge"))
    return w.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("day_us"), "mean_gauge")


@query("o178_durations", "select event_type, count(*) as completions, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1")
def o178(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("completions"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("o90_error_categories", "select k as key, count(user_id) as n from (select unnest(['HTTP_500','HTTP_502','HTTP_503','HTTP_504','HTTP_429','connection_reset','timeout','connection_error']) as k, unnest(range(8)) as i) left join events on event_type = 'error' and user_id % 7 = i group by k")
def o90(t):
    from ..functions.vocab import ERROR_CATEGORIES

    name = F.element_at(F.array(*map(F.lit, ERROR_CATEGORIES)), (F.col("user_id") % 7 + 1).cast("int"))
    return zero_filled(t.events.filter("event_type = 'error'"), name, list(ERROR_CATEGORIES))
