"""Evidence retrieval, dedup, ordering and bounded lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import normalized_title, tokens
from ..functions.vocab import QUERY_TERMS, TOPIC_TERMS
from ..operators import dedup as D
from ..operators import evidence as E
from ..operators import recovery as R
from ..operators.rows import bounded_with_rest, spread, top_per_key
from .registry import query

TOPICS = {"identity": TOPIC_TERMS, "query": QUERY_TERMS}
_CHUNKS = "select doc_id, cast(o // 1400 as int) as chunk_no, substr(text, cast(o + 1 as int), 1400) as chunk from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 1400)) as o from documents where length(text) > 0)"
_TOPICS = "(values ('identity', ['the','of','and','that']), ('query', ['in','is','for','to'])) v(topic, terms)"
_TOP = f"""with c as ({_CHUNKS}), k as (select *, list_distinct(regexp_extract_all(lower(chunk), '[a-z0-9]+')) as tok from c),
 s as (select doc_id, chunk_no, chunk, topic, len(list_intersect(tok, terms)) / 4.0::double as score from k, {_TOPICS}),
 r as (select *, cast(row_number() over (partition by doc_id, topic order by score desc, chunk_no) as int) as rank from s) """


@query("o27_chunks", f"select doc_id, chunk_no, md5(chunk) as digest from ({_CHUNKS})")
def o27(t):
    return E.chunks(t.documents).select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("o28_tokens", "select doc_id, cast(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as bigint) as n, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ')) as digest from documents")
def o28(t):
    k = tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(k), " ").cast("binary")).alias("digest"))


_TOPK = _TOP + "select doc_id, topic, rank, chunk_no, score, md5(chunk) as digest from r where rank <= 4"


@query("o80_evidence_topk", _TOPK)
def o80(t):
    return E.topk(spread(t.documents.select("doc_id", "text")), TOPICS).select("doc_id", "topic", "rank", "chunk_no", "score", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("o80_evidence_in_rows", _TOPK)
def o80_in_rows(t):
    return E.topk_in_rows(spread(t.documents.select("doc_id", "text")), TOPICS).select("doc_id", "topic", "rank", "chunk_no", "score", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(
    "o80_evidence_text",
    _TOP + """, b as (select *, row_number() over (partition by doc_id, chunk_no order by topic, rank) as once from r where rank <= 4),
 e as (select doc_id, substr(string_agg('[Chunk ' || chunk_no || '] ' || chunk, chr(10) || chr(10) order by topic, rank, chunk_no), 1, 12000) as evidence, string_agg(cast(chunk_no as varchar), ',' order by chunk_no) as chunks_sampled from b where once = 1 group by doc_id)
 select doc_id, md5(evidence) as digest, chunks_sampled, case when length(evidence) >= 2500 then 'good' else 'sparse' end as quality from e""",
)
def o80b(t):
    return E.evidence(spread(t.documents.select("doc_id", "text")), TOPICS).select("doc_id", F.md5(F.col("evidence").cast("binary")).alias("digest"), "chunks_sampled", "quality")


@query(
    "o29_preview",
    f"""with c as ({_CHUNKS.replace("1400", "500")}), u as (select doc_id, chunk_no, lower(trim(chunk)) as t, case when length(trim(chunk)) >= 80 then length(trim(chunk)) else 0 end as used, row_number() over (partition by doc_id order by chunk_no) as n from c),
 b as (select *, coalesce(sum(used) over (partition by doc_id order by chunk_no rows between unbounded preceding and 1 preceding), 0) as before from u where n <= 10),
 x as (select *, used > 0 and ((n >= 3 and least(12000, before + used) >= 2500) or before >= 12000) as ends, used > 0 and (contains(t, 'table of contents') or contains(left(t, 300), 'contents')) as toc from b),
 k as (select *, greatest(0, least(used, 12000 - before)) as take, coalesce(bool_or(ends) over (partition by doc_id order by chunk_no rows between unbounded preceding and 1 preceding), false) as ended from x)
 select doc_id, cast(sum(take) as bigint) as characters, count(*) filter (where take > 0) as pages_with_text, string_agg(cast(chunk_no as varchar), ',' order by chunk_no) as pages_sampled, coalesce(string_agg(cast(chunk_no as varchar), ',' order by chunk_no) filter (where toc), '') as toc_pages,
 case when sum(take) >= 2500 and count(*) filter (where take > 0) >= 2 then 'good' when sum(take) > 0 then 'weak' else 'empty' end as quality from k where not ended group by doc_id""",
)
def o29(t):
    return E.preview(E.chunks(t.documents, size=500), "doc_id", "chunk_no", "chunk")


@query("o42_content_dedup", "select doc_id, source, canonical_id, canonical_id <> doc_id as is_duplicate from (select *, case when text is null then doc_id else first_value(doc_id) over (partition by source, sha256(text) order by doc_id) end as canonical_id from documents)")
def o42(t):
    return D.content_duplicates(t.documents, "doc_id", "text", "source").select("doc_id", "source", "canonical_id", "is_duplicate")


_DUP = "with d as (select doc_id, case when text is null then doc_id else first_value(doc_id) over (partition by sha256(text) order by doc_id) end as canon from documents), l as (select doc_id, case when quality = 1 and toxic = 0 then 'APPROVED' when quality = 0 then 'REJECTED' else 'PENDING' end as status from labels)"


@query("o43_inherited_verdicts", _DUP + " select d.doc_id, canon as canonical_id, case when d.doc_id = canon then coalesce(o.status, 'PENDING') when c.status in ('APPROVED', 'REJECTED', 'PDF_INVALID') then c.status else 'DUPLICATE_PENDING' end as status from d left join l o on o.doc_id = d.doc_id left join l c on c.doc_id = canon")
def o43(t):
    return D.inherited(D.content_duplicates(t.documents, "doc_id", "text"), D.label_status(t.labels), "doc_id")


@query(
    "o44_propagated_duplicates",
    _DUP + " select d.doc_id, c.status from d join l c on c.doc_id = canon where d.doc_id <> canon and c.status in ('APPROVED', 'REJECTED', 'PDF_INVALID')",
)
def o44(t):
    return D.propagated(D.content_duplicates(t.documents, "doc_id", "text"), D.label_status(t.labels), "doc_id")


@query("o45_ordered_distinct", """with a as (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages) select page_id, (select string_agg(x, ' ' order by p) from (select x, min(p) as p from (select unnest(l) as x, unnest(range(len(l))) as p) group by x)) as links from a""")
def o45(t):
    return t.pages.select("page_id", F.nullif(F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))), " "), F.lit("")).alias("links"))


@query("o46_round_dedup", "with r as (select o_custkey % 97 as k, o_orderkey, o_custkey % 8 as attempt, row_number() over (partition by o_custkey % 97 order by o_orderkey) as rn from orders) select k, o_orderkey, attempt, case when attempt between 1 and 5 then 'QUEUED' else 'PERMANENTLY_FAILED' end as status from r where rn = 1")
def o46(t):
    rows = t.orders.select((F.col("o_custkey") % 97).alias("k"), "o_orderkey", (F.col("o_custkey") % 8).alias("attempt"))
    return R.round_jobs(rows, "k", "o_orderkey", "attempt")


_REC = "with r as (select o_orderkey, case o_orderstatus when 'F' then 'FAILED_FOR_ROUND' when 'O' then 'QUEUED' else 'PARTIAL' end as status, case when o_orderkey % 3 = 0 then 0 else cast(floor(o_totalprice) as bigint) end as part, epoch_us(o_orderdate) as updated, cast(o_custkey % 6 + 1 as int) as attempt from orders), n as (select *, attempt + case when status in ('DOWNLOADING', 'QUEUED', 'RECOVERING') then 0 else 1 end as next from r)"


@query("o47_recovery_order", _REC + " select o_orderkey, status, next as next_attempt from n where next <= 5 order by case when part > 0 then 0 else 1 end, part desc, updated desc, o_orderkey limit 100")
def o47(t):
    return R.recovery_plan(R.order_jobs(t.orders), 100).select("o_orderkey", "status", "next_attempt")


@query("o47_exhausted", _REC + " select o_orderkey, 'PERMANENTLY_FAILED' as status from n where next > 5")
def o47b(t):
    return R.exhausted(R.order_jobs(t.orders)).select("o_orderkey", "status")


@query("o48_recent", "select event_id, event_type from events order by ts desc, event_id desc limit 12")
def o48(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(12).select("event_id", "event_type")


@query("o48_recent_per_worker", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 5")
def o48b(t):
    return top_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("o189_debug_history", "select event_id, event_type, value from events where event_type = 'error' order by ts desc, event_id desc limit 500")
def o189(t):
    return t.events.filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", "value")


@query("o49_bounded_listing", "(select c_name as entry from customer order by c_name limit 50) union all select '... ' || (count(*) - 50) || ' more' from customer having count(*) > 50")
def o49(t):
    return bounded_with_rest(t.customer, ["c_name"], "c_name", 50)


@query(
    "o55_candidate_order",
    "with h as (select user_id, sum(case event_type when 'purchase' then 10 when 'error' then -20 else 0 end) as score from events group by 1), c as (select p_partkey, p_size % 5 as prio, coalesce(score, 0) as score, p_name from part left join h on user_id = p_partkey % 200) select p_partkey, cast(row_number() over (partition by p_partkey % 50 order by prio, score desc, p_name, p_partkey) as int) as pos from c",
)
def o55(t):
    health = t.events.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "error", -20).otherwise(0)).alias("score"))
    c = t.part.withColumn("user_id", F.col("p_partkey") % 200).join(health, "user_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    w = Window.partitionBy(F.col("p_partkey") % 50).orderBy(F.col("p_size") % 5, F.desc("score"), "p_name", "p_partkey")
    return c.select("p_partkey", F.row_number().over(w).alias("pos"))


@query(
    "o56_route_rotation",
    "with r as (select p_partkey, string_split(p_name, ' ') || [p_brand, p_type] as a, p_size as n from part) select p_partkey, array_to_string(a[(n % len(a)) + 1:] || a[1:(n % len(a))], '|') as rotated, a[(n - 1) % len(a) + 1] as pick from r",
)
def o56(t):
    a = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return t.part.withColumn("a", a).select("p_partkey", F.array_join(R.rotate(F.col("a"), F.col("p_size")), "|").alias("rotated"), R.pick(F.col("a"), F.col("p_size")).alias("pick"))


@query(
    "o77_library_match",
    "with l as (select array_to_string(regexp_extract_all(lower(p_name || p_type), '[a-z0-9]+'), ' ') as title, p_partkey from part), u as (select title, min(p_partkey) as path from l group by title having count(distinct p_partkey) = 1) select p_partkey, path from l left join u using (title)",
)
def o77(t):
    lib = t.part.select(normalized_title(F.concat("p_name", "p_type")).alias("title"), "p_partkey")
    return D.unique_match(lib, lib, "title", "p_partkey", "path").select("p_partkey", "path")


@query(
    "o77_library_namesakes",
    "with l as (select p_partkey, lower(p_name) as title, '/lib' || p_partkey % 3 || '/' || p_size || p_type || '.pdf' as path, p_size || p_type as name from part), n as (select name from l group by name having count(distinct path) = 1), u as (select title, min(path) as path, any_value(name) as name from l group by title having count(distinct path) = 1) select p_partkey, n.name is not null as found, case when n.name is not null then u.path end as match from l left join u on u.title = l.title left join n on n.name = u.name",
)
def o77b(t):
    i = F.col("p_partkey")
    path = F.concat(F.lit("/lib"), (i % 3).cast("string"), F.lit("/"), F.col("p_size").cast("string"), F.col("p_type"), F.lit(".pdf"))
    lib = t.part.select(i, F.lower("p_name").alias("title"), path.alias("path"))
    return D.unique_match(lib.select("p_partkey", "title"), lib, "title", "path", "match").select("p_partkey", F.col("match").isNotNull().alias("found"), "match")


@query("o119_key_admission", "select min(event_id) as event_id, user_id from events where user_id not in (select c_custkey from customer where c_nationkey = 3) group by user_id")
def o119(t):
    known = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return t.events.join(known, "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("o120_bounded_admission", "select event_id, case when row_number() over (partition by user_id order by ts, event_id) <= 20 then 'ACCEPTED' else 'BACKPRESSURE' end as decision from events")
def o120(t):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", F.when(rn <= 20, "ACCEPTED").otherwise("BACKPRESSURE").alias("decision"))
