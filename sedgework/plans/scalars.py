"""Scalar functions: URLs, names, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .registry import query

# Pieces of the SQL that several queries share.
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"


def _identity(keep: str) -> str:
    pairs = f"list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' and {keep}))"
    return f"{_SCHEME} || '://' || {_NETLOC} || {_PATH} || case when len({pairs}) = 0 then '' else '?' || array_to_string({pairs}, '&') end"


@query("o31_defragment", "select page_id, regexp_replace(url, '#.*$', '') as clean from pages")
def o31(t):
    return t.pages.select("page_id", U.defragment(F.col("url")).alias("clean"))


@query(
    "o31_absolutize",
    r"""with a as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages)
    select page_id, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') as link from a where href like '/%'""",
)
def o31b(t):
    a = t.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return a.filter(F.col("href").startswith("/")).select("page_id", "href", U.absolutize(F.col("url"), F.col("href")).alias("link"))


@query("o32_http_with_host", f"select page_id, {_SCHEME} in ('http', 'https') and {_NETLOC} <> '' as ok from pages")
def o32(t):
    return t.pages.select("page_id", U.http_with_host(F.col("url")).alias("ok"))


@query(
    "o33_blocked_route",
    "select page_id, page_id % 9 < 8 as blocked from pages",
)
def o33(t):
    bad = ("http://127.0.0.1/x", "ftp://a/b", "http://a.localhost/", "http://x.onion/p", "http://localhost./x", "http://onion/x", "HTTP://A.Onion.:80/", "http://0.0.0.0:1/")
    url = F.coalesce(F.get(F.array(*map(F.lit, bad)), (F.col("page_id") % 9).cast("int")), F.col("url"))
    return t.pages.select("page_id", U.blocked(url).alias("blocked"))


#: Links and their identities, worked out by hand; the last are the pages' own.
_ROUTES = (
    ("HTTP://U:p@Host.Example.:80/p?a=1&a-b=2&B=%7e+x#f", "http://host.example:80/p?B=~+x&a=1&a-b=2"),
    ("http://h.example/x;v=1?b=&a=2&a=10&&c", "http://h.example/x?a=10&a=2&b=&c="),
    ("mailto:x#f", "mailto:x"),
    ("http://h.example:0/y?q=%C3%A9%2A", "http://h.example/y?q=%C3%A9%2A"),
    ("http://h.example:bad/y?b=1&a=2#f", "http://h.example:bad/y?b=1&a=2"),
)


@query("o34_route_identity", "select page_id, case page_id % 6 " + " ".join(f"when {k} then '{want}'" for k, (_, want) in enumerate(_ROUTES)) + f" else {_identity('true')} end as route from pages")
def o34(t):
    url = F.coalesce(F.get(F.array(*[F.lit(u) for u, _ in _ROUTES]), (F.col("page_id") % 6).cast("int")), F.col("url"))
    return t.pages.select("page_id", U.route_identity(url).alias("route"))


#: Links with their keys and the addresses that their identities are made of, worked out by hand.
_SPELLINGS = (
    ("HTTP://Host.Example:80/p;v=1?a-b=2&a=1#f", "http://host.example:80/p?a=1&a-b=2", "http://host.example:80/p?a=1&a-b=2"),
    ("http://h.example/p?a=1&a-b=2", "http://h.example/p?a=1&a-b=2", "http://h.example/p?a=1&a-b=2"),
    ("http://h.example/a;b/c;d?a&UTM_x=1&ts=2&_=3&q=%41+%zz", "http://h.example/a;b/c?a=&q=A+%25zz", "http://h.example/a;b/c?UTM_x=1&_=3&q=A+%25zz&ts=2"),
    ("http://h.example/p?%75tm_x=1&%74s=2&tst=3&=v&x=", "http://h.example/p?=v&tst=3&x=", "http://h.example/p?=v&ts=2&tst=3&utm_x=1"),
    ("http://h.example?b=%C3%A9&b=~*", "http://h.example?b=~%2A&b=%C3%A9", "http://h.example?b=~%2A&b=%C3%A9"),
)


def _spelled(t):
    return F.coalesce(F.get(F.array(*[F.lit(x[0]) for x in _SPELLINGS]), (F.col("page_id") % (len(_SPELLINGS) + 1)).cast("int")), F.col("url"))


def _worked(k: int, otherwise: str) -> str:
    return f"case page_id % {len(_SPELLINGS) + 1} " + " ".join(f"when {i} then '{x[k]}'" for i, x in enumerate(_SPELLINGS)) + f" else {otherwise} end"


@query("o35_route_key", f"""select page_id, {_worked(1, _identity("not regexp_matches(lower(p), '^(utm_[^=]*|_|cache_bust|cachebuster|timestamp|ts)(=|$)')"))} as route from pages""")
def o35(t):
    return t.pages.select("page_id", U.route_key(_spelled(t)).alias("route"))


@query(
    "o36_md5_selector",
    "select doc_id, case when doc_id % 3 = 2 then null else md5(text) end as md5 from documents",
)
def o36(t):
    h = F.md5(F.col("text").cast("binary"))
    m = F.col("doc_id") % 3
    url = F.when(m == 0, F.concat(F.lit("http://a.example/get?x=1&MD5="), F.upper(h))).when(m == 1, F.concat(F.lit("http://a.example/main/"), h, F.lit("/f"))).otherwise("http://a.example/main/12ab?md5=zz")
    return t.documents.select("doc_id", U.md5_selector(url).alias("md5"))


@query(
    "o37_document_identity",
    f"""select page_id, 'source-sha256:' || substr(sha256({_worked(2, _identity("regexp_matches(p, '^[^=]+=.')"))} || chr(10) || lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[ \\t\\n\\r\\f]+', ' ', 'g')))), 1, 32) as document_id from pages""",
)
def o37(t):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return t.pages.select("page_id", U.document_identity(_spelled(t), F.expr("cast(array() as array<string>)"), title).alias("document_id"))


@query("o38_query_hash", """select c_custkey, sha256('["' || lower(trim(regexp_replace(c_mktsegment || '  ' || c_name, '[ \\t\\n\\r\\f]+', ' ', 'g'))) || '", "search-v1"]') as query_hash from customer""")
def o38(t):
    return t.customer.select("c_custkey", U.query_hash(F.concat_ws("  ", "c_mktsegment", "c_name"), "search-v1").alias("query_hash"))


@query("o39_cache_key", "select page_id, sha256(url) as cache_key from pages")
def o39(t):
    return t.pages.select("page_id", U.cache_key(F.col("url")).alias("cache_key"))


@query(
    "o40_safe_filename",
    """with n as (select p_partkey, trim(regexp_replace('. ' || p_name || ' (' || p_type || ')!', '[^A-Za-z0-9._ -]+', '_', 'g'), ' ._') as s from part)
    select p_partkey, printf('page_%03d_%03d_', cast(p_partkey // 25 + 1 as int), cast(p_partkey % 25 + 1 as int)) || case when s = '' then 'document' else substr(regexp_replace(s, '[ ]+', '_', 'g'), 1, 100) end || '.pdf' as filename from n""",
)
def o40(t):
    name = F.concat(F.lit(". "), F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")!"))
    page, item = F.floor(F.col("p_partkey") / 25).cast("int") + 1, (F.col("p_partkey") % 25).cast("int") + 1
    return t.part.select("p_partkey", T.safe_filename(name, page, item).alias("filename"))


@query(
    "o41_provenance",
    "select p_partkey, case when p_size > 25 and p_partkey % 3 > 0 then p_size when p_partkey % 5 > 0 then cast(p_partkey % 1000 as int) end as page, case when p_size > 25 and p_partkey % 3 > 0 then cast(p_partkey % 3 as int) when p_partkey % 5 > 0 then cast(p_partkey % 7 as int) end as item from part",
)
def o41(t):
    name = F.format_string("%s_%03d_%03d_x.pdf", F.when(F.col("p_partkey") % 5 > 0, "Page").otherwise("leaf"), (F.col("p_partkey") % 1000).cast("int"), (F.col("p_partkey") % 7).cast("int"))
    given = F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(-1)
    return t.part.select("p_partkey", T.provenance(given, (F.col("p_partkey") % 3).cast("int"), name).alias("p")).select("p_partkey", "p.page", "p.item")


@query(
    "o41b_normalized_title",
    "select p_partkey, array_to_string(regexp_extract_all(lower(p_name || ' -- ' || p_type), '[a-z0-9]+'), ' ') as title from part",
)
def o41b(t):
    return t.part.select("p_partkey", T.normalized_title(F.concat(F.lit("Page_001_002_"), F.col("p_name"), F.lit(" -- "), F.col("p_type"), F.lit(".PDF"))).alias("title"))


@query("o41c_human_name", "select p_partkey, substr(p_name || ' ' || lower(p_brand), 1, 90) as name from part")
def o41c(t):
    file = F.concat(F.lit("/tmp/page_003_004_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_brand"), F.lit(".pdf"))
    return t.part.select("p_partkey", T.human_name(F.lit("  "), file).alias("name"))


@query(
    "o41d_failure_detail",
    r"select doc_id, substr(regexp_replace(trim(regexp_replace('apikey=s3cr3t ' || text, '[ \t\n\r\f]+', ' ', 'g')), '(api_?key=)[^ &]+', '\1[redacted]', 'gi'), 1, 300) as detail from documents",
)
def o41d(t):
    return t.documents.select("doc_id", T.failure_detail(F.concat(F.lit("apikey=s3cr3t "), F.col("text"))).alias("detail"))


@query("o41e_hide_values", "select c_custkey, replace(replace(c_name, 'Customer', '***'), '007', '***') as hidden from customer")
def o41e(t):
    return t.customer.select("c_custkey", T.hide_values(F.col("c_name"), ["Customer", "", "007"]).alias("hidden"))


@query(
    "o41f_progress",
    """with e as (select event_id, cast(floor(value * 1048576) as bigint) as done, user_id % 3 as m from events), p as (select *, case m when 0 then 0 when 1 then done * 2 else done - 1 end as total from e)
    select event_id, case when total > 0 and total >= done then greatest(0.0, least(100.0, done * 100.0::double / total)) end as pct, case when total > 0 and total >= done then '[' || repeat('#', cast(floor(done * 100.0::double / total / 10) as int)) || repeat('-', 10 - cast(floor(done * 100.0::double / total / 10) as int)) || ']' end as bar from p""",
)
def o41f(t):
    done = F.floor(F.col("value") * 1048576)
    total = F.when(F.col("user_id") % 3 == 0, 0).when(F.col("user_id") % 3 == 1, done * 2).otherwise(done - 1)
    bar = F.regexp_extract(T.progress_text(done, total), r"^(\[[#-]*\])", 1)
    return t.events.select("event_id", T.progress_percent(done, total).alias("pct"), F.nullif(bar, F.lit("")).alias("bar"))


@query("o41g_rebase_path", "select page_id, case when page_id % 2 = 0 then '/new/root/' || page_id || '/f.pdf' else '/older/' || page_id end as path from pages")
def o41g(t):
    i = F.col("page_id").cast("string")
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/old\\"), i, F.lit("\\f.pdf"))).otherwise(F.concat(F.lit("/older/"), i))
    return t.pages.select("page_id", T.rebase_path(p, "/old", "/new/root").alias("path"))


#: Links and their ranks, worked out by hand.
_RANKED = (
    ("http://a.example/x.PDF?k=1", 0), ("http://a.example/a.pdf#x", 0), ("http://a.example/a.pdf;v=1", 0), (f"http://{U.MAIN_HOST}/main/ab", 1), (f"http://u@{U.MAIN_HOST.upper()}:80/MAIN/ab", 1), ("http://l.example/main/ab", 4),
    (f"http://{U.MAIN_HOST}/x?f=/main/", 4), ("http://l.example/get.php?md5=1", 2), ("http://l.example/?next=get.php", 4), ("http://ipfs.io./x", 3), ("http://l.example/IPFS/x", 3), ("http://ipfsx.com/y", 4), ("http://g.example/?x=/ipfs/", 4), ("http://l.example/x#.pdf", 4),
)


@query("o54_route_rank", f"select page_id, case page_id % {len(_RANKED)} " + " ".join(f"when {k} then {rank}" for k, (_, rank) in enumerate(_RANKED)) + " end as rnk from pages")
def o54(t):
    link = F.get(F.array(*[F.lit(u) for u, _ in _RANKED]), (F.col("page_id") % len(_RANKED)).cast("int"))
    return t.pages.select("page_id", U.route_rank(link).alias("rnk"))


@query(
    "o170_destination_name",
    "select p_partkey, case p_partkey % 4 when 0 then null when 1 then p_name || '.pdf' when 2 then p_name || '.PDF' else p_brand || '.pdf' end as name, case p_partkey % 4 when 0 then null when 1 then p_name || '.pdf' when 2 then p_name || '.PDF' else p_brand || '.pdf' end || '.part' as partial from part",
)
def o170(t):
    m = F.col("p_partkey") % 4
    raw = F.when(m == 0, "a/..").when(m == 1, F.concat(F.lit("/x/y/"), F.col("p_name"))).when(m == 2, F.concat(F.lit("x\\"), F.col("p_name"), F.lit(".PDF"))).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", T.destination_name(raw).alias("name"), F.concat(T.destination_name(raw), F.lit(".part")).alias("partial"))


@query("o171_effective_size", "select p_partkey, cast(coalesce(case when p_size > 30 then p_size end, case when p_size > 10 then p_size * 2 end, 0) as bigint) as size from part")
def o171(t):
    return t.part.select("p_partkey", T.effective_size(F.when(F.col("p_size") > 30, F.col("p_size")), F.when(F.col("p_size") > 10, F.col("p_size") * 2)).alias("size"))


@query("o180_escapes_root", "select page_id, page_id % 4 <> 3 as escapes from pages")
def o180(t):
    m = F.col("page_id") % 4
    return t.pages.select("page_id", T.escapes_root(F.when(m == 0, "/abs").when(m == 1, "a/../b").when(m == 2, "..").otherwise("a/..b/c..")).alias("escapes"))


@query("o184_object_key", "select doc_id, 'objects/' || sha256(cast(doc_id as varchar)) || '/' || (doc_id % 9) || '-' || sha256(text) || '.pdf' as key from documents")
def o184(t):
    return t.documents.select("doc_id", T.object_key(F.col("doc_id").cast("string"), F.col("doc_id") % 9, F.sha2("text", 256)).alias("key"))


@query("o191_search_url", "select p_partkey, 'https://search.example/find?q=' || replace(p_name, ' ', '%20') || '&page=' || p_size as url from part")
def o191(t):
    return t.part.select("p_partkey", U.search_url("https://search.example/find?q={query}&page={page}", F.col("p_name"), F.col("p_size")).alias("url"))


@query("o168_state_of_message", "select event_id, case event_type when 'view' then 'RETRYING' when 'click' then 'STALLED' when 'signup' then 'SWITCHING_ROUTE' else 'DOWNLOADING' end as state from events")
def o168(t):
    e = F.col("event_type")
    m = F.when(e == "view", "Retry in 3 s after stall").when(e == "click", "STALLED, will switch").when(e == "signup", "Switching to mirror").otherwise("bytes")
    return t.events.select("event_id", T.state_of_message(m).alias("state"))
