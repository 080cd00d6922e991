"""Semi-structured verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..operators import batches as B
from .registry import query


def _raw():
    """A response for each label, in several styles."""
    m = F.col("doc_id") % 6
    body = F.format_string('{"approved": %s, "score": %d}', (F.col("quality") == 1).cast("string"), (F.col("doc_id") * 37 % 101).cast("int"))
    return (
        F.when(m == 0, body)
        .when(m == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("text ```\n"), body, F.lit("\n``` tail")))
        .when(m == 3, F.concat(F.lit("Sure: "), body, F.lit(" done")))
        .when(m == 4, "```json\n{broken\n```\n```\n{}\n```")
        .otherwise("no json")
    )


_BODY = """'{"approved": ' || (quality = 1) || ', "score": ' || (doc_id * 37 % 101) || '}'"""


#: Responses with the JSON that they hold, and with the list of objects that they give.
_RESPONSES = (
    ("```[]```", "[]", "[]"),
    ("```JSON\r\n[]\r\n```", "[]", "[]"),
    ("```json []```", "[]", "[]"),
    ("```json5\n{}\n```", None, "[]"),
    ('[{"a": 1}] done', None, '[{"a": 1}]'),
    ('{"a": [{"x": 1}]}', '{"a": [{"x": 1}]}', "[]"),
    ('```text\nintro\n```\n```json\n[{"t": "b"}]\n```', '[{"t": "b"}]', '[{"t": "b"}]'),
    ('```json\n[{"t":}]\n```', None, "[]"),
    ('[{"t": "b"}', None, "[]"),
    ('```json\n["b"]\n```', '["b"]', "[]"),
    ('First [{bad}] then [{"t": "a ] b", "d": [{"n": "} and \\" ]"}]}] or [{"u": 1}]', None, '[{"t": "a ] b", "d": [{"n": "} and \\" ]"}]}]'),
    ('["```json and ```"]', '["```json and ```"]', "[]"),
    ("null", "null", "[]"),
)


def _response():
    return F.element_at(F.array(*[F.lit(r[0]) for r in _RESPONSES]), (F.floor(F.col("doc_id") / 7) % len(_RESPONSES) + 1).cast("int"))


def _listed(k: int) -> str:
    return "[" + ", ".join("null" if r[k] is None else f"'{r[k]}'" for r in _RESPONSES) + f"][cast(doc_id // 7 % {len(_RESPONSES)} as int) + 1]"


@query("o60_clean_json", f"select doc_id, case when doc_id % 7 = 6 then {_listed(1)} when doc_id % 6 < 3 then {_BODY} end as body from labels")
def o60(t):
    raw = F.when(F.col("doc_id") % 7 == 6, _response()).otherwise(_raw())
    return t.labels.select("doc_id", V.clean_json(raw).alias("body"))


@query("o61_recover_array", f"select doc_id, case when doc_id % 7 = 6 then {_listed(2)} when doc_id % 2 = 0 then '[' || {_BODY} || ']' else '[]' end as body from labels")
def o61(t):
    body = F.format_string('{"approved": %s, "score": %d}', (F.col("quality") == 1).cast("string"), (F.col("doc_id") * 37 % 101).cast("int"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see [x] and [{bad} then [ "), body, F.lit("] end"))).otherwise("[1, 2] only")
    raw = F.when(F.col("doc_id") % 7 == 6, _response()).otherwise(raw)
    return t.labels.select("doc_id", V.recover_array(raw).alias("body"))


@query("o62_recover_object", f"select doc_id, case when doc_id % 6 < 4 then {_BODY} when doc_id % 6 = 4 then '{{}}' end as body from labels")
def o62(t):
    return t.labels.select("doc_id", V.recover_object(_raw()).alias("body"))


@query("o193_verdict_list", f"select doc_id, {_listed(2)} as body from labels")
def o193(t):
    return t.labels.select("doc_id", V.recover_array(_response()).alias("body"))


def _batches(t):
    docs = t.labels.select((F.floor(F.col("doc_id") / 25)).cast("long").alias("batch"), "doc_id", "quality").dropDuplicates(["doc_id"])
    listed = F.array_sort(F.collect_list(F.when(F.col("quality") == 1, F.col("doc_id"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x.cast("string")), ", "), F.lit("]"))
    raw = docs.groupBy("batch").agg(text.alias("raw"))
    b = F.col("batch")
    raw = raw.withColumn("raw", F.when(b % 5 == 1, "[true]").when(b % 5 == 2, "[-7]").when(b % 5 == 3, "[1,").otherwise(F.col("raw")))
    return docs, raw


@query("o63_approved_items", "select distinct doc_id, doc_id // 25 as batch from labels where quality = 1 and (doc_id // 25) % 5 in (0, 4)")
def o63(t):
    docs, raw = _batches(t)
    return B.approved_items(docs, raw, "batch", "doc_id", "raw").select("batch", "doc_id")


@query("o63_batch_errors", "select distinct doc_id // 25 as batch from labels where (doc_id // 25) % 5 in (1, 2, 3)")
def o63b(t):
    docs, raw = _batches(t)
    return B.batch_errors(docs, raw, "batch", "doc_id", "raw")


@query("o64_valid_batches", "select o_custkey % 50 as batch, count(*) = count(distinct o_orderkey % 100) as valid from orders group by 1")
def o64(t):
    return B.valid_batches(t.orders.select((F.col("o_custkey") % 50).alias("batch"), (F.col("o_orderkey") % 100).alias("item")), "batch", "item")


_FIELDS = """with v as (select d.doc_id, quality = 1 as approved, cast(d.doc_id * 37 % 101 as int) as score, case when n_chars >= 1500 then 'good' else 'sparse' end as q, d.doc_id % 13 = 0 as more, case when d.doc_id % 3 = 0 then 'High' else 'low' end as conf, d.doc_id % 4 = 0 as req, case when d.doc_id % 5 = 0 then null else toxic = 0 end as ident, quality = 1 as rel from labels l join documents d on d.doc_id = l.doc_id)"""
_STATUS = """case when req and not (ident is not distinct from true and rel is not distinct from true) then case when (ident is not distinct from false or rel is not distinct from false) and lower(conf) = 'high' and not more and q = 'good' then 'REJECTED' else 'PENDING' end
 when more or q <> 'good' or (approved and score < 70) or (not approved and score > 30 and score < 70) then 'PENDING' when approved and score >= 70 then 'APPROVED' when not approved and score <= 30 then 'REJECTED' else 'PENDING' end"""


def _fields(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    i = F.col("doc_id")
    score = V.clamp_score((i * 37 % 101).cast("string"))
    d = d.withColumn("approved", V.truthy(F.when(F.col("quality") == 1, "Yes").otherwise("no"))).withColumn("score", score)
    d = d.withColumn("q", F.when(F.col("n_chars") >= 1500, "good").otherwise("sparse")).withColumn("ident", F.when(i % 5 != 0, F.col("toxic") == 0))
    return d.withColumn("status", V.status_of(F.col("approved"), F.col("score"), i % 13 == 0, F.col("q"), F.when(i % 3 == 0, "High").otherwise("low"), i % 4 == 0, F.col("ident"), F.col("quality") == 1))


@query("o65_verdict_status", f"{_FIELDS} select doc_id, score, {_STATUS} as status from v")
def o65(t):
    return _fields(t).select("doc_id", "score", "status")


@query("o65_categories", "select p_partkey, array_to_string((list_filter([trim(x) for x in string_split(p_name || ' ; ; ' || p_type, ' ')], lambda x: x <> ''))[1:12], ',') as cats from part")
def o65b(t):
    return t.part.select("p_partkey", F.array_join(V.categories(F.split(F.concat("p_name", F.lit(" ; ; "), "p_type"), " ")), ",").alias("cats"))


@query("o66_guarded_status", f"{_FIELDS}, s as (select *, case when doc_id % 2 = 0 then 'approved' when doc_id % 7 = 0 then 'odd' else 'REJECTED' end as said from v) select doc_id, case when upper(said) = 'APPROVED' and approved and score >= 70 then 'APPROVED' when upper(said) = 'REJECTED' and not approved and q = 'good' then 'REJECTED' else 'PENDING' end as status from s")
def o66(t):
    i = F.col("doc_id")
    said = F.when(i % 2 == 0, "approved").when(i % 7 == 0, "odd").otherwise("REJECTED")
    return _fields(t).select("doc_id", V.guarded(said, F.col("approved"), F.col("score"), F.col("q")).alias("status"))


@query("o67_needs_model", "select doc_id, not (n_chars < 1500 or doc_id % 17 = 0) as needs_model from documents")
def o67(t):
    error = F.when(F.col("doc_id") % 17 == 0, "broken")
    quality = F.when(F.col("n_chars") >= 1500, "good").otherwise("sparse")
    return t.documents.select("doc_id", (error.isNull() & (F.trim("text") != "") & (quality == "good")).alias("needs_model"))


@query("o68_title_conflict", "select p_partkey, case when regexp_matches(lower(p_name), 'ring|bolt') and p_size % 2 = 0 then case when p_size % 3 = 0 then 'PENDING' else 'APPROVED' end else case when p_size % 2 = 0 then 'REJECTED' else 'APPROVED' end end as status from part")
def o68(t):
    first = F.when(F.col("p_size") % 2 == 0, "REJECTED").otherwise("APPROVED")
    second = F.when(F.col("p_size") % 3 == 0, "REJECTED").otherwise("APPROVED")
    strong = F.lower("p_name").rlike("ring|bolt") & (first == "REJECTED")
    return t.part.select("p_partkey", F.when(strong, F.when(second == "REJECTED", "PENDING").otherwise(second)).otherwise(first).alias("status"))


@query("o69_evidence_merge", "select doc_id, md5(substr(text || chr(10) || text, 1, 12000)) as digest, cast(least(12000, 2 * length(text)) as bigint) as characters, case when 2 * length(text) >= 2500 then 'good' when length(text) > 0 then 'weak' else 'empty' end as quality from documents")
def o69(t):
    n = F.length("text") * 2
    return t.documents.select("doc_id", F.md5(F.substring(F.concat_ws("\n", "text", "text"), 1, 12000).cast("binary")).alias("digest"), F.least(F.lit(12000), n).cast("long").alias("characters"), F.when(n >= 2500, "good").when(n > 0, "weak").otherwise("empty").alias("quality"))
