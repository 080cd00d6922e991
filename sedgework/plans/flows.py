"""Whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows, providers
from ..operators.dedup import label_status
from .ranking import _DUP
from .registry import query
from .verdicts import _raw


@query(
    "flow_validation_summary",
    _DUP + """, s as (select d.doc_id, case when d.doc_id = canon then coalesce(o.status, 'PENDING') when c.status in ('APPROVED', 'REJECTED', 'PDF_INVALID') then c.status else 'DUPLICATE_PENDING' end as status from d left join l o on o.doc_id = d.doc_id left join l c on c.doc_id = canon)
 select source, count(*) as found, count(*) filter (where status = 'APPROVED') as approved, count(*) filter (where status = 'REJECTED') as rejected, count(*) filter (where status = 'PENDING') as pending, count(*) filter (where status = 'DUPLICATE_PENDING') as duplicates_waiting from s join documents using (doc_id) group by source""",
)
def validation_summary(t):
    return flows.validation_summary(t.documents, label_status(t.labels), "source")


@query(
    "flow_provided_verdicts",
    """with a as (select d.doc_id, n_chars, case when l.doc_id is null or d.doc_id % 6 = 5 then null else d.doc_id % 6 end as style, l.quality = 1 and d.doc_id % 6 < 4 as yes, case when d.doc_id % 6 < 4 then cast(d.doc_id * 37 % 101 as int) else 0 end as score from documents d left join labels l on l.doc_id = d.doc_id)
 select doc_id, case when style is not null then yes end as approved, case when style is not null then score end as score, case when style is null or n_chars < 1500 then 'PENDING' when yes and score >= 70 then 'APPROVED' when not yes and score <= 30 then 'REJECTED' else 'PENDING' end as status from a""",
)
def provided_verdicts(t):
    requests = t.documents.select("doc_id", F.when(F.col("n_chars") >= 1500, "good").otherwise("sparse").alias("evidence"))
    provider = providers.table_provider(t.labels.select("doc_id", _raw().alias("raw")), ["doc_id"])
    return providers.judged(requests, provider, ["doc_id"], "evidence").select("doc_id", "approved", "score", "status")
