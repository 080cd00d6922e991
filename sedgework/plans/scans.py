"""Scans, lookups and incremental listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rebase_json, rebase_path, usable_page
from ..sources import files as S
from .registry import query


@query("o01_page_cache", "select sha256(url) as key, page_id from pages where length(trim(html)) >= 200 and not regexp_matches(lower(html), 'access denied|captcha|temporarily unavailable|error 502|error 503')")
def o01(t):
    return t.pages.filter(usable_page(F.col("html"))).select(F.sha2("url", 256).alias("key"), "page_id")


@query("o05_point_lookup", "select doc_id, source, n_chars from documents where doc_id = 42")
def o05(t):
    return t.documents.filter("doc_id = 42").select("doc_id", "source", "n_chars")


@query("o07_files_to_validate", "select '/data/' || source || '/doc_' || doc_id || '.PDF' as path from documents where doc_id not in (select doc_id from labels where quality = 1) and source <> 'src3'")
def o07(t):
    folder = F.when(F.col("source") == "src3", "approved").otherwise(F.col("source"))
    path = F.concat(F.lit("/data/"), folder, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".PDF"))
    files = t.documents.select(path.alias("path"), "doc_id")
    names = files.join(t.labels, "doc_id")
    reports = names.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).alias("filepath"), F.when(F.col("doc_id") % 2 == 1, F.col("path")).alias("stored_path"), (F.col("quality") == 1).alias("stage2_completed"))
    return S.files_to_validate(files, reports).select("path")


@query("o06_reports_of_paths", "select doc_id from documents where doc_id % 10 = 3 or doc_id % 10 = 4")
def o06(t):
    i = F.col("doc_id").cast("string")
    reports = t.documents.select("doc_id", F.concat(F.lit("/in/"), i).alias("filepath"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/out/"), i)).otherwise(F.concat(F.lit("/in/"), i)).alias("stored_path"))
    m = F.col("doc_id") % 10
    paths = t.documents.filter(m.isin(3, 4)).select(F.when(m == 3, F.concat(F.lit("/in/"), i)).otherwise(F.concat(F.lit("/out/"), i)).alias("path"))
    return S.reports_of_paths(reports, paths).select("doc_id")


@query("o08_library_index", "select '/lib/' || p_partkey || '/' || p_name || '.pdf' as path, case when p_partkey % 3 = 0 then 'kept title' else array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') end as title from part")
def o08(t):
    path = F.concat(F.lit("/lib/"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_name"), F.lit(".pdf"))
    listing = t.part.select(path.alias("path"), F.concat(F.col("p_size").cast("string"), F.lit(":1")).alias("signature"))
    old = t.part.filter("p_partkey % 3 <> 2").select(path.alias("path"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ":1").otherwise(":0")).alias("signature"), F.lit("kept title").alias("title"))
    return S.library_index(listing, old).select("path", "title")


@query("o10_path_rebase", "select doc_id, '/content/drive/' || source || '/' || doc_id || '.pdf' as path from documents")
def o10(t):
    p = F.concat(F.lit("/local/run\\"), F.col("source"), F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return t.documents.select("doc_id", rebase_path(p, "/local/run", "/content/drive").alias("path"))


@query("o10_nested_rebase", """select page_id, '{"entry": {"part_path": "/content/drive/a/' || page_id || '.pdf", "/local/run/k": [{"paths": ["/content/drive/x/y", "/local/runs/z", ' || page_id || ', null, true]}], "title": "see /local/run/x é"}}' as document from pages""")
def o10b(t):
    i = F.col("page_id").cast("string")
    document = F.concat(F.lit('{"entry": {"part_path": "/local/run/a/'), i, F.lit('.pdf", "/local/run/k": [{"paths": ["\\\\local\\\\run\\\\x\\\\y", "/local/runs/z", '), i, F.lit(', null, true]}], "title": "see /local/run/x é"}}'))
    return t.pages.select("page_id", rebase_json(document, "/local/run/", "/content/drive").alias("document"))


@query("o13_proxy_list", "select p_partkey, trim(p_name) as line from part where p_partkey % 3 = 0")
def o13(t):
    m = F.col("p_partkey") % 3
    line = F.trim(F.when(m == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).when(m == 1, F.concat(F.lit("# "), F.col("p_name"))).otherwise("   "))
    return t.part.select("p_partkey", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
