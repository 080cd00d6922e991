"""Extraction from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from .registry import query


@query("o25_anchors", """with a as (select page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) as h, regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) as l from pages) select page_id, cast(unnest(range(len(h))) as int) as pos, unnest(h) as href, unnest(l) as label from a""")
def o25(t):
    return H.anchors(t.pages, "page_id")


@query("o23_plain_text", r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) as digest from pages")
def o23(t):
    return t.pages.select("page_id", F.md5(H.plain_text(F.col("html")).cast("binary")).alias("digest"))


@query("o23_linear_text")
def o23b(t):
    return t.pages.select("page_id", F.length(H.linear_text(F.col("html"))).alias("characters"))


def _table(t):
    """A result page of six rows for each page."""
    row = lambda i: F.concat(F.lit(f"<tr><td><a href='/book/{i}/"), F.col("page_id").cast("string"), F.lit(f"'>Title {i}</a></td><td><a href='http://mirror.example/main/"), F.md5(F.concat("url", F.lit(str(i))).cast("binary")), F.lit(f"'>[1]</a></td><td>{i} MB</td></tr>"))
    return t.pages.select("page_id", F.lit("http://site.example/search").alias("base_url"), F.concat(F.lit("<table>"), *[row(i) for i in range(6)], F.lit("</table>")).alias("html"))


_I = "pages, range(6) r(i)"


@query("o21_mirror_rows", f"select page_id, cast(i as int) as row_no, 'http://mirror.example/main/' || md5(url || i) as mirror from {_I}")
def o21(t):
    return H.extract_mirror_rows(_table(t), ["page_id"]).select("page_id", "row_no", F.element_at("mirrors", 1).alias("mirror"))


@query("o22_document_rows", f"select page_id, cast(i as int) as row_no, 'Title ' || i as title, 'http://site.example/book/' || i || '/' || page_id as link, 'Title ' || i || ' [1] ' || i || ' MB' as text from {_I}")
def o22(t):
    return H.extract_document_rows(_table(t), ["page_id"])


@query("o22_document_row_labels", "select page_id, cast(i as int) as row_no, case i when 0 then '[1]' when 1 then '7 of ' || page_id when 2 then 'of ' || page_id else 'X ' || page_id end as title, case i when 0 then '/b/' when 1 then '/n/' when 2 then '/f?MD5=' else '/x/' end || page_id as path from pages, range(4) r(i)")
def o22b(t):
    """Labels in brackets are titles, bare digits and empty labels give way to the row's text; links are told by their letters in any case."""
    i = F.col("page_id").cast("string")
    rows = (("/b/", "[1]", "of"), ("/n/", "7", "of"), ("/f?MD5=", "", "of"), ("/gone/", "", "of"), ("/x/", "X {}", ""))
    parts = [F.concat(F.lit(f"<tr><td><a href='{link}"), i, F.lit("'>"), F.replace(F.lit(label), F.lit("{}"), i), F.lit(f"</a></td><td>{text} "), i if text else F.lit(""), F.lit("</td></tr></x>")) for link, label, text in rows]
    pages = t.pages.select("page_id", F.lit("http://site.example").alias("base_url"), F.concat(F.lit("<table>"), *parts).alias("html"))
    return H.extract_document_rows(pages, ["page_id"]).select("page_id", "row_no", "title", F.substring("link", 20, 1000).alias("path"))


@query("o22_lateral_rows", f"select page_id, cast(i as int) as row_no, 'Title ' || i as title, 'http://site.example/book/' || i || '/' || page_id as link from {_I}")
def o22c(t):
    """The rows by the table function, joined laterally in SQL."""
    H.register_tables(t.spark)
    return t.spark.sql("select p.page_id, r.row_no, r.title, r.link from {pages} p, lateral document_rows(p.html, p.base_url) r", pages=_table(t))


@query("o21_lateral_rows", f"select page_id, cast(i as int) as row_no, 'http://mirror.example/main/' || md5(url || i) as mirror from {_I}")
def o21b(t):
    H.register_tables(t.spark)
    return t.spark.sql("select p.page_id, r.row_no, element_at(r.mirrors, 1) as mirror from {pages} p, lateral mirror_rows(p.html, p.base_url) r", pages=_table(t))


@query("o24_download_links", """select page_id, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: contains(x, '.pdf'))[1] as first_pdf from pages""")
def o24(t):
    links = F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda x: x.contains(".pdf"))
    return t.pages.select("page_id", F.get(links, F.lit(0)).alias("first_pdf"))
