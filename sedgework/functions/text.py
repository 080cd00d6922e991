"""Names, titles, tokens and other text functions as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .vocab import BLOCK_PAGE_SIGNS


def usable_page(html: Column) -> Column:
    """Long enough and without the words of block pages."""
    return (F.length(F.trim(html)) >= 200) & ~F.lower(html).rlike("|".join(BLOCK_PAGE_SIGNS))


def tokens(text: Column) -> Column:
    """Distinct ASCII alphanumeric tokens, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def safe_filename(title: Column, page: Column, item: Column) -> Column:
    s = F.regexp_replace(title, "[^A-Za-z0-9._ -]+", "_")
    s = F.substring(F.regexp_replace(_trim_marks(s), "[ ]+", "_"), 1, 100)
    return F.concat(F.format_string("page_%03d_%03d_", page, item), F.when(s == "", "document").otherwise(s), F.lit(".pdf"))


def _trim_marks(s: Column) -> Column:
    return F.regexp_replace(s, "^[ ._]+|[ ._]+$", "")


def provenance(page: Column, item: Column, filename: Column) -> Column:
    """Page and item, both from one place: the given ones if both are above 0, else the file name, else null."""
    found = lambda g: F.try_to_number(F.nullif(F.regexp_extract(filename, r"(?i)^page_([0-9]{3})_([0-9]{3})_", g), F.lit("")), F.lit("999")).cast("int")
    both = F.coalesce((page > 0) & (item > 0), F.lit(False))
    return F.struct(F.when(both, page).otherwise(found(1)).alias("page"), F.when(both, item).otherwise(found(2)).alias("item"))


def normalized_title(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"^page_[0-9]+_[0-9]+_", ""), r"\.pdf$", "")
    return F.array_join(F.regexp_extract_all(bare, F.lit("[a-z0-9]+"), F.lit(0)), " ")


def human_name(title: Column, filename: Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?i)\.pdf$", "")
    name = F.replace(F.regexp_replace(F.coalesce(F.nullif(F.trim(title), F.lit("")), base), r"^page_[0-9]+_[0-9]+_", ""), F.lit("_"), F.lit(" "))
    return F.coalesce(F.nullif(F.trim(F.substring(name, 1, 90)), F.lit("")), F.lit("document"))


def failure_detail(text: Column, fallback: str = "no detail") -> Column:
    s = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    s = F.substring(F.regexp_replace(s, r"(?i)(api_?key=)[^ &]+", "$1[redacted]"), 1, 300)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def hide_values(text: Column, values: list[str], mark: str = "***") -> Column:
    for v in values:
        if v:
            text = F.replace(text, F.lit(v), F.lit(mark))
    return text


def progress_percent(done: Column, total: Column) -> Column:
    """0 to 100; null when the total is unknown, not positive or below what is there already."""
    return F.when((total > 0) & (total >= done), F.greatest(F.lit(0.0), F.least(F.lit(100.0), done * 100.0 / total)))


def progress_text(done: Column, total: Column) -> Column:
    pct = progress_percent(done, total)
    mb = lambda x: F.format_string("%.1f MB", x / 1048576.0)
    filled = F.floor(pct / 10).cast("int")
    bar = F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), 10 - filled))
    return F.when(pct.isNull(), mb(done)).otherwise(F.concat(F.lit("["), bar, F.lit("] "), mb(done), F.lit(" / "), mb(total)))


def rebase_path(p: Column, old: str, new: str) -> Column:
    q = F.replace(p, F.lit("\\"), F.lit("/"))
    return F.when((q == old) | q.startswith(old + "/"), F.concat(F.lit(new), F.substring(q, F.lit(len(old) + 1), F.length(q)))).otherwise(q)


def rebased(value, old: str, new: str):
    """A JSON value with the paths below ``old`` put below ``new``, at any depth; names of objects stay."""
    old = old.replace("\\", "/").rstrip("/")
    box = [value]
    todo: list[tuple] = [(box, 0)]  # a holder and a place in it, so that nesting needs no recursion
    while todo:
        holder, at = todo.pop()
        x = holder[at]
        if isinstance(x, str):
            path = x.replace("\\", "/")
            if path.startswith(old + "/"):
                holder[at] = str(PurePosixPath(new) / path[len(old) + 1 :].lstrip("/"))
        elif isinstance(x, (dict, list)):
            todo += [(x, k) for k in (x if isinstance(x, dict) else range(len(x)))]
    return box[0]


def rebase_json(document: Column, old: str, new: str) -> Column:
    """``rebased`` over JSON documents; what is no JSON stays as it is, a null is null."""

    def one(text):
        try:
            value = json.loads(text)
            moved = rebased(value, old, new)
            return json.dumps(moved, ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            return text

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(one)

    return F.pandas_udf(run, StringType())(document)


def destination_name(name: Column) -> Column:
    """The base name with .pdf; null for names that are no file."""
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.when(base.isin("", ".", ".."), None).when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))


def effective_size(final: Column, part: Column) -> Column:
    return F.coalesce(final, part, F.lit(0)).cast("long")


def escapes_root(p: Column) -> Column:
    return p.rlike("^/") | p.rlike(r"(^|/)[.][.](/|$)")


def object_key(doc: Column, token: Column, sha: Column) -> Column:
    return F.concat(F.lit("objects/"), F.sha2(doc, 256), F.lit("/"), token.cast("string"), F.lit("-"), sha, F.lit(".pdf"))


def state_of_message(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.contains("retry"), "RETRYING").when(m.contains("stall"), "STALLED").when(m.contains("switch"), "SWITCHING_ROUTE").otherwise("DOWNLOADING")
