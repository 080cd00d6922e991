"""Predicates and routing decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import CONNECTION_ERRORS, NETWORK_ERRORS, PDF_TYPES, TEMPORARY_SIGNS


def relevant(title: Column, text: Column, owner: str, numbers: tuple[str, ...], books: tuple[str, ...], terms: tuple[str, ...]) -> Column:
    """The first-page rule cascade; unreadable or very short text passes."""
    t, x = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    named = rf"\b(standard|st|std)[\s/_-]*({'|'.join(numbers)})\b"
    hits = F.size(F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains(x, w)))
    return (
        F.when(F.length(F.trim(x)) < 50, True)
        .when(~t.contains(owner) & ~x.contains(owner), False)
        .when(t.rlike(named) | x.rlike(named), True)
        .when(t.contains("handbook") & t.rlike("|".join(books)), True)
        .otherwise(hits >= 2)
    )


def keyword_match(text: Column, query: str, vocabulary: tuple[str, ...] = ()) -> Column:
    """Any query token of three or more characters, or any term of the vocabulary, in the text."""
    import re

    found = [w.lower() for w in re.findall("[a-zA-Z0-9.]+", query) if len(w) > 2] + list(vocabulary)
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, found)), lambda w: F.contains(low, w)) if found else F.lit(False)


def response_class(status: Column, content_type: Column, partial: Column) -> Column:
    kind = F.lower(F.split(F.coalesce(content_type, F.lit("")), ";")[0])
    return (
        F.when(status >= 500, "RETRY")
        .when((status == 416) & partial, "RESTART")
        .when(status == 429, "DEFER")
        .when(~status.isin(200, 206), "FAIL")
        .when(kind.contains("html"), "CHALLENGE")
        .when(kind.isin("", *PDF_TYPES), "ACCEPT")
        .otherwise("FAIL")
    )


def temporary_failure(name: Column, message: Column, started: Column | None = None, part_size: Column | None = None) -> Column:
    """Whether a transfer may go on: bytes were moved, or the error's name or message speaks of the network."""
    said = F.lower(F.coalesce(message, F.lit("")))
    out = F.coalesce(name.isin(*CONNECTION_ERRORS, *NETWORK_ERRORS), F.lit(False))
    for sign in TEMPORARY_SIGNS:
        out = out | F.contains(said, F.lit(sign))
    if started is not None:
        out = out | F.coalesce(started, F.lit(False))
    return out if part_size is None else out | (F.coalesce(part_size, F.lit(0)) > 0)


def verified_download(status: Column, integrity: Column, path: Column, wanted: Column, signature: Column, current: Column) -> Column:
    same_path = wanted.isNull() | (path == wanted)
    return F.coalesce((F.upper(status) == "COMPLETED") & (integrity == "VALID") & same_path & signature.isNotNull() & (signature == current), F.lit(False))
