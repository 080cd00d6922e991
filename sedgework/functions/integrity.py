"""Structural checks of stored files, as column expressions over their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER, LEAST_BYTES, LEAST_FINAL = "%PDF-", 128, 2048


def file_signature(size: Column, modified_ns: Column) -> Column:
    """Size and time of the last change in nanoseconds; null for a file that isn't there."""
    return F.when(size.isNotNull() & modified_ns.isNotNull(), F.array(size.cast("long"), modified_ns.cast("long")))


def structure(content: Column, length: Column, pages: Column | None = None) -> Column:
    """(valid, error_type): the first check that fails.

    ``pages`` is the page count of a parser, if there is one; without, a file counts as cut when its
    end marker is missing from the last KiB.
    """
    tail = F.substring(content, F.greatest(F.lit(1), (length - 1023).cast("int")), F.lit(1024)).cast("string")
    error = (
        F.when(content.isNull(), "PDF_MISSING")
        .when(length == 0, "EMPTY_PDF")
        .when(length < LEAST_BYTES, "PDF_TRUNCATED")
        .when(F.substring(content, 1, 5) != F.lit(HEADER).cast("binary"), "INVALID_PDF_HEADER")
        .when(~tail.contains("%%EOF"), "PDF_TRUNCATED")
    )
    if pages is not None:
        error = error.when(pages.isNull(), "PDF_PARSE_ERROR").when(pages == 0, "ZERO_PAGE_PDF")
    return F.struct(error.isNull().alias("valid"), error.alias("error_type"))


def finalization(size: Column, expected: Column) -> Column:
    return F.when(size < LEAST_FINAL, "DISCARDED").when(size < expected, "INCOMPLETE").otherwise("FINAL")


def promotion(valid: Column, error: Column, has_partial: Column) -> Column:
    """(status, integrity, action) after a file was checked."""
    cut = error == "PDF_TRUNCATED"
    s = lambda status, integrity, action: F.struct(F.lit(status).alias("status"), F.lit(integrity).alias("integrity"), F.lit(action).alias("action"))
    return (
        F.when(valid, s("COMPLETED", "VALID", "keep")).when(cut & ~has_partial, s("PARTIAL", "INVALID", "becomes partial"))
        .when(has_partial, s("PARTIAL", "INVALID", "quarantine")).otherwise(s("FAILED_FOR_ROUND", "INVALID", "quarantine"))
    )


def validation_admission(exists: Column, status: Column, valid: Column, running: Column, capacity: int) -> Column:
    return (
        F.when(~exists, "MISSING").when(F.upper(status).isin("APPROVED", "REJECTED", "PDF_INVALID"), "DONE").when(~valid, "PDF_INVALID")
        .when(running < capacity, "QUEUED").otherwise("PENDING")
    )
