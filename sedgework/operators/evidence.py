"""Chunking of documents and selection of the best chunks for sets of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import CHUNK_CHARS, EVIDENCE_CHARS, GOOD_CHARS, PREVIEW_PAGES, TOP_CHUNKS


def pieces(text, size: int = CHUNK_CHARS):
    """Consecutive stretches of ``size`` characters of a text, by one walk over it; empty texts have none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARS) -> DataFrame:
    """(id, chunk_no from 0, chunk): consecutive stretches of ``size`` characters; empty texts have none."""
    return docs.select(F.col(id_col), F.posexplode(pieces(F.col(text_col), size)).alias("chunk_no", "chunk"))


def spaced(text):
    """The tokens of a text with a space around each, for ``score``."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))


def score(spaced_tokens, terms: tuple[str, ...]):
    """Share of the terms (each one token) that occur; substring searches in place of token arrays."""
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.contains(spaced_tokens, F.lit(f" {t} ")).cast("int")
    return hits / F.lit(float(max(1, len(terms))))


def _best(docs: DataFrame, topics: dict[str, tuple[str, ...]], id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, _p, _best): the chunks of a document and, by topic, its best ``k`` as (topic, rank, chunk_no, score).

    A document is one row, so its chunks are ranked inside the row and nothing is shuffled.
    """
    rows = docs.select(F.col(id_col), pieces(F.col(text_col)).alias("_p")).filter(F.size("_p") > 0)
    rows = rows.withColumn("_t", F.transform("_p", spaced))

    def ranked(name: str, terms: tuple[str, ...]):
        # higher scores first, then earlier chunks; the score is negated for the order alone
        order = F.slice(F.array_sort(F.transform("_t", lambda t, i: F.struct((-score(t, terms)).alias("s"), i.alias("c")))), 1, k)
        return F.transform(order, lambda e, i: F.struct(F.lit(name).alias("topic"), (i + 1).alias("rank"), e["c"].alias("chunk_no"), F.abs(e["s"]).alias("score")))

    return rows.select(id_col, "_p", F.concat(*[ranked(n, t) for n, t in topics.items()]).alias("_best"))


def topk(docs: DataFrame, topics: dict[str, tuple[str, ...]], id_col: str = "doc_id", text_col: str = "text", k: int = TOP_CHUNKS) -> DataFrame:
    """As ``topk_in_rows``, but the chunks of all rows with one id are ranked together.

    Topics become an array that is exploded after tokenizing, so each chunk is tokenized once; the
    rank filter runs as a group limit before the shuffle, which thus moves at most k chunks for each
    document, topic and task.
    """
    parts = chunks(docs, id_col, text_col).withColumn("_tok", spaced(F.col("chunk")))
    scored = F.array(*[F.struct(F.lit(name).alias("topic"), score(F.col("_tok"), terms).alias("score")) for name, terms in topics.items()])
    rows = parts.withColumn("_s", F.explode(scored)).select(id_col, "chunk_no", "chunk", "_s.topic", "_s.score")
    rank = F.row_number().over(Window.partitionBy(id_col, "topic").orderBy(F.desc("score"), "chunk_no"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def topk_in_rows(docs: DataFrame, topics: dict[str, tuple[str, ...]], id_col: str = "doc_id", text_col: str = "text", k: int = TOP_CHUNKS) -> DataFrame:
    """(id, topic, rank, chunk_no, score, chunk): the best ``k`` chunks of each document and topic, earlier ones first on ties.

    Rows with equal ids are documents of their own; null and empty texts have no chunks.
    """
    entries = F.transform("_best", lambda e: F.struct(e.alias("e"), F.get("_p", e["chunk_no"]).alias("chunk")))
    rows = _best(docs, topics, id_col, text_col, k).select(id_col, F.explode(entries).alias("_e"))
    return rows.select(id_col, *[F.col(f"_e.e.{c}") for c in ("topic", "rank", "chunk_no", "score")], "_e.chunk")


def evidence(docs: DataFrame, topics: dict[str, tuple[str, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the labelled best chunks of all topics as one bounded text, their places, and its quality.

    A chunk that is among the best of several topics stands once, where the first of them by name puts it.
    """
    order = F.array_sort(F.transform("_best", lambda e: F.struct(e["topic"].alias("topic"), e["rank"].alias("rank"), e["chunk_no"].alias("chunk_no"))))
    rows = _best(docs, topics, id_col, text_col, TOP_CHUNKS).withColumn("_n", F.array_distinct(F.transform(order, lambda e: e["chunk_no"])))
    entry = F.transform("_n", lambda n: F.concat(F.lit("[Chunk "), n.cast("string"), F.lit("] "), F.get("_p", n)))
    sampled = F.array_join(F.transform(F.array_sort("_n"), lambda n: n.cast("string")), ",")
    out = rows.select(id_col, F.substring(F.array_join(entry, "\n\n"), 1, EVIDENCE_CHARS).alias("evidence"), sampled.alias("chunks_sampled"))
    return out.withColumn("quality", F.when(F.length("evidence") >= GOOD_CHARS, "good").otherwise("sparse"))


def preview(pages: DataFrame, key: str, page: str, text: str, limit: int = EVIDENCE_CHARS, enough: int = GOOD_CHARS, most: int = PREVIEW_PAGES) -> DataFrame:
    """Adaptive sampling of the first ``most`` pages in order; short ones are listed but add nothing.

    Sampling ends with the first page of use that is the third or later and brings the characters to ``enough``,
    or that finds ``limit`` characters taken.  ``toc_pages`` are the sampled pages of use that hold a table of
    contents.  Only lengths and flags are shuffled, not texts.
    """
    lower, useful = F.lower(F.trim(text)), F.length(F.trim(text)) >= 80
    toc = useful & (F.contains(lower, F.lit("table of contents")) | F.contains(F.substring(lower, 1, 300), F.lit("contents")))
    w = Window.partitionBy(key).orderBy(page)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select(key, page, F.coalesce(F.when(useful, F.length(F.trim(text))), F.lit(0)).alias("_used"), F.coalesce(toc, F.lit(False)).alias("_toc"))
    rows = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).withColumn("_before", F.coalesce(F.sum("_used").over(before), F.lit(0)))
    ends = (F.col("_used") > 0) & (((F.col("_n") >= 3) & (F.least(F.lit(limit), F.col("_before") + F.col("_used")) >= enough)) | (F.col("_before") >= limit))
    rows = rows.withColumn("_ended", F.coalesce(F.max(ends).over(before), F.lit(False))).filter(~F.col("_ended"))
    rows = rows.withColumn("_take", F.greatest(F.lit(0), F.least("_used", limit - F.col("_before"))))
    chars = F.sum("_take").cast("long")
    n = F.count_if(F.col("_take") > 0)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda p: p.cast("string")), ",")
    return rows.groupBy(key).agg(
        chars.alias("characters"),
        n.alias("pages_with_text"),
        listed(F.col(page)).alias("pages_sampled"),
        listed(F.when(F.col("_toc"), F.col(page))).alias("toc_pages"),
        F.when((chars >= enough) & (n >= 2), "good").when(chars > 0, "weak").otherwise("empty").alias("quality"),
    )
