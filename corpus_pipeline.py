"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. quality rules: documents that the base rules or the learned decision list reject go;
2. n-gram Jaccard join: of each group of near duplicates (five words, 80 percent) the one with the least id stays;
3. secret scans: every secret found is replaced by a mark;
4. mixing sources: documents are left out or repeated so that sources come to their target weights;
5. SentencePiece: the token counts and digests of what the mix holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.llm import jaccard, mixing, quality, secrets, sentencepiece
from sedgework.llm.common import materialize, table


#: The near-duplicate stage: words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the list learned from ``labels`` keep, with their columns as they are.

    Null, empty and word-free texts fail the base rules; labels without a document, null and repeated ones do no
    harm; without labels only the base rules decide; repeated rows are judged each; no rows give no rows.
    """
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity the one with the least id (null ids last, then the least text hash).

    Texts without words link with nothing and stay, repeated rows of them too; equal rows with words leave one;
    texts of any length are read whole; no rows give no rows; other columns ride along whatever their names.
    """
    return jaccard.representatives(docs, shingle=SHINGLE, percent=PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark, and ``n_chars`` counted again (null for a null text).

    Overlapping findings are replaced as one; equal texts are scanned once and changed alike; repeated rows stay;
    no rows give no rows.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (up to three times, perhaps never), with its columns as they are.

    Texts without words are taken never, as their size is 0; a null source is a source of its own; repeated rows
    are documents of their own; equal sizes are told apart by a hash of the id; no rows give no rows.
    """
    return mixing.copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, token count and digests of ids, decoded text and byte spans of each row of the mix, copies included.

    A null text counts as empty; texts of any length are encoded whole; no rows give no rows.
    """
    return sentencepiece.digests(docs, sentencepiece.model_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", source_mix),
    ("SentencePiece", tokens),
]

#: The learned rules and the tokenizer can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
