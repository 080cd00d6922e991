"""Helpers shared by the corpus operators: table reading, shared work folders, materialising."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words, here and in every operator of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sedgework-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor and the driver can read.

    Only in local mode (tests), where the session does not set that folder, a temporary one is taken; on a
    cluster its absence is an error, as executors could not read a folder of the driver.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base and not (conf.get("spark.master") or "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or _own_folder()
    return f"{base.rstrip('/')}/sedgework/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends; else they stay until the driver happens to collect its garbage.

    For steps that run one after the other, each over what the one before has written.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives free memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def frugal(run):
    """``run``, a function over Arrow batches, that gives its free memory back when a task ends.

    Workers are kept for later tasks and stages; without this each holds on to the most that it ever took.
    """

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return wrapped


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words (runs of characters other than ASCII white space); null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def slices(lengths, limit: int):
    """Index ranges of consecutive rows whose lengths sum to at most ``limit`` (a longer single row stands alone)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
