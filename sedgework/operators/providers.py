"""Where verdicts come from: a provider is a function from requests to raw responses, both DataFrames.

The engine calls no model.  A provider gets the requests with all their columns and returns their keys with a column ``raw``;
the default one looks responses up in a table.  Whatever it is, its answers go through the same cleaning and rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts as V

Provider = Callable[[DataFrame], DataFrame]


def table_provider(responses: DataFrame, keys: list[str], raw: str = "raw") -> Provider:
    """Answers requests from a table of responses; those that it lacks stay unanswered."""
    known = responses.select(*keys, F.col(raw).alias("raw"))
    return lambda requests: requests.select(*keys).distinct().join(known, keys)


def judged(requests: DataFrame, provider: Provider, keys: list[str], quality: str) -> DataFrame:
    """``requests`` with body (the response's first object), approved, score, and status.

    Of several answers to a request the greatest text counts.  A request without an answer, or whose answer holds no
    object, is PENDING with null fields.
    """
    answers = provider(requests)
    if missing := {*keys, "raw"} - set(answers.columns):
        raise ValueError(f"the provider's answers have no column {', '.join(sorted(missing))}")
    one = answers.groupBy(*keys).agg(F.max("raw").alias("_raw"))
    rows = requests.join(one, keys, "left").withColumn("body", V.recover_object(F.coalesce("_raw", F.lit("")))).drop("_raw")
    field = lambda name: F.get_json_object("body", f"$.{name}")
    approved, score = V.truthy(field("approved")), V.clamp_score(field("score"))
    status = V.status_of(approved, score, V.truthy(field("needs_more_text")), F.col(quality), field("confidence"), F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))
    told = F.col("body").isNotNull()
    return rows.withColumns({"approved": F.when(told, approved), "score": F.when(told, score), "status": F.when(told, status).otherwise("PENDING")})
