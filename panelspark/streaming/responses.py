"""Responses as they come in: quality flags and how far quotas are filled.

The tools have no streaming mode of their own to match; this applies the same
column functions to a Structured Streaming frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.quality import has_keyword, straight_line
from panelspark.operators.quota import one_target, room


def flagged(responses: DataFrame, answers: list[str], text: str, words: list[str]) -> DataFrame:
    """The stream's rows with `straight` and `keyword`; no state."""
    return responses.withColumn("straight", straight_line(responses, answers)).withColumn("keyword", has_keyword(F.col(text), words))


def quota_progress(responses: DataFrame, quota: DataFrame, key: str) -> DataFrame:
    """Rows (m_key, wanted, filled) for update mode: responses so far in each main quota. State: a number per key.

    Of repeated quota keys the largest target counts, and a null key matches a null one, as in the allocation.
    """
    rooms = one_target(quota, "m_key").select(F.col("m_key").alias("_key"), room(F.col("target")).alias("wanted"))
    matched = responses.select(F.col(key).alias("m_key")).join(rooms, F.col("m_key").eqNullSafe(F.col("_key")))
    return matched.groupBy("m_key", "wanted").agg(F.count(F.lit(1)).alias("filled"))
