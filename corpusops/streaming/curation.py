"""Structured Streaming forms of the curation operators; the batch operators stay the definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.functions import text as T


def drop_contaminated(stream: DataFrame, prompt: str, reference_keys: DataFrame, key: str) -> DataFrame:
    """Leaves out rows of a stream whose question key equals a reference key (stream-static join). Rows without a question stay."""
    refs = reference_keys.select(F.col(key).alias("__key")).where("__key is not null").distinct().withColumn("__hit", F.lit(True))
    return stream.withColumn("__key", T.question_key(T.question_of(F.col(prompt)))).join(refs, "__key", "left").where("__hit is null").drop("__key", "__hit")


def drop_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Keeps the first arrival of each key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, window: str, delay: str, *groups: str) -> DataFrame:
    """Rows per event-time window and group; rows later than the delay are left out."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), *groups).agg(F.count("*").alias("n"))
