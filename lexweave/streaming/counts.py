"""Counts of terms over a stream of documents: the batch matching, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.tokens import Analyzer
from lexweave.operators.match import matches
from lexweave.operators.words import tokenized


def running_counts(stream: DataFrame, patterns: DataFrame, analyzer: Analyzer, **options) -> DataFrame:
    """stream: doc_id, segment, text. segment, pattern, cnt so far (output mode complete or update): matching is stateless,
    the state is one count for each segment and pattern."""
    return matches(tokenized(stream), patterns, analyzer, "segment", **options).groupBy("segment", "pattern").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(stream: DataFrame, patterns: DataFrame, analyzer: Analyzer, *, event_time: str, every: str, late: str, **options) -> DataFrame:
    """As running_counts for each window of event time; rows later than `late` are dropped and closed windows leave the
    state."""
    timed = stream.withWatermark(event_time, late)
    hits = matches(tokenized(timed, "segment", event_time), patterns, analyzer, "segment", event_time, **options)
    return hits.groupBy(F.window(event_time, every).alias("window"), "segment", "pattern").agg(F.count(F.lit(1)).alias("cnt"))
