"""Frequencies of terms: counts with zero rows, per million words, and the term by segment table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_counts(patterns: DataFrame, counts: DataFrame, segments: Sequence) -> DataFrame:
    """term_id, term, pattern, segment and cnt for every term and every named segment, 0 where there is no hit. Terms of
    one pattern each have its whole count; an empty pattern has 0."""
    named = F.explode(F.array(*(F.lit(s) for s in segments)))
    return patterns.select("term_id", "term", "pattern", named.alias("segment")).join(counts, ["segment", "pattern"], "left").select("term_id", "term", "pattern", "segment", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def per_million(counted: DataFrame, totals: DataFrame, norm_per: int = 1_000_000) -> DataFrame:
    """counted with ipm: cnt divided by the segment's total (at least 1), times norm_per."""
    denominators = totals.select("segment", F.greatest(F.lit(1), F.col("total")).alias("denom"))
    return counted.join(denominators, "segment", "left").withColumn("ipm", F.col("cnt") / F.coalesce("denom", F.lit(1)) * F.lit(norm_per)).drop("denom")


def dynamics(frequencies: DataFrame, segments: Sequence, names: Sequence[str] | None = None) -> DataFrame:
    """term_id, term, then for every segment its count, then for every segment its ipm (cnt_s and ipm_s, or the names
    given for each segment)."""
    names = names or [str(s) for s in segments]
    wide = frequencies.groupBy("term_id", "term").pivot("segment", list(segments)).agg(F.sum("cnt").alias("cnt"), F.sum("ipm").alias("ipm"))
    zero = lambda kind, to: [F.coalesce(F.col(f"`{s}_{kind}`"), F.lit(0)).cast(to).alias(f"{kind}_{name}") for s, name in zip(segments, names)]
    return wide.select("term_id", "term", *zero("cnt", "bigint"), *zero("ipm", "double"))


def numeric_or_zero(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as doubles; what is no number becomes 0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})
