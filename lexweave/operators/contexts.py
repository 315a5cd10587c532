"""Keyword in context: the first hits of each pattern with the tokens around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surface(win: Column, low: Column, first: Column, last: Column) -> Column:
    """The tokens from first to last, joined by spaces; win holds the tokens from low on."""
    return F.array_join(F.slice(win, first - low + 1, last - first + 1), " ")


def context(win: Column, low: Column, first: Column, last: Column, window: int) -> Column:
    """The tokens from window before first to window after last, clipped at the ends of the document."""
    left = F.greatest(first - window, F.lit(0))
    return F.array_join(F.slice(win, left - low + 1, last + window - left + 1), " ")


def contexts(hits: DataFrame, *, window: int = 6, cap: int = 20) -> DataFrame:
    """hits: segment, doc_id, pattern, k, first_tok, last_tok, and win and low with `window` tokens around. The first cap hits
    of each pattern of each segment, in the order of documents and tokens: match_no (from 1), surface, context.

    The rank is a window with a limit, so each task passes on no more than cap hits of a pattern; contexts are made of
    what is left.
    """
    order = Window.partitionBy("segment", "pattern").orderBy("doc_id", "first_tok", "last_tok")
    kept = hits.select("segment", "doc_id", "pattern", "k", "first_tok", "last_tok", "low", "win").withColumn("match_no", F.row_number().over(order)).where(F.col("match_no") <= cap)
    at = (F.col("win"), F.col("low"), F.col("first_tok"), F.col("last_tok"))
    return kept.withColumns({"surface": surface(*at), "context": context(*at, window)}).drop("win", "low")


def of_terms(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """The hits of chosen terms (chosen: pattern, as many as a person names)."""
    return hits.join(F.broadcast(chosen.select("pattern").distinct()), "pattern", "left_semi")


def context_log(found: DataFrame, terms: DataFrame) -> DataFrame:
    """found: contexts. terms: pattern, terms. The nine columns of the log; a pattern without terms stands for itself."""
    return found.join(terms, "pattern", "left").select(
        "segment", "doc_id", F.coalesce("terms", "pattern").alias("term"), "pattern", "match_no", "surface", "context", F.col("first_tok").alias("start_tok_idx"), F.col("last_tok").alias("end_tok_idx")
    )


def in_log_order(log: DataFrame) -> DataFrame:
    """Shorter patterns first, patterns by their first hit, hits by number. For a log that a person reads: a total sort."""
    return with_place(log).orderBy("segment", "place").drop("place")


def with_place(log: DataFrame) -> DataFrame:
    """log with place, the number (from 1) of a row in its segment's log, which holds no more than the cap of each pattern."""
    k = F.size(F.split("pattern", " "))
    first = F.min(F.struct("doc_id", "start_tok_idx")).over(Window.partitionBy("segment", "pattern"))
    order = Window.partitionBy("segment").orderBy("k_", "first_", "pattern", "match_no")
    return log.withColumns({"k_": k, "first_": first}).withColumn("place", F.row_number().over(order)).drop("k_", "first_")
