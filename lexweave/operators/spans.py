"""Spans of hits: character positions, merging, gaps, and alternating runs of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_spans(hits: DataFrame, *keys: str) -> DataFrame:
    """hits: matches with spans. keys, start, end: from the first code point of the first token to behind the last token."""
    return hits.select(*keys, "start", "end")


def merge_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans of each key that touch or overlap as one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (before.isNull() | (F.col("start") > before)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def runs(texts: DataFrame, merged: DataFrame, *keys: str) -> DataFrame:
    """texts: keys, text. merged: spans of merge_spans. keys, run_idx, text, is_term: the text cut at its spans; empty
    plain runs are left out, and a text without spans is one plain run."""
    order = Window.partitionBy(*keys).orderBy("start")
    placed = merged.withColumn("_from", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("_last", F.lead("start").over(order).isNull())
    joined = texts.join(placed, list(keys), "left").withColumn("_n", F.char_length("text"))
    run = lambda a, b, term: F.struct(a.alias("a"), b.alias("b"), F.lit(term).alias("is_term"))
    plain = run(F.lit(0), F.col("_n"), False)
    own = F.array(run(F.col("_from"), F.col("start"), False), run(F.col("start"), F.col("end"), True))
    tail = F.when(F.col("_last"), F.array(run(F.col("end"), F.col("_n"), False))).otherwise(F.array().cast("array<struct<a:int,b:int,is_term:boolean>>"))
    all_runs = F.when(F.col("start").isNull(), F.array(plain)).otherwise(F.concat(own, tail))
    cut = joined.select(*keys, "text", F.explode(F.filter(all_runs, lambda r: r["b"] > r["a"])).alias("r"))
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy("r.a")) - 1
    return cut.select(*keys, numbered.alias("run_idx"), F.substring("text", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("text"), F.col("r.is_term").alias("is_term"))


def markup(cut: DataFrame, *keys: str, before: str = "<mark>", after: str = "</mark>") -> DataFrame:
    """keys and text: the runs put together, terms between before and after."""
    shown = F.when(F.col("is_term"), F.concat(F.lit(before), F.col("text"), F.lit(after))).otherwise(F.col("text"))
    return cut.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", shown.alias("shown")))), lambda r: r["shown"]), "").alias("text"))
