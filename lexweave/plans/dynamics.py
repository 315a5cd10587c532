"""The full run: a dictionary over segments of documents, to frequencies, context logs and highlighted copies."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.config import EngineConfig
from lexweave.functions.tokens import Analyzer
from lexweave.operators import contexts as K
from lexweave.operators import match as M
from lexweave.operators import stats as A
from lexweave.operators import words as W
from lexweave.operators.lexicon import read_lexicon
from lexweave.sources import sinks
from lexweave.sources.lists import read_replacements
from lexweave.sources.readers import read_segments, read_terms


@dataclass(frozen=True)
class Dynamics:
    """Results of a run, lazily: patterns of the terms, frequencies (long), table (wide) and the context log."""

    patterns: DataFrame
    hits: DataFrame
    totals: DataFrame
    frequencies: DataFrame
    table: DataFrame
    log: DataFrame
    empty_patterns: DataFrame


def term_dynamics(documents: DataFrame, terms: DataFrame, config: EngineConfig, analyzer: Analyzer | None = None) -> Dynamics:
    """documents: segment, doc_id, text and, if segments have files, path. terms: term_id, term.

    Counts and totals come from one pass over the texts and one shuffle of sums; contexts are made of the few hits that a
    second pass finds to be the first of their pattern.
    """
    analyzer = analyzer or Analyzer()
    patterns = W.term_patterns(terms, analyzer)
    texts = W.tokenized(documents)
    options = {"allow_punct_between": config.allow_punct_between, "disallow_hyphen_adjacent_for_unigrams": config.disallow_hyphen_adjacent_for_unigrams, "max_broadcast": config.max_broadcast_patterns}
    counts, words = M.counts_and_totals(texts, patterns, analyzer, **options)
    hits = M.matches(texts, patterns, analyzer, around=config.context_window, **options)
    totals = segment_totals(documents, words, config)
    counted = A.term_counts(patterns, counts, config.segments)
    frequencies = A.per_million(counted, totals, config.norm_per)
    logged = hits
    if not config.debug_all_terms:
        chosen = documents.sparkSession.createDataFrame([*enumerate(config.debug_terms)], "term_id bigint, term string")
        logged = K.of_terms(hits, W.term_patterns(chosen, analyzer))
    found = K.contexts(logged, window=config.context_window, cap=config.max_contexts_per_term)
    log = K.context_log(found, W.terms_by_pattern(patterns))
    return Dynamics(patterns, hits, totals, frequencies, A.dynamics(frequencies, config.segments), log, W.empty_patterns(patterns))


def segment_totals(documents: DataFrame, counted: DataFrame, config: EngineConfig) -> DataFrame:
    """segment and total: from the file's name, else the fallback of the config, else the words counted."""
    if "path" not in documents.columns:
        paths = counted.select("segment", F.lit("").alias("path"))
    else:
        paths = documents.groupBy("segment").agg(F.first("path").alias("path"))
    fallback = F.lit(None).cast("bigint")
    for segment, total in config.fallback_totals.items():
        fallback = F.when(F.col("segment") == F.lit(segment), F.lit(total).cast("bigint")).otherwise(fallback)
    joined = counted.withColumnRenamed("total", "counted").join(paths, "segment", "left")
    return joined.select("segment", W.total_words(F.coalesce("path", F.lit("")), fallback, F.col("counted")).alias("total"))


def analyzer_of(spark: SparkSession, config: EngineConfig) -> Analyzer:
    """The analyzer that a config names: its replacements and its lexicon."""
    replacements = read_replacements(spark, config.replacements) if config.replacements else {}
    return Analyzer(replacements=replacements, lexicon=read_lexicon(spark, config.lexicon) if config.lexicon else None)


def run(spark: SparkSession, config: EngineConfig, analyzer: Analyzer | None = None) -> Dynamics:
    """Everything a config names, with the files of the output folder written if it names one. Missing files stop the run
    before anything is computed."""
    if problems := config.problems():
        raise FileNotFoundError("; ".join(problems))
    if analyzer is None:
        analyzer = analyzer_of(spark, config)
    paths = {s: config.documents[s] for s in config.segments}
    result = term_dynamics(read_segments(spark, paths), read_terms(spark, config.dictionary), config, analyzer)
    if config.output:
        folder = Path(config.output)
        sinks.write_xlsx(sinks.result_table(result.table, config.segments), str(folder / "dynamics.xlsx"), config.segments)
        sinks.write_context_logs(result.log, str(folder), config.segments)
        word_files = [p for p in paths.values() if p.lower().endswith(".docx")]
        if word_files:
            options = {"allow_punct_between": config.allow_punct_between, "disallow_hyphen_adjacent_for_unigrams": config.disallow_hyphen_adjacent_for_unigrams}
            sinks.write_highlighted(sinks.annotated_docx(spark, result.patterns, analyzer, *word_files, **options), str(folder))
    return result
