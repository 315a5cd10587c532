"""Why a term is found or not: its pattern, the tokens that look like it, its hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.tokens import Analyzer
from lexweave.operators.contexts import context, contexts
from lexweave.operators.match import MAX_BROADCAST, MAX_FIRST_FORMS, matches
from lexweave.operators.words import indices, term_patterns, tokenized

#: Letters of the first lemma that a token has to show, and contexts of a report.
LOOKED_FOR, SHOWN = 5, 10


@dataclass(frozen=True)
class DebugReport:
    """What the debug mode prints, as values and small DataFrames. hits is None for a term without a pattern."""

    term: str
    pattern: str
    k: int
    replacement: str | None
    tokens: DataFrame
    hits: DataFrame | None
    count: int


def pattern_of(texts: DataFrame, term: str, analyzer: Analyzer) -> tuple[str, int]:
    """The pattern of one term and its length: a single row."""
    one = texts.sparkSession.createDataFrame([(0, term)], "term_id bigint, term string")
    row = term_patterns(one, analyzer).first()
    return row["pattern"], row["k"]


def term_tokens(texts: DataFrame, term: str, analyzer: Analyzer, *, window: int = 6) -> DataFrame:
    """texts: tokenized. Every token whose lower-case text or lemma holds the first letters of the term's first lemma (all
    tokens if it has none), with its context. Lemmas are those of distinct tokens; only such tokens leave a text."""
    part = pattern_of(texts, term, analyzer)[0].split(" ")[0][:LOOKED_FOR]
    distinct = texts.select(F.explode_outer(F.array_distinct("tokens")).alias("text")).where("text is not null").distinct()
    known = analyzer.with_lemmas(distinct, known="text").select("text", "known.pos", "known.lemma")
    alike = known.where(F.lower("text").contains(part) | F.lower(F.coalesce("lemma", F.lit(""))).contains(part))
    n = alike.count()
    found = indices(F.size("tokens"))
    if n <= MAX_FIRST_FORMS:
        forms = [r["text"] for r in alike.select("text").collect()]  # MAX_FIRST_FORMS at most
        found = F.filter(found, lambda i: F.get("tokens", i).isin(forms))
    shown = F.transform(found, lambda i: F.struct(i.alias("tok_idx"), F.get("tokens", i).alias("token"), context(F.col("tokens"), F.lit(0), i, i, window).alias("context")))
    rows = texts.select("doc_id", F.explode_outer(shown).alias("t")).where("t is not null").select("doc_id", "t.*")
    return rows.join(F.broadcast(alike) if n <= MAX_BROADCAST else alike, F.col("token") == F.col("text")).select("doc_id", "tok_idx", "text", "lemma", "pos", "context")


def term_hits(texts: DataFrame, term: str, analyzer: Analyzer, **options) -> DataFrame:
    pattern, k = pattern_of(texts, term, analyzer)
    one = texts.sparkSession.createDataFrame([(pattern, k)], "pattern string, k int")
    return matches(texts, one, analyzer, **options)


def debug_term(spark, term: str, text: str, analyzer: Analyzer, *, allow_punct_between: bool = False, disallow_hyphen_adjacent_for_unigrams: bool = False, window: int = 6) -> DebugReport:
    """The report of one term over one text."""
    texts = tokenized(spark.createDataFrame([(0, 0, text)], "doc_id bigint, segment int, text string"))
    pattern, k = pattern_of(texts, term, analyzer)
    found, count = None, 0
    if pattern:
        hits = term_hits(texts, term, analyzer, allow_punct_between=allow_punct_between, disallow_hyphen_adjacent_for_unigrams=disallow_hyphen_adjacent_for_unigrams, around=window)
        found, count = contexts(hits, window=window, cap=SHOWN), hits.count()
    return DebugReport(term, pattern, k, analyzer.replacements.get(term.lower()), term_tokens(texts, term, analyzer, window=window), found, count)
