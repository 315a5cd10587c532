"""The whole preprocessing of texts: normalised, blanked, tokenised, reduced to lemmas and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.normalize import filter_lemmas, normalize_preprocess, remove_special_chars, split_words
from lexweave.functions.tokens import Analyzer, tokens
from lexweave.operators import morphology as R
from lexweave.operators.lexicon import MAX_BROADCAST


def lemma_lists(documents: DataFrame, parsed: DataFrame, analyzer: Analyzer, key: str, **lemmas: Column) -> DataFrame:
    """documents: key, text. parsed: what lexicon.compiled gives. key and, for each name of lemmas (a column over pos, lemma
    and lemma_parses, null: left out), the array of a text's lemmas in order.

    Distinct forms are joined to tokens; a text's lemmas meet by its key, as they are one value of the result.
    """
    texts = documents.select(key, remove_special_chars(normalize_preprocess(F.coalesce("text", F.lit("")))).alias("norm"))
    rows = texts.select(key, F.posexplode_outer(tokens(F.col("norm"))).alias("tok_idx", "token"))
    forms = parsed.select("form", F.struct(F.col("pos").alias("known_pos"), "lemma", "lemma_parses").alias("known"))
    small = forms.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    found = rows.join(F.broadcast(forms) if small else forms, analyzer.key(F.col("token")) == F.col("form"), "left")
    # a token that the lexicon does not list has no parse, so every rule leaves it out
    placed = found.select(key, "tok_idx", F.coalesce("known.known_pos", analyzer.tagger(F.col("token"))).alias("pos"), "known.lemma", "known.lemma_parses")
    named = placed.select(key, "tok_idx", *(column.alias(name) for name, column in lemmas.items()))
    lists = named.groupBy(key).agg(*(F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("tok_idx", F.col(name).alias("lemma"))))).alias(name) for name in lemmas))
    return lists.select(key, *(F.transform(name, lambda w: w["lemma"]).alias(name) for name in lemmas))


def preprocess(documents: DataFrame, parsed: DataFrame, analyzer: Analyzer, key: str = "doc_id", *, stopwords: list[str] | None = None, standard: bool = True, skip_proper_nouns: bool = True) -> DataFrame:
    """key and words. The standard profile drops proper nouns, months, Latin and short words and stop words; the other
    one drops proper nouns only."""
    pos, lemma, parses = F.col("pos"), F.col("lemma"), F.col("lemma_parses")
    if standard:
        done = lemma_lists(documents, parsed, analyzer, key, lemmas=R.lemmatize_standard(lemma, pos, parses, analyzer.replacements, skip_proper_nouns=skip_proper_nouns))
        return done.select(key, filter_lemmas(F.col("lemmas"), stopwords).alias("words"))
    done = lemma_lists(documents, parsed, analyzer, key, lemmas=R.lemmatize_without_proper(lemma, pos, parses, analyzer.replacements))
    return done.select(key, split_words(F.array_join("lemmas", " ")).alias("words"))
