"""The queries of the engine over the driver's tables. A segment is a document's language unless a name says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import normalize as N
from lexweave.functions.tokens import Analyzer, is_hyphen
from lexweave.operators import contexts as K
from lexweave.operators import match as M
from lexweave.operators import morphology as R
from lexweave.operators import preprocess as P
from lexweave.operators import spans as S
from lexweave.operators import stats as A
from lexweave.operators import words as W
from lexweave.operators.lexicon import Lexicon, compiled
from lexweave.operators.relational import merge_dataframes
from lexweave.plans import fixtures
from lexweave.sources.lists import parse_replacements, parse_stopwords, parse_terms

Query = Callable[[SparkSession, str], DataFrame]

ANALYZER = Analyzer(replacements={N.fold(k): N.fold(v) for k, v in fixtures.REPLACEMENTS.items()})
CAP, WINDOW = 5, 6

#: Terms whose contexts are asked for alone; the second one is not in the dictionary, so nothing is found for it.
CHOSEN = ("and the", "house", "El")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, segment: str = "lang") -> DataFrame:
    """doc_id, segment and text of the documents; the scan reads these columns only."""
    return W.spread(_table(spark, sf_dir, "documents").select("doc_id", F.col(segment).alias("segment"), "text"))


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*fixtures.TERMS], "term_id bigint, term string")


def patterns(spark: SparkSession) -> DataFrame:
    return W.term_patterns(terms(spark), ANALYZER)


def texts_of(spark: SparkSession, sf_dir: str, segment: str = "lang") -> DataFrame:
    return W.tokenized(documents(spark, sf_dir, segment))


def tokens_of(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return W.token_rows(texts_of(spark, sf_dir), ANALYZER, *keys)


def _normalized(function: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: W.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", function(F.col("text")).alias("text"))


def filter_latin_months_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemma filter over a text with a month name and short words added, so that each rule has something to do."""
    lemmas = F.split(F.concat(F.lit("мая клетка я он 3вук xiv "), N.replace_letters(F.col("text"))), r"\s+")
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.filter_lemmas(lemmas), " ").alias("words"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document without stop words: a logical anti-join, as a list that is part of the expression."""
    words = F.split(F.lower("text"), r"\s+")
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(words, lambda w: ~w.isin(*fixtures.STOPWORDS)), " ").alias("words"))


def preprocess_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = N.remove_special_chars(N.normalize_preprocess(F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(F.split(text, r"\s+"), lambda w: w != ""), " ").alias("words"))


def tokens_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.token_table(documents(spark, sf_dir), None, "doc_id")


def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokens_of(spark, sf_dir, "segment")
    return tokens.groupBy("segment", "pos").agg(F.count(F.lit(1)).alias("n"), F.count("lemma").alias("n_words"), F.count_if("inner_hyphen").alias("n_inner_hyphen"))


def pos_filter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemmas = F.filter(F.transform("tokens", lambda t: ANALYZER.lemma(t, ANALYZER.tagger(t))), lambda w: w.isNotNull())
    return texts_of(spark, sf_dir).select("doc_id", lemmas.alias("lemmas")).select("doc_id", F.size("lemmas").cast("bigint").alias("n_words"), F.array_join("lemmas", " ").alias("lemmas"))


def hyphen_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens_of(spark, sf_dir, "doc_id").where("lemma is not null and (hyph_left or hyph_right or inner_hyphen)")
    return words.select("doc_id", "tok_idx", "lemma", "hyph_left", "hyph_right", "inner_hyphen")


def lemma_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokens_of(spark, sf_dir, "segment")
    raw = ANALYZER.key(F.col("text"))
    return tokens.where(raw.isin(*ANALYZER.replacements) & F.col("lemma").isNotNull()).groupBy("segment", raw.alias("raw"), "lemma").agg(F.count(F.lit(1)).alias("n"))


def replacement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([*enumerate(fixtures.REPLACEMENT_LINES)], "line_no bigint, line string")
    return parse_replacements(lines)


def stopword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop list joined with a second one: here the languages of the documents."""
    lines = spark.createDataFrame([(i, f" {w} ") for i, w in enumerate((*fixtures.STOPWORDS, "", "the"))], "line_no bigint, line string")
    return parse_stopwords(lines, _table(spark, sf_dir, "documents").select(F.col("lang").alias("word")))


def parses(spark: SparkSession) -> DataFrame:
    """token, lemma and their parses, from the inline lexicon."""
    parse = lambda p: (p[0], p[1], p[2].split(), p[3])
    rows = [(i, token, lemma, [parse(p) for p in of_token], [parse(p) for p in of_lemma]) for i, (token, lemma, of_token, of_lemma) in enumerate(fixtures.PARSES)]
    return spark.createDataFrame(rows, f"id bigint, token string, lemma string, token_parses array<{R.PARSE}>, lemma_parses array<{R.PARSE}>")


def lemma_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parses(spark).select("id", R.correct_lemma(F.col("token"), F.col("lemma"), F.col("token_parses"), F.col("lemma_parses")).alias("lemma"))


def term_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns(spark).select("term_id", "term", "pattern", F.col("k").cast("int").alias("k"))


def terms_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.terms_by_pattern(patterns(spark))


def empty_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.empty_patterns(patterns(spark))


def read_terms_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_terms(spark.createDataFrame([*enumerate(fixtures.TERM_LINES)], "line_no bigint, line string"))


def _unigrams(**options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.count_hits(M.matches(texts_of(spark, sf_dir), patterns(spark).where("k = 1"), ANALYZER, "segment", **options), "segment")

    return query


def _kgrams(scope: str = "document", **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = documents(spark, sf_dir)
        done = W.tokenized(W.blocks(texts), "segment") if scope == "block" else W.tokenized(texts)
        return M.count_hits(M.matches(done, patterns(spark).where("k > 1"), ANALYZER, "segment", **options), "segment")

    return query


def distinct_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns(spark).where("pattern <> ''").select("pattern", F.col("k").cast("int").alias("k")).distinct()


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.word_totals(texts_of(spark, sf_dir), ANALYZER)


def total_words_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([*fixtures.TOTALS], "path string, fallback bigint, counted bigint")
    total = W.total_words(F.col("path"), F.col("fallback"), F.col("counted"))
    return rows.select("path", total.alias("total"), F.greatest(F.lit(1), total).cast("bigint").alias("denom"))


def frequencies(spark: SparkSession, sf_dir: str, segment: str = "lang", segments: Sequence[str] = fixtures.SEGMENTS) -> DataFrame:
    """Every term and segment with cnt and ipm."""
    known = patterns(spark)
    counts, totals = M.counts_and_totals(texts_of(spark, sf_dir, segment), known, ANALYZER)
    return A.per_million(A.term_counts(known, counts, segments), totals)


def term_ipm_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies(spark, sf_dir).select("term_id", "term", "segment", "cnt", "ipm")


def term_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dynamics(frequencies(spark, sf_dir), fixtures.SEGMENTS)


def term_dynamics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form, a row for each term and each source that the table has."""
    sources = [r[0] for r in _table(spark, sf_dir, "documents").where("source is not null").select("source").distinct().orderBy("source").collect()]  # columns of a report
    return frequencies(spark, sf_dir, "source", sources).select("term_id", "term", "segment", "cnt", "ipm")


def lexicon(spark: SparkSession) -> DataFrame:
    """The inline lexicon: form, pos, raw, parses."""
    rows = [(form, pos, raw, [(p[0], p[1], p[2].split(), p[3]) for p in own]) for form, pos, raw, own in fixtures.LEXICON]
    return compiled(spark.createDataFrame(rows, f"form string, pos string, raw string, parses array<{R.PARSE}>"))


def lemma_analyzer(spark: SparkSession) -> Analyzer:
    return Analyzer(replacements=ANALYZER.replacements, lexicon=Lexicon(lexicon(spark).select("form", "pos", "lemma")))


def lemma_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected lemma of every form of the lexicon."""
    return lexicon(spark).select("form", "pos", "lemma", F.size("lemma_parses").alias("n_parses"))


def lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of terms whose inflected forms have one lemma."""
    analyzer = lemma_analyzer(spark)
    known = W.term_patterns(spark.createDataFrame([*fixtures.LEMMA_TERMS], "term_id bigint, term string"), analyzer)
    counts, totals = M.counts_and_totals(texts_of(spark, sf_dir), known, analyzer)
    return A.per_million(A.term_counts(known, counts, fixtures.SEGMENTS), totals).select("term_id", "term", "pattern", "segment", "cnt", "ipm")


def lemmatize_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lemmas of each text under the three rules for proper nouns."""
    pos, lemma, own = F.col("pos"), F.col("lemma"), F.col("lemma_parses")
    rules = {
        "standard": R.lemmatize_standard(lemma, pos, own, ANALYZER.replacements),
        "titled": R.lemmatize_standard(lemma, pos, own, ANALYZER.replacements, skip_proper_nouns=False),
        "without_proper": R.lemmatize_without_proper(lemma, pos, own, ANALYZER.replacements),
    }
    lists = P.lemma_lists(documents(spark, sf_dir), lexicon(spark), ANALYZER, "doc_id", **rules)
    return lists.select("doc_id", *(F.array_join(name, " ").alias(name) for name in rules))


def _preprocessed(**options) -> Query:
    return lambda spark, sf_dir: P.preprocess(documents(spark, sf_dir), lexicon(spark), ANALYZER, **options).select("doc_id", F.array_join("words", " ").alias("words"))


def numeric_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of strings, 0 for what is none: the digits at the end of a page's address, and the address itself."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([0-9]*)$", 1).alias("tail"), "url")
    return A.numeric_or_zero(pages, "tail", "url")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matches(texts_of(spark, sf_dir), patterns(spark), ANALYZER, around=WINDOW)


def kwic_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.contexts(hits(spark, sf_dir), window=WINDOW, cap=CAP).select("segment", "pattern", "match_no", "doc_id", "first_tok", "last_tok")


def kwic_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.contexts(hits(spark, sf_dir), window=WINDOW, cap=CAP).select("segment", "pattern", "match_no", "surface", "context")


def kwic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.context_log(K.contexts(hits(spark, sf_dir), window=WINDOW, cap=CAP), W.terms_by_pattern(patterns(spark)))


def kwic_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the log: where each of its rows stands."""
    return K.with_place(kwic_log(spark, sf_dir)).select("segment", "pattern", "match_no", "place")


def kwic_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of chosen terms only."""
    chosen = W.term_patterns(spark.createDataFrame([*enumerate(CHOSEN)], "term_id bigint, term string"), ANALYZER)
    return K.contexts(K.of_terms(hits(spark, sf_dir), chosen), window=WINDOW, cap=CAP).select("segment", "pattern", "match_no", "surface", "context")


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tokenized(W.blocks(documents(spark, sf_dir)), "doc_id", "block_id", offsets=True)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.matches(blocks_of(spark, sf_dir), patterns(spark), ANALYZER, "doc_id", "block_id", spans=True)
    return S.hit_spans(found, "doc_id", "block_id")


def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(_spans(spark, sf_dir), "doc_id", "block_id")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = blocks_of(spark, sf_dir).select("doc_id", "block_id", F.col("norm").alias("text"))
    return S.runs(texts, merged_spans(spark, sf_dir), "doc_id", "block_id")


def highlight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def highlight_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markup(_runs(spark, sf_dir), "doc_id", "block_id")


DEBUG_TERM = "orre orre"


def debug_term_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.operators.debug import term_tokens

    return term_tokens(texts_of(spark, sf_dir), DEBUG_TERM, ANALYZER, window=WINDOW).select("doc_id", "tok_idx", "text", "lemma", "pos", "context")


def debug_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.operators.debug import term_hits

    return term_hits(texts_of(spark, sf_dir), DEBUG_TERM, ANALYZER).groupBy("doc_id").agg(F.count(F.lit(1)).alias("cnt"))


def left_merge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return merge_dataframes(left, _table(spark, sf_dir, "labels").withColumn("mark", F.lit("x")), "doc_id", "doc_id")


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size rule over paths of a whole table: the url of a page stands for the file name."""
    return _table(spark, sf_dir, "pages").select("page_id", W.total_words(F.regexp_replace("url", "/", "_"), F.lit(None).cast("bigint"), F.char_length("url")).alias("total"))


def hyphen_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone hyphens, by document: what makes a neighbour of a word a hyphen."""
    tokens = W.unnested(texts_of(spark, sf_dir), "tokens", "t", "doc_id")
    return tokens.where(is_hyphen(F.col("t"), ANALYZER.tagger)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Query] = {
    "normalize_letters": _normalized(N.replace_letters),
    "strip_invisible": _normalized(N.strip_invisible),
    "remove_accents": _normalized(N.remove_accents),
    "normalize_tokens": _normalized(N.normalize_tokens),
    "remove_chars": _normalized(lambda c: N.remove_chars(c, ".,!aeiou")),
    "remove_special": _normalized(N.remove_special_chars),
    "remove_special_soft": _normalized(N.remove_special_chars_soft),
    "filter_latin_months_short": filter_latin_months_short,
    "stopword_filter": stopword_filter,
    "preprocess_tokens": preprocess_tokens,
    "tokens_offsets": tokens_offsets,
    "token_flags": token_flags,
    "pos_filter_words": pos_filter_words,
    "hyphen_neighbors": hyphen_neighbors,
    "hyphen_tokens": hyphen_tokens,
    "lemma_replacements": lemma_replacements,
    "replacement_lines": replacement_lines,
    "stopword_lines": stopword_lines,
    "lemma_decision": lemma_decision,
    "term_patterns": term_patterns,
    "terms_by_pattern": terms_by_pattern,
    "empty_patterns": empty_patterns,
    "distinct_patterns": distinct_patterns,
    "read_terms_dedup": read_terms_dedup,
    "unigram_counts": _unigrams(),
    "unigram_counts_nohyphen": _unigrams(disallow_hyphen_adjacent_for_unigrams=True),
    "kgram_counts_strict": _kgrams(),
    "kgram_counts_soft": _kgrams(allow_punct_between=True),
    "kgram_counts_block": _kgrams("block"),
    "word_totals": word_totals,
    "total_words_priority": total_words_priority,
    "page_totals": page_totals,
    "term_ipm_long": term_ipm_long,
    "term_dynamics": term_dynamics,
    "term_dynamics_by_source": term_dynamics_by_source,
    "kwic_topn": kwic_topn,
    "kwic_window": kwic_window,
    "kwic_log": kwic_log,
    "kwic_places": kwic_places,
    "kwic_chosen": kwic_chosen,
    "lemma_table": lemma_table,
    "lemma_counts": lemma_counts,
    "lemmatize_lists": lemmatize_lists,
    "preprocess_standard": _preprocessed(stopwords=[N.fold(w) for w in fixtures.PREPROCESS_STOPWORDS]),
    "preprocess_minimal": _preprocessed(standard=False),
    "numeric_or_zero": numeric_or_zero,
    "highlight_spans": highlight_spans,
    "merged_spans": merged_spans,
    "highlight_runs": highlight_runs,
    "highlight_markup": highlight_markup,
    "debug_term_tokens": debug_term_tokens,
    "debug_term_counts": debug_term_counts,
    "left_merge_fill": left_merge_fill,
}
