"""Matching of word patterns: every k-gram of lemmas, overlapping ones too, against a dictionary of patterns.

A text is looked through once for tokens that can begin a pattern; only these leave the row, each with the few tokens
after it. Lemmas, patterns and the rest are made of these small rows, in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.tokens import Analyzer, has_inner_hyphen, is_hyphen
from lexweave.operators.words import indices, piece_start

#: Patterns that are broadcast (some 100 bytes each), and forms of first words that are sought in texts; with more, every
#: token is tried.
MAX_BROADCAST, MAX_FIRST_FORMS = 1_000_000, 20_000

#: The pattern of rows that count the words of a text: no dictionary has it.
TOTAL = ""


def _starts(analyzer: Analyzer, longest: int, forms: list[str] | None, soft: bool, around: int, spans: bool) -> Column:
    """array<struct<at, low, win, start, ends>> of the tokens that can begin a pattern: the indices of the tokens of the
    longest gram from there, the tokens from low on that surround them, and code points, if spans are asked for."""
    tokens, n = F.col("tokens"), F.size("tokens")
    first = (lambda i: F.get("open", i)) if soft else (lambda i: i)
    begin = indices(F.size("open") if soft else n)
    if forms is not None:
        begin = F.filter(begin, lambda i: analyzer.key(F.get(tokens, first(i))).isin(forms))

    def one(i: Column) -> Column:
        at = F.slice("open", i + 1, F.lit(longest)) if soft else F.sequence(i, F.least(i + longest - 1, n - 1))
        low = F.greatest(first(i) - around, F.lit(0))
        win = F.slice(tokens, low + 1, F.element_at(at, -1) + around - low + 1)
        where = [F.lit(None).cast("int"), F.lit(None).cast("array<int>")]
        if spans:
            where = [piece_start(F.get("at", first(i))), F.transform(at, lambda q: piece_start(F.get("at", q)) + F.char_length(F.get(tokens, q)))]
        return F.struct(at.alias("at"), low.alias("low"), win.alias("win"), where[0].alias("start"), where[1].alias("ends"))

    return F.transform(begin, one)


def _open(analyzer: Analyzer) -> Column:
    """Indices of the tokens that are no punctuation."""
    return F.filter(indices(F.size("tokens")), lambda i: analyzer.tagger(F.get("tokens", i)) != "PUNCT")


def _words(analyzer: Analyzer) -> Column:
    """The number of words of a text, if tokens are tagged without a lexicon."""
    return F.size(F.filter("tokens", lambda t: analyzer.is_word(t, analyzer.tagger(t))))


def matches(
    texts: DataFrame,
    patterns: DataFrame,
    analyzer: Analyzer,
    *carry: str,
    allow_punct_between: bool = False,
    disallow_hyphen_adjacent_for_unigrams: bool = False,
    max_broadcast: int = MAX_BROADCAST,
    around: int = 0,
    spans: bool = False,
    totals: bool = False,
) -> DataFrame:
    """texts: tokenized (with offsets, if spans are asked for). patterns: pattern, k. The hits: carry (doc_id and segment if
    none is named), k, pattern, first_tok, last_tok, low and win (the tokens from low on, with `around` more on both
    sides), start and end (code points, if spans are asked for), weight (1).

    With totals (not with a lexicon) there is a row of pattern TOTAL and k 0 for each text, of its number of words as
    weight, so that one pass gives hits and totals. The dictionary is counted first: up to max_broadcast patterns are
    broadcast, more are joined by shuffle.
    """
    carry = carry or ("doc_id", "segment")
    distinct = patterns.where(F.col("pattern") != TOTAL).select("pattern", F.col("k").cast("int").alias("k")).distinct()
    known = [tuple(r) for r in distinct.limit(MAX_FIRST_FORMS + 1).collect()]
    forms: list[str] | None = None
    if len(known) <= MAX_FIRST_FORMS:  # a small dictionary is made once, not in each stage that asks for it
        distinct, size, ks = texts.sparkSession.createDataFrame(known, distinct.schema), len(known), sorted({k for _, k in known})
        first = {pattern.split(" ")[0] for pattern, _ in known}
        if not any(" " in v for v in analyzer.replacements.values()) and all(first):
            forms = analyzer.surfaces(sorted(first), MAX_FIRST_FORMS) if known else []
    else:
        counted = distinct.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length
        size, ks = sum(r["n"] for r in counted), sorted(r["k"] for r in counted)
    longest = max(ks, default=1)
    reach = max(1, around)
    opened = texts.withColumn("open", _open(analyzer)) if allow_punct_between else texts
    begin = _starts(analyzer, longest, forms, allow_punct_between, reach, spans)
    n_words = _words(analyzer) if totals else F.lit(0)
    # made before the explode, which would else copy the whole text to each of its rows
    made = opened.select(*carry, n_words.cast("bigint").alias("_n_words"), begin.alias("_starts"))
    rows = made.select(*carry, "_n_words", F.posexplode_outer("_starts").alias("_nr", "_s"))
    rows = rows.select(*carry, F.when(F.coalesce("_nr", F.lit(0)) == 0, F.col("_n_words")).alias("_n_words"), "_s")
    if not totals:
        rows = rows.where("_s is not null")
    at, low, win, ends = (F.col(f"_s.{name}") for name in ("at", "low", "win", "ends"))
    named = rows.withColumns({f"_t{j}": F.get(win, F.get(at, F.lit(j)) - low) for j in range(longest)})
    lemmas = analyzer.with_lemmas(named, **{f"_w{j}": f"_t{j}" for j in range(longest)})
    lemma = lambda j: F.col(f"_w{j}.lemma")
    here = F.get(at, F.lit(0)) - low
    hyphen = is_hyphen(F.get(win, here - 1), analyzer.tagger) | is_hyphen(F.get(win, here + 1), analyzer.tagger) | has_inner_hyphen(F.col("_t0"))

    def gram(k: int) -> Column:
        whole = lemma(0).isNotNull()
        for j in range(1, k):
            whole = whole & lemma(j).isNotNull()
        if k == 1 and disallow_hyphen_adjacent_for_unigrams:
            whole = whole & ~hyphen
        pattern = F.concat_ws(" ", *(lemma(j) for j in range(k)))
        return F.when(whole, F.struct(F.lit(k).alias("k"), pattern.alias("pattern"), F.get(at, F.lit(k - 1)).alias("last_tok"), F.get(ends, F.lit(k - 1)).alias("end"), F.lit(1).cast("bigint").alias("weight")))

    none = F.lit(None).cast("int")
    grams = [gram(k) for k in ks]
    if totals:
        grams.append(F.when(F.col("_n_words").isNotNull(), F.struct(F.lit(0).alias("k"), F.lit(TOTAL).alias("pattern"), none.alias("last_tok"), none.alias("end"), F.col("_n_words").alias("weight"))))
        distinct = distinct.unionByName(texts.sparkSession.createDataFrame([(TOTAL, 0)], "pattern string, k int"))
    if not grams:
        grams = [F.when(F.lit(False), F.struct(F.lit(0).alias("k"), F.lit(TOTAL).alias("pattern"), none.alias("last_tok"), none.alias("end"), F.lit(1).cast("bigint").alias("weight")))]
    found = lemmas.select(*carry, "_s", F.explode_outer(F.array(*grams)).alias("_g")).where("_g is not null")
    hits = found.select(*carry, "_g.k", "_g.pattern", F.get(at, F.lit(0)).alias("first_tok"), "_g.last_tok", "_s.low", "_s.win", "_s.start", "_g.end", "_g.weight")
    return hits.join(F.broadcast(distinct) if size <= max_broadcast else distinct, ["k", "pattern"], "left_semi").select(*carry, "k", "pattern", "first_tok", "last_tok", "low", "win", "start", "end", "weight")


def count_hits(hits: DataFrame, *by: str) -> DataFrame:
    """by, pattern and cnt."""
    return hits.groupBy(*by, "pattern").agg(F.count(F.lit(1)).alias("cnt"))


def counts_and_totals(texts: DataFrame, patterns: DataFrame, analyzer: Analyzer, **options) -> tuple[DataFrame, DataFrame]:
    """texts: tokenized, with segment. (segment, pattern, cnt) of all hits, and (segment, total) of all words, from one pass
    over the texts and one shuffle of sums; with a lexicon, totals need a pass of their own."""
    from lexweave.operators.words import word_totals

    if analyzer.lexicon is not None:
        return count_hits(matches(texts, patterns, analyzer, "segment", **options), "segment"), word_totals(texts, analyzer)
    rows = matches(texts, patterns, analyzer, "segment", totals=True, **options)
    # what tells totals from hits is an aggregate too: a filter on it stays above the shuffle that both share
    summed = rows.groupBy("segment", F.coalesce("pattern", F.lit(TOTAL)).alias("pattern")).agg(F.sum("weight").alias("cnt"), F.max("k").alias("k"))
    totals = summed.where("k = 0").select("segment", F.greatest(F.lit(1), F.col("cnt")).cast("bigint").alias("total"))
    return summed.where("k > 0").select("segment", "pattern", "cnt"), totals
