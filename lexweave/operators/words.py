"""Documents to tokens, words and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.normalize import normalize_tokens
from lexweave.functions.tokens import PIECE, TOKEN, Analyzer, has_inner_hyphen, is_hyphen


#: Pieces of a text whose lengths are added up once for all of them.
GROUP_BITS = 6
GROUP = 1 << GROUP_BITS


def blocks(documents: DataFrame) -> DataFrame:
    """A row for each line of a text: doc_id, segment, block_id, text. Phrases do not cross blocks."""
    return documents.select("doc_id", "segment", F.posexplode(F.split("text", "\n")).alias("block_id", "text"))


def unnested(df: DataFrame, array: str | Column, name: str, *carry: str | Column) -> DataFrame:
    """carry and each element of an array that has no null elements. The outer form: for the plain one the optimizer adds
    a filter on the array's size below, which would compute a derived array again."""
    return df.select(*carry, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer partitions than there are, as a small table in one file does. A large input
    has more and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def tokenized(documents: DataFrame, *keys: str, offsets: bool = False) -> DataFrame:
    """keys (doc_id and segment if none are named), norm (normalised text) and tokens of each text. With offsets also
    pieces, which tile norm, at, the piece of each token, and starts, the code points before each group of GROUP pieces.
    Narrow: one row in, one row out.

    An array that a lambda looks into is named twice wherever it is used, else the optimizer would move the making of the
    array into the lambda.
    """
    keys = keys or ("doc_id", "segment")
    normalized = documents.select(*keys, normalize_tokens(F.coalesce("text", F.lit(""))).alias("norm"))
    if not offsets:
        return normalized.withColumn("tokens", F.regexp_extract_all("norm", F.lit(TOKEN), 0))
    cut = normalized.withColumn("pieces", F.regexp_extract_all("norm", F.lit(PIECE), 0))
    placed = cut.withColumn("at", F.filter(indices(F.size("pieces")), lambda i: F.get("pieces", i).rlike(r"\S")))
    sizes = F.transform(indices(F.shiftright(F.size("pieces"), GROUP_BITS) + 1), lambda g: F.char_length(F.array_join(F.slice("pieces", F.shiftleft(g, GROUP_BITS) + 1, F.lit(GROUP)), "")))
    grouped = placed.withColumn("tokens", F.transform("at", lambda i: F.get("pieces", i))).withColumn("sizes", sizes)
    before = lambda g: F.aggregate(F.slice("sizes", F.lit(1), g), F.lit(0), lambda total, n: total + n)
    return grouped.withColumn("starts", F.transform(indices(F.size("sizes")), before)).drop("sizes")


def piece_start(i: Column) -> Column:
    """Code points before piece i of a text with offsets: those before its group and those before it in the group."""
    return F.get("starts", F.shiftright(i, GROUP_BITS)) + F.char_length(F.array_join(F.slice("pieces", i.bitwiseAND(~(GROUP - 1)) + 1, i.bitwiseAND(GROUP - 1)), ""))


def indices(n: Column) -> Column:
    """array<int> of 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def token_rows(texts: DataFrame, analyzer: Analyzer, *keys: str) -> DataFrame:
    """texts: tokenized. A row for each token: keys, tok_idx, text, pos, lemma (null: no word), hyph_left, hyph_right (a lone
    hyphen stands next to it), inner_hyphen. Neighbours come with the token, so no row has to look for them."""
    around = F.arrays_zip(F.col("tokens").alias("text"), F.concat(F.array(F.lit(None).cast("string")), "tokens").alias("before"), F.slice("tokens", F.lit(2), F.size("tokens") + 1).alias("after"))
    rows = texts.select(*keys, F.posexplode_outer(around).alias("tok_idx", "t")).select(*keys, "tok_idx", "t.*").where("text is not null")
    known = analyzer.with_lemmas(rows, known="text")
    return known.select(*keys, "tok_idx", "text", "known.pos", "known.lemma", is_hyphen(F.col("before"), analyzer.tagger).alias("hyph_left"), is_hyphen(F.col("after"), analyzer.tagger).alias("hyph_right"), has_inner_hyphen(F.col("text")).alias("inner_hyphen"))


def token_table(documents: DataFrame, analyzer: Analyzer | None = None, *keys: str) -> DataFrame:
    """A row for each token: keys, tok_idx, text, start and end (code points of the normalised text, end exclusive) and,
    with an analyzer, pos, lemma and has_inner_hyphen. Narrow: the offsets of a document are sums of its own lengths."""
    keys = keys or ("doc_id", "segment")
    texts = tokenized(documents, *keys, offsets=True)
    zipped = F.arrays_zip(F.col("tokens").alias("text"), F.transform("at", piece_start).alias("start"))
    rows = texts.select(*keys, F.posexplode_outer(zipped).alias("tok_idx", "t")).select(*keys, "tok_idx", "t.*").where("text is not null")
    out = rows.withColumn("end", F.col("start") + F.char_length("text"))
    if analyzer is None:
        return out
    known = analyzer.with_lemmas(out, known="text")
    return known.select(*out.columns, "known.pos", "known.lemma", has_inner_hyphen(F.col("text")).alias("has_inner_hyphen"))


def word_counts(texts: DataFrame) -> DataFrame:
    """texts: tokenized, with segment. segment, text, n: how often each distinct token occurs."""
    return unnested(texts, "tokens", "text", "segment").groupBy("segment", "text").agg(F.count(F.lit(1)).alias("n"))


def term_patterns(terms: DataFrame, analyzer: Analyzer) -> DataFrame:
    """terms: term_id, term. Adds lemmas, pattern (lemmas joined by spaces, maybe empty) and k, their number. Tokens that
    are no words vanish, so a term with a preposition has a pattern that its own surface form cannot match."""
    rows = token_rows(tokenized(terms.withColumn("text", F.col("term")), "term_id", "term"), analyzer, "term_id", "term").where("lemma is not null")
    own = rows.groupBy("term_id", "term").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "lemma"))).alias("found"))
    none = F.array().cast("array<string>")
    lemmas = terms.join(own.withColumnRenamed("term", "_term").withColumnRenamed("term_id", "_id"), F.col("term_id").eqNullSafe(F.col("_id")) & F.col("term").eqNullSafe(F.col("_term")), "left")
    named = lemmas.select("term_id", "term", F.coalesce(F.transform("found", lambda w: w["lemma"]), none).alias("lemmas"))
    return named.withColumn("pattern", F.array_join("lemmas", " ")).withColumn("k", F.size("lemmas"))


def terms_by_pattern(patterns: DataFrame) -> DataFrame:
    """pattern and its terms in dictionary order, joined by ' | '."""
    ordered = F.sort_array(F.collect_list(F.struct("term_id", "term")))
    return patterns.where("pattern <> ''").groupBy("pattern").agg(F.array_join(F.transform(ordered, lambda t: t["term"]), " | ").alias("terms"))


def empty_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.count_if(F.col("pattern") == "").alias("empty_patterns"))


def word_totals(texts: DataFrame, analyzer: Analyzer) -> DataFrame:
    """texts: tokenized, with segment. segment and total: the number of words, at least 1. Distinct tokens are counted before
    they are tagged."""
    known = analyzer.with_lemmas(word_counts(texts), known="text")
    counted = known.groupBy("segment").agg(F.sum(F.when(F.col("known.lemma").isNotNull(), F.col("n"))).alias("total"))
    everywhere = texts.select("segment").distinct().withColumnRenamed("segment", "_segment")
    return everywhere.join(counted, F.col("_segment").eqNullSafe(F.col("segment")), "left").select(F.col("_segment").alias("segment"), F.greatest(F.lit(1), F.coalesce("total", F.lit(0))).cast("bigint").alias("total"))


def total_words(path: Column, fallback: Column, counted: Column) -> Column:
    """Words of a segment: the number at the end of its file name, else a fallback that is not 0, else the count."""
    named = F.nullif(F.regexp_extract(path, r"(?U)_(\d+)(?:\.\w+)?$", 1), F.lit("")).try_cast("bigint")
    return F.coalesce(named, F.nullif(fallback, F.lit(0)), F.greatest(F.lit(1), counted)).cast("bigint")
