"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets a few statistics of its whole text. Their distribution is kept, for each language and source,
in a log-bucket quantile sketch: a value falls in bucket ceil(log(value) / log(GAMMA)), and a sketch is the count
of each bucket. Sketches merge by adding counts, so they are built by partial aggregation; merging the sources of
a language gives the sketch of the language, and merging languages that of the corpus. A quantile is exact to
within GAMMA. Thresholds are fences around the quartiles of a group, so they follow each source; the quartiles are
drawn towards those of the language, and these towards the corpus's, by the weight of PRIOR documents, so a small
group has its language's fences and a growing one comes to its own without a step. Documents outside a fence, or that fail the base
rules, go.

Edge cases: a null text has no words and fails the base rules; a null language or source is a group of its own;
ties fall in one bucket; an empty table gives empty results; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexweave.llm.common import ROW, field_of, map_batches, whole_row, written

#: Ratio of neighbouring buckets: quantiles are exact to 2 %.
GAMMA = 1.02

#: Documents that the group above counts for in the quartiles of a group.
PRIOR = 50

#: Groups whose thresholds are broadcast, at most (some 100 bytes each); beyond, Spark joins them by shuffle.
MAX_BROADCAST_GROUPS = 100_000

#: Rules: statistic, side, width of the fence in inter-quartile ranges, and the least distance from the quartile
#: (as a part of it, and absolute), which keeps a group of nearly equal documents from rejecting its own.
RULES = (
    ("symbols", "high", 6.0, 0.5, 0.10),
    ("repeats", "high", 6.0, 0.5, 0.35),
    ("word_length", "high", 6.0, 0.6, 1.0),
    ("word_length", "low", 6.0, 0.5, 1.0),
    ("upper", "high", 6.0, 0.5, 0.25),
)

STATS = ("symbols", "repeats", "word_length", "upper")

SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(c for c in range(256) if c not in SYMBOLS)
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_ASCII_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUATION))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    found = end = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            found += i + 3 - max(i, end)
            end = i + 3
    return found


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, letters (ASCII), capitals (ASCII)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # in bytes: exactly space and \x09-\x0D
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    return (
        len(words),
        code_points(b"".join(words)),
        len(data.translate(None, _OTHERS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(data.translate(None, _ASCII_LETTERS)),
        len(data.translate(None, _UPPER)),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")


def with_measures(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns named by keep and the measures of each row's text, which is part of ROW if that is kept."""
    source = documents.select(*keep, *(["text"] if ROW not in keep else []))
    schema = StructType([*documents.select(*keep).schema, *(StructField(m, LongType()) for m in MEASURES)])

    def measure(batches):
        for batch in batches:
            rows = [measures(text) for text in (field_of(batch, "text") if ROW in keep else batch.column("text")).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *MEASURES])

    return map_batches(source, measure, schema)


def statistics() -> dict[str, Column]:
    """The statistics that the rules look at, from the measures."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "upper": F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1)).cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame, *, gamma: float = GAMMA) -> DataFrame:
    """(lang, source, stat, bucket, n): the quantile sketch of each statistic in each group. Bucket null: the value 0.

    Documents that fail the base rules are left out: they go anyway and would widen the fences.
    """
    stats = F.array(*(F.struct(F.lit(name).alias("stat"), value.alias("value")) for name, value in statistics().items()))
    one = measured.where(~base_failed()).select("lang", "source", F.explode(stats).alias("s"))
    bucket = F.when(F.col("s.value") > 0, F.ceil(F.log(F.col("s.value")) / F.log(F.lit(gamma))))
    return one.groupBy("lang", "source", F.col("s.stat").alias("stat"), bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, *by: str, gamma: float = GAMMA) -> DataFrame:
    """by, stat, size, q25, q50, q75: quartiles of merged sketches, as the middle of the bucket that holds the rank."""
    merged = sketch.groupBy(*by, "stat", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "stat")
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(gamma), F.col("bucket") - F.lit(0.5)))
    ranked = merged.select(*by, "stat", value.alias("value"), F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket"))).alias("below"), F.sum("n").over(group).alias("size"))
    at = lambda q: F.min(F.when(F.col("below") >= F.ceil(F.col("size") * q), F.col("value")))
    return ranked.groupBy(*by, "stat").agg(F.max("size").alias("size"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))


def thresholds(sketch: DataFrame, *, gamma: float = GAMMA, prior: int = PRIOR) -> DataFrame:
    """One row for each (lang, source): a column for each rule with its fence."""
    own = quartiles(sketch, "lang", "source", gamma=gamma)
    lang = quartiles(sketch, "lang", gamma=gamma).select(F.col("lang").alias("l"), F.col("stat").alias("ls"), F.struct("size", "q25", "q50", "q75").alias("of_lang"))
    corpus = quartiles(sketch, gamma=gamma).select(F.col("stat").alias("cs"), F.struct("size", "q25", "q50", "q75").alias("of_corpus"))
    both = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["stat"] == lang["ls"])).join(F.broadcast(corpus), F.col("stat") == F.col("cs"))  # corpus: a row for each statistic
    drawn = lambda n, own, above: (n.cast("double") * own + F.lit(float(prior)) * above) / (n.cast("double") + F.lit(float(prior)))
    of = lambda q: drawn(F.col("size"), F.col(q), drawn(F.col("of_lang.size"), F.col(f"of_lang.{q}"), F.col(f"of_corpus.{q}"))).alias(q)
    chosen = both.select("lang", "source", "stat", of("q25"), of("q75"))
    spread = F.col("q75") - F.col("q25")
    fences = []
    for stat, side, width, part, least in RULES:
        quartile = F.col("q75") if side == "high" else F.col("q25")
        away = F.greatest(spread * width, quartile * part, F.lit(least))
        fences.append(F.max(F.when(F.col("stat") == stat, quartile + away if side == "high" else quartile - away)).alias(f"{stat}_{side}"))
    return chosen.groupBy("lang", "source").agg(*fences)


def judged(measured: DataFrame, like: DataFrame | None = None, *, gamma: float = GAMMA, prior: int = PRIOR) -> DataFrame:
    """measured with base_failed and kept. measured has lang, source and the measures of with_measures; the thresholds are
    those of like, if it is given."""
    limits = written(thresholds(sketches(measured if like is None else like, gamma=gamma), gamma=gamma, prior=prior), "rule-thresholds")
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(F.col(f"{stat}_{side}").alias(f"_{stat}_{side}") for stat, side, *_ in RULES))
    if limits.count() <= MAX_BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    stats = statistics()
    outside = [F.coalesce(stats[stat] > F.col(f"_{stat}_{side}") if side == "high" else stats[stat] < F.col(f"_{stat}_{side}"), F.lit(False)) for stat, side, *_ in RULES]
    joined = measured.join(limits, measured["lang"].eqNullSafe(F.col("_lang")) & measured["source"].eqNullSafe(F.col("_source")), "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~(base_failed() | reduce(lambda a, b: a | b, outside))}).drop(*limits.columns)


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep, with the same columns, whatever their names.

    Texts are measured twice, for the sketches and for the verdicts: to keep them with their measures in between would
    write the whole input again.
    """
    rows = documents.select(whole_row(documents), "lang", "source")
    return judged(with_measures(rows, ROW, "lang", "source"), with_measures(documents, "lang", "source")).where("kept").select(f"{ROW}.*")
