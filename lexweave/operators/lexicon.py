"""A morphological lexicon as a table: the tag and the corrected lemma of every form, found by a join on distinct forms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.normalize import fold_yo, normalize_tokens
from lexweave.functions.tokens import Analyzer
from lexweave.operators import morphology as R

#: Forms of a lexicon that are broadcast (some 100 bytes each); a larger one is joined by shuffle.
MAX_BROADCAST = 500_000


@dataclass(frozen=True)
class Lexicon:
    """forms: form (a key of Analyzer), pos (or null) and lemma, a row for each form."""

    forms: DataFrame
    max_broadcast: int = MAX_BROADCAST

    @cached_property
    def _small(self) -> bool:
        return self.forms.limit(self.max_broadcast + 1).count() <= self.max_broadcast

    def looked_up(self, df: DataFrame, token: Column, name: str) -> DataFrame:
        """df with a struct (pos, lemma) of the form of a token, null if the lexicon has none."""
        forms = self.forms.select(F.col("form").alias("_form"), F.struct("pos", "lemma").alias(name))
        return df.join(F.broadcast(forms) if self._small else forms, Analyzer.key(token) == F.col("_form"), "left").drop("_form")

    def forms_of(self, lemmas: set[str], most: int) -> list[str] | None:
        """Forms with one of these lemmas, in any case; None if there are more than most."""
        wanted = self.forms.sparkSession.createDataFrame([(v,) for v in lemmas], "_lemma string")
        found = self.forms.join(F.broadcast(wanted), F.lower("lemma") == F.col("_lemma"), "left_semi").select("form").limit(most + 1).collect()  # most at most
        return None if len(found) > most else [r["form"] for r in found]


def compiled(parses: DataFrame) -> DataFrame:
    """parses: form, pos (of the tagger, or null), raw (lemma of the tagger, or null), parses (array of morphology.PARSE).
    form, pos, lemma, parses and lemma_parses (those of the corrected lemma): each form once, the first by its spelling.

    The parses of a lemma are those of the form that is spelt like it: a join of the table with itself on distinct forms.
    """
    keyed = parses.withColumn("_key", Analyzer.key(normalize_tokens(F.col("form"))))
    one = keyed.groupBy("_key").agg(F.min_by(F.struct("form", "pos", F.coalesce("raw", "form").alias("raw"), "parses"), F.struct("form", F.to_json(F.struct("pos", "raw", "parses")))).alias("p"))
    own = one.select(F.col("_key").alias("form"), "p.pos", "p.raw", "p.parses", F.col("p.form").alias("spelt"))
    known = own.select(F.col("form").alias("_lemma"), F.col("parses").alias("_parses"))
    of = lambda df, column, name: df.join(known, Analyzer.key(normalize_tokens(column)) == F.col("_lemma"), "left").withColumnRenamed("_parses", name).drop("_lemma")
    raw = of(own, F.col("raw"), "raw_parses")
    corrected = raw.withColumn("lemma", fold_yo(R.correct_lemma(F.col("spelt"), F.col("raw"), F.col("parses"), F.col("raw_parses"))))
    return of(corrected, F.col("lemma"), "lemma_parses").select("form", "pos", normalize_tokens(F.col("lemma")).alias("lemma"), "parses", "lemma_parses")


def read_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """A lexicon from a Parquet table of `compiled` input, or from a tab-separated file with a header: word, pos, raw,
    normal_form, tags (separated by spaces), score; a row for each parse, in the analyser's order."""
    if path.lower().endswith(".tsv"):
        lines = spark.read.csv(path, sep="\t", header=True, quote="", schema="word string, pos string, raw string, normal_form string, tags string, score double")
        numbered = lines.withColumn("_n", F.monotonically_increasing_id())
        parse = F.struct("word", "normal_form", F.split(F.coalesce("tags", F.lit("")), " ").alias("tags"), "score")
        each = numbered.groupBy("word").agg(F.min_by("pos", "_n").alias("pos"), F.min_by("raw", "_n").alias("raw"), F.sort_array(F.collect_list(F.when(F.col("normal_form").isNotNull(), F.struct("_n", parse.alias("p"))))).alias("all"))
        table = each.select(F.col("word").alias("form"), "pos", "raw", F.transform("all", lambda p: p["p"]).cast(f"array<{R.PARSE}>").alias("parses"))
    else:
        table = spark.read.parquet(path)
    return Lexicon(compiled(table).select("form", "pos", "lemma"))
