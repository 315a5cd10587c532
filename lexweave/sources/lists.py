"""Word lists, replacement maps and term dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.normalize import strip


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line of a text file. The number orders lines within the file: a list is one file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line"))
    return lines.select(F.col("line_no").cast("bigint").alias("line_no"), "line")


def parse_replacements(lines: DataFrame) -> DataFrame:
    """line_no, line to key, value: the first colon divides, both sides are trimmed, the last of equal keys counts."""
    parts = lines.where(F.col("line").contains(":")).select("line_no", F.split("line", ":", 2).alias("p"))
    pairs = parts.select("line_no", strip(F.get("p", F.lit(0))).alias("key"), strip(F.get("p", F.lit(1))).alias("value"))
    return pairs.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def parse_stopwords(lines: DataFrame, *others: DataFrame) -> DataFrame:
    """word: the distinct lines that are not blank, and those of others."""
    words = lines.select(strip(F.col("line")).alias("word"))
    for other in others:
        words = words.unionByName(other.select("word"))
    return words.where("word <> ''").distinct()


def parse_terms(lines: DataFrame, column: str = "line") -> DataFrame:
    """term_id (the place in the file), term: trimmed, without blanks and the literal nan, first of equal ones."""
    terms = lines.select(F.col("line_no").alias("term_id"), strip(F.col(column).cast("string")).alias("term")).where("term <> '' and term <> 'nan'")
    first = F.row_number().over(Window.partitionBy("term").orderBy("term_id"))
    return terms.withColumn("_n", first).where("_n = 1").drop("_n")


def read_stopwords(spark: SparkSession, path: str, *others: DataFrame) -> DataFrame:
    return parse_stopwords(numbered_lines(spark, path), *others)


def read_replacements(spark: SparkSession, path: str) -> dict[str, str]:
    """The map of a replacement file; it becomes part of a column expression, so it has to be small."""
    return {r["key"]: r["value"] for r in parse_replacements(numbered_lines(spark, path)).collect()}
