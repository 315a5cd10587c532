"""Readers of whole inputs: term dictionaries, segments of documents, generic tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.lists import numbered_lines, parse_terms
from lexweave.sources.ooxml import read_docx, read_xlsx, read_xlsx_column


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """term_id, term of a dictionary: the first column of a workbook, or the lines of a text file."""
    lines = read_xlsx_column(spark, path) if path.lower().endswith(".xlsx") else numbered_lines(spark, path)
    return parse_terms(lines)


def read_segments(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """segment, doc_id (the path), path and text of one document for each segment: Word files or plain text. Every path is
    checked before any is read."""
    missing = [p for p in paths.values() if "://" not in p and not Path(p).exists()]
    if missing:
        raise FileNotFoundError(f"documents not found: {', '.join(missing)}")
    out = None
    for segment, path in paths.items():
        one = read_docx(spark, path) if path.lower().endswith(".docx") else spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
        rows = one.select(F.lit(segment).alias("segment"), F.lit(path).alias("doc_id"), F.lit(path).alias("path"), "text")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no segments")
    return out


def load_dataframe(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header from .xlsx or .csv, types inferred."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    suffix = Path(path).suffix.lower()
    if suffix == ".xlsx":
        return read_xlsx(spark, path)
    if suffix == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"unsupported format: {suffix or path}")
