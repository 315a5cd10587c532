"""Writers: the frequency workbook, context logs, highlighted documents. Large results are DataFrames to write with
Spark; these files are for people and small by nature."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from itertools import groupby
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lexweave.functions.normalize import blank
from lexweave.functions.tokens import Analyzer
from lexweave.operators.contexts import in_log_order
from lexweave.operators.match import matches
from lexweave.operators.spans import hit_spans, merge_spans
from lexweave.operators.words import tokenized
from lexweave.sources.ooxml import _blocks, binaries, highlighted_docx, make_xlsx

# Column names of the result table and of the log, and the names of files.
TERM_COLUMN = "Термин"
COUNT_COLUMN, IPM_COLUMN = "КВ {} класс", "НЧ {} класс"
LOG_COLUMNS = ("Grade", "Doc", "Term", "Pattern", "Match#", "Surface", "Context", "StartTokIdx", "EndTokIdx")
LOG_NAME, SHEET_NAME, HIGHLIGHT_NAME = "grade_{}_contexts.csv", "Динамика {}-{}", "{} — термины.docx"


def result_table(dynamics: DataFrame, segments: Sequence) -> DataFrame:
    """The wide frequency table under its published column names, in dictionary order."""
    counts = [F.col(f"cnt_{s}").alias(COUNT_COLUMN.format(s)) for s in segments]
    ipm = [F.col(f"ipm_{s}").alias(IPM_COLUMN.format(s)) for s in segments]
    return dynamics.orderBy("term_id").select(F.col("term").alias(TERM_COLUMN), *counts, *ipm)


def write_xlsx(table: DataFrame, path: str, segments: Sequence) -> None:
    """One row for each term of the dictionary: a workbook holds no more than fits on the driver anyway."""
    rows = (tuple(r) for r in table.toLocalIterator())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(make_xlsx(table.columns, rows, SHEET_NAME.format(min(segments), max(segments))))


def log_table(log: DataFrame) -> DataFrame:
    """The context log under its published column names, in the order of the log; a document that is a path has its last
    part as its name."""
    columns = ("segment", "doc_id", "term", "pattern", "match_no", "surface", "context", "start_tok_idx", "end_tok_idx")
    named = in_log_order(log).withColumn("doc_id", F.regexp_extract(F.col("doc_id").cast("string"), r"([^/\\]*)[/\\]*$", 1))
    return named.select(*(F.col(c).alias(name) for c, name in zip(columns, LOG_COLUMNS)))


def write_context_logs(log: DataFrame, folder: str, segments: Sequence) -> list[str]:
    """A UTF-8 file with byte order mark for each of the segments that has rows. The log is made and sorted once; rows are
    streamed, never held."""
    written = []
    rows = log_table(log.where(F.col("segment").isin(*segments))).toLocalIterator()
    for segment, own in groupby(rows, key=lambda row: row[0]):
        path = Path(folder) / LOG_NAME.format(segment)
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("w", encoding="utf-8-sig", newline="") as file:
            out = csv.writer(file)
            out.writerow(LOG_COLUMNS)
            out.writerows(own)
        written.append(str(path))
    return written


@F.pandas_udf(BinaryType())
def _highlighted(contents: pd.Series, spans: pd.Series) -> pd.Series:
    def one(content: bytes, found) -> bytes:
        by: dict[int, list[tuple[int, int]]] = {}
        for s in sorted(() if found is None else found, key=lambda s: (s["block_id"], s["start"])):
            by.setdefault(s["block_id"], []).append((s["start"], s["end"]))
        return highlighted_docx(content, by) if by else content

    return pd.Series([one(c, f) for c, f in zip(contents, spans)])


def annotated_docx(spark: SparkSession, patterns: DataFrame, analyzer: Analyzer, *paths: str, allow_punct_between: bool = False, disallow_hyphen_adjacent_for_unigrams: bool = False) -> DataFrame:
    """path and content of highlighted copies: in every paragraph, those of tables included, terms are red. Offsets are
    those of the normalised paragraph. A document is a row throughout; only its spans are grouped."""
    files = binaries(spark, *paths)
    blocks = files.select("path", F.explode(_blocks("content")).alias("b")).select("path", "b.block_id", "b.text").where(~blank(F.col("text")))
    texts = tokenized(blocks, "path", "block_id", offsets=True)
    options = {"allow_punct_between": allow_punct_between, "disallow_hyphen_adjacent_for_unigrams": disallow_hyphen_adjacent_for_unigrams}
    hits = matches(texts, patterns, analyzer, "path", "block_id", spans=True, **options)
    spans = merge_spans(hit_spans(hits, "path", "block_id"), "path", "block_id")
    each = spans.groupBy("path").agg(F.collect_list(F.struct("block_id", "start", "end")).alias("spans"))
    return files.join(each, "path", "left").select("path", _highlighted("content", "spans").alias("content"))


def highlight_path(path: Column | str, folder: str) -> str:
    return str(Path(folder) / HIGHLIGHT_NAME.format(Path(str(path)).stem))


def write_highlighted(copies: DataFrame, folder: str) -> list[str]:
    """Write highlighted copies, one file after the other."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    written = []
    for row in copies.toLocalIterator():
        target = highlight_path(row["path"].removeprefix("file:"), folder)
        Path(target).write_bytes(bytes(row["content"]))
        written.append(target)
    return written
