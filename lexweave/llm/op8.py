"""Query op8_html_text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import table
from lexweave.llm.html_text import extract


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
