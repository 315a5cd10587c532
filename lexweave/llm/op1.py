"""Query op1_quality_classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import held_out, table, training_labels, written
from lexweave.llm.quality import fit, score, with_statistics

#: Scores from here on are predicted to be label 1.
THRESHOLD = 0.3


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit(vectors, training_labels(table(spark, sf_dir, "labels"), "quality"))
    return score(vectors, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
