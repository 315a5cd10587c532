"""Query op5_toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import held_out, table, training_labels
from lexweave.llm.toxicity import fit, score, training_sample

#: Scores from here on are predicted to be label 1.
THRESHOLD = 0.5


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(training_sample(documents, training_labels(table(spark, sf_dir, "labels"), "toxic")))
    return score(documents, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").cast("bigint").alias("n_offending"),
    )
