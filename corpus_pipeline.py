"""The corpus pipeline: `documents` through the stages of STAGES, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.bpe import encode
from lexweave.llm.common import table, written
from lexweave.llm.decontamination import decontaminate
from lexweave.llm.near_duplicates import keep_one
from lexweave.llm.personal_data import fit, redact
from lexweave.llm.rules import keep_good

#: Near duplicates: words of a shingle, and the similarity (in percent) from which documents are one.
SHINGLE_WORDS, SIMILARITY = 5, 80

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the fences of their language and source go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return keep_one(docs, size=SHINGLE_WORDS, percent=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that is nearly all benchmark goes."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact(docs, fit(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and text: the tokens of each text, and the text decoded from them."""
    return encode(
        docs,
        TOKENIZER,
        "doc_id",
        "lang",
        "source",
        finish=lambda codec, ids: (ids, len(ids), codec.decode(ids)),
        columns="ids array<int>, n_tokens bigint, text string",
        kinds=(pa.list_(pa.int32()), pa.int64(), pa.string()),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: The last two stages have no SQL: the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
