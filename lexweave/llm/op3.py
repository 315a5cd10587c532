"""Query op3_bpe_codec."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.bpe import Codec, encode
from lexweave.llm.common import table


class Decimals(dict):
    def __missing__(self, i: int) -> str:
        text = self[i] = str(i)
        return text


DECIMALS = Decimals()


def digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    """n_tokens, ids_sha256 and decoded_sha256 of the tokens of a text."""
    written = ",".join(map(DECIMALS.__getitem__, ids))
    return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        finish=digests,
        columns="n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        kinds=(pa.int64(), pa.string(), pa.string()),
    )
