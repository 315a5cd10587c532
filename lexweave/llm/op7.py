"""Query op7_chat_format and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.chat import END, TURN, format_chat, read_loss, read_turns, text_part
from lexweave.llm.common import table

#: A conversation of control strings that every run formats besides the table.
EXTRA = "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM (SELECT 0 AS n, 'user' AS r UNION ALL SELECT 1, 'assistant')"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA))
    chats = format_chat(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    read = chats.select("conv_id", read_turns(F.col("formatted")).alias("t"), F.array_join(read_loss(F.col("formatted"), F.col("turns")), "").alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_LENGTH = "length(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))"

SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {EXTRA}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(END) + 1} + {_LENGTH.format("replace(role, chr(10), '&#10;')").replace("'&', '&amp;'", "'&', '&amp;'")} + {_LENGTH.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
