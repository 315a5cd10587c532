"""Query op10_ngram_jaccard_join and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import table
from lexweave.llm.near_duplicates import link_documents

#: Words of a shingle, and the least similarity in percent.
SIZE, PERCENT = 3, 90


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), size=SIZE, percent=PERCENT)


def clauses(source: str, size: int, percent: int) -> str:
    """WITH RECURSIVE clauses that end in `joined`: doc_id, n_shingles, component_id of the rows of source."""
    return rf"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(list_slice(w, i, i + {size} - 1), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS c FROM words UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.x),
joined AS (
  SELECT words.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, least.c AS component_id
  FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT x, min(c) AS c FROM reach GROUP BY x) least ON least.x = words.doc_id)
"""


SQL = f"WITH RECURSIVE {clauses('documents', SIZE, PERCENT)} SELECT doc_id, n_shingles, component_id FROM joined"
