"""Query op4_quality_rules and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import table, written
from lexweave.llm.rules import GAMMA, PRIOR, RULES, judged, with_measures


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(with_measures(table(spark, sf_dir, "documents"), "doc_id", "lang", "source"), "rule-measures")
    return judged(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _fence(stat: str, side: str, width: float, part: float, least: float) -> str:
    quartile, sign = ("q75", "+") if side == "high" else ("q25", "-")
    return f"max(CASE WHEN stat = '{stat}' THEN {quartile} {sign} greatest((q75 - q25) * {width!r}, {quartile} * {part!r}, {least!r}) END) AS {stat}_{side}"


def _quartiles(by: str) -> str:
    group = f"{by}, " if by else ""
    return f"""SELECT {group}stat, max(size) AS size, min(CASE WHEN below >= ceil(size * 0.25) THEN v END) AS q25, min(CASE WHEN below >= ceil(size * 0.75) THEN v END) AS q75
  FROM (SELECT {group}stat, coalesce(pow({GAMMA!r}, bucket - 0.5), 0.0) AS v,
    sum(n) OVER (PARTITION BY {group}stat ORDER BY bucket NULLS FIRST) AS below, sum(n) OVER (PARTITION BY {group}stat) AS size
    FROM (SELECT {group}stat, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {group}stat"""


def _drawn(n: str, own: str, above: str) -> str:
    return f"(CAST({n} AS DOUBLE) * {own} + {float(PRIOR)!r} * {above}) / (CAST({n} AS DOUBLE) + {float(PRIOR)!r})"


def _of(q: str) -> str:
    return f"{_drawn('own.size', f'own.{q}', '(' + _drawn('lng.size', f'lng.{q}', f'corp.{q}') + ')')} AS {q}"


_STATS = "[{'stat': 'symbols', 'v': symbols}, {'stat': 'repeats', 'v': repeats}, {'stat': 'word_length', 'v': word_length}, {'stat': 'upper', 'v': upper}]"
_OUTSIDE = " OR ".join(f"coalesce({stat} {'>' if side == 'high' else '<'} {stat}_{side}, false)" for stat, side, *_ in RULES)

#: WITH clauses that end in `judged`: doc_id, the measures, base_failed and kept.
CLAUSES = rf"""
w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (
        SELECT doc_id, i, list_slice(words, i, i + 2) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)))
    WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN rep USING (doc_id)),
s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / CAST(greatest(n_words, 1) AS DOUBLE) AS symbols,
    n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE) AS repeats, word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS word_length,
    n_capitals / CAST(greatest(n_letters, 1) AS DOUBLE) AS upper FROM m),
sk AS (
  SELECT lang, source, u.stat AS stat, CASE WHEN u.v > 0 THEN ceil(ln(u.v) / ln({GAMMA!r})) END AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest({_STATS}) AS u FROM s WHERE NOT base_failed) GROUP BY ALL),
own AS ({_quartiles('lang, source')}),
lng AS ({_quartiles('lang')}),
corp AS ({_quartiles('')}),
chosen AS (
  SELECT own.lang, own.source, own.stat, {_of('q25')}, {_of('q75')}
  FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.stat = lng.stat JOIN corp ON corp.stat = own.stat),
lim AS (SELECT lang, source, {', '.join(_fence(*rule) for rule in RULES)} FROM chosen GROUP BY lang, source),
judged AS (
  SELECT s.*, NOT (base_failed OR {_OUTSIDE}) AS kept
  FROM s LEFT JOIN lim ON s.lang IS NOT DISTINCT FROM lim.lang AND s.source IS NOT DISTINCT FROM lim.source)
"""

SQL = f"WITH {CLAUSES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
