"""Correction of lemmas by the parses of a morphological analyser.

A parse is a struct (word, normal_form, tags array<string>, score); parses of a form are an array in the analyser's
order. Reparses of a word are looked up in the same arrays, so the decision is one expression over a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.normalize import fold_yo
from lexweave.functions.tokens import BANNED, replaced

PARSE = "struct<word:string,normal_form:string,tags:array<string>,score:double>"

#: Tags of proper nouns: places, given names, surnames (fixed values).
PROPER = ("Geox", "Name", "Surn")


def _has(parse: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(parse["tags"], tag), F.lit(False))


def _first(parses: Column, test) -> Column:
    return F.get(F.filter(parses, test), F.lit(0))["normal_form"]


def short_to_full(best: Column, parses: Column) -> Column:
    """Normal form of the first parse that is a full adjective or participle, else of the best one."""
    full = lambda p: (_has(p, "ADJF") & ~_has(p, "ADJS")) | (_has(p, "PRTF") & ~_has(p, "PRTS"))
    return F.coalesce(_first(parses, full), best["normal_form"])


def imperfective(best: Column, parses: Column) -> Column:
    """Normal form of the first imperfective verb, else of the best parse."""
    return F.coalesce(_first(parses, lambda p: _has(p, "VERB") & _has(p, "impf")), best["normal_form"])


def _by_form(best: Column, parses: Column, otherwise: Column) -> Column:
    short = _has(best, "ADJS") | _has(best, "PRTS")
    return F.when(short, short_to_full(best, parses)).when(_has(best, "VERB"), imperfective(best, parses)).otherwise(otherwise)


def processed(parses: Column) -> Column:
    """Lemma of a form from its own parses."""
    best = F.get(parses, F.lit(0))
    return _by_form(best, parses, best["normal_form"])


def correct_lemma(token: Column, lemma: Column, token_parses: Column, lemma_parses: Column) -> Column:
    """The lemma of a tagger, corrected: from the token's parses if the lemma is unknown or the token itself, else full
    forms for short ones and imperfective verbs, else as it was. Yo is folded."""
    token_parses, lemma_parses = (F.coalesce(p, F.array().cast(f"array<{PARSE}>")) for p in (token_parses, lemma_parses))
    best = F.get(lemma_parses, F.lit(0))
    unknown = (F.size(lemma_parses) == 0) | F.coalesce(best["score"] < 0, F.lit(False)) | (F.lower(lemma) == F.lower(token))
    from_token = F.when(F.size(token_parses) > 0, processed(token_parses)).otherwise(token)
    return fold_yo(F.when(unknown, from_token).otherwise(_by_form(best, lemma_parses, lemma)))


def is_proper(parses: Column) -> Column:
    best = F.get(parses, F.lit(0))
    return _has(best, PROPER[0]) | _has(best, PROPER[1]) | _has(best, PROPER[2])


def dropped(parses: Column, pos: Column) -> Column:
    """Tokens that `lemmatize` leaves out: those whose corrected lemma has no parse, or one with a score of 0 or less, and
    those of a closed class."""
    best = F.get(parses, F.lit(0))
    return best.isNull() | F.coalesce(best["score"] <= 0, F.lit(True)) | F.coalesce(pos.isin(*BANNED), F.lit(False))


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first; unlike initcap also behind hyphens and apostrophes."""
    cut = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(cut, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def lemmatize_standard(lemma: Column, pos: Column, lemma_parses: Column, replacements: dict[str, str], *, skip_proper_nouns: bool = True) -> Column:
    """What stands for a token, or null if it is left out. lemma is the corrected lemma, lemma_parses are its parses. Proper
    nouns go, or are kept in title case; what is left is replaced once."""
    proper = is_proper(lemma_parses)
    cased = F.when(proper, title_case(lemma)).otherwise(F.lower(lemma))
    out = dropped(lemma_parses, pos) | (proper if skip_proper_nouns else F.lit(False))
    return F.when(~out, replaced(fold_yo(cased), replacements))


def lemmatize_without_proper(lemma: Column, pos: Column, lemma_parses: Column, replacements: dict[str, str]) -> Column:
    """What stands for a token in lower case, or null: proper nouns always go."""
    return F.when(~(dropped(lemma_parses, pos) | is_proper(lemma_parses)), replaced(fold_yo(F.lower(lemma)), replacements))
