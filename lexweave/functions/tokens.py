"""Tokens, part-of-speech tags and lemmas as column functions over arrays.

A document's tokens are one array of strings, so tokenising and matching are narrow: no token crosses the network. What
costs more than a look at a token is done after an explode, in generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.normalize import fold, fold_yo

if TYPE_CHECKING:
    from lexweave.operators.lexicon import Lexicon

#: Hyphens and dashes (fixed values).
HYPHENS = "-‑–—−"

#: A token: letters with inner hyphens, digits, or any other sign; pieces add the white space between, so that they tile
#: the text.
TOKEN = rf"\p{{L}}+(?:[{HYPHENS}]\p{{L}}+)*|\p{{N}}+|[^\s]"
PIECE = rf"{TOKEN}|\s+"

#: Tags that are never words (fixed values).
BANNED = ("PRON", "NUM", "ADP", "SCONJ", "CCONJ", "PART", "INTJ", "PUNCT", "SYM")

ALPHA = "[A-Za-zА-Яа-яЁё]"

#: Closed-class words of the default tagger, our own short lists.
CLOSED_CLASS = {
    "ADP": "of in to for on with at by from into über für von mit auf bei aus zu nach de en con por para sur dans avec pour par du в во на с со по из к ко у о об от до за над под при для без между через после перед про".split(),
    "PRON": "he she it they we you i me him her them us who which er sie es wir ich il elle nous vous je se le la los les lo я ты он она оно мы вы они его ее их себя кто что это".split(),
    "CCONJ": "and or but nor und oder aber y o et ou mais и а но или либо да".split(),
    "SCONJ": "that because if while although than dass weil wenn que porque si как если чтобы потому когда хотя".split(),
    "PART": "not no n't nicht ne pas не ни бы же ли лишь только вот".split(),
    "DET": "the a an this these those die der das den dem ein eine einer einen un una une el las des этот эта эти тот та те весь все".split(),
    "AUX": "is was are were be been being has have had ist sind war hat es son est sont быть был была было были есть".split(),
    "INTJ": "oh ah hey ой ах эх".split(),
    "NUM": "one two three four five zwei drei dos tres deux trois один два три четыре пять".split(),
}

_SYMBOLS = r"[$€£¥+=<>|~^%№§°±×÷∙•→←↔≠≤≥≈∈∉∩∪⊂⊃∠⊥∥□■♦✓©®]"


def pieces(normalized: Column) -> Column:
    """array<string> of pieces that tile the text."""
    return F.regexp_extract_all(normalized, F.lit(PIECE), 0)


def tokens(normalized: Column) -> Column:
    """array<string> of tokens, punctuation included."""
    return F.regexp_extract_all(normalized, F.lit(TOKEN), 0)


def closed_class(folded: bool = True) -> dict[str, list[str]]:
    """Words of each closed class, as normalised texts show them; a word has the first class that lists it."""
    seen: set[str] = set()
    out: dict[str, list[str]] = {}
    for tag, words in CLOSED_CLASS.items():
        shown = [fold(w).lower() if folded else w for w in words]
        out[tag] = [w for w in dict.fromkeys(shown) if w not in seen]
        seen |= set(shown)
    return out


def lexicon_tag(token: Column) -> Column:
    """Tag of a normalised token: signs, numbers, closed classes, else NOUN."""
    tag = F.when(token.rlike(_SYMBOLS), "SYM").when(~token.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(token.rlike(r"^\p{N}+$"), "NUM")
    word = F.lower(token)
    for name, words in closed_class().items():
        tag = tag.when(word.isin(words), name)
    return tag.otherwise("NOUN")


def identity_lemma(token: Column, tag: Column) -> Column:
    """Without a morphological lexicon a token is its own lemma, with yo folded."""
    return fold_yo(token)


def replaced(lemma: Column, replacements: dict[str, str]) -> Column:
    """One step of the replacement map; only lemmas that have an entry pay for the lookup."""
    if not replacements:
        return lemma
    table = F.create_map(*(F.lit(x) for pair in replacements.items() for x in pair))
    return F.when(lemma.isin(list(replacements)), F.element_at(table, lemma)).otherwise(lemma)


@dataclass(frozen=True)
class Analyzer:
    """How tokens are tagged and reduced to lemmas. `tagger` maps a token to its tag; `lemmatizer` maps a token and its tag
    to a raw lemma; the lemma is then lower-cased and replaced once. A lexicon (see operators.lexicon) comes before both,
    for the forms that it lists."""

    tagger: Callable[[Column], Column] = lexicon_tag
    lemmatizer: Callable[[Column, Column], Column] = identity_lemma
    replacements: dict[str, str] = field(default_factory=dict)
    lexicon: Lexicon | None = None

    def is_word(self, token: Column, tag: Column) -> Column:
        return token.rlike(ALPHA) & ~tag.isin(*BANNED)

    def finished(self, token: Column, tag: Column, raw: Column) -> Column:
        """Lemma of a word from its raw lemma, null for other tokens."""
        return F.when(self.is_word(token, tag), replaced(F.lower(raw), self.replacements))

    def lemma(self, token: Column, tag: Column) -> Column:
        """Lemma of a word without a lexicon, null for other tokens."""
        return self.finished(token, tag, self.lemmatizer(token, tag))

    def with_lemmas(self, df: DataFrame, **tokens: str) -> DataFrame:
        """df with a column for each name of tokens: a struct (pos, lemma) of the token in the column given for it."""
        if self.lexicon is None:
            return df.withColumns({name: F.struct(self.tagger(F.col(c)).alias("pos"), self.lemma(F.col(c), self.tagger(F.col(c))).alias("lemma")) for name, c in tokens.items()})
        for name, c in tokens.items():
            token = F.col(c)
            df = self.lexicon.looked_up(df, token, "_found")
            pos = F.coalesce("_found.pos", self.tagger(token))
            raw = F.coalesce("_found.lemma", self.lemmatizer(token, pos))
            df = df.withColumn(name, F.struct(pos.alias("pos"), self.finished(token, pos, raw).alias("lemma"))).drop("_found")
        return df

    def surfaces(self, lemmas: list[str], most: int) -> list[str] | None:
        """The `key`s of all tokens whose lemma is among lemmas (and maybe others); None if they cannot be listed, or are
        more than most."""
        if self.lemmatizer is not identity_lemma:
            return None
        raw = {*lemmas, *(k for k, v in self.replacements.items() if v in lemmas)}
        known = [] if self.lexicon is None else self.lexicon.forms_of(raw, most)
        return None if known is None or len(raw) + len(known) > most else sorted({*raw, *known})

    @staticmethod
    def key(token: Column) -> Column:
        """What the default lemmatizer makes of a token, and a lexicon is asked for."""
        return F.lower(fold_yo(token))


def has_inner_hyphen(token: Column) -> Column:
    return token.rlike(f"[{HYPHENS}]")


def is_hyphen(token: Column, tagger: Callable[[Column], Column] = lexicon_tag) -> Column:
    """A punctuation token that is exactly one hyphen; only hyphens are tagged for this."""
    return F.coalesce(token.isin(*HYPHENS) & (tagger(token) == "PUNCT"), F.lit(False))
