"""Text normalisation as column functions.

All of them are JVM expressions; only texts with combining marks, or letters that combine with their neighbours, take
the Arrow function behind `remove_accents`.
"""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Latin letters and digits that are read as the Cyrillic letters of the same look, and the folding of yo.
LATIN = "ABCEHKMOPTXYabcehkmoptxy"
CYRILLIC = "АВСЕНКМОРТХУавсенкмортху"
YO, YO_FOLDED = "ёЁ", "еЕ"
DIGITS, DIGIT_LETTERS = "06", "Об"
#: A 3 that no letter, number or underscore stands before (a mark may).
WORD_INITIAL_THREE = r"(?<![\p{L}\p{N}_])3"
THREE_LETTER = "З"

#: Soft hyphen, zero-width space, non-joiner and joiner, word joiner (fixed values).
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060"

#: Characters that `remove_special_chars` blanks (fixed values): ASCII punctuation and digits, and these.
SPECIAL_SIGNS = "।«»…•°‒–—£‹∆∠„№→↔♦✓′″€±∙‚÷≤⊃⊥⋂⋃■↓≠×∈∉∥∩∪≈⊂□←§¬®·"
SPECIAL_SPACES = "\n\u00a0\t\u00ad"
SPECIAL_LETTERS = "abcen" + "éöżžüóōáēíł" + "ρμχνκυβοςζαδστηι"
SPECIAL_FULL = string.punctuation + string.digits + SPECIAL_SPACES + SPECIAL_SIGNS + SPECIAL_LETTERS

#: Characters that the soft variant blanks (fixed values): it keeps ASCII punctuation but for the double quote.
SPECIAL_SOFT = '…•°"£‹∆∠„№→↔♦′″।∙⊥⋂⋃■↓≠×∈∉∥∩∪⊂□←¬±·' + "en" + "éöżžüóōáēíł" + "μχνκυβοςζαδστηι"

#: Month names, Russian, in the forms that texts carry (fixed values).
MONTHS = r"январ[ья]|феврал[ья]|март[а]?|апрел[ья]|ма[йя]|июн[ья]|июл[ья]|август[а]?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья]"

BREVE = "\u0306"

#: Blocks in which each character can be stripped of its accents on its own: no marks, nothing that joins a neighbour.
_ALONE = ((0x00, 0x2FF), (0x370, 0x482), (0x48A, 0x52F), (0x1E00, 0x20CF), (0x2100, 0x2CEE), (0x2CF2, 0x2D7E), (0x2D80, 0x2DDF), (0x3000, 0x3029), (0x3030, 0x3098), (0x309B, 0x30FF), (0x4E00, 0x9FFF))


def _ranges(*blocks: tuple[int, int]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in blocks)


_TOGETHER = f"[^{_ranges(*_ALONE)}]"

#: Latin and Cyrillic of these blocks: texts of nothing else are told by a pattern of few ranges.
_USUAL = f"^[{_ranges((0x00, 0x2FF), (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x2027))}]*+$"


def strip_accents(text: str) -> str:
    """Decompose, drop marks but for the breve, compose."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if c == BREVE or unicodedata.category(c) != "Mn"))


def _accent_table() -> tuple[str, str]:
    pairs = [(chr(c), strip_accents(chr(c))) for a, b in _ALONE for c in range(a, b + 1)]
    pairs = [(c, bare) for c, bare in pairs if c != bare]
    if any(len(bare) != 1 for _, bare in pairs):
        raise AssertionError("a character of these blocks has no single base")
    return "".join(c for c, _ in pairs), "".join(bare for _, bare in pairs)


_ACCENTED, _BARE = _accent_table()


def _accent_function():
    """The rule as an Arrow function that carries its own code, so that executors need nothing installed."""

    def strip(texts: pd.Series) -> pd.Series:
        import unicodedata

        nfd, nfc, kind = (lambda t: unicodedata.normalize("NFD", t)), (lambda t: unicodedata.normalize("NFC", t)), unicodedata.category
        return texts.map(lambda t: nfc("".join(c for c in nfd(t) if c == "\u0306" or kind(c) != "Mn")), na_action="ignore")

    return F.pandas_udf(strip, StringType())


_strip_accents = _accent_function()


def remove_accents(text: Column) -> Column:
    """Letters without their accents; й, ў and ă keep the breve. A table lookup in the JVM where characters stand alone."""
    alone = text.rlike(_USUAL) | ~text.rlike(_TOGETHER)
    return F.when(alone, F.translate(text, _ACCENTED, _BARE)).otherwise(_strip_accents(F.when(~alone, text)))


def replace_letters(text: Column) -> Column:
    """Latin letters as the Cyrillic ones they look like, yo as ye, a word-initial 3 and every 0 and 6 as letters."""
    folded = F.translate(text, LATIN + YO + DIGITS, CYRILLIC + YO_FOLDED + DIGIT_LETTERS)
    return F.regexp_replace(folded, WORD_INITIAL_THREE, THREE_LETTER)


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def fold_yo(text: Column) -> Column:
    return F.translate(text, YO, YO_FOLDED)


def remove_chars(text: Column, chars: str) -> Column:
    """Each of chars as a space; the length stays."""
    distinct = "".join(dict.fromkeys(chars))
    return F.translate(text, distinct, " " * len(distinct)) if distinct else text


def remove_special_chars(text: Column) -> Column:
    return remove_chars(text, SPECIAL_FULL)


def remove_special_chars_soft(text: Column) -> Column:
    return remove_chars(text, SPECIAL_SOFT)


def normalize_tokens(text: Column) -> Column:
    """The profile of the token path: accents, letters, invisible characters."""
    return strip_invisible(replace_letters(remove_accents(text)))


def normalize_preprocess(text: Column) -> Column:
    """The profile of `preprocess`: accents, invisible characters, letters."""
    return replace_letters(strip_invisible(remove_accents(text)))


def fold(text: str) -> str:
    """`normalize_tokens` of a short constant without a word-initial 3, for word lists."""
    table = str.maketrans(LATIN + YO + DIGITS, CYRILLIC + YO_FOLDED + DIGIT_LETTERS, INVISIBLE)
    return strip_accents(text).translate(table)


def blank(text: Column) -> Column:
    """True for null and for texts of white space only (any Unicode white space)."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filter_lemmas(lemmas: Column, stopwords: list[str] | None = None) -> Column:
    """array<string> of lemmas without Latin words, month names and words of one or two letters, then without stop
    words (exact case). The words are those of the lemmas joined by spaces."""
    text = F.array_join(lemmas, " ")
    for pattern in (r"(?U)\b[a-zA-Z]+\b", r"(?U)\b[ivxlcdm]+\b", rf"(?iuU)\b(?:{MONTHS})\b", r"(?U)\b\w\b", r"(?U)\b\w{2}\b|\b\w-\w\b"):
        text = F.regexp_replace(text, pattern, " ")
    words = split_words(F.regexp_replace(text, WORD_INITIAL_THREE, THREE_LETTER))
    return F.filter(words, lambda w: ~w.isin(stopwords)) if stopwords else words


def split_words(text: Column) -> Column:
    """Words between white space; signs at the ends of a word are words of their own."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+(?:[-'.]\w+)*|[^\s\w]"), 0)
