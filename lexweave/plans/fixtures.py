"""Small inline inputs of the queries: terms, replacements, stop words, parses."""

from __future__ import annotations

#: (term_id, term): single words, phrases, terms that share a pattern ("the", "and the") and one without any ("of").
TERMS = (
    (0, "the"), (1, "and the"), (2, "of"), (3, "the the"), (4, "orre"), (5, "orre orre orre"), (6, "der die"),
    (7, "die"), (8, "rañ asasta asgado"), (9, "el"), (10, "des"), (11, "BY-NC"), (12, "Is, the"), (13, "a thing"),
)

SEGMENTS = ("en", "de", "fr", "es")

#: Lemma replacements, in normalised letters on both sides.
REPLACEMENTS = {"thing": "the", "des": "der", "una": "un"}

STOPWORDS = ("the", "der", "die", "und", "and")

#: Stop words in normalised letters.
PREPROCESS_STOPWORDS = ("orre",)

#: Lines of a replacement file: the first colon divides, the last of equal keys counts.
REPLACEMENT_LINES = ("a: b", " c :d: e ", "no colon", "a: z", ": empty key", "")

#: Lines of a term dictionary with duplicates, blanks and the literal nan.
TERM_LINES = (" cell ", "nucleus", "cell", "", "nan", "Cell", "cell membrane")

#: (token, lemma, parses of the token, parses of the lemma); a parse is (word, normal_form, tags, score).
PARSES = (
    ("красив", "красивый", (("красив", "красивый", "ADJS sing", 0.9),), (("красивый", "красивый", "ADJF masc", 0.8),)),
    ("делает", "делает", (("делает", "делать", "VERB impf", 1.0), ("делает", "деланный", "PRTF", 0.1)), (("делает", "делать", "VERB impf", 1.0),)),
    ("дом", "дом", (("дом", "дом", "NOUN", 0.7),), (("дом", "дом", "NOUN", 0.7),)),
    ("ёжик", "зверь", (("ёжик", "ёжик", "NOUN", 0.5),), ()),
    ("абв", "где", (), ()),
    ("сказал", "сказать", (("сказал", "сказать", "VERB perf", 0.9),), (("сказать", "сказать", "VERB perf", 0.9), ("сказать", "сказывать", "VERB impf", 0.1))),
    ("видна", "виден", (("видна", "видный", "ADJS femn", 0.9),), (("виден", "виден", "ADJS masc", 0.9), ("виден", "видный", "ADJF masc", 0.2))),
    ("негатив", "негатив", (("негатив", "негатив", "NOUN", 0.6),), (("негатив", "негативный", "ADJS", -1.0),)),
    ("клетки", "клетка", (("клетки", "клетка", "NOUN", 0.6),), (("клетка", "клетка", "NOUN", 0.6),)),
)

#: A small lexicon over the tables' words: (form, tag or None, lemma of a tagger or None, parses).
LEXICON = (
    ("asga", None, None, (("asga", "asga", "NOUN", 0.9),)),
    ("asgado", None, "asga", (("asgado", "asga", "NOUN", 0.8),)),
    ("asgaes", None, "asga", (("asgaes", "asga", "NOUN", 0.8),)),
    ("asgaos", None, "asgaos", (("asgaos", "asga", "NOUN", 0.7),)),
    ("orre", None, None, (("orre", "orre", "NOUN", 0.9),)),
    ("orrest", "VERB", "orrest", (("orrest", "orreth", "VERB perf", 0.5), ("orrest", "orre", "VERB impf", 0.4))),
    ("orreti", None, "orrehe", (("orreti", "orreti", "ADJS", 0.6),)),
    ("orrehe", None, "orrehe", (("orrehe", "orrehe", "ADJS", 0.5), ("orrehe", "orre", "ADJF", 0.4))),
    ("der", "DET", "der", (("der", "der", "ADJF", 0.7),)),
    ("die", "DET", "der", (("die", "der", "ADJF", 0.7),)),
    ("des", "DET", "der", ()),
    ("hehely", "PROPN", "hehely", (("hehely", "hehely", "NOUN Name", 0.9),)),
    ("ti", None, "ti", (("ti", "ti", "NOUN", 0.0),)),
    ("thati", "ADP", "thati", (("thati", "thati", "NOUN", 0.9),)),
    ("et", "CCONJ", "et", (("et", "et", "CONJ", 0.9),)),
)

#: (term_id, term): inflected forms and phrases of them.
LEMMA_TERMS = ((0, "asgaes"), (1, "orrest"), (2, "die"), (3, "hehely"), (4, "orreti asgado"), (5, "et"), (6, "des der"), (7, "las der"))

#: (path, fallback, counted words) of a segment's size.
TOTALS = (("Biology_5_35834.docx", None, 10), ("x_7", 99, 10), ("x_0.docx", 99, 10), ("x_12.tar.gz", 55, 10), ("/a_9/b.docx", 0, 0), ("plain.docx", None, 42))
