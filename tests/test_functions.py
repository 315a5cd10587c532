from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import normalize as N
from lexweave.functions.tokens import Analyzer
from lexweave.operators import words as W


def one(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def test_accents(spark):
    source = ["ё й Й É ǎ ă ї ў ñ ø ß œ", "é й", None, ""]
    assert one(spark, source, N.remove_accents) == ["е й Й E a ă і ў n ø ß œ", "e й", None, ""]


def test_letters(spark):
    assert one(spark, ["2016", "13", "30 306", "Ёж", "\u03013", "é3 _3 ²3 -33"], N.replace_letters) == ["2О1б", "13", "ЗО ЗОб", "Еж", "\u0301З", "é3 _3 ²3 -З3"]


def test_order_of_invisible(spark):
    text = ["1​3"]
    assert one(spark, text, N.normalize_tokens) == ["1З"]
    assert one(spark, text, N.normalize_preprocess) == ["13"]


def test_remove_chars(spark):
    assert one(spark, ["a-b!c"], lambda c: N.remove_chars(c, "-!")) == ["a b c"]
    assert one(spark, ["a.b"], lambda c: N.remove_chars(c, "")) == ["a.b"]
    assert one(spark, ["and"], N.remove_special_chars) == ["  d"]
    assert one(spark, ['it\'s "x"'], N.remove_special_chars_soft) == ["it's  x "]


def test_filter_lemmas(spark):
    got = one(spark, ["мая клетка я он xiv hello ядро"], lambda c: F.array_join(N.filter_lemmas(F.split(c, " "), ["ядро"]), " "))
    assert got == ["клетка"]


def test_blank_and_strip(spark):
    assert one(spark, [None, "  \t\n", " a "], N.blank) == [True, True, False]
    assert one(spark, ["  a b \n"], N.strip) == ["a b"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abCEё03 6.,-­́é", max_size=30), min_size=1, max_size=20))
def test_letters_against_sequence(spark, texts):
    import re

    def naive(t):
        for a, b in zip(N.LATIN, N.CYRILLIC):
            t = t.replace(a, b)
        t = t.replace("ё", "е").replace("Ё", "Е")
        return re.sub(r"\b3", "З", t).replace("0", "О").replace("6", "б")

    assert one(spark, texts, N.replace_letters) == [naive(t) for t in texts]
    assert one(spark, texts, N.remove_accents) == [N.strip_accents(t) for t in texts]


def test_tokens_tile_the_text(spark):
    text = "Ядро клетки, 25 x-y — «да»!\nНовая 🙂 строка"
    df = spark.createDataFrame([(1, "s", text)], "doc_id int, segment string, text string")
    rows = W.token_table(df, Analyzer()).orderBy("tok_idx").collect()
    norm = one(spark, [text], N.normalize_tokens)[0]
    assert [norm[r["start"] : r["end"]] for r in rows] == [r["text"] for r in rows]
    assert [r["tok_idx"] for r in rows] == list(range(len(rows)))
    assert {r["text"]: r["lemma"] for r in rows}["клетки"] == "клетки"
    assert [r["pos"] for r in rows if r["text"] == "25"] == ["NUM"]


def test_total_words(spark):
    rows = [("Биология_5_35834.docx", None, 1), ("x_7", 9, 1), ("x_0.docx", 9, 1), ("x_12.tar.gz", 55, 1), ("/a_9/b.docx", 0, 0)]
    df = spark.createDataFrame(rows, "path string, fallback bigint, n bigint")
    assert [r[0] for r in df.select(W.total_words(F.col("path"), F.col("fallback"), F.col("n"))).collect()] == [35834, 7, 0, 55, 1]
