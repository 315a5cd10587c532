from __future__ import annotations

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.config import EngineConfig
from lexweave.functions.tokens import Analyzer
from lexweave.operators import match as M
from lexweave.operators import morphology as R
from lexweave.operators import preprocess as P
from lexweave.operators import stats as A
from lexweave.operators import words as W
from lexweave.operators.lexicon import Lexicon, compiled, read_lexicon
from lexweave.plans.dynamics import run, term_dynamics
from lexweave.sources import ooxml as X

HEADER = "word\tpos\traw\tnormal_form\ttags\tscore\n"
LINES = (
    "клетка\tNOUN\t\tклетка\tNOUN nomn\t0.9\n"
    "клетки\tNOUN\tклетка\tклетка\tNOUN gent\t0.6\n"
    "клеток\tNOUN\tклетка\tклетка\tNOUN gent\t0.9\n"
    "ядро\tNOUN\t\tядро\tNOUN nomn\t0.9\n"
    "ядра\tNOUN\tядро\tядро\tNOUN gent\t0.9\n"
    "жив\tADJ\tжив\tжив\tADJS masc\t0.6\n"
    "жив\tADJ\tжив\tживой\tADJF masc\t0.2\n"
    "живой\tADJ\t\tживой\tADJF masc\t0.9\n"
    "растёт\tVERB\tрасти\tрасти\tVERB impf\t0.9\n"
    "расти\tVERB\t\tрасти\tVERB impf\t0.9\n"
    "около\tADP\tоколо\tоколо\tPREP\t0.9\n"
    "анна\tPROPN\tанна\tанна\tNOUN Name\t0.9\n"
    "нуль\tNOUN\tнуль\tнуль\tNOUN\t0.0\n"
)


@pytest.fixture()
def lexicon_path(tmp_path):
    path = tmp_path / "lexicon.tsv"
    path.write_text(HEADER + LINES, encoding="utf-8")
    return str(path)


def docs(spark, *texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id int, segment string, text string")


def test_inflected_forms_hit_one_pattern(spark, lexicon_path):
    analyzer = Analyzer(lexicon=read_lexicon(spark, lexicon_path))
    texts = docs(spark, "Клетки и ядра клеток. Клетка растёт около клетки, жив!", None, "клетка-клетка")
    patterns = W.term_patterns(spark.createDataFrame([(0, "клетки"), (1, "ядро клетки"), (2, "живой"), (3, "около")], "term_id int, term string"), analyzer)
    assert {r["term_id"]: r["pattern"] for r in patterns.collect()} == {0: "клетка", 1: "ядро клетка", 2: "живой", 3: ""}
    counts, totals = M.counts_and_totals(W.tokenized(texts), patterns, analyzer)
    assert {r["pattern"]: r["cnt"] for r in counts.collect()} == {"клетка": 4, "ядро клетка": 1, "живой": 1}
    assert [r["total"] for r in totals.collect()] == [8]  # neither a conjunction nor a preposition is a word


def test_large_lexicon_is_joined_by_shuffle(spark, lexicon_path, monkeypatch):
    small = read_lexicon(spark, lexicon_path)
    large = Lexicon(small.forms, max_broadcast=2)
    monkeypatch.setattr(M, "MAX_FIRST_FORMS", 1)  # more forms than that: every token is tried
    texts, patterns = W.tokenized(docs(spark, "ядра клеток, клетки")), spark.createDataFrame([("ядро клетка", 2), ("клетка", 1)], "pattern string, k int")
    for lexicon in (small, large):
        got = {(r["pattern"], r["first_tok"], r["last_tok"]) for r in M.matches(texts, patterns, Analyzer(lexicon=lexicon)).collect()}
        assert got == {("ядро клетка", 0, 1), ("клетка", 1, 1), ("клетка", 3, 3)}


def test_full_run_with_a_lexicon(spark, tmp_path, lexicon_path):
    (tmp_path / "dict.xlsx").write_bytes(X.make_xlsx([], [("клетка",), ("ядро клетки",)]))
    (tmp_path / "b_5_100.docx").write_bytes(X.make_docx(["Ядра клеток растут", "клетки"], [[["клетку", " ядра клетки "], ["", "x"]]]))
    config = EngineConfig(segments=(5, 7), documents={5: str(tmp_path / "b_5_100.docx"), 7: str(tmp_path / "b_5_100.docx")}, dictionary=str(tmp_path / "dict.xlsx"), lexicon=lexicon_path, output=str(tmp_path / "out"))
    run(spark, config)
    assert X.xlsx_rows((tmp_path / "out/dynamics.xlsx").read_bytes())[1:] == [["клетка", 3, 3, 30000, 30000], ["ядро клетки", 2, 2, 20000, 20000]]
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out/dynamics.xlsx").read_bytes())) as z:
        assert 'name="Динамика 5-7"' in z.read("xl/workbook.xml").decode()
    log = list(csv.DictReader((tmp_path / "out/grade_7_contexts.csv").read_text(encoding="utf-8-sig").splitlines()))
    assert {r["Doc"] for r in log} == {"b_5_100.docx"} and {r["Grade"] for r in log} == {"7"}
    assert [(r["Pattern"], r["Match#"], r["Surface"]) for r in log] == [("клетка", "1", "клеток"), ("клетка", "2", "клетки"), ("клетка", "3", "клетки"), ("ядро клетка", "1", "Ядра клеток"), ("ядро клетка", "2", "ядра клетки")]
    marked = next((tmp_path / "out").glob("*.docx")).read_bytes()
    with zipfile.ZipFile(io.BytesIO(marked)) as z:
        body = X.ET.fromstring(z.read(X.BODY))
    red = ["".join(t.text for t in run.iter(f"{X.W}t")) for run in body.iter(f"{X.W}r") if run.find(f"{X.W}rPr/{X.W}color") is not None]
    assert red == ["Ядра клеток", "клетки", "ядра клетки"]  # the last one in a cell
    with pytest.raises(FileNotFoundError):
        run(spark, EngineConfig(segments=(5,), documents={5: config.documents[5]}, dictionary=config.dictionary, lexicon="/no/lexicon.tsv"))


def test_chosen_terms_alone_are_logged(spark):
    rows = spark.createDataFrame([(5, "a", "ядро лист ядро лист"), (6, "b", "лист")], "segment int, doc_id string, text string")
    terms = spark.createDataFrame([(0, "ядро"), (1, "лист")], "term_id int, term string")
    result = term_dynamics(rows, terms, EngineConfig(segments=(5, 6), debug_all_terms=False, debug_terms=("Лист", "дом")))
    assert sorted((r["segment"], r["pattern"], r["match_no"]) for r in result.log.collect()) == [(5, "лист", 1), (5, "лист", 2), (6, "лист", 1)]
    assert {r["term"]: r["cnt_5"] for r in result.table.collect()} == {"ядро": 2, "лист": 2}
    none = term_dynamics(rows, terms, EngineConfig(segments=(5,), debug_all_terms=False))
    assert none.log.count() == 0


def test_lemma_rules(spark, lexicon_path):
    parsed = compiled(spark.createDataFrame(
        [
            ("анна-мария", "PROPN", None, [("анна-мария", "анна-мария", ["NOUN", "Name"], 0.9)]),
            ("клетки", "NOUN", "клетка", [("клетки", "клетка", ["NOUN"], 0.6)]),
            ("клетка", None, None, [("клетка", "клетка", ["NOUN"], 0.9)]),
            ("нуль", None, None, [("нуль", "нуль", ["NOUN"], 0.0)]),
            ("около", "ADP", None, [("около", "около", ["PREP"], 0.9)]),
            ("слово", None, None, []),
        ],
        f"form string, pos string, raw string, parses array<{R.PARSE}>",
    ))
    lemma, pos, own = F.col("lemma"), F.col("pos"), F.col("lemma_parses")
    replacements = {"клетка": "ячейка", "ячейка": "нет"}
    rules = {"a": R.lemmatize_standard(lemma, pos, own, replacements), "b": R.lemmatize_standard(lemma, pos, own, replacements, skip_proper_nouns=False), "c": R.lemmatize_without_proper(lemma, pos, own, replacements)}
    text = "Анна-Мария: клетки, нуль около слово неведомое"
    got = P.lemma_lists(docs(spark, text, None, ""), parsed, Analyzer(), "doc_id", **rules).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, ["ячейка"], ["ячейка"], ["ячейка"]), (1, [], [], []), (2, [], [], [])]  # signs are blanked, so the name falls apart
    placed = parsed.select("form", *(rule.alias(name) for name, rule in rules.items()))
    assert {r["form"]: (r["a"], r["b"], r["c"]) for r in placed.collect()}["анна-мария"] == (None, "Анна-Мария", None)


def test_preprocess(spark, lexicon_path):
    parsed = compiled(spark.createDataFrame(
        [(w, None, None, [(w, w, ["NOUN"], 0.9)]) for w in ("клетка", "дом", "маи", "он", "мая")], f"form string, pos string, raw string, parses array<{R.PARSE}>"
    ))
    text = docs(spark, "Клетка, мая 25! ДОМ клетка; дом")
    words = lambda **options: P.preprocess(text, parsed, Analyzer(), **options).first()["words"]
    assert words(stopwords=["дом"]) == ["клетка", "клетка"]
    assert words() == ["клетка", "дом", "клетка", "дом"]
    assert words(standard=False) == ["клетка", "мая", "дом", "клетка", "дом"]


def test_numeric_or_zero(spark):
    df = spark.createDataFrame([("1.5", "x"), (None, "2"), ("1e3", "")], "a string, b string")
    assert [tuple(r) for r in A.numeric_or_zero(df, "a", "b").collect()] == [(1.5, 0.0), (0.0, 2.0), (1000.0, 0.0)]


def test_cells_are_joined_as_they_are():
    assert X.docx_text(X.make_docx([], [[[" a ", "b"], ["  ", "c "]]])) == " a  b\nc "


def test_windowed_stream(spark, tmp_path):
    from lexweave.streaming.counts import windowed_counts

    rows = [("s", "ядро лист ядро", "2024-01-01 00:00:10"), ("s", "ядро", "2024-01-01 00:05:00"), ("t", "лист", "2024-01-01 00:00:20")]
    source = spark.createDataFrame(rows, "segment string, text string, at string").selectExpr("segment", "text", "timestamp(at) AS at")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    counts = windowed_counts(stream, spark.createDataFrame([("ядро", 1)], "pattern string, k int"), Analyzer(), event_time="at", every="1 minute", late="10 minutes")
    query = counts.writeStream.outputMode("update").format("memory").queryName("windowed").start()
    try:
        query.processAllAvailable()
        assert sorted((r["window"]["start"].minute, r["segment"], r["cnt"]) for r in spark.table("windowed").collect()) == [(0, "s", 2), (5, "s", 1)]
    finally:
        query.stop()
