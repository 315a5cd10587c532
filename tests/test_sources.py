from __future__ import annotations

import csv
from pathlib import Path

import pytest

from lexweave.cli import load_config, main, report
from lexweave.config import EngineConfig
from lexweave.plans.dynamics import run
from lexweave.sources import ooxml as X
from lexweave.sources.lists import read_replacements, read_stopwords
from lexweave.sources.readers import load_dataframe, read_terms


def test_docx_round_trip():
    content = X.make_docx(["Первый абзац", "  ", "Второй"], [[["a", " "], ["b", "c"]]])
    assert X.docx_text(content) == "Первый абзац\nВторой\na\nb c"
    marked = X.highlighted_docx(content, {0: [(0, 6)]})
    assert X.docx_text(marked) == X.docx_text(content)
    assert X.highlighted_docx(content, {}) != b"" and X.RED.encode() in __import__("zipfile").ZipFile(__import__("io").BytesIO(marked)).read(X.BODY)


def test_xlsx_round_trip():
    content = X.make_xlsx(["t", "n"], [("a", 1), (None, 2.5), ("b<&", None)], "Лист")
    assert X.xlsx_rows(content) == [["t", "n"], ["a", 1], [None, 2.5], ["b<&", None]]
    assert X.first_column([[1], [2]]) == ["1", "2"]
    assert X.first_column([[1], []]) == ["1.0", "nan"]


def test_lists(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a: b\n c :d: e \nnone\na: z\n", encoding="utf-8")
    assert read_replacements(spark, str(tmp_path / "r.txt")) == {"a": "z", "c": "d: e"}
    (tmp_path / "s.txt").write_text(" x \n\ny\nx\n", encoding="utf-8")
    assert sorted(r[0] for r in read_stopwords(spark, str(tmp_path / "s.txt")).collect()) == ["x", "y"]


def test_terms_and_tables(spark, tmp_path):
    (tmp_path / "d.xlsx").write_bytes(X.make_xlsx([], [("клетка",), (" ядро ",), ("клетка",), ("nan",)]))
    assert [tuple(r) for r in read_terms(spark, str(tmp_path / "d.xlsx")).orderBy("term_id").collect()] == [(0, "клетка"), (1, "ядро")]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n", encoding="utf-8")
    assert [tuple(r) for r in load_dataframe(spark, str(tmp_path / "t.csv")).collect()] == [(1, "x")]
    (tmp_path / "t.xlsx").write_bytes(X.make_xlsx(["a", "b"], [(1, "x"), (2, None)]))
    assert load_dataframe(spark, str(tmp_path / "t.xlsx")).count() == 2
    with pytest.raises(FileNotFoundError):
        load_dataframe(spark, str(tmp_path / "no.csv"))
    (tmp_path / "t.bin").write_text("")
    with pytest.raises(ValueError):
        load_dataframe(spark, str(tmp_path / "t.bin"))


def test_full_run_writes_files(spark, tmp_path):
    (tmp_path / "dict.xlsx").write_bytes(X.make_xlsx([], [("ядро",), ("лист ядро",)]))
    (tmp_path / "b_5_100.docx").write_bytes(X.make_docx(["ядро и лист ядро", "нет"]))
    (tmp_path / "c.docx").write_bytes(X.make_docx(["пусто"]))
    config = EngineConfig(segments=(5, 6), documents={5: str(tmp_path / "b_5_100.docx"), 6: str(tmp_path / "c.docx")}, dictionary=str(tmp_path / "dict.xlsx"), output=str(tmp_path / "out"))
    run(spark, config)
    rows = X.xlsx_rows((tmp_path / "out/dynamics.xlsx").read_bytes())
    assert rows == [["Термин", "КВ 5 класс", "КВ 6 класс", "НЧ 5 класс", "НЧ 6 класс"], ["ядро", 2, 0, 20000, 0], ["лист ядро", 1, 0, 10000, 0]]
    raw = (tmp_path / "out/grade_5_contexts.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and not (tmp_path / "out/grade_6_contexts.csv").exists()
    log = list(csv.reader(raw.decode("utf-8-sig").splitlines()))
    assert log[0][4] == "Match#" and len(log) == 4
    assert sorted(p.name for p in Path(tmp_path / "out").glob("*.docx")) == ["b_5_100 — термины.docx", "c — термины.docx"]
    with pytest.raises(FileNotFoundError):
        run(spark, EngineConfig(segments=(5,), documents={5: "/no/file.docx"}, dictionary=config.dictionary))


def test_command_line(spark, tmp_path, capsys):
    assert main(["--config"]) == 0 and "segments" in capsys.readouterr().out
    (tmp_path / "c.json").write_text('{"segments": [1], "documents": {"1": "/no/x.docx"}}')
    assert load_config(str(tmp_path / "c.json")).problems() == ["document of segment 1 not found: /no/x.docx"]
    assert "hits: 1" in report(spark, "ядро", "одно ядро", EngineConfig())


def test_streaming(spark, tmp_path):
    from lexweave.functions.tokens import Analyzer
    from lexweave.streaming.counts import running_counts

    spark.createDataFrame([(1, "s", "ядро лист ядро")], "doc_id int, segment string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, segment string, text string").parquet(str(tmp_path / "in"))
    counts = running_counts(stream, spark.createDataFrame([("ядро", 1)], "pattern string, k int"), Analyzer())
    query = counts.writeStream.outputMode("complete").format("memory").queryName("term_counts").start()
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("term_counts").collect()] == [("s", "ядро", 2)]
    finally:
        query.stop()
