from __future__ import annotations

import random

import pytest

from lexweave.config import EngineConfig
from lexweave.functions.normalize import fold
from lexweave.functions.tokens import Analyzer
from lexweave.operators import contexts as K
from lexweave.operators import match as M
from lexweave.operators import spans as S
from lexweave.operators import words as W
from lexweave.operators.debug import debug_term
from lexweave.operators.relational import merge_dataframes
from lexweave.plans.dynamics import term_dynamics

ANALYZER = Analyzer(replacements={"дополни": "дополнить", "дополнить": "дополнять", "санктпетербург": "Санкт-Петербург"})


def corpus(spark, *texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id int, segment string, text string")


def count(spark, text, pattern, **options):
    patterns = spark.createDataFrame([(pattern, len(pattern.split()))], "pattern string, k int")
    return M.matches(W.tokenized(corpus(spark, text)), patterns, ANALYZER, **options).count()


@pytest.mark.parametrize(
    ("text", "pattern", "strict", "soft"),
    [("ядро , клетка", "ядро клетка", 0, 1), ("ядро в клетка", "ядро клетка", 0, 0), ("ядро ядро ядро", "ядро ядро", 2, 2), ("ядро ядро ядро", "ядро", 3, 3), ("дополни", "дополнить", 1, 1), ("", "ядро", 0, 0)],
)
def test_adjacency(spark, text, pattern, strict, soft):
    assert count(spark, text, pattern) == strict
    assert count(spark, text, pattern, allow_punct_between=True) == soft


def test_hyphens(spark):
    assert count(spark, "ядро - клетка", "ядро") == 1
    assert count(spark, "ядро - клетка", "ядро", disallow_hyphen_adjacent_for_unigrams=True) == 0
    assert count(spark, "ядро - клетка", "ядро клетка", allow_punct_between=True, disallow_hyphen_adjacent_for_unigrams=True) == 1
    assert count(spark, "ядро-клетка", "ядро-клетка", disallow_hyphen_adjacent_for_unigrams=True) == 0


def test_replacement_is_one_step_and_keeps_case(spark):
    terms = spark.createDataFrame([(0, "Дополни"), (1, "санктпетербург"), (2, "в на"), (3, None)], "term_id int, term string")
    got = {r["term_id"]: (r["pattern"], r["k"]) for r in W.term_patterns(terms, ANALYZER).collect()}
    assert got == {0: ("дополнить", 1), 1: ("Санкт-Петербург", 1), 2: ("", 0), 3: ("", 0)}


def test_matches_against_naive(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ядро", "клетка", "лист", ",", "-", "в", "и"]) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    done = W.tokenized(corpus(spark, *texts))
    pats = [("ядро", 1), ("ядро клетка", 2), ("лист ядро клетка", 3), ("лист лист", 2)]
    patterns = spark.createDataFrame(pats, "pattern string, k int")
    for soft in (False, True):
        got = sorted((r["doc_id"], r["pattern"], r["first_tok"], r["last_tok"]) for r in M.matches(done, patterns, ANALYZER, allow_punct_between=soft).collect())
        want = []
        for d, text in enumerate(texts):
            toks = text.split()
            words = [(i, t) for i, t in enumerate(toks) if t not in (",", "-", "в", "и")]
            for pattern, k in pats:
                for j in range(len(words) - k + 1):
                    part = words[j : j + k]
                    between = [toks[x] for a, b in zip(part, part[1:]) for x in range(a[0] + 1, b[0])]
                    if " ".join(w for _, w in part) == pattern and (not between or (soft and all(b in (",", "-") for b in between))):
                        want.append((d, pattern, part[0][0], part[-1][0]))
        assert got == sorted(want)


def test_merge_spans(spark):
    rng = random.Random(2)
    groups = {0: [(0, 5), (3, 8), (10, 15)], 1: [(0, 5), (5, 7)]} | {g: [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 40) for _ in range(12))] for g in range(2, 12)}
    df = spark.createDataFrame([(g, a, b) for g, s in groups.items() for a, b in s], "g int, start int, end int")
    got: dict[int, list] = {}
    for r in S.merge_spans(df, "g").orderBy("g", "start").collect():
        got.setdefault(r["g"], []).append((r["start"], r["end"]))
    for g, spans in groups.items():
        want: list = []
        for a, b in sorted(spans):
            if want and a <= want[-1][1]:
                want[-1] = (want[-1][0], max(b, want[-1][1]))
            else:
                want.append((a, b))
        assert got[g] == want


def test_runs_and_markup(spark):
    texts = spark.createDataFrame([(0, "a🙂bcd"), (1, "none"), (2, "")], "g int, text string")
    spans = spark.createDataFrame([(0, 0, 2), (0, 3, 4)], "g int, start int, end int")
    cut = S.runs(texts, spans, "g")
    assert [tuple(r) for r in cut.orderBy("g", "run_idx").collect()] == [(0, 0, "a🙂", True), (0, 1, "b", False), (0, 2, "c", True), (0, 3, "d", False), (1, 0, "none", False)]
    assert {r["g"]: r["text"] for r in S.markup(cut, "g").collect()}[0] == "<mark>a🙂</mark>b<mark>c</mark>d"


def test_context_cap_and_clipping(spark):
    done = W.tokenized(corpus(spark, " ".join(["ядро"] * 25)))
    hits = M.matches(done, spark.createDataFrame([("ядро", 1)], "pattern string, k int"), ANALYZER, around=2)
    rows = K.contexts(hits, window=2, cap=20).orderBy("match_no").collect()
    assert hits.count() == 25 and len(rows) == 20
    assert rows[0]["context"] == "ядро ядро ядро" and rows[5]["context"] == " ".join(["ядро"] * 5)


def test_scope(spark):
    docs = corpus(spark, "лист\nядро")
    patterns = spark.createDataFrame([("лист ядро", 2)], "pattern string, k int")
    assert M.matches(W.tokenized(docs), patterns, ANALYZER).count() == 1
    assert M.matches(W.tokenized(W.blocks(docs), "doc_id", "block_id"), patterns, ANALYZER, "doc_id", "block_id").count() == 0


def test_dynamics(spark):
    docs = spark.createDataFrame([(5, "a", "ядро лист ядро", "x_1000.docx"), (6, "b", "лист", "y.docx")], "segment int, doc_id string, text string, path string")
    terms = spark.createDataFrame([(0, "ядро"), (1, "и ядро"), (2, "в"), (3, "лист ядро")], "term_id int, term string")
    config = EngineConfig(segments=(5, 6, 7), fallback_totals={6: 50})
    result = term_dynamics(docs, terms, config, ANALYZER)
    rows = [tuple(r) for r in result.table.orderBy("term_id").collect()]
    assert rows[0] == (0, "ядро", 2, 0, 0, 2000.0, 0.0, 0.0)
    assert rows[1][2:5] == (2, 0, 0) and rows[2][2:5] == (0, 0, 0) and rows[3][2:5] == (1, 0, 0)
    assert {r["segment"]: r["total"] for r in result.totals.collect()} == {5: 1000, 6: 50}
    assert {r["term"] for r in result.log.where("pattern = 'ядро'").collect()} == {"ядро | и ядро"}
    assert result.empty_patterns.first()[0] == 1


def test_debug(spark):
    found = debug_term(spark, "ядро лист", "ядро лист, ядро", ANALYZER)
    assert (found.pattern, found.k, found.count) == ("ядро лист", 2, 1)
    assert found.tokens.count() == 2
    empty = debug_term(spark, "в", "ядро лист", ANALYZER)
    assert empty.hits is None and empty.tokens.count() == 2


def test_left_merge(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (None, 7, "z")], "id int, n int, v string")
    got = sorted((r["k"] if r["k"] is not None else -1, r["v_x"], r["n"], r["v_y"]) for r in merge_dataframes(left, right, "k", "id").collect())
    assert [g[1:] for g in got if g[0] == 1] == [("a", 5, "x"), ("a", 6, "y")]
    assert ("", 0, "") in [g[1:] for g in got] and ("c", 7, "z") in [g[1:] for g in got]


def test_plan_reads_once_and_broadcasts(spark):
    docs = corpus(spark, "ядро лист")
    patterns = spark.createDataFrame([("ядро", 1), ("ядро лист", 2)], "pattern string, k int")
    plan = M.count_hits(M.matches(W.tokenized(docs), patterns, ANALYZER), "segment")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning(segment") == 1
    assert fold("cell") == "сеll"


def test_offsets_of_long_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ядро", "a", " ", "  ", "\n", "🙂", ",", "й", "25"]) for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 700)]
    rows = W.token_table(corpus(spark, *texts), ANALYZER).collect()
    norm = {r["doc_id"]: r["norm"] for r in W.tokenized(corpus(spark, *texts)).collect()}
    assert len(rows) > 400 and all(norm[r["doc_id"]][r["start"] : r["end"]] == r["text"] for r in rows)
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["tok_idx"])):
        by.setdefault(r["doc_id"], []).append(r)
    for own in by.values():
        assert [r["tok_idx"] for r in own] == list(range(len(own))) and all(a["end"] <= b["start"] for a, b in zip(own, own[1:]))
    patterns = spark.createDataFrame([("ядро", 1), ("ядро ядро", 2)], "pattern string, k int")
    for soft in (False, True):
        hits = M.matches(W.tokenized(corpus(spark, *texts), offsets=True), patterns, ANALYZER, spans=True, allow_punct_between=soft).collect()
        assert hits and all((h["start"], h["end"]) == (by[h["doc_id"]][h["first_tok"]]["start"], by[h["doc_id"]][h["last_tok"]]["end"]) for h in hits)


def test_counts_and_totals_read_texts_once(spark, tmp_path):
    docs = corpus(spark, "ядро лист, ядро", "", None, "и в 25")
    docs.write.parquet(str(tmp_path / "docs"))
    patterns = spark.createDataFrame([("ядро", 1), ("лист ядро", 2)], "pattern string, k int")
    counts, totals = M.counts_and_totals(W.tokenized(spark.read.parquet(str(tmp_path / "docs"))), patterns, ANALYZER)
    both = counts.join(totals, "segment")
    assert [tuple(r) for r in both.collect()] == [("s", "ядро", 2, 3)]
    final = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_log_order(spark):
    texts = ["лист ядро лист", "ядро лист ядро лист"]
    hits = M.matches(W.tokenized(corpus(spark, *texts)), spark.createDataFrame([("ядро", 1), ("лист", 1), ("ядро лист", 2)], "pattern string, k int"), ANALYZER, around=3)
    terms = spark.createDataFrame([("ядро", "ядро")], "pattern string, terms string")
    log = K.in_log_order(K.context_log(K.contexts(hits, window=3, cap=2), terms)).collect()
    assert [(r["pattern"], r["doc_id"], r["start_tok_idx"], r["match_no"]) for r in log] == [("лист", 0, 0, 1), ("лист", 0, 2, 2), ("ядро", 0, 1, 1), ("ядро", 1, 0, 2), ("ядро лист", 0, 1, 1), ("ядро лист", 1, 0, 2)]
