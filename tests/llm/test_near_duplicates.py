from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

from lexweave.llm import near_duplicates as D
from lexweave.llm.signature_tree import SignatureJoin

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, size, percent):
    """component and set size of each row by all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").translate(lower).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted((a, len(s), find(a)) for (a, _), s in zip(rows, sets) if a is not None)


def corpus(seed, n, low, high):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.randint(low, high))]
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(base) // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts[:n]


@pytest.mark.parametrize(
    ("size", "percent", "low", "high", "run_tokens", "seen", "hot"),
    [(3, 90, 1, 40, 10**6, 6, 10**3), (5, 80, 5, 200, 10**6, 3, 2), (3, 90, 60, 200, 900, 10**6, 2), (5, 80, 20, 120, 500, 2, 10**3)],
)
def test_components_against_all_pairs(spark, monkeypatch, size, percent, low, high, run_tokens, seen, hot):
    monkeypatch.setattr(D, "SEEN", seen)  # a small corpus: what few texts share is common, and few links make a hot centre
    monkeypatch.setattr(D, "HOT_DEGREE", hot)
    texts = corpus(size * percent + low, 120, low, high)
    rows = [(i * 3 % 121, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, " \n"), (203, "One Two"), (204, "one two"), (205, "one"), (None, "one two")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 AS node", "2 AS block", "3 AS n", "4 AS token", "5 AS component_id")
    got = D.link_documents(df, size=size, percent=percent, run_tokens=run_tokens).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute(rows, size, percent)


def test_repeated_ids_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (7, a), (7, b), (9, b), (9, b), (11, "alone in the world")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((r["doc_id"], r["component_id"]) for r in D.link_documents(df, size=3, percent=90).collect())
    assert got == [(5, 5), (7, 5), (7, 5), (9, 5), (9, 5), (11, 11)]
    kept = D.keep_one(df, size=3, percent=90)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 11]
    assert D.keep_one(df.where("false"), size=3, percent=90).count() == 0


def test_linked_sets_share_kept_tokens():
    rng = np.random.default_rng(1)
    for percent in (50, 80, 90, 100):
        bounds, linked = D.Bounds(percent), 0
        for _ in range(3000):
            n = int(rng.integers(1, 60 if rng.random() < 0.5 else 400))
            a = rng.permutation(2000)[:n]
            b = np.concatenate([a[: int(rng.integers(n * percent // 100, n + 1))], 5000 + rng.permutation(2000)[: int(rng.integers(0, 1 + n * (100 - percent) // 100))] - rng.integers(0, 2) * 5000])
            a, b = np.unique(a), np.unique(b)  # in order
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                linked += 1
                share = len(np.intersect1d(a[: bounds.kept(len(a))], b[: bounds.kept(len(b))]))
                assert share >= max(bounds.least(len(a)), bounds.least(len(b))) >= 1
        assert linked > 300


def test_shared_passages_name_no_tokens(spark):
    """Texts that share half of their words are in no block, those that link are."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(10**9)}" for _ in range(60))]) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[3] + " more"])], "doc_id bigint, text string")
    classes = spark.createDataFrame([(i, len(t.split()) - 4) for i, t in enumerate([*texts, texts[3] + " more"])], "rep bigint, n_shingles bigint")
    got = D.candidate_edges(df, classes, np.empty(0, np.uint64), size=5, percent=80).collect()
    assert {tuple(r) for r in got} == {(40, 3)}


def test_pivots_meet_in_bounded_units(spark):
    from pyspark.sql import functions as F

    placed = spark.range(40_000).select((F.col("id") % 2).alias("block"), F.col("id").alias("node"), F.lit(20).alias("n"), F.lit(b"").alias("hashes"))
    units = D.pivots(placed, 10_000).groupBy("block", "i", "j").count().collect()
    by_level = {level: [r["count"] for r in units if r["block"] == 0 and r["i"] == -level] for level in (1, 2, 3)}
    assert len(by_level[1]) > 1 and len(by_level[2]) == 1 and not by_level[3]
    assert all(r["count"] * 20 < 1.3 * 10_000 for r in units) and sum(r["count"] for r in units) < 10_000


def test_keep_one_with_clashing_columns_and_ties(spark):
    text = " ".join(f"a{i}" for i in range(30))
    names = ("maybe", "n", "component_id", "_id", "id", "row", "empty", "n_shingles", "_bits")
    rows = [(5, text, "x"), (7, text, "y"), (9, "b " + text, "w"), (9, "b " + text, "v"), (9, "", "u"), (None, text, "t"), (11, None, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string").selectExpr("*", *(f"k AS {name}" for name in names))
    kept = D.keep_one(df.where("doc_id <> 7 or doc_id is null"), size=5, percent=80)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["k"], r["maybe"], r["component_id"]) for r in kept.collect()) == [(0, *"ttt"), (5, *"xxx"), (9, *"uuu"), (11, *"sss")]
    two = D.keep_one(df.where("doc_id in (9, 11)"), size=5, percent=80)
    assert sorted((r["doc_id"], r["k"]) for r in two.collect()) == [(9, "u"), (9, "v"), (11, "s")]


def test_signature_tree_against_all_pairs():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 5000, 60)
        for _ in range(int(rng.integers(1, 6))):
            sets.append(np.unique(np.concatenate([base[: int(rng.integers(50, 61))], rng.integers(0, 5000, int(rng.integers(0, 5)))])).astype(np.uint64))
    join = SignatureJoin(85)
    tree = join.tree(list(enumerate(sets)))
    join.join(tree, tree)
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert [join.forest.find(i) for i in range(len(sets))] == up


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage in plain Python over a small folder of tables."""
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline
    from lexweave.llm import decontamination, personal_data

    texts = corpus(77, 60, 60, 140)
    item = " ".join(f"bench{i}" for i in range(12))
    texts += [texts[0] + " " + item, "mail me@x.com now " + texts[1][::-1], "short", None, "### " * 100]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = {i: t for i, t in enumerate(texts) if t and len(t.split()) >= 50 and "###" not in t}
    component = {i: c for i, _, c in brute(list(docs.items()), 5, 80)}
    docs = {i: t for i, t in docs.items() if component[i] == i}
    automaton = decontamination.SuffixAutomaton({"1": [item.encode().split()]})
    model = personal_data.fit(spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id bigint, text string"))
    for i, t in docs.items():
        spans, _ = automaton.scan(decontamination.words_of(t))
        for s in reversed(decontamination.char_spans(t, spans)):
            t = t[: s["start"]] + t[s["end"] :]
        docs[i] = personal_data.redacted(t, personal_data.final_spans(t, model))
    assert {i: r["text"] for i, r in got.items()} == docs
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in got.values())
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_over_odd_tables(spark, tmp_path):
    """No rows at all; then repeated and null ids, null columns and columns named like those of the stages."""
    import corpus_pipeline

    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    for name in ("none", "odd"):
        benchmark.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "text"]
    a, b = (" ".join(f"{c}{i}" for i in range(70)) for c in "ab")
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, b, None, None), (2, a, "en", "s"), (None, b + " more", "en", None), (None, None, None, None), (3, b, "en", "s"), (4, "", "en", "s")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    for name in ("row", "maybe", "n", "n_words", "kept", "spans", "component_id", "x"):
        df = df.selectExpr("*", f"'{name}' AS {name}")
    df.write.parquet(str(tmp_path / "odd/documents.parquet"))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
    assert got == [(0, b + " more"), (1, a)]  # 1, 2 and 3 are one group; a row without an id stays
    kept = corpus_pipeline.near_duplicates(spark, df, str(tmp_path / "odd"))
    assert kept.dtypes == df.dtypes and kept.count() == 4
