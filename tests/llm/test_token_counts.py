from __future__ import annotations

import random

import public_tokenizers

from lexweave.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, scores):
    """Pieces of the best segmentation of one word, over all ends, without any sharing."""
    table = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        ways = [(table[i - 1][0] + size * T.BYTE_SCORE, -(table[i - 1][1] + size))]
        ways += [(table[j][0] + scores[word[j:i]], -(table[j][1] + 1)) for j in range(i) if word[j:i] in scores]
        top = max(ways)
        table.append((top[0], -top[1]))
    return table[-1][1]


def test_counts_against_brute_force(spark, monkeypatch):
    scores, rng = T.vocabulary(PATH), random.Random(1)
    texts = [" ".join("".join(rng.choice("thereinga") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += [None, "", " \n ", "漢字🙂 é", "x" * 700, texts[0], "a\n\nb  c\td ▁ ", "    indent\r\n"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in T.count_tokens(df, PATH).collect()}
    assert got == {i: (len(T.pretokens(t)), sum(brute(w, scores) for w in T.pretokens(t))) for i, t in enumerate(texts)}
    assert all("".join(T.pretokens(t)) == (T.SPACE + t.replace(" ", T.SPACE) if t else "") for t in texts)
    assert T.pretokens("a\n\nb  c") == ["▁a", "\n\n", "b", "▁▁c"]
    assert T.count_tokens(df.where("false"), PATH).count() == 0
    monkeypatch.setattr(T, "MAX_NODES", 20)
    trie = T.ForwardTrie(scores)
    assert all(trie.count(w) == brute(w, scores) for w in "there thereof other in inner gain again".split())
