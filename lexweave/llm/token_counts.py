"""Token counts by dynamic programming over a trie.

A text, with a space put before it and spaces written as marks, is cut into pre-tokens that tile it: a word with the
marks before it, marks that no word follows, and other white space. The distinct pre-tokens go into a trie. A node stands for a prefix and holds the forward score of its best segmentation into pieces
of the vocabulary (the largest sum of unigram scores) and the number of those pieces; it is computed once, from the
nodes above it, for all pre-tokens that share the prefix. The node at which a pre-token ends holds its count, and a text
has the sum of the counts of its pre-tokens.

The vocabulary is a sentencepiece model, read on the driver and broadcast (its size is fixed by the file). The scores of
a unigram model are used as they are. A BPE model has ranks instead of scores; its pieces get the logarithm of the
probability that Zipf's law gives their rank. Characters without a piece count as their bytes.

Edge cases: null and empty texts have no tokens; white space counts like any other characters; a pre-token beyond MAX_WORD characters is
scored in the same way outside the trie, so no text fills it; rows are independent, so repeated rows and ties change
nothing (equal scores: fewer pieces); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lexweave.llm.common import map_batches

#: The mark of a space before a pre-token (fixed value of the format).
SPACE = "▁"

PRETOKEN = re.compile(rf"{SPACE}*[^{SPACE}\s]+|{SPACE}+|\s+")

#: Nodes of a worker's trie, at most; it is then begun anew. Characters of the longest pre-token that goes into it.
MAX_NODES, MAX_WORD = 1_000_000, 256

#: Score of a byte that stands for part of a character without a piece.
BYTE_SCORE = -12.0


def pretokens(text: str | None) -> list[str]:
    return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and their unigram scores; control, unknown, byte and unused pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids}
    if all(float(s).is_integer() for s in scores.values()):  # ranks of a BPE model
        total = math.log(sum(1 / (r + 2) for r in range(len(scores))))
        order = sorted(scores, key=lambda piece: (-scores[piece], piece))
        scores = {piece: -math.log(r + 2) - total for r, piece in enumerate(order)}
    return scores


class ForwardTrie:
    """Forward scores and piece counts of pre-tokens, shared by prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self._begin()

    def _begin(self) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.pieces: list[int] = [0]

    def _step(self, word: str, i: int, best: list[float], pieces: list[int]) -> tuple[float, int]:
        """Score and count of the prefix of length i from those of shorter prefixes, in the order of length."""
        size = len(word[i - 1].encode("utf-8", "surrogatepass"))
        top, n = best[i - 1] + size * BYTE_SCORE, pieces[i - 1] + size
        for j in range(max(0, i - self.longest), i):
            score = self.scores.get(word[j:i])
            if score is not None:
                score += best[j]
                if score > top or (score == top and pieces[j] < n - 1):
                    top, n = score, pieces[j] + 1
        return top, n

    def count(self, word: str) -> int:
        if len(word) > MAX_WORD:
            return self._alone(word)
        if len(self.kids) > MAX_NODES:
            self._begin()
        node, best, pieces = 0, [0.0], [0]
        for i, c in enumerate(word, 1):
            child = self.kids[node].get(c)
            if child is None:
                child = self.kids[node][c] = len(self.kids)
                top, n = self._step(word, i, best, pieces)
                self.kids.append({})
                self.best.append(top)
                self.pieces.append(n)
            node = child
            best.append(self.best[node])
            pieces.append(self.pieces[node])
        return self.pieces[node]

    def _alone(self, word: str) -> int:
        best, pieces = [0.0], [0]
        for i in range(1, len(word) + 1):
            top, n = self._step(word, i, best, pieces)
            best.append(top)
            pieces.append(n)
        return pieces[-1]


class Counts(dict):
    """Counts of the distinct pre-tokens that a worker has met, filled from the trie."""

    def __init__(self, trie: ForwardTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_NODES // 4:
            self.clear()
        value = self[word] = self.trie.count(word)
        return value


def count_tokens(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(ForwardTrie(shared.value))
        for batch in batches:
            words = [pretokens(text) for text in batch.column("text").to_pylist()]
            found = [sum(map(counts.__getitem__, own)) for own in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint")
