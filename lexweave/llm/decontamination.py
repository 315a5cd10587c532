"""Benchmark decontamination with a generalised suffix automaton.

Every benchmark item is normalised to words and inserted, item after item, in one suffix automaton. Training
tokens are streamed through it; the automaton keeps the longest suffix of the text read so far that is a
substring of some item. Where that length reaches `window`, all of its words are contaminated; an item shorter
than a window counts where all of it occurs.

The automaton is broadcast. Its size is proven before: items are dealt into blocks of at most
`max_block_words` words, each with its own automaton. With several blocks a task gathers texts of a bounded size and
runs them through one automaton after the other, so that it holds one at a time whatever the benchmark's size.

Edge cases: null and empty texts have no words; items with a null id or without words have no windows;
repeated items count once per id; an item longer than a block is a block of its own; texts are streamed whole, whatever
their length; extra columns are ignored, whatever their names; empty tables give empty results and no windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.llm.common import ROW, field_of, map_batches, quoted, whole_row

#: Words of an item that make up a window.
WINDOW = 10

#: Words of benchmark items in one broadcast automaton (some 100 MB in a Python worker at most).
MAX_BLOCK_WORDS = 100_000

#: Bytes of texts that a task gathers before it runs them through several automata.
GATHERED_BYTES = 16 << 20

#: A document with a larger part of its words in benchmark passages goes as a whole.
MAX_COVERAGE = 0.8

#: ASCII letters in lower case; every other ASCII character but digits becomes a space.
NORMALISE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    # split() knows only ASCII white space in bytes, so what stands between spaces is a word
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMALISE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items that own each window."""

    def __init__(self, items: dict[str, list[list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}
        texts = [(item, words) for item, lists in sorted(items.items()) for words in lists if words]
        for item, words in texts:
            last = 0
            for word in words:
                last = self._extend(last, word)
            if len(words) < window:
                ends.setdefault(last, set()).add(item)
        self.shortest = min([window, *(len(words) for _, words in texts)])
        self._own(texts)
        self._short(ends)

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and word not in nxt[at]:
            nxt[at][word] = state
            at = link[at]
        if at != -1:
            target = nxt[at][word]
            link[state] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return state

    def _split(self, at: int, word: bytes, target: int) -> int:
        """A copy of target that holds only its suffixes reachable from at."""
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[at] + 1)
        self.link[target] = copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _own(self, texts: list[tuple[str, list[bytes]]]) -> None:
        """owners: for each state, the items with the window that ends there; it hangs on the state of the window itself."""
        base = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            parent = self.link[state]
            base[state] = base[parent] if self.length[parent] >= self.window else state if self.length[state] >= self.window else 0
        own: dict[int, set[str]] = {}
        for item, words in texts:
            state = 0
            for n, word in enumerate(words, 1):
                state = self.next[state][word]
                if n >= self.window:
                    own.setdefault(base[state], set()).add(item)
        frozen = {state: frozenset(found) for state, found in own.items()}
        self.owners = [frozen.get(base[state], frozenset()) if base[state] else frozenset() for state in range(len(self.next))]

    def _short(self, ends: dict[int, set[str]]) -> None:
        """short: for each state, (length, items) of the short items that are a suffix of it."""
        self.short: list[tuple] = [()] * len(self.next)
        if ends:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                above = self.short[self.link[state]]
                self.short[state] = (*above, (self.length[state], frozenset(ends[state]))) if state in ends else above

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans [start, end) of contaminated words, and the items with a window in them."""
        nxt, link, length, owners, short, window, shortest = self.next, self.link, self.length, self.owners, self.short, self.window, self.shortest
        state = matched = 0
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for i, word in enumerate(words):
            to = nxt[state].get(word)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(word)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched < shortest:
                continue
            start = i + 1
            if matched >= window:
                start -= matched
                items |= owners[state]
            for size, which in short[state]:
                if size <= matched:
                    items |= which
                    start = min(start, i + 1 - size)
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def blocks(benchmark: DataFrame, max_block_words: int = MAX_BLOCK_WORDS) -> Iterator[dict[str, list[list[bytes]]]]:
    """The items as {id: texts of words}, in blocks of bounded size; an item is never divided."""
    block: dict[str, list[list[bytes]]] = {}
    size = 0
    for item, text in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct().toLocalIterator():
        words = words_of(text)
        if size and size + len(words) > max_block_words:
            yield block
            block, size = {}, 0
        block.setdefault(item, []).append(words)
        size += len(words)
    yield block


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word spans as code points [start, end) of the text."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans]


def loader(shared) -> Callable[[], SuffixAutomaton]:
    """Loads a broadcast automaton anew at each call, so that it is gone when the caller has done with it."""
    path = getattr(shared, "_path", None)
    return lambda: shared.load_from_path(path) if path else shared.value


def scanned(texts: list[list[bytes]], loaders: list[Callable[[], SuffixAutomaton]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Spans and items of each text over all automata, one of which is held at a time."""
    found: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
    for load in loaders:
        automaton = load()
        for words, (spans, items) in zip(texts, found):
            own, which = automaton.scan(words)
            spans += own
            items |= which
        del automaton
    return [(merged(spans) if len(loaders) > 1 else spans, items) for spans, items in found]


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of `least` bytes or more."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= least:
            yield group
            group, size = [], 0
    if group:
        yield group


def find_contamination(documents: DataFrame, benchmark: DataFrame, *keep: str, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS, gathered_bytes: int = GATHERED_BYTES) -> DataFrame:
    """Per row of documents: the columns named by keep (doc_id if none is), n_words, n_hit, items (sorted as strings) and
    spans (code points). The text is a column of its own, or part of ROW if that is kept.

    A window is `window` consecutive words of an item, or a whole shorter item; n_hit counts the words inside any
    occurrence of one.
    """
    spark = documents.sparkSession
    automata = [spark.sparkContext.broadcast(SuffixAutomaton(block, window)) for block in blocks(benchmark, max_block_words)]
    kept = keep or ("doc_id",)
    source = documents.select(*kept, *(["text"] if ROW not in kept else []))
    spans_type = "array<struct<start:bigint,end:bigint>>"
    schema = StructType([*documents.select(*kept).schema, *StructType.fromDDL(f"n_words bigint, n_hit bigint, items array<string>, spans {spans_type}")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(automata) == 1:
            one = automata[0].value
            loaders, least = [lambda: one], 0
        else:
            loaders, least = [loader(a) for a in automata], gathered_bytes
        for group in gathered(batches, least):
            texts = [(field_of(batch, "text") if ROW in kept else batch.column("text")).to_pylist() for batch in group]
            words = [words_of(text) for own in texts for text in own]
            results = iter(zip(words, scanned(words, loaders)))
            for batch, own in zip(group, texts):
                n_words, n_hit, items, spans = [], [], [], []
                for text, (words, (hit, which)) in zip(own, results):
                    n_words.append(len(words))
                    n_hit.append(sum(end - start for start, end in hit))
                    items.append(sorted(which))
                    spans.append(char_spans(text or "", hit))
                extra = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *extra], names=[*kept, "n_words", "n_hit", "items", "spans"])

    return map_batches(source, scan, schema)


def without_spans(text, spans):
    """Column: the text with the code points of sorted, disjoint spans taken out."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            (F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]) + 1).cast("int"),
            (F.coalesce(F.get(spans, i)["start"], F.char_length(text)) - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])).cast("int"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(gaps, ""))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """documents without contaminated passages: spans of `window` words or more (or whole short items) are cut out of
    the text, and a document with more than `max_coverage` of its words in them goes as a whole. Columns stay, whatever
    their names; others are untouched, n_chars (if there) follows the new text."""
    rows = documents.select(whole_row(documents))
    left = find_contamination(rows, benchmark, ROW, window=window).where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    new = left.withColumn("new_text", without_spans(F.col(f"{ROW}.text"), F.col("spans")))
    changed = {"text": F.col("new_text"), "n_chars": F.when(F.col("n_hit") > 0, F.char_length("new_text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col(f"{ROW}.n_chars")) if "n_chars" in documents.columns else None}
    return new.select(*((changed[c] if c in changed else F.col(f"{ROW}.{quoted(c)}")).alias(c) for c in documents.columns))
