"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text is not split beforehand: it is halved, and halved again, to leaves of a few thousand characters wherever the
cuts fall. The leaves are encoded on their own, and the halves are put together up the tree. At each join a window
around the cut is encoded again, and grows until both sides agree exactly with it:

- where the window starts and ends at a place at which the tokenizer splits any text (white space after something
  else, or a change between ASCII letters, digits and other signs), the tokens outside it cannot depend on the cut;
- inside a long run of one kind of character, which is one piece for the merges, the window is made of whole tokens of
  both sides, and it agrees if its first and last tokens come out as they were: a sequence of byte-pair tokens is the
  encoding of its text exactly if each two neighbours are, and every two neighbours then come from an encoding.

A window that reaches both ends of its halves is simply their encoding, so the result is exact for any text. Texts over
`task_bytes` have their parts encoded in several tasks.

The vocabulary is read from a tokenizer file of the tokenizers library on the driver and broadcast (a few MB).

Edge cases: null and empty texts have no tokens; the special token in a text is that token, as in the library; rows are
independent, so repeated rows and ties change nothing; extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexweave.llm.common import ROW, field_of, map_batches, written

#: Characters of a leaf of the tree.
LEAF = 2048

#: A window grows by characters up to this reach before it is tried inside a run.
REACH = 256

#: Bytes of a text from which its parts are dealt to several tasks, and characters of such a part.
TASK_BYTES, TASK_CHARS = 1 << 20, 1 << 18

#: Characters that both libraries surely class alike; a leaf with others is encoded by the slower one.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e¡-¬®-ɏ]*")

#: The pattern of byte-level BPE (fixed value, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary, from the text of its tokenizer file."""

    def __init__(self, tokenizer_json: str, leaf: int = LEAF):
        spec = json.loads(tokenizer_json)
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        plain = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
        self.tokenizer_json = tokenizer_json
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.divider = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.leaf = leaf

    @cached_property
    def slow(self) -> Tokenizer:
        """Made for the first text that needs it."""
        return Tokenizer.from_str(self.tokenizer_json)

    def _direct(self, text: str) -> list[int]:
        """Encoding of a short text without special tokens."""
        if PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for start, end, special in self.sections(text):
            out += self.concatenated(text, self.leaves(text, start, end)) if special is None else [special]
        return out

    def sections(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """(start, end, special token) of the consecutive sections of a text; None: text between special tokens."""
        at = 0
        for m in self.divider.finditer(text) if self.divider is not None else ():
            if m.start() > at:
                yield at, m.start(), None
            yield *m.span(), self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield at, len(text), None

    def leaves(self, text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, list[int]]]:
        """(start, end, tokens) of the leaves of text[start:end], halved until they are short."""
        cuts = [(start, len(text) if end is None else end)]
        while cuts[0][1] - cuts[0][0] > self.leaf:
            cuts = [half for a, b in cuts for half in ((a, (a + b) // 2), ((a + b) // 2, b))]
        return [(a, b, self._direct(text[a:b])) for a, b in cuts]

    def concatenated(self, text: str, parts: list[tuple[int, int, list[int]]]) -> list[int]:
        """Tokens of a text from those of its consecutive parts, joined in pairs up the tree."""
        while len(parts) > 1:
            paired = [self._joined(text, *parts[i], *parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = paired + parts[len(paired) * 2 :]
        return parts[0][2] if parts else []

    def _joined(self, text: str, start: int, cut: int, left: list[int], _: int, end: int, right: list[int]) -> tuple[int, int, list[int]]:
        if not left or not right:
            return start, end, left or right
        reach = 8
        while True:
            a = next((p for p in range(cut - 1, max(start, cut - reach), -1) if certain(text, p)), start if cut - reach <= start else None)
            b = next((p for p in range(cut, min(end, cut + reach)) if certain(text, p)), end if cut + reach >= end else None)
            if a is not None and b is not None:
                middle = self._direct(text[a:b])
                return start, end, left[: self._before(left, text[a:cut])] + middle + right[self._after(right, text[cut:b]) :]
            if reach >= REACH and (ids := self._in_run(text, start, cut, left, end, right)) is not None:
                return start, end, ids
            reach *= 2

    def _before(self, ids: list[int], tail: str) -> int:
        """How many tokens come before the bytes of tail at the end."""
        size, at = len(tail.encode()), len(ids)
        while size > 0:
            at -= 1
            size -= len(self.bytes_of[ids[at]])
        return at

    def _after(self, ids: list[int], head: str) -> int:
        """How many tokens the bytes of head take at the start."""
        size, at = len(head.encode()), 0
        while size > 0:
            size -= len(self.bytes_of[ids[at]])
            at += 1
        return at

    def _in_run(self, text: str, start: int, cut: int, left: list[int], end: int, right: list[int]) -> list[int] | None:
        """The joined tokens if the cut is deep inside a run of one kind; None if no window inside the run agrees."""
        kind = kind_of(text[cut])
        if kind == "space" or kind_of(text[cut - 1]) != kind:
            return None
        before = after = 0
        while before < 8 * REACH and cut - before - 1 >= start and kind_of(text[cut - before - 1]) == kind:
            before += 1
        while after < 8 * REACH and cut + after < end and kind_of(text[cut + after]) == kind:
            after += 1
        # a side that ends inside the run may have its first or last character taken by its neighbour: stay off it
        room_left, room_right = len(text[cut - before + 2 : cut].encode()), len(text[cut : cut + after - 2].encode())
        k = 4
        while k <= min(len(left), len(right)):
            middle = b"".join(map(self.bytes_of.__getitem__, left[-k:] + right[:k]))
            if sum(len(self.bytes_of[i]) for i in left[-k:]) > room_left or sum(len(self.bytes_of[i]) for i in right[:k]) > room_right:
                return None
            try:
                again = self._direct(middle.decode())
            except UnicodeDecodeError:  # a token ends inside a character
                k += 1
                continue
            if again[0] == left[-k] and again[-1] == right[k - 1]:
                return left[:-k] + again + right[k:]
            k *= 2
        return None

    def decode(self, ids: list[int]) -> str:
        """The text of the tokens, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def kind_of(c: str) -> str:
    if c.isspace():
        return "space"
    category = unicodedata.category(c)[0]
    return category if category in "LN" else "other"


def certain(text: str, p: int) -> bool:
    """Whether the tokenizer starts a new piece at p, whatever stands around the two characters there."""
    x, y = text[p - 1], text[p]
    if x.isspace():
        return False
    if y in " \t\n\v\f\r":
        return True
    return x != "'" and x.isascii() and y.isascii() and not y.isspace() and kind_of(x) != kind_of(y)


def tokenizer_file(df: DataFrame, path: str):
    """Broadcast of the file's text: the size of a vocabulary, whatever the input."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


Finish = Callable[[Codec, list[int]], tuple]


def encode(documents: DataFrame, path: str, *keep: str, finish: Finish = lambda codec, ids: (ids,), columns: str = "ids array<int>", kinds: tuple = (pa.list_(pa.int32()),), task_bytes: int = TASK_BYTES, task_chars: int = TASK_CHARS) -> DataFrame:
    """The columns named by keep (doc_id first) and, of each text, what finish makes of its tokens: the ids themselves, or
    columns derived from them in the same worker, so that they need not travel."""
    shared = tokenizer_file(documents, path)
    kept = ["doc_id", *(c for c in keep if c != "doc_id")]
    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    head = ", ".join(f"`{c}` {fields[c]}" for c in kept)
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", columns)]

    def rows(before: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*found)) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([*before, *(pa.array(v, kind) for v, kind in zip(values, kinds))], names=[*kept, *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            yield rows([batch.column(c) for c in kept], [finish(codec, codec.encode(text)) for text in batch.column("text").to_pylist()])

    source = documents.select(*kept, "text") if "text" not in kept else documents.select(*kept)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    usual = map_batches(source.where(size <= task_bytes), short, f"{head}, {columns}")
    numbered = source.where(size > task_bytes).select(F.struct(*kept).alias(ROW), "text", F.monotonically_increasing_id().alias("number"))
    long = written(numbered, "long-texts")
    if long.isEmpty():
        return usual

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist()):
                for start, end, special in codec.sections(text):
                    for at in range(start, end, task_chars) if special is None else ():
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([at], pa.int64()), pa.array([text[at : min(end, at + task_chars)]])], names=["number", "at", "part"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            parts = batch.column("part").to_pylist()
            found = [codec.concatenated(part, codec.leaves(part)) for part in parts]
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("at"), pa.array(found, pa.list_(pa.int32()))], names=["number", "at", "tokens"])

    parts = map_batches(map_batches(long.select("number", "text"), cut, "number bigint, at bigint, part string").repartition("number", "at"), encoded, "number bigint, at bigint, tokens array<int>")
    # a document's tokens meet in one task, as they are one value of the result
    whole = parts.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            found = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
                ids, tokens = [], {p["at"]: p["tokens"] for p in parts or ()}
                for start, end, special in codec.sections(text):
                    own = [(at, min(end, at + task_chars), tokens[at]) for at in range(start, end, task_chars)] if special is None else ()
                    ids += codec.concatenated(text, own) if special is None else [special]
                found.append(finish(codec, ids))
            yield rows([field_of(batch, c) for c in kept], found)

    return usual.unionByName(map_batches(long.join(whole, "number", "left"), joined, f"{head}, {columns}"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded: doc_id, ids. doc_id and text."""
    shared = tokenizer_file(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
