"""Personal data by weak supervision.

Base patterns find email addresses, IP addresses, card and phone numbers exactly. Looser patterns propose further
candidates: other notations of these kinds, such numbers beside other digits, social security numbers and credentials. Labelers vote on each candidate
for, against or not at all: how strict its pattern is, a checksum or range test, gazetteers (top-level domains, card
issuers, names of keys), the words before it, words that speak against it, and whether it stands alone. Expectation
maximisation over the counts of vote patterns estimates for each kind how common true spans are and how reliable each
labeler is (Dawid and Skene), without labels. The resulting probabilities train a final span classifier, a logistic
regression over the votes and the shape of a candidate, which decides on all candidates beyond the base spans; base
spans always stay.

What the fit gathers from the corpus are counts of (kind, votes, shape), of which there can only be a fixed number,
whatever the input.

Positions are code points, end exclusive. Edge cases: null and empty texts have no spans; texts are read whole in
linear time, however long a span or however many candidates there are; rows are independent, so repeated rows and ties change nothing; without candidates no
span is added; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "secret")

# Base patterns. A lookbehind keeps a match from starting inside a run of digits, where it could only fail or has begun
# before; with possessive repeats every pattern reads a text once.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


# Patterns of further candidates: kind, strings of which each match holds one (a text without them is not searched), pattern,
# and what a match has to pass.
LOOSE = (
    ("email", ("(at)", "[at]"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++"), bool),
    ("ip", (":",), re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), bool),
    ("phone", tuple("0123456789"), re.compile(r"(?<![0-9+(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-.][0-9]{4}(?![0-9-])"), bool),
    ("card", tuple("0123456789"), re.compile(r"(?<![0-9-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9-])"), bool),
    ("card", tuple("0123456789"), re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"), luhn),
    ("ssn", tuple("0123456789"), re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), bool),
    ("secret", ("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), bool),
    ("secret", ("=", ":"), re.compile(r"(?<![A-Za-z])(?:[Pp]assword|[Pp]asswd|PASSWORD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?[Kk]ey|API_?KEY) ?[=:] ?\"?([A-Za-z0-9+/_.~-]{6,}+)"), bool),
)

# Gazetteers (fixed values).
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai dev app de fr es uk it nl eu ch at be pl ru cn jp kr in br mx us ca au nz se no dk fi pt gr cz ie".split())
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "62")
CONTEXT = {
    "email": "email e-mail mail contact correo courriel kontakt write".split(),
    "ip": "ip address server host addr dirección adresse from".split(),
    "card": "card visa mastercard amex credit debit karte tarjeta carte payment".split(),
    "phone": "phone tel telephone call mobile fax cell teléfono téléphone telefon whatsapp".split(),
    "ssn": "ssn social security".split(),
    "secret": "key secret password token credential credentials login aws access".split(),
}
AGAINST = "version isbn issn doi order invoice item section figure chapter page part build release".split()

#: How far before a span its context goes.
REACH = 40
WORD = re.compile(r"[^\W\d_][\w-]*")

LABELERS = ("pattern", "test", "gazetteer", "context", "against", "alone")
SHAPES = ("short", "long", "digits", "letters", "capitals", "separators", "quoted", "line_start")


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: a local part holds no @, so each @ is tried once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str, str]]:
    """(kind, start, end, base, votes, shape): base spans and further candidates that none of the same kind overlaps."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int, bool]]] = {}
    for kind, a, b in base_spans(text):
        found.setdefault(kind, []).append((a, b, True))
    for kind, needs, pattern, passes in LOOSE:
        if any(need in text for need in needs):
            spans = (m.span(1) if kind == "secret" and m.re.groups else m.span() for m in pattern.finditer(text) if passes(m[0]))
            known = found.get(kind, [])
            if new := apart(spans, known):
                found[kind] = sorted([*known, *((a, b, False) for a, b in new)])
    return [(kind, a, b, base, votes(text, kind, a, b, base), shape(text, a, b)) for kind in KINDS for a, b, base in found.get(kind, ())]


def apart(spans: Iterable[tuple[int, int]], known: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the known ones; both are disjoint and in order, so one pass over both tells."""
    out, i = [], 0
    for a, b in spans:
        while i < len(known) and known[i][1] <= a:
            i += 1
        if i == len(known) or known[i][0] >= b:
            out.append((a, b))
    return out


def votes(text: str, kind: str, a: int, b: int, base: bool) -> str:
    """A letter for each labeler: + for, - against, 0 none."""
    span = text[a:b]
    digits = digits_of(span)
    before = [w.lower() for w in WORD.findall(text[max(0, a - REACH) : a])]
    if kind == "email":
        test, known = 1 if re.search(r"\.[A-Za-z]{2,}$", span) else -1, 1 if span.rpartition(".")[2].lower() in TOP_LEVEL else -1
    elif kind == "ip":
        test, known = (1 if ":" in span or octets(span) else -1), (-1 if span.startswith(("0.", "255.")) else 0)
    elif kind == "card":
        test, known = (1 if luhn(digits) else -1), (1 if digits.startswith(CARD_ISSUERS) else -1)
    elif kind == "phone":
        test, known = (1 if 9 <= len(digits) <= 15 else -1), (1 if span.startswith("+") and digits[0] != "0" else 0)
    elif kind == "ssn":
        test, known = (-1 if digits.startswith(("000", "666", "9")) or digits[3:5] == "00" or digits[5:] == "0000" else 1), 0
    else:
        test, known = (1 if digits and re.search("[A-Za-z]", span) else -1), (1 if span.startswith(("AKIA", "ASIA")) or re.search(r"(?i)(password|passwd|secret|token|api_?key)\W*$", text[max(0, a - 16) : a]) else 0)
    strict = 1 if base else 1 if kind in ("ssn", "secret") else 0
    context = 1 if any(w in CONTEXT[kind] for w in before) else 0
    against = -1 if any(w in AGAINST for w in before) else 0
    edge = (text[a - 1] if a else " ") + (text[b] if b < len(text) else " ")
    alone = -1 if any(c.isalnum() for c in edge) else 1
    return "".join("-0+"[v + 1] for v in (strict, test, known, context, against, alone))


def shape(text: str, a: int, b: int) -> str:
    """A bit for each shape feature."""
    span = text[a:b]
    n = len(span)
    digits = sum("0" <= c <= "9" for c in span)
    bits = (n < 12, n > 24, 2 * digits >= n, any(c.isalpha() for c in span), any(c.isupper() for c in span), any(c in " .-()" for c in span), a > 0 and text[a - 1] in "\"'<(", a == 0 or text[a - 1] == "\n")
    return "".join("01"[bit] for bit in bits)


@dataclass
class SpanModel:
    """What was learnt: reliabilities[kind][labeler] = (P(+ | true), P(0 | true), P(- | true), and the same for false),
    prior of each kind, and the weights of the span classifier (None: there was nothing to learn from)."""

    priors: dict[str, float]
    reliabilities: dict[str, np.ndarray]
    weights: np.ndarray | None

    def probability(self, kind: str, votes: str, shape: str) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(inputs(kind, votes, shape) @ self.weights, -50, 50))))


def inputs(kind: str, votes: str, shape: str) -> np.ndarray:
    """Features of the span classifier: bias, kinds, votes for and against, shape."""
    return np.array([1.0, *(float(k == kind) for k in KINDS), *(float(v == "+") for v in votes), *(float(v == "-") for v in votes), *(float(s == "1") for s in shape)])


def expectation_maximisation(patterns: list[tuple[str, float]], rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """patterns: (votes, count) of one kind. Prior, reliabilities (labeler, truth, vote) and the probability of each
    pattern to be true. Starts from the majority of votes; counts are smoothed towards labelers better than chance.

    A labeler that does not vote says nothing: it abstains as often on true candidates as on false ones. Otherwise a rare
    pattern would be a class of its own for no more than its abstentions."""
    n = np.array([c for _, c in patterns])
    vote = np.array([["+0-".index(v) for v in votes] for votes, _ in patterns])
    p = np.clip(0.5 + ((vote == 0).sum(axis=1) - 2.0 * (vote == 2).sum(axis=1)) / (2.0 * vote.shape[1]), 0.05, 0.95)
    smooth = np.array([[2.0, 0.5], [0.5, 2.0]])
    for _ in range(rounds):
        prior = float(((n * p).sum() + 1) / (n.sum() + 2))
        rates = np.empty((vote.shape[1], 2, 3))
        for j in range(vote.shape[1]):
            silent = float((n[vote[:, j] == 1].sum() + 1) / (n.sum() + 2))
            for truth, weight in enumerate((p, 1 - p)):
                cast = np.array([(n * weight)[vote[:, j] == v].sum() for v in (0, 2)]) + smooth[truth]
                rates[j, truth, [0, 2]] = (1 - silent) * cast / cast.sum()
                rates[j, truth, 1] = silent
        like = [np.log(rates[np.arange(vote.shape[1]), truth, :][np.arange(vote.shape[1]), vote]).sum(axis=1) for truth in (0, 1)]
        odds = np.log(prior / (1 - prior)) + like[0] - like[1]
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return prior, rates, p


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, decay: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression on probabilities y with counts n (Newton's method). Counts are taken as they are, so
    that the penalty weighs no more against a rare kind or pattern if others are common."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x * (n * q * (1 - q) + 1e-6)[:, None]).T @ x + decay * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (n * (y - q)) - decay * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def pattern_counts(documents: DataFrame) -> DataFrame:
    """kind, votes, shape and n: the corpus as the fit sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter((kind, votes, shape) for text in batch.column("text").to_pylist() for kind, _, _, _, votes, shape in candidates(text))
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.string()) for i in range(3)), pa.array(found.values(), pa.int64())], names=["kind", "votes", "shape", "n"])

    return map_batches(documents.select("text"), run, "kind string, votes string, shape string, n bigint").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame) -> SpanModel:
    """Reliabilities and span classifier from all texts. Only counts reach the driver, of at most
    len(KINDS) * 3 ** len(LABELERS) * 2 ** len(SHAPES) patterns, in practice some dozens."""
    return learnt([(r["kind"], r["votes"], r["shape"], float(r["n"])) for r in pattern_counts(documents).collect()])


def learnt(counts: list[tuple[str, str, str, float]]) -> SpanModel:
    """The model from (kind, votes, shape, count), in any order."""
    counts = sorted(counts)
    priors: dict[str, float] = {}
    reliabilities: dict[str, np.ndarray] = {}
    truth: dict[tuple[str, str], float] = {}
    for kind in KINDS:
        by: dict[str, float] = {}
        for k, votes, _, n in counts:
            if k == kind:
                by[votes] = by.get(votes, 0.0) + n
        if by:
            priors[kind], reliabilities[kind], p = expectation_maximisation(sorted(by.items()))
            truth |= {(kind, votes): float(q) for (votes, _), q in zip(sorted(by.items()), p)}
    if not counts:
        return SpanModel(priors, reliabilities, None)
    x = np.array([inputs(kind, votes, shape) for kind, votes, shape, _ in counts])
    weights = logistic(x, np.array([truth[kind, votes] for kind, votes, _, _ in counts]), np.array([n for *_, n in counts]))
    return SpanModel(priors, reliabilities, weights)


def final_spans(text: str | None, model: SpanModel, least: float = 0.5) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, probability): all base spans and the candidates that the classifier takes, by kind as
    listed in KINDS, then start."""
    out = []
    for kind, a, b, base, votes_, shape_ in candidates(text):
        p = model.probability(kind, votes_, shape_)
        if base or p >= least:
            out.append((kind, a, b, base, p))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))


def find(documents: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id and spans of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base", "probability"), s)) for s in final_spans(text, shared.value)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int, bool, float]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(documents: DataFrame, model: SpanModel) -> DataFrame:
    """documents with the personal data in their texts replaced. Columns stay, whatever their names; n_chars (if there) follows the new text
    where it changed."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [redacted(text, spans) if (spans := final_spans(text, shared.value)) else text for text in texts]
            columns = {name: batch.column(name) for name in names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                before = columns["n_chars"]
                columns["n_chars"] = pa.array([n if a is b else len(b) for n, a, b in zip(before.to_pylist(), texts, new)], before.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return map_batches(documents, run, documents.schema)
