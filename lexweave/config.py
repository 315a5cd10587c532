"""Settings of the engine."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Everything a run can be told. Paths are optional: a DataFrame can be given instead."""

    segments: tuple[int, ...] = (5, 6, 7, 8, 9, 10, 11)
    documents: dict[int, str] = field(default_factory=dict)
    dictionary: str | None = None
    stopwords: str | None = None
    replacements: str | None = None
    #: Parses of word forms (see operators.lexicon.read_lexicon); without it a token is its own lemma.
    lexicon: str | None = None
    output: str | None = None
    #: Words of a segment where neither its file name nor its tokens should say.
    fallback_totals: dict[int, int] = field(default_factory=dict)
    allow_punct_between: bool = False
    disallow_hyphen_adjacent_for_unigrams: bool = False
    context_window: int = 6
    max_contexts_per_term: int = 20
    norm_per: int = 1_000_000
    debug_all_terms: bool = True
    debug_terms: tuple[str, ...] = ()
    #: Patterns that are sent to every task; more are joined by shuffle.
    max_broadcast_patterns: int = 1_000_000

    def problems(self) -> list[str]:
        """What is missing: every path is checked before anything runs."""
        found = []
        for name, path in (("stop words", self.stopwords), ("replacements", self.replacements), ("lexicon", self.lexicon), ("dictionary", self.dictionary)):
            if path and not Path(path).exists():
                found.append(f"{name} not found: {path}")
        for segment in self.segments:
            path = self.documents.get(segment)
            if self.documents and path is None:
                found.append(f"segment {segment} has no document")
            elif path is not None and not Path(path).exists():
                found.append(f"document of segment {segment} not found: {path}")
        return found

    def summary(self) -> str:
        lines = [f"{name}: {value}" for name, value in asdict(self).items()]
        return "\n".join([*lines, *([f"missing: {p}" for p in self.problems()] or ["all files found"])])
