"""Settings of the engine and its dictionaries: always passed, never read from the surroundings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ombra.functions.lexicons import DEFAULT_CATEGORIES


@dataclass(frozen=True)
class Dictionaries:
    """Lower-case tokens. Ambiguous names are common words too; missing dictionaries are empty and their rules say "unknown"."""

    names: frozenset[str] = frozenset()
    ambiguous_names: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    ambiguous_surnames: frozenset[str] = frozenset()
    vocabulary: frozenset[str] = frozenset()
    wide_vocabulary: frozenset[str] = frozenset()
    municipalities: frozenset[str] = frozenset()

    @property
    def municipality_tokens(self) -> frozenset[str]:
        return frozenset(t for m in self.municipalities for t in m.replace("-", " ").split() if len(t) >= 4 and t not in self.vocabulary)

    def name(self, token: str) -> bool:
        return len(token) >= 3 and token in self.names

    def surname(self, token: str) -> bool:
        return len(token) >= 3 and token in self.surnames

    def known(self, token: str) -> bool:
        return self.name(token) or self.surname(token)

    def common(self, token: str) -> bool:
        return token in self.vocabulary or token in self.wide_vocabulary


@dataclass(frozen=True)
class Config:
    """How documents are analysed.

    ``language``: "auto" routes each text; "it" and "en" fix it. English texts get only the
    detectors that aren't Italian, unless ``all_languages``. ``strict_phone`` drops phones written
    with dots or slashes. ``readmit`` takes back spans that lost to a span which itself lost.
    ``model`` is an optional detector: texts to lists of (label, start, end, score).
    """

    categories: frozenset[str] = DEFAULT_CATEGORIES
    language: str = "auto"
    all_languages: bool = False
    strict_phone: bool = False
    readmit: bool = False
    context_boost: float = 0.35
    dictionaries: Dictionaries = field(default_factory=Dictionaries)
    #: (term, type) pairs of the address book; each wins over everything.
    book: tuple[tuple[str, str], ...] = ()
    model: Callable[[str], list[tuple[str, int, int, float]]] | None = None
    model_threshold: float = 0.5
    trace: bool = False
    #: Detectors to leave out, by name.
    without: frozenset[str] = frozenset()
