"""License scans: fuzzy search for short notices.

Texts become words (ASCII lowered; letters, digits and all non-ASCII characters) joined by single
spaces. Base phrases are found exactly, word by word. Each longer notice may contain up to ``k``
character edits: it is split into k + 1 pieces, one of which any such occurrence holds unchanged,
so an automaton over all pieces finds every candidate place; the regex library then matches the
notice there with at most k errors, at word borders, and reports the span and its edits. Each
candidate window is matched by itself, so places next to one another are all found; of places of a
notice that overlap, the one with the fewest edits stays, then the leftmost, then the shorter.

Defined results: a null text is empty; a text without words or notices has zero counts, null
words, empty labels and score 0; overlapping places of a phrase all count; equal rows give equal
rows; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ombra.llm.common import documents, map_rows, text_bytes

#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices searched with errors, and their labels.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("released into the public domain", "public-domain"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license", "boost"),
)
#: Characters of a notice for each allowed edit.
PER_EDIT = 10
#: Maps bytes to lowered words: every byte that isn't part of a word becomes a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    pieces: tuple[tuple[int, str], ...]
    pattern: regex.Pattern


def notice(text: str, label: str) -> Notice:
    """The notice with its exact seeds: k + 1 pieces of nearly equal length, with their offsets."""
    k = len(text) // PER_EDIT
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    pieces = tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    return Notice(text, label, k, pieces, regex.compile(rf"(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}(?= )", regex.BESTMATCH))


@cache
def searcher(notices: tuple[tuple[str, str], ...] = NOTICES):
    made = [notice(*n) for n in notices]
    seeds: dict[str, list[tuple[int, int]]] = {}
    for n, x in enumerate(made):
        for at, seed in x.pieces:
            seeds.setdefault(seed, []).append((n, at))
    automaton = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    return made, automaton


@dataclass(frozen=True)
class Found:
    """A notice at [start, end) of the joined words, with its number of edits."""

    label: str
    start: int
    end: int
    edits: int
    notice: str


def fuzzy(joined: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[Found]:
    """All notices in the joined words: the best match of each seed's window, then those that don't overlap."""
    made, automaton = searcher(notices)
    windows: dict[int, set[tuple[int, int]]] = {}
    for stop, (size, uses) in automaton.iter(joined):
        begin = stop + 1 - size
        for n, at in uses:
            x = made[n]
            windows.setdefault(n, set()).add((begin - at - x.edits, begin - at + len(x.text) + x.edits))
    out = []
    padded = f" {joined} "  # shows the words' borders; a place is one further on in it
    for n, own in windows.items():
        x = made[n]
        found = set()
        for a, b in own:
            # a blank on both sides belongs to the window
            if m := x.pattern.search(padded, max(a, 0), b + 2):
                found.add((sum(m.fuzzy_counts), m.start() - 1, m.end() - 1))
        out += [Found(x.label, a, b, edits, x.text) for edits, a, b in apart(found)]
    return sorted(out, key=lambda f: (f.start, f.end, f.notice))


def apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end), in order, those that overlap none taken before."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for edits, a, b in sorted(found):
        at = bisect_right(starts, a)
        if (not at or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
            starts.insert(at, a)
            ends.insert(at, b)
            out.append((edits, a, b))
    return out


def scan_text(data: bytes) -> tuple[int, list[tuple[int, str]], list[Found], str]:
    """Words in a text, base places as (word, label), notices, and the joined words."""
    words = data.translate(FOLD).split()
    joined = b" ".join(words).decode()
    base, padded = [], f" {joined} "
    for phrase, label in PHRASES:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            base.append((padded.count(" ", 0, at), label))
            at = padded.find(f" {phrase} ", at + 1)
    return len(words), sorted(base), fuzzy(joined), joined


def score(n_base: int, found: list[Found]) -> float:
    """1 if a base phrase is there, else the closeness of the best notice."""
    return 1.0 if n_base else max((1 - f.edits / len(f.notice) for f in found), default=0.0)


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, base, notices): base places (word, label); notices (label, start, end, edits, notice) with code-point spans of the original text."""

    def rows(ids: list, texts: list) -> Iterable[tuple]:
        for i, data in zip(ids, texts, strict=True):
            n, base, found, joined = scan_text(data)
            spans = []
            if found:
                words = [m.span() for m in WORD.finditer(data.lower().decode())]
                starts = [0] + [m.end() for m in re.finditer(" ", joined)]
                for f in found:
                    first, last = bisect_right(starts, f.start) - 1, bisect_right(starts, f.end - 1) - 1
                    spans.append({"label": f.label, "start": words[first][0], "end": words[last][1], "edits": f.edits, "notice": f.notice, "word": first})
            yield i, n, [{"word": w, "label": x} for w, x in base], spans, score(len(base), found)

    return map_rows(docs, [F.col(id_col).cast("long"), text_bytes(text_col)], "id long, n_words long, base array<struct<word:long,label:string>>, notices array<struct<label:string,start:long,end:long,edits:int,notice:string,word:long>>, score double", rows)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """One row for each document; nulls, empty texts and repeated rows as at the top."""
    found = license_notices(documents(spark, sf_dir))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.col("base.label"), F.col("notices.label")).alias("labels"),
        "score",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"), x["edits"].cast("string"))), ",").alias("spans"),
    )
