"""Matches of the case and statute patterns in time linear in the text.

A plain search for "parties v. parties" begins anew at every letter of a long
run of words. Here a run is looked at once: a match lies in one run of the
characters that parties are made of, its first party ends at the last " v "
that serves, its second one goes on to the run's end. Each finder gives just
what finditer() gives for the pattern that it stands for (functions/text.py).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from verdigraph.functions.text import CITATION_PATTERNS, ENTITY_PATTERNS, LIGHT_STATUTES

I = re.IGNORECASE  # noqa: E741


class Span(NamedTuple):
    start: int
    end: int
    groups: tuple[str | None, ...]


_LETTER = re.compile(r"[A-Z]", I)
_WORD = re.compile(r"\w")
# Parties of a citation: words with digits and dots too, so that "v." doesn't end a run.
_RUN = re.compile(r"[\w\s&.]+")
_APART = re.compile(r"[^\w\s&.]+")
# Patterns that begin with a set of characters are looked for fast.
_VERSUS = re.compile(r"[vV](?<=\s[vV])\.?\s++(?=(?i:[A-Z])[\w\s&.])")
_COMMA_TAIL = re.compile(r",\s++(\d++)\s++([A-Z][\w.]++)\s++(\d++)(?:\s++\((\d{4})\))?", I)
_TAIL = re.compile(r"\s(?=(\d++)\s++([A-Z][\w.]++)\s++(\d++))", I)
_YEAR = re.compile(r"\s++\((\d{4})\)")
# Parties of an entity: letters alone, a dot ends the run.
_NAMES = re.compile(r"[a-zA-Z\s&]+", I)
_NAME_START = re.compile(r"\b[A-Z]", I)
_NAME_VERSUS = re.compile(r"(?<=\s)v\s++(?=[A-Z][a-zA-Z\s&])", I)
_DOTTED = re.compile(r"\.\s++(?=[A-Z][a-zA-Z\s&])", I)
_NAME_TAIL = re.compile(r",\s++\d++\s++[A-Z][a-zA-Z.]++\s++\d++\b", I)


def _serving(anchors: list[tuple[int, int]], start: int, upto: int) -> tuple[int, int] | None:
    """The last " v " (its place, the second party's start) after two characters of the first party, two of the second one before upto."""
    for v, q in reversed(anchors):
        if v - 1 < start + 2:
            return None
        if q + 2 <= upto:
            return v, q
    return None


class Run(NamedTuple):
    """A run of the characters that parties are made of, in which a " v " stands."""

    start: int
    end: int
    anchors: list[tuple[int, int]]
    first: int
    comma: re.Match | None


@lru_cache(maxsize=1)
def versus_runs(text: str) -> list[Run]:
    """Runs with each " v " in them, their first letter and the tail after them; the rest of a text has no case. Kept for the text's next finder."""
    places: list[tuple[int, int, list[tuple[int, int]]]] = []
    a, b = 0, 0
    for m in _VERSUS.finditer(text):
        if m.start() >= b:
            a = b
            for gap in _APART.finditer(text, b, m.start()):
                a = gap.end()
            b = _RUN.match(text, m.start()).end()
            places.append((a, b, []))
        places[-1][2].append(m.span())
    # The letter after a " v " is in its run, so there is a first one.
    return [Run(a, b, anchors, _LETTER.search(text, a, b).start(), _COMMA_TAIL.match(text, b) if text.startswith(",", b) else None) for a, b, anchors in places]


def cited_cases(text: str, tail: str) -> Iterator[Span]:
    """Matches of "parties v parties" with volume, reporter, page and year: tail is "must", "may" or "none" (parties alone).

    Groups are parties and, in order, volume, reporter, page, year ("must") or volume, year ("may").
    """
    pos = 0
    for a, b, anchors, s, comma in versus_runs(text):
        if pos > a:
            a, anchors = pos, [x for x in anchors if x[0] >= pos]
            if not anchors:
                continue
            s = _LETTER.search(text, a, b).start()
        if tail == "none":
            comma = None
        if comma or tail != "must":
            if at := _serving(anchors, s, b):
                groups = (text[s : at[0] - 1], text[at[1] : b])
                if tail == "must":
                    groups += comma.groups()
                elif tail == "may":
                    groups += (comma[1], comma[4]) if comma else (None, None)
                pos = comma.end() if comma else b
                yield Span(s, pos, groups)
            continue
        last = None
        for last in _TAIL.finditer(text, a, b):
            pass
        if last and (at := _serving(anchors, s, last.start())):
            year = _YEAR.match(text, last.end(3))
            pos = year.end() if year else last.end(3)
            yield Span(s, pos, (text[s : at[0] - 1], text[at[1] : last.start()], *last.groups(), year[1] if year else None))


def _names_end(text: str, upto: int, tail: bool) -> int:
    """Where a second party whose run ends at upto ends: after its tail, or at the last word boundary."""
    if tail and (m := _NAME_TAIL.match(text, upto)):
        return m.end()
    after, k = upto < len(text) and bool(_WORD.match(text, upto)), upto
    word = bool(_WORD.match(text, upto - 1))
    if word == after:
        while k and bool(_WORD.match(text, k - 1)) == word:
            k -= 1
    return k


def named_cases(text: str, tail: bool) -> Iterator[Span]:
    """Matches of an entity's "names v names", with a tail of volume, reporter and page where there is one and it is asked for."""
    pos = 0
    while run := _NAMES.search(text, pos):
        a, b = run.span()
        pos = b
        dotted = _DOTTED.match(text, b) if b - a > 3 and text[b - 1] in "vV" and text[b - 2].isspace() else None
        anchors = [(m.start(), m.end()) for m in _NAME_VERSUS.finditer(text, a, b)]
        first = _NAME_START.search(text, a, b) if dotted or anchors else None
        if not first:
            continue
        s = first.start()
        if dotted and b - 2 >= s + 2:
            q = dotted.end()
            end = _names_end(text, _NAMES.match(text, q).end(), tail)
            if end >= q + 2:
                pos = end
                yield Span(s, end, ())
                continue
        if anchors:
            end = _names_end(text, b, tail)
            if _serving(anchors, s, min(end, b)):
                pos = end
                yield Span(s, end, ())


def tight(pattern: str) -> str:
    """The pattern without ways of matching that differ in nothing: runs of digits from their start, and of white space, are taken whole."""
    out = pattern.replace(r"\s*§?\s*", r"\s*+(?:§\s*+)?").replace(r"([IVX]+)", r"([IVX]++)").replace(r"\s+", r"\s++")
    for start, whole in ((r"(\d+)", r"(\d(?<!\d\d)\d*+)"), (r"\b\d+", r"\b\d++")):
        if out.startswith(start):
            out = whole + out[len(start) :]
    return out


def _all(pattern: str):
    compiled = re.compile(tight(pattern), I)
    return lambda text: [Span(m.start(), m.end(), m.groups()) for m in compiled.finditer(text)]


def _kept(find):
    """A finder that keeps what it found last: several readers look through the same text."""
    return lru_cache(maxsize=1)(find)


#: Finders of the entity and citation patterns, in their order.
ENTITY_FINDERS = [(kind, (lambda text, tail=i == 0: named_cases(text, tail)) if kind == "CASE" else _all(p)) for kind, ps in ENTITY_PATTERNS.items() for i, p in enumerate(ps)]
_STATUTES = {p: _kept(_all(p)) for p in [*LIGHT_STATUTES, *(p for kind, p, _ in CITATION_PATTERNS if kind == "statute")]}
CITATION_FINDERS = [(kind, (lambda text, tail="none" if i else "must": cited_cases(text, tail)) if kind == "case" else _STATUTES.get(p) or _all(p), score) for i, (kind, p, score) in enumerate(CITATION_PATTERNS)]
LIGHT_STATUTE_FINDERS = [_STATUTES[p] for p in LIGHT_STATUTES]
