"""Licence scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import slices
from verdigraph.llm.spdx import EXCEPTIONS, LICENSES

#: Lower-cases A-Z; other ASCII than letters and digits parts words.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method's own, and how much each restricts use (0 free, 1 not at all allowed).
NOTICES = {
    "mit license": ("mit", 0.1),
    "apache license": ("apache", 0.1),
    "bsd license": ("bsd", 0.1),
    "isc license": ("isc", 0.1),
    "zlib license": ("zlib", 0.1),
    "unlicense": ("unlicense", 0.0),
    "public domain": ("public-domain", 0.0),
    "creative commons zero": ("cc0", 0.0),
    "creative commons attribution": ("cc-by", 0.1),
    "mozilla public license": ("mpl", 0.4),
    "eclipse public license": ("epl", 0.4),
    "lesser general public license": ("lgpl", 0.5),
    "affero general public license": ("agpl", 0.8),
    "cc by sa": ("cc-by-sa", 0.5),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "cc0 1 0": ("cc0", 0.0),
    "creative commons attribution sharealike": ("cc-by-sa", 0.5),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons attribution noderivatives": ("cc-by-nd", 0.8),
    "boost software license": ("bsl", 0.1),
    "artistic license": ("artistic", 0.2),
    "python software foundation license": ("psf", 0.1),
    "european union public licence": ("eupl", 0.5),
    "sil open font license": ("ofl", 0.2),
    "open database license": ("odbl", 0.5),
    "common development and distribution license": ("cddl", 0.4),
    "free documentation license": ("gfdl", 0.5),
    "server side public license": ("sspl", 0.9),
    "business source license": ("busl", 0.9),
    "do what the fuck you want to public license": ("wtfpl", 0.0),
    "permission is hereby granted free of charge": ("mit", 0.1),
    "redistribution and use in source and binary forms": ("bsd", 0.1),
    "this program is free software": ("gpl", 0.7),
    "this library is free software": ("lgpl", 0.5),
    "released into the public domain": ("public-domain", 0.0),
    "non commercial use only": ("non-commercial", 0.9),
    "may not be reproduced": ("reserved", 1.0),
    "proprietary and confidential": ("proprietary", 1.0),
    "confidential and proprietary": ("proprietary", 1.0),
    "unauthorized copying": ("proprietary", 1.0),
    "no part of this publication may be": ("reserved", 1.0),
}
BASE_LIMITS = {"cc-by": 0.1, "gpl": 0.7, "reserved": 1.0}
TAG = "spdx license identifier"
#: How much licences restrict use, by the start of their lower-cased identifier; the longest that fits counts.
FAMILIES = {
    "mit": 0.1, "apache": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "unlicense": 0.0, "cc0": 0.0, "0bsd": 0.0,
    "mpl": 0.4, "epl": 0.4, "cddl": 0.4, "lgpl": 0.5, "gpl": 0.7, "agpl": 0.8, "sspl": 0.9, "busl": 0.9, "elastic": 0.9,
    "cc-by": 0.1, "cc-by-sa": 0.5, "cc-by-nd": 0.8, "cc-by-nc": 0.9, "licenseref": 1.0, "none": 1.0, "noassertion": 1.0,
}
LISTED_LIMIT, UNKNOWN_LIMIT, EXCEPTION_RELIEF = 0.3, 0.5, 0.2
_LICENSES, _EXCEPTIONS = frozenset(LICENSES), frozenset(EXCEPTIONS)
_REFERENCE = re.compile(r"(documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+")
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def _limit(name: str) -> float:
    """Restriction of a licence identifier, by its family; of other listed ones and of unknown ones a fixed one."""
    fits = [f for f in FAMILIES if name == f or re.match(re.escape(f) + r"[-.\d+]", name)]
    return UNKNOWN_LIMIT if not _listed(name) else FAMILIES[max(fits, key=len)] if fits else LISTED_LIMIT


def _listed(name: str) -> bool:
    return name.removesuffix("+") in _LICENSES or _REFERENCE.fullmatch(name) is not None


@dataclass(frozen=True)
class Expression:
    """Licences, exceptions and unknown identifiers of an expression, each once in order, and how much it restricts use."""

    licenses: list[str]
    exceptions: list[str]
    unknown: list[str]
    limit: float


def evaluate(expression: str) -> Expression | None:
    """Evaluate a licence expression by a shunting yard; None if it doesn't parse.

    WITH binds most, then AND, then OR (any case). Under AND the stricter
    side counts, under OR the freer one; a listed exception after WITH
    relieves the licence before by EXCEPTION_RELIEF. WITH needs a licence
    before and an exception after. Identifiers that are not listed are
    unknown, with UNKNOWN_LIMIT. What follows the last token that can stand
    in an expression (the end of a comment, say) is left out.
    """
    output: list[float] = []
    stack: list[str] = []
    licenses, exceptions, unknown = {}, {}, {}

    def apply(op: str) -> None:
        b, a = output.pop(), output.pop()
        output.append(max(0.0, a - b) if op == "with" else max(a, b) if op == "and" else min(a, b))

    at, due, before = 0, True, ""  # due: an operand comes next; before: the token before
    while m := _TOKEN.match(expression, at):
        low = m.group(1).lower()
        if due:
            if low == ")" or low in _RANK or low == "(" and before == "with":
                return None
            if low == "(":
                stack.append(low)
            elif before == "with":
                (exceptions if low in _EXCEPTIONS else unknown)[low] = None
                output.append(EXCEPTION_RELIEF if low in _EXCEPTIONS else 0.0)
                due = False
            else:
                (licenses if _listed(low) else unknown)[low] = None
                output.append(_limit(low))
                due = False
        elif low in _RANK:
            if low == "with" and (before == ")" or stack[-1:] == ["with"]):
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                apply(stack.pop())
            stack.append(low)
            due = True
        elif low == ")":
            while stack and stack[-1] != "(":
                apply(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            break
        at, before = m.end(), low
    if due or "(" in stack:
        return None
    while stack:
        apply(stack.pop())
    return Expression(list(licenses), list(exceptions), list(unknown), output[0])


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases between spaces, with what they stand for: (label, limit, in the base, characters)."""
    found = ahocorasick.Automaton()
    known = {p: (label, limit, False) for p, (label, limit) in NOTICES.items()}
    known |= {p: (label, BASE_LIMITS[label], True) for p, label in BASE.items()} | {TAG: ("", 0.0, False)}
    for phrase, what in known.items():
        found.add_word(f" {phrase} ", (*what, len(phrase) + 2))
    found.make_automaton()
    return found


def _expression_after(raw: bytes, end: int) -> str | None:
    """What stands on the line after a tag that ends at a place and a colon."""
    line = raw[end:].split(b"\n", 1)[0].lstrip(b" \t")
    return line[1:].decode("utf-8", "replace") if line.startswith(b":") else None


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, str, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, exceptions and unknown of one whole text."""
    raw = b"" if text is None else text.encode("utf-8", "replace")
    apart = raw.translate(_WORDS)
    ws = apart.split()
    flat = f" {b' '.join(ws).decode('utf-8', 'replace')} "
    hits = list(automaton().iter(flat))
    if not hits:
        return len(ws), 0, None, None, "", "", 0.0, "", ""
    labels, exceptions, unknown, score = set(), set(), set(), 0.0
    spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32) == 32)
    starts = np.searchsorted(spaces, [end - size + 1 for end, (*_, size) in hits])
    base, tags = [], []
    for at, (_, (label, limit, is_base, _)) in zip(starts.tolist(), hits):
        if not label:
            tags.append(at)
            continue
        labels.add(label)
        score = max(score, limit)
        if is_base:
            base.append((at, label))
    if tags:
        ink = np.concatenate([np.frombuffer(apart, dtype=np.uint8) != 32, [False]])
        ends = np.flatnonzero(ink[:-1] & ~ink[1:]) + 1
        for at in tags:
            said = _expression_after(raw, int(ends[at + TAG.count(" ")]))
            if said is not None and (told := evaluate(said)):
                labels.update(told.licenses)
                exceptions.update(told.exceptions)
                unknown.update(told.unknown)
                score = max(score, told.limit)
    places = [at for at, _ in base]
    joined = [",".join(sorted(x)) for x in ({label for _, label in base}, labels, exceptions, unknown)]
    return len(ws), len(base), min(places, default=None), max(places, default=None), joined[0], joined[1], score, joined[2], joined[3]


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, exceptions string, unknown string"


def license_scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep (columns of docs) and what each whole text says of its licence, a row for each row of docs; no shuffle.

    Words are runs of 0-9, a-z and non-ASCII characters after A-Z is
    lower-cased. n_base counts the places of the BASE phrases, overlaps
    included; first_word and last_word are their least and largest start.
    labels has the base labels, those of NOTICES and the licences of the
    expressions after SPDX tags (see evaluate; expressions that don't parse
    give none); exceptions and unknown have the exceptions and the unlisted
    identifiers of these expressions. score is the largest restriction found,
    from 0 (none, or no notice) to 1. Null texts count as empty: no words, no
    labels (""). Repeated rows each keep theirs; an empty table gives an
    empty result; other columns of docs don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.string()] * 2
        for batch in slices(batches):
            found = [scan(t) for t in batch.column(len(keep)).to_pylist()]
            cols = zip(*found) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    names = [*keep, *(x.split()[0] for x in SCHEMA.split(", "))]
    slim = docs.select(*keep, F.col(text).alias("vg_text"))
    return slim.mapInArrow(run, "".join(f"`{k}` {slim.schema[k].dataType.simpleString()}, " for k in keep) + SCHEMA)
