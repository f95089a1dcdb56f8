"""Linear matching against the plain patterns, and its time on long texts."""

import collections
import random
import re
import time

import pytest

from verdigraph.functions.text import CITATION_PATTERNS, ENTITY_PATTERNS, LIGHT_CASE, LIGHT_STATUTES, PERSON_PATTERN
from verdigraph.operators.extract import citations_of, entities_of, light_of
from verdigraph.queries import QUERIES
from verdigraph.operators.matching import CITATION_FINDERS, ENTITY_FINDERS, LIGHT_STATUTE_FINDERS, cited_cases

WORDS = ["A", "b", "v", "V", "v.", "vv", "Ab", "Roe & Co.", "&", ".", ",", " ", "  ", "\n", "\x1c", "1", "12", "410", "U.S.", "F.2d", "(1999)", "(19)", "_", "é", "ſa", "K", "İ", "§", "-", "USC", "U.S.C.", "CFR", "C.F.R.", "(a)(1)", "3.4", "$5,000", "$,", "million", "Section", "U.S. Const. art. IV", "Amend. XIV", "art", "May 3, 2020", "2020-01-02", "٣"]


def made(rng):
    return "".join(rng.choice(WORDS) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(40)))


def plain(pattern, text):
    return [(m.start(), m.end(), m.groups()) for m in re.finditer(pattern, text, re.IGNORECASE)]


@pytest.mark.parametrize("seed", range(10))
def test_finders_are_their_patterns(seed):
    rng = random.Random(seed)
    entity = [(p, find) for (_, find), p in zip(ENTITY_FINDERS, [p for ps in ENTITY_PATTERNS.values() for p in ps])]
    cited = [(p, find) for (_, find, _), (_, p, _) in zip(CITATION_FINDERS, CITATION_PATTERNS)]
    light = [(LIGHT_CASE, lambda t: cited_cases(t, "may")), *zip(LIGHT_STATUTES, LIGHT_STATUTE_FINDERS)]
    named = 0
    for _ in range(2000):
        text = made(rng)
        for p, find in entity:
            got = [(m.start, m.end) for m in find(text)]
            assert got == [x[:2] for x in plain(p, text)], (p, text)
        for p, find in cited + light:
            got = list(map(tuple, find(text)))
            assert got == plain(p, text), (p, text)
            named += len(got)
    assert named > 800


MB = 1_000_000
LONG = {
    "words": "Roe v. Wade, 410 U.S. 113 (1973). " + "the court held that it was so " * (MB // 30),
    "words before": "the court held that it was so " * (MB // 30) + " in Roe v. Wade.",
    "cases": "Roe v. Wade, 410 U.S. 113 (1973), and 42 U.S.C. § 1983; " * (MB // 60),
    "versus": "a v b " * (MB // 6),
    "dots": "A v. " * (MB // 5),
    "spaces": "Roe v. Wade" + " " * MB + "- x v y",
    "spaces after numbers": "12 USC" + " " * MB + "x v y 12" + " " * MB,
    "digits": "1" * MB + " v x y" + " 1" * (MB // 2),
    "letters": "x" * MB + " v " + "y" * MB,
    "sections": "1 U.S.C. 2" + "(a)" * (MB // 3) + "(" + "a" * MB,
    "roman": "U.S. Const. art. " + "IVX" * (MB // 3),
    "money": "$" + "5," * (MB // 2) + " v. x",
    "commas": "A v. B, " * (MB // 8),
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_takes_seconds(name):
    text = LONG[name]
    began = time.process_time()
    for f in (entities_of, citations_of, light_of):
        f(text)
    assert time.process_time() - began < 5


def plain_entities(text):
    """Entities by the patterns themselves, and by comparing every span with all that are kept."""
    found = [(0.85, "PERSON", m.start(), m.end()) for m in re.finditer(PERSON_PATTERN, text) if not re.search(r" v\.? ", m.group())]
    found += [(0.9, kind, m.start(), m.end()) for kind, ps in ENTITY_PATTERNS.items() for p in ps for m in re.finditer(p, text, re.IGNORECASE)]
    kept = []
    for e in sorted(found, key=lambda e: -e[0]):
        if not any(e[2] < b and e[3] > a for _, _, a, b in kept):
            kept.append(e)
    return kept


def test_entities_of_the_documents(spark):
    """Counts over whole documents, as they are and with citations set among their words, are those of the plain patterns."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = collections.Counter(e[1] for r in docs.collect() for e in plain_entities(r["text"] or ""))
    assert {r["entity_group"]: r["n"] for r in QUERIES["document_entities"](spark, sf).collect()} == dict(want) != {}
    for r in docs.limit(40).collect():
        text = f"Doe v. Roe, 12 F.3d 4 {r['text'][:1500]} Smith & Co v. {r['text'][:300]}, $5,000 on May 3, 2020; 42 U.S.C. § 7(a) {r['text'][-200:]}"
        assert sorted((e["score"], e["entity_group"], e["start"], e["end"]) for e in entities_of(text)) == sorted(plain_entities(text))
