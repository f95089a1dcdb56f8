"""Text extraction: entities, obligations and citations with Python's regex semantics, Arrow batches at a time."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from verdigraph.functions.text import OBLIGATION_PATTERNS, OBLIGATION_SCORE, PATTERN_SCORE, PERSON_PATTERN, PERSON_SCORE
from verdigraph.operators.matching import CITATION_FINDERS, ENTITY_FINDERS, LIGHT_STATUTE_FINDERS, cited_cases

ENTITY = "struct<entity_group:string,word:string,start:int,end:int,score:double,method:string>"
OBLIGATION = "struct<bearer:string,duty:string,start:int,end:int,confidence:double,pattern:string>"
CITATION = "struct<type:string,raw:string,start:int,end:int,groups:array<string>,confidence:double>"
PERSONAL = "struct<word:string,start:int,end:int,tag:string>"
NODE = "struct<id:string,kind:string,year:int,ref:string>"
EDGE = "struct<src:string,dst:string,label:string,year:int>"

_PERSON = re.compile(PERSON_PATTERN)
_OBLIGATIONS = [re.compile(p, re.IGNORECASE) for p in OBLIGATION_PATTERNS]
#: What a match of a pattern must contain, looked for first: most texts have none of it.
_NEEDS = {"CASE": re.compile(r"[vV](?<=\s[vV])\.?\s"), "STATUTE": re.compile(r"\d"), "MONEY": re.compile(r"\$\d|\$,"), "DATE": re.compile(r"\d{4}")}
#: The same for the citation patterns, in their order, in a folded text.
_CITED = ["v", "v", "s", "usc", "f", "const", "const"]
_DUTY = re.compile(r"shall|must|required|duty|obligat|responsible|owes", re.IGNORECASE)
_SENTENCE, _WORDS_RUN = re.compile(r"[^.!?]+"), re.compile(r"[\w\s]+")


def greedy_spans(found: list[dict]) -> list[dict]:
    """Spans without overlaps: higher scores first, of equals the earlier listed."""
    kept: list[dict] = []
    starts: list[tuple[int, int]] = []
    for e in sorted(found, key=lambda e: -e["score"]):
        at = bisect_left(starts, (e["start"], e["end"]))
        near = starts[max(0, at - 1) : at + 1]
        if e["end"] > e["start"] and any(e["start"] < b and e["end"] > a for a, b in near):
            continue
        kept.append(e)
        insort(starts, (e["start"], e["end"]))
    return kept


def entities_of(text: str | None) -> list[dict]:
    """Persons and pattern entities of a text without overlaps, surest first."""
    if not text:
        return []
    found = [_entity("PERSON", text, *m.span(), PERSON_SCORE, "person_pattern") for m in _PERSON.finditer(text) if not re.search(r" v\.? ", m.group())]
    there = {kind for kind, p in _NEEDS.items() if p.search(text)}
    found += [_entity(kind, text, m.start, m.end, PATTERN_SCORE, "pattern_based") for kind, find in ENTITY_FINDERS if kind in there for m in find(text)]
    return greedy_spans(found)


def _entity(kind: str, text: str, start: int, end: int, score: float, method: str) -> dict:
    return {"entity_group": kind, "word": text[start:end], "start": start, "end": end, "score": score, "method": method}


def obligations_of(text: str | None) -> list[dict]:
    """Who must do what, in order of the patterns.

    A bearer lies in one run of words and a duty goes on to the sentence's
    end, so each sentence has one match of a pattern at most: in its first
    run of words that has what the pattern looks for.
    """
    out: list[dict] = []
    if not text or not _DUTY.search(text):
        return out
    for p in _OBLIGATIONS:
        for s in _SENTENCE.finditer(text):
            if not _DUTY.search(text, s.start(), s.end()):
                continue
            for run in _WORDS_RUN.finditer(text, s.start(), s.end()):
                if _DUTY.search(text, run.start(), run.end()) and (m := p.search(text, run.start(), s.end())):
                    out.append({"bearer": m.group(1).strip(), "duty": m.group(2).strip(), "start": m.start(), "end": m.end(), "confidence": OBLIGATION_SCORE, "pattern": "obligation_extraction"})
                    break
    return out


def citations_of(text: str | None) -> list[dict]:
    """All matches of all citation patterns; one citation may match several."""
    text = text or ""
    folded = text.casefold()
    return [{"type": kind, "raw": text[m.start : m.end], "start": m.start, "end": m.end, "groups": list(m.groups), "confidence": score} for (kind, find, score), need in zip(CITATION_FINDERS, _CITED) if need in folded for m in find(text)]


def persons_of(text: str | None) -> list[dict]:
    """Names like those of persons, all of them, tagged as personal data; parties of a citation ("X v Y") are none."""
    found = [m for m in _PERSON.finditer(text or "") if not re.search(r" v\.? ", m.group().lower())]
    return [{"word": m.group(), "start": m.start(), "end": m.end(), "tag": "pii_basic"} for m in found]


def light_of(text: str | None) -> dict:
    cases = [{"plaintiff": g[0].strip(), "defendant": g[1].strip(), "volume": g[2], "year": g[3]} for *_, g in cited_cases(text or "", "may")]
    return {"cases": cases, "statutes": [{"title": g[0], "section": g[1]} for find in LIGHT_STATUTE_FINDERS for *_, g in find(text or "")]}


def _each(docs: DataFrame, key: str, text: str, f: Callable[[str | None], list[dict]], kind: str) -> DataFrame:
    """A row for each thing that f finds in a text, after its key: columns are made batch by batch, no value goes through a list of its row."""
    own = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    fields = DataType.fromDDL(kind).fields
    columns = list(to_arrow_schema(StructType(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f(t) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = [x for each in found for x in each]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array([x[c.name] for x in flat], c.type) for c in columns)], names=[key, *(c.name for c in columns)])

    return own.mapInArrow(run, StructType([own.schema[0], *fields]))


def extract_entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity_group, word, start, end, score, method), a row for each entity."""
    return _each(docs, key, text, entities_of, ENTITY)


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, start, end, tag), a row for each span of personal data."""
    return _each(docs, key, text, persons_of, PERSONAL)


def extract_obligations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _each(docs, key, text, obligations_of, OBLIGATION)


def extract_citations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, type, raw, start, end, groups, confidence), a row for each match."""
    return _each(docs, key, text, citations_of, CITATION)


def citation_parts(citations: DataFrame) -> DataFrame:
    """Citations with their parts by type: parties, volume, reporter, page and year; title and section; article or amendment."""
    n = F.size("groups")

    def part(i: int, kind: str, least: int) -> Column:
        return F.when((F.col("type") == kind) & (n >= least), F.trim(F.get("groups", F.lit(i))))

    return citations.select("*", part(0, "case", 2).alias("plaintiff"), part(1, "case", 2).alias("defendant"), part(2, "case", 5).alias("volume"), part(3, "case", 5).alias("reporter"), part(4, "case", 5).alias("page"), part(5, "case", 6).alias("year"), part(0, "statute", 2).alias("title"), F.coalesce(part(1, "statute", 2), part(1, "constitution", 2)).alias("section"), part(0, "constitution", 1).alias("article_or_amendment"))


def standard_form(citations: DataFrame) -> DataFrame:
    """Citations (with groups) and their standard form; statutes are always rendered as of the U.S. Code."""
    g = [F.trim(F.get("groups", F.lit(i))) for i in range(5)]
    statute = F.concat(g[0], F.lit(" U.S.C. § "), g[1])
    parties = F.concat(g[0], F.lit(" v. "), g[1])
    full = F.concat(parties, F.lit(", "), g[2], F.lit(" "), g[3], F.lit(" "), g[4])
    form = F.when((F.col("type") == "statute") & (F.size("groups") >= 2), statute).when((F.col("type") == "case") & (F.size("groups") >= 5), full).when((F.col("type") == "case") & (F.size("groups") >= 2), parties)
    return citations.withColumn("standard_form", form)


_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


@lru_cache(maxsize=256)
def _case(plaintiff: str, defendant: str, year: str | None, default_year: int | None) -> tuple[str, int | None]:
    """Id (that of functions.text.case_id) and year of a case; the readers find the same ones in a text."""
    a, b = (_BLANKS.sub("_", x.strip(" ")) for x in (plaintiff, defendant))
    return f"case::{a}_v_{b}_{year}" if year else f"case::{a}_v_{b}", int(year) if year and year.isascii() else default_year


def _statute(title: str, section: str) -> tuple[str, str]:
    """Id (that of functions.text.statute_id) and reference of a statute."""
    return f"statute::{title}_USC_{section}", f"{title} U.S.C. § {section}"


Reading = tuple[list[tuple[str, int | None]], list[tuple[str, str]]]


def readings_of(text: str | None, default_year: int | None, auto: bool) -> list[Reading]:
    """Cases and statutes as they are named: as the light reader finds them and, if asked for, as the citation extractor does."""
    light = light_of(text)
    out = [([_case(c["plaintiff"], c["defendant"], c["year"], default_year) for c in light["cases"]], [_statute(s["title"], s["section"]) for s in light["statutes"]])]
    if auto:
        cited = citations_of(text)
        cases = [_case(*c["groups"][:2], *(c["groups"][5:] or [None]), default_year) for c in cited if c["type"] == "case"]
        out.append((cases, [_statute(*c["groups"]) for c in cited if c["type"] == "statute"]))
    return out


def graph_nodes_of(readings: list[Reading], document: str) -> list[dict]:
    """Each statute and case once, and the document; of a further reading what isn't there already."""
    out: list[dict] = []
    for i, (cases, statutes) in enumerate(readings):
        known = {n["id"] for n in out}
        cited = [{"id": s, "kind": "statute", "year": None, "ref": ref} for s, ref in dict.fromkeys(statutes)]
        named = [{"id": c, "kind": "case", "year": year, "ref": None} for c, year in dict.fromkeys(cases)]
        out += [n for n in cited + named if n["id"] not in known]
        if not i:
            out.append({"id": document, "kind": "document", "year": None, "ref": None})
    return out


def graph_edges_of(readings: list[Reading], assume_persuasive: bool) -> list[dict]:
    """Every case cites every statute; the first is persuasive for all named after it, itself included if it is named again."""
    out: list[dict] = []
    for cases, statutes in readings:
        known = {(e["src"], e["dst"]) for e in out}
        ends = [(c, s, "cites", year) for c, year in dict.fromkeys(cases) for s, _ in dict.fromkeys(statutes)]
        if assume_persuasive and cases:
            lead, year = cases[0]
            ends += [(lead, c, "persuasive_relation", year) for c, _ in dict.fromkeys(cases[1:])]
        out += [{"src": a, "dst": b, "label": label, "year": year} for a, b, label, year in ends if (a, b) not in known]
    return out


def _graph(docs: DataFrame, jurisdiction: str, default_year: int | None, assume_persuasive: bool, key: str, text: str, auto: bool) -> tuple[DataFrame, DataFrame]:
    document, none = f"doc::{jurisdiction}", F.array().cast("array<string>")
    nodes = _each(docs, key, text, lambda t: graph_nodes_of(readings_of(t, default_year, auto), document), NODE)
    edges = _each(docs, key, text, lambda t: graph_edges_of(readings_of(t, default_year, auto), assume_persuasive), EDGE)
    own, kind = F.col("kind") == "document", F.col("kind")
    nodes = nodes.select(
        key, "id", "kind", F.when(~own, F.lit(jurisdiction).cast("string")).alias("jurisdiction"), "year", F.when(kind == "case", True).alias("precedential"),
        F.when(kind == "statute", F.array("ref")).otherwise(none).alias("statute_refs"), F.when(own, F.array(F.lit("pii_basic"))).otherwise(none).alias("pii_tags"),
    )
    return nodes, edges.select(key, "src", "dst", "label", F.lit("neutral").alias("treatment"), "year")


def documents_graph(docs: DataFrame, jurisdiction: str = "US-CA", default_year: int | None = None, assume_persuasive: bool = True, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (key, id, kind, jurisdiction, year, precedential, statute_refs, pii_tags) and edges (key, src, dst, label, treatment, year) of each document.

    Every case cites every statute of its document; the first case is
    persuasive for the others (for itself, if it is named again). A case's
    year is that of its citation, or the default year. All of it happens
    within a document's row: no join, no shuffle.
    """
    return _graph(docs, jurisdiction, default_year, assume_persuasive, key, text, False)


def documents_graph_auto(docs: DataFrame, jurisdiction: str = "US-CA", default_year: int | None = None, assume_persuasive: bool = True, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """documents_graph, and what only the citation extractor finds: further cases, statutes and the edges among them.

    An edge that is there already stays as it is. Cases are taken in the
    order of the extractor: all matches of the full pattern, then the simple
    one.
    """
    return _graph(docs, jurisdiction, default_year, assume_persuasive, key, text, True)
