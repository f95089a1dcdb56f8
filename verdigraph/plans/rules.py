"""Rules: conjunctions of label patterns whose head gets a probability interval. Rules are plan, not data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from verdigraph.errors import RuleError
from verdigraph.functions.thresholds import Threshold


@dataclass(frozen=True)
class Clause:
    """A pattern: label(variables), required to lie within the bound. kind: node, edge or comparison."""

    kind: str
    label: str
    variables: tuple[str, ...]
    bound: tuple[float, float] = (0.0, 1.0)

    @property
    def well_formed(self) -> bool:
        return len(self.variables) >= {"node": 1, "edge": 2}.get(self.kind, 0)

    @property
    def holds_if_present(self) -> bool:
        """Presence counts as [1, 1]; a bound without it can't be met by any assignment."""
        return self.kind == "comparison" or (self.well_formed and self.bound[0] <= 1.0 <= self.bound[1])


def node(label: str, variable: str, bound: tuple[float, float] = (0.0, 1.0)) -> Clause:
    return Clause("node", label, (variable,), bound)


def edge(label: str, u: str, v: str, bound: tuple[float, float] = (0.0, 1.0)) -> Clause:
    return Clause("edge", label, (u, v), bound)


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    target: str
    head: tuple[str, ...]
    clauses: tuple[Clause, ...]
    thresholds: tuple[Threshold, ...] = ()
    head_bound: tuple[float, float] | None = (1.0, 1.0)
    aggregate: str | None = None
    weights: tuple[float, ...] = ()
    delta: int = 0
    static: bool = False
    infer_edges: bool = False
    infer_label: str = ""
    source: str = field(default="", compare=False)

    def validate(self) -> None:
        """Raise ValueError if the rule can't be evaluated."""
        if not self.id or not self.target:
            raise RuleError("a rule needs an id and a target label")
        if self.kind not in ("node", "edge") or len(self.head) != (1 if self.kind == "node" else 2):
            raise RuleError("a node rule has one head variable and an edge rule two", self.id)
        if self.thresholds and len(self.thresholds) != len(self.clauses):
            raise RuleError(f"{len(self.thresholds)} thresholds for {len(self.clauses)} clauses", self.id)
        if self.weights and len(self.weights) != len(self.clauses):
            raise RuleError(f"{len(self.weights)} weights for {len(self.clauses)} clauses", self.id)
        if any(c.kind not in ("node", "edge", "comparison") for c in self.clauses):
            raise RuleError("unknown clause kind", self.id)

    @property
    def valid(self) -> bool:
        try:
            self.validate()
        except ValueError:
            return False
        return True

    def threshold(self, i: int) -> Threshold:
        return self.thresholds[i] if i < len(self.thresholds) else Threshold()


def in_order(rules: list[Rule]) -> list[Rule]:
    """Valid rules in the order in which their updates are combined; invalid ones are left out."""
    return sorted((r for r in rules if r.valid), key=lambda r: (r.kind, r.id))


_LINE = re.compile(r"^\s*rule\s+(?P<id>[\w\-]+)\s*:\s*(?P<head>[A-Za-z_]\w*)\s*\(\s*(?P<args>[^)]*)\)\s*(?::-\s*(?P<rest>.*))?$", re.IGNORECASE)
_UNARY = re.compile(r"^\s*([A-Za-z_]\w*)\s*\(\s*([A-Za-z_]\w*)\s*\)\s*$")
_TRUE = ("true", "1", "yes", "y")


def parse_rules(text: str) -> list[Rule]:
    """Rules of a text, one on a line: rule ID: Head(X[,Y]) :- c1(X), c2(X); ann=...; weights=1,1; delta=1; set_static=true

    Lines that are no rules, and comments after #, are skipped. The body is
    cut at commas, so only clauses with one variable are read; others are
    dropped. Raises ValueError for a rule that doesn't validate (weights
    that don't match the clauses, say).
    """
    rules = []
    for line in text.splitlines():
        m = _LINE.match(line.split("#", 1)[0].rstrip())
        if not m:
            continue
        head = tuple(v.strip() for v in m["args"].split(",") if v.strip())
        body, *directives = (m["rest"] or "").split(";")
        clauses = tuple(node(c[1], c[2]) for c in map(_UNARY.match, body.split(",")) if c)
        given = dict((k.strip().lower(), v.strip()) for k, _, v in (d.partition("=") for d in directives) if v)
        aggregate = given.get("ann") or None
        rule = Rule(
            id=m["id"],
            kind="edge" if len(head) == 2 else "node",
            target=m["head"],
            head=head,
            clauses=clauses,
            head_bound=None if aggregate else (1.0, 1.0),
            aggregate=aggregate,
            weights=tuple(float(w) for w in given.get("weights", "").split(",") if w.strip()),
            delta=int(given.get("delta", 0)),
            static=given.get("set_static", "").lower() in _TRUE,
        )
        rule.validate()
        rules.append(rule)
    return rules


def rules_from_dicts(specs: list[dict]) -> list[Rule]:
    """Rules from plain dicts, for rules that other tools write."""
    out = []
    for s in specs:
        clauses = tuple(Clause(c.get("kind", "node"), c["label"], tuple(c["variables"]), tuple(c.get("bound", (0.0, 1.0)))) for c in s.get("clauses", ()))
        thresholds = tuple(Threshold(**t) for t in s.get("thresholds", ()))
        known = {k: v for k, v in s.items() if k in ("id", "kind", "target", "aggregate", "delta", "static", "infer_edges", "infer_label")}
        bound = s.get("head_bound", None if s.get("aggregate") else (1.0, 1.0))
        rule = Rule(head=tuple(s["head"]), clauses=clauses, thresholds=thresholds, weights=tuple(s.get("weights", ())), head_bound=tuple(bound) if bound else None, **known)
        rule.validate()
        out.append(rule)
    return out
