"""The shipped rules: how citations become controlling, persuasive and contrary authority, and support for a claim."""

from __future__ import annotations

from dataclasses import replace

from verdigraph.plans.policy import burden_for, clause_weights, normalized, select_rules, style_for, styled
from verdigraph.plans.rules import Rule, edge, node

SURE, LIKELY = (1.0, 1.0), (0.51, 1.0)


def derivation_rules() -> list[Rule]:
    def over_pairs(name: str, relation: str, *more) -> Rule:
        body = (edge("cites", "x", "y", SURE), edge("same_issue", "x", "y", LIKELY), edge(relation, "x", "y", SURE), *more)
        return Rule(f"derive_{name}", "edge", name, ("x", "y"), body)

    def of_case(name: str, label: str, bound: tuple[float, float]) -> Rule:
        return Rule(f"derive_{name}", "node", name, ("x",), (edge(label, "x", "y", SURE),), head_bound=bound)

    return [
        over_pairs("controlling_for", "controlling_relation", node("precedential", "y", SURE)),
        over_pairs("persuasive_for", "persuasive_relation"),
        of_case("controlling_support", "controlling_for", LIKELY),
        of_case("persuasive_support", "persuasive_for", LIKELY),
        of_case("contrary_authority", "contrary_to", SURE),
    ]


def support_rule(claim: str, aggregate: str, weights: list[float]) -> Rule:
    """Support for a claim. Contrary authority must lie in [0, 0.49], which presence never does: it takes looser bounds, or facts that say so, to fire."""
    body = (node("controlling_support", "x", LIKELY), node("persuasive_support", "x", LIKELY), node("contrary_authority", "x", (0.0, 0.49)))
    return Rule(f"support_{claim}_burdened", "node", f"support_for_{claim}", ("x",), body, head_bound=None, aggregate=aggregate, weights=tuple(weights))


def rules_for_claim(claim: str, jurisdiction: str = "US-FED", conservative: bool = False, courts: dict | None = None, burden: dict | None = None, prefs: dict | None = None, weights: list[float] | None = None, multipliers: list[float] | None = None) -> list[Rule]:
    """All rules of a claim under a policy.

    The support rule's weights are the courts', moved by the style of
    interpretation and scaled by authority multipliers; given weights
    replace them all.
    """
    courts = courts or {}
    own = styled(clause_weights(courts), style_for(claim, jurisdiction, prefs or {}, courts))
    aggregate = "legal_conservative_min" if conservative else burden_for(claim, jurisdiction, burden or {})
    rules = select_rules([support_rule(claim, aggregate, own), *derivation_rules()], courts, jurisdiction)
    final = weights if weights is not None else scale(own, multipliers)
    return [replace(r, weights=tuple(final)) if r.target == f"support_for_{claim}" else r for r in rules]


def scale(weights: list[float], multipliers: list[float] | None) -> list[float]:
    """Weights times multipliers, summing to 1; the weights as they are without multipliers or if nothing is left."""
    scaled = [max(0.0, w * m) for w, m in zip(weights, multipliers or [])]
    return normalized(scaled) if scaled and sum(scaled) > 0 else list(weights)
