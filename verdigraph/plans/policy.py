"""Policy of a claim: burden of proof, clause weights, interpretation style, lineage and rule selection. Driver-side."""

from __future__ import annotations

from verdigraph.plans.rules import Rule

BURDENS = ((0.90, "legal_burden_criminal_090"), (0.75, "legal_burden_clear_075"))
CIVIL = "legal_burden_civil_051"
#: Keys of a jurisdiction that stand for a kind of claim, in the order in which they are tried.
CATEGORIES = ("criminal", "civil", "clear_and_convincing")
STYLES = {"textualism": (1.0, 0.9, 1.0), "purposivism": (1.0, 1.1, 1.0), "lenity": (1.0, 1.0, 1.1)}


def burden_function(threshold: float) -> str:
    return next((name for least, name in BURDENS if threshold >= least), CIVIL)


def _float(x: object) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def burden_for(claim: str, jurisdiction: str, cfg: dict) -> str:
    """Aggregate that proves the claim: the jurisdiction's own threshold, its category's, the global one, or the default."""
    overrides = cfg.get("BURDEN_OVERRIDES") or {}
    own, everywhere = overrides.get((jurisdiction or "").strip()) or {}, overrides.get("GLOBAL") or {}
    claim = (claim or "").strip()
    tried = [own[k] for k in (claim, *CATEGORIES) if k in own] + [everywhere[k] for k in (claim,) if k in everywhere]
    found = next((t for t in map(_float, tried) if t is not None), None)
    return burden_function(found if found is not None else float(cfg.get("DEFAULT_BURDEN", 0.51)))


def normalized(weights: list[float]) -> list[float]:
    whole = max(sum(weights), 1e-9)
    return [w / whole for w in weights]


def clause_weights(courts: dict) -> list[float]:
    """Weights of controlling, persuasive and contrary authority, summing to 1."""
    w = courts.get("weights") or {}
    return normalized([float(w.get("controlling", 0.6)), float(w.get("persuasive", 0.3)), float(w.get("contrary", 0.1))])


def lineage(courts: dict, jurisdiction: str) -> list[str]:
    """The jurisdiction and its ancestors, nearest first, each once (cycles are fine)."""
    parents, out, ahead = courts.get("hierarchy") or {}, [], [(jurisdiction or "").strip()]
    while ahead:
        at = ahead.pop(0)
        if at and at not in out:
            out.append(at)
            ahead += parents.get(at) or []
    return out


def style_for(claim: str, jurisdiction: str, prefs: dict, courts: dict) -> str:
    """Interpretation style: of the claim, else the default, in the nearest jurisdiction that says; else the global one."""
    overrides = prefs.get("style_overrides") or {}
    for j in lineage(courts, jurisdiction):
        said = overrides.get(j) or {}
        for k in (claim, "default"):
            if k in said:
                return str(said[k]).strip()
    return str(prefs.get("default_style") or "").strip()


def styled(weights: list[float], style: str) -> list[float]:
    return normalized([w * f for w, f in zip(weights, STYLES.get(style, (1.0, 1.0, 1.0)))])


def label_filter(courts: dict, jurisdiction: str) -> tuple[set[str], set[str]]:
    """Included and excluded target labels; what a nearer jurisdiction says of a label holds."""
    said: dict[str, bool] = {}
    for j in lineage(courts, jurisdiction):
        own = (courts.get("rule_overrides") or {}).get(j) or {}
        for key, keep in (("include_labels", True), ("exclude_labels", False)):
            for label in own.get(key) or []:
                if str(label).strip():
                    said.setdefault(str(label).strip(), keep)
    return {k for k, v in said.items() if v}, {k for k, v in said.items() if not v}


def select_rules(rules: list[Rule], courts: dict, jurisdiction: str) -> list[Rule]:
    """Rules that the jurisdiction's lineage allows; an include list shuts out every other label."""
    wanted, barred = label_filter(courts, jurisdiction)
    return [r for r in rules if r.target not in barred and (not wanted or r.target in wanted)]
