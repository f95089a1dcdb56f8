"""Policy files: read on the driver, checked, and used as literals in plans."""

from __future__ import annotations

import re
from pathlib import Path

import yaml

from verdigraph.errors import PolicyError

ACTIONS = ("mask", "drop", "hash")
MODES = ("ingest_blocking", "dry_run")


def read_config(path: str) -> dict:
    """A YAML mapping; an empty file is an empty mapping."""
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def _number(errors: list[str], where: str, value: object, low: float, high: float) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        errors.append(f"{where}: not a number")
    elif not low <= value <= high:
        errors.append(f"{where}: {value} is not in [{low}, {high}]")


def check_courts(cfg: dict) -> list[str]:
    errors: list[str] = []
    weights = cfg.get("weights", {})
    if not isinstance(weights, dict):
        return ["weights: not a mapping"]
    for k in ("controlling", "persuasive", "contrary"):
        if k in weights:
            _number(errors, f"weights.{k}", weights[k], 0, float("inf"))
    hierarchy = cfg.get("hierarchy", {})
    if not isinstance(hierarchy, dict):
        return [*errors, "hierarchy: not a mapping"]
    return errors + [f"hierarchy.{k}: not a list" for k, v in hierarchy.items() if not isinstance(v, list)]


def check_precedent_weights(cfg: dict) -> list[str]:
    errors: list[str] = []
    for section, keys, low, high in (("recency", ("half_life_years",), 0, 1000), ("recency", ("min_multiplier",), 0, 1)):
        for k in keys:
            if k in (cfg.get(section) or {}):
                _number(errors, f"{section}.{k}", cfg[section][k], low, high)
    for section in ("jurisdiction_alignment", "court_levels", "treatment_modifier"):
        for k, v in (cfg.get(section) or {}).items():
            _number(errors, f"{section}.{k}", v, 0, 2)
    return errors


def check_burden(cfg: dict) -> list[str]:
    errors: list[str] = []
    if "DEFAULT_BURDEN" in cfg:
        _number(errors, "DEFAULT_BURDEN", cfg["DEFAULT_BURDEN"], 0, 1)
    for j, claims in (cfg.get("BURDEN_OVERRIDES") or {}).items():
        for claim, v in (claims or {}).items():
            _number(errors, f"BURDEN_OVERRIDES.{j}.{claim}", v, 0, 1)
    return errors


def check_statutory_prefs(cfg: dict) -> list[str]:
    known = ("textualism", "purposivism", "lenity", "")
    errors = [] if str(cfg.get("default_style") or "") in known else ["default_style: unknown style"]
    for j, claims in (cfg.get("style_overrides") or {}).items():
        errors += [f"style_overrides.{j}.{c}: unknown style" for c, s in (claims or {}).items() if str(s) not in known]
    return errors


def _patterns(where: str, patterns: object) -> list[str]:
    errors = []
    for i, p in enumerate(patterns if isinstance(patterns, list) else []):
        try:
            re.compile(p)
        except (re.error, TypeError):
            errors.append(f"{where}[{i}]: regex doesn't compile")
    return errors


def check_redaction(cfg: dict) -> list[str]:
    """Patterns need a regex that compiles and an action (mask if none is named); a mode is one of MODES."""
    errors = [] if cfg.get("mode", MODES[0]) in MODES else [f"mode: none of {', '.join(MODES)}"]
    patterns = cfg.get("patterns") or []
    if not isinstance(patterns, list):
        return [*errors, "patterns: not a list"]
    for i, p in enumerate(patterns):
        if not isinstance(p, dict):
            errors.append(f"patterns[{i}]: not a mapping")
            continue
        if p.get("action", "mask") not in ACTIONS:
            errors.append(f"patterns[{i}]: action is none of {', '.join(ACTIONS)}")
        try:
            re.compile(p.get("regex") or "(")
        except re.error:
            errors.append(f"patterns[{i}]: regex doesn't compile")
    return errors


def check_reporters(cfg: dict) -> list[str]:
    """Every reporter has names and patterns, and its patterns compile."""
    known = cfg.get("canonical")
    if not isinstance(known, dict) or not known:
        errors = ["canonical: no mapping"]
    else:
        errors = []
        for k, v in known.items():
            if not isinstance(v, dict):
                errors.append(f"canonical.{k}: not a mapping")
                continue
            errors += [f"canonical.{k}.{part}: no list, or an empty one" for part in ("names", "patterns") if not isinstance(v.get(part), list) or not v[part]]
            errors += _patterns(f"canonical.{k}.patterns", v.get("patterns"))
    if not isinstance(cfg.get("normalization") or {}, dict):
        errors.append("normalization: not a mapping")
    return errors


CHECKS = {"courts": check_courts, "precedent_weights": check_precedent_weights, "burden": check_burden, "statutory_prefs": check_statutory_prefs, "redaction": check_redaction, "reporters": check_reporters}


def check_folder(folder: str) -> list[str]:
    """Errors of the configurations in a folder, each named by its kind (courts.yaml, burden.yml, ...); files that aren't there have none."""
    found = {kind: path for kind in CHECKS for end in ("yaml", "yml") if (path := Path(folder) / f"{kind}.{end}").exists()}
    errors = []
    for kind, path in found.items():
        try:
            cfg = read_config(str(path))
        except yaml.YAMLError as e:
            errors.append(f"{kind}: {e}")
            continue
        errors += check_all({kind: cfg}) if isinstance(cfg, dict) else [f"{kind}: not a mapping"]
    return errors


def check_all(configs: dict[str, dict], strict: bool = False) -> list[str]:
    """Errors of all given configurations, each named by its kind; raises PolicyError for any if strict."""
    errors = [f"{kind}: {e}" for kind, cfg in configs.items() for e in CHECKS[kind](cfg)]
    if errors and strict:
        raise PolicyError("; ".join(errors))
    return errors
