"""Clause thresholds: how many, or how large a share, of a group's assignments must satisfy a clause."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigraph.errors import RuleError

_COMPARE = {"greater_equal": operator.ge, "greater": operator.gt, "less_equal": operator.le, "less": operator.lt, "equal": operator.eq}
_TYPES, _BASES = ("number", "percent"), ("total", "available")


@dataclass(frozen=True)
class Threshold:
    quantifier: str = "greater_equal"
    kind: str = "number"
    base: str = "total"
    value: float = 1.0

    def __post_init__(self) -> None:
        if self.quantifier not in _COMPARE or self.kind not in _TYPES or self.base not in _BASES:
            raise RuleError(f"no such threshold: {self}")

    @property
    def trivial(self) -> bool:
        """Met by every group in which all assignments satisfy the clause."""
        return self.quantifier == "greater_equal" and self.kind == "number" and self.value <= 1


def passes(spec: Threshold, satisfied: Column, total: Column, available: Column | None = None) -> Column:
    """Whether a group passes; a percentage of an empty base is 0."""
    if spec.kind == "number":
        measured = satisfied.cast("double")
    else:
        base = total if spec.base == "total" or available is None else available
        measured = F.when(base > 0, satisfied.cast("double") * 100.0 / base).otherwise(0.0)
    return _COMPARE[spec.quantifier](measured, F.lit(float(spec.value)))
