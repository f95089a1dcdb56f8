"""Interval aggregates by name: how the clauses of a fired rule make its head's interval.

An aggregate sees each clause as sums over its intervals, already weighted,
so the same expression serves counted groups and arrays of intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigraph.functions.intervals import closed, greatest_of, least_of, total


@dataclass(frozen=True)
class Evidence:
    """Per clause: weighted sum of lower and upper bounds, number of intervals, largest plain upper bound."""

    lower: list[Column]
    upper: list[Column]
    count: list[Column]
    top: list[Column]

    @property
    def mean(self) -> tuple[Column, Column]:
        """Sums over all clauses by the number of all intervals (not by the weights)."""
        if not self.lower:
            return F.lit(0.0), F.lit(1.0)
        n = F.greatest(total(self.count), F.lit(1))
        return total(self.lower) / n, total(self.upper) / n


Aggregate = Callable[[Evidence], Column]


def _average(e: Evidence) -> Column:
    return closed(*e.mean)


def _average_lower(e: Evidence) -> Column:
    return closed(e.mean[0], F.greatest(F.lit(0.0), *e.top) if e.top else F.lit(0.0))


def _maximum(e: Evidence) -> Column:
    return closed(greatest_of(e.lower), greatest_of(e.upper)) if e.lower else closed(0.0, 1.0)


def _minimum(e: Evidence) -> Column:
    return closed(least_of(e.lower), least_of(e.upper)) if e.lower else closed(0.0, 1.0)


def _floored(floor: float) -> Aggregate:
    """Mean, with the lower bound raised to a burden of proof; a burden over the upper bound proves nothing ([0, 1])."""
    return lambda e: closed(F.greatest(e.mean[0], F.lit(floor)), e.mean[1])


def _conservative(e: Evidence) -> Column:
    return closed(least_of(e.lower) if e.lower else F.lit(0.0), e.mean[1])


def _stretched(factor: float) -> Aggregate:
    """Mean, with the span above its lower bound scaled."""
    return lambda e: closed(e.mean[0], e.mean[0] + (e.mean[1] - e.mean[0]) * factor)


def _lenient(e: Evidence) -> Column:
    return closed(e.mean[0] * 0.95, e.mean[1])


_AGGREGATES: dict[str, Aggregate] = {
    "average": _average,
    "average_lower": _average_lower,
    "maximum": _maximum,
    "minimum": _minimum,
    "legal_burden_civil_051": _floored(0.51),
    "legal_burden_clear_075": _floored(0.75),
    "legal_burden_criminal_090": _floored(0.90),
    "legal_conservative_min": _conservative,
    "precedent_weighted": _average,
    "textualism_alpha": _stretched(0.95),
    "purposivism_alpha": _stretched(1.05),
    "lenity_alpha": _lenient,
}


def register_aggregator(name: str, aggregate: Aggregate) -> None:
    """Add or replace an aggregate; it returns an interval column for the evidence."""
    _AGGREGATES[name] = aggregate


class Repeated(Sequence):
    """One interval (l, u), n times: what a clause gives to a head, however many assignments there are."""

    def __init__(self, interval: tuple[float, float], n: int):
        self.interval, self.n = interval, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        at = range(self.n)[i]
        return Repeated(self.interval, len(at)) if isinstance(at, range) else self.interval


@dataclass(frozen=True)
class PythonAggregate:
    """Any Python function of (intervals of each clause, weights) that returns (l, u).

    Heads go through it in Arrow batches. If it raises for a head, or what it
    returns is no interval, that head alone has [0, 1]: nothing is known of it.
    """

    function: Callable[[list[Repeated], list[float]], tuple[float, float]]

    def column(self, clauses: list[tuple[Column, Column, Column]], weights: list[float]) -> Column:
        """The interval of a head from each clause's l, u and number."""
        f = self.function

        @F.pandas_udf("struct<l:double,u:double>")
        def run(heads: pd.Series) -> pd.DataFrame:
            out = []
            for head in heads:
                try:
                    l, u = map(float, f([Repeated((c["l"], c["u"]), int(c["n"])) for c in head], list(weights)))
                    if l != l or u != u:
                        raise ValueError("not a number")
                except Exception:  # noqa: BLE001 - whatever a given function raises
                    l, u = 0.0, 1.0
                out.append((l, u))
            return pd.DataFrame(out, columns=["l", "u"])

        head = F.array(*[F.struct(l.cast("double").alias("l"), u.cast("double").alias("u"), n.cast("long").alias("n")) for l, u, n in clauses])
        b = run(head)
        return closed(b["l"], b["u"])


_PYTHON: dict[str, PythonAggregate] = {}


def register_python_aggregator(name: str, function: Callable[[list[Repeated], list[float]], tuple[float, float]]) -> None:
    """Add or replace an aggregate that is a Python function (see PythonAggregate)."""
    _PYTHON[name] = PythonAggregate(function)


def aggregator(name: str | None) -> Aggregate | PythonAggregate | None:
    """The aggregate of that name; None for an unknown one (the head bound then holds)."""
    return _PYTHON.get(name or "") or _AGGREGATES.get(name or "")


def aggregator_names() -> list[str]:
    return sorted(_AGGREGATES)


def matched_weights(weights: list[float] | tuple[float, ...], clauses: int) -> list[float]:
    """The weights, or all ones if there isn't one for each clause."""
    return [float(w) for w in weights] if weights and len(weights) == clauses else [1.0] * clauses


def counted_evidence(counts: list[Column], intervals: list[tuple[float, float]], weights: list[float]) -> Evidence:
    """Evidence of clauses that all have the same interval counts[i] times."""
    n = [c.cast("double") for c in counts]
    return Evidence(
        [F.lit(l * w) * c for (l, _), w, c in zip(intervals, weights, n)],
        [F.lit(u * w) * c for (_, u), w, c in zip(intervals, weights, n)],
        n,
        [F.lit(u) for _, u in intervals],
    )


def array_evidence(clauses: list[Column], weights: list[float]) -> Evidence:
    """Evidence of clauses given as arrays of intervals; sums run from left to right."""

    def weighed(items: Column, end: str, w: float) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, x: s + x[end] * F.lit(w))

    return Evidence(
        [weighed(c, "l", w) for c, w in zip(clauses, weights)],
        [weighed(c, "u", w) for c, w in zip(clauses, weights)],
        [F.size(c).cast("double") for c in clauses],
        [F.coalesce(F.array_max(F.transform(c, lambda x: x["u"])), F.lit(0.0)) for c in clauses],
    )
