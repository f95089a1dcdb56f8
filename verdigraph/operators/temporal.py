"""Discrete time without a loop: every step schedules the same updates, so each statement's timeline is one fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.intervals import TYPE, change, fold_intersection, intersection, unknown

KEY = ["label", "arg0", "arg1"]
_STATE = f"struct<v:{TYPE},present:boolean,fixed:boolean,d:double>"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _queued(updates: DataFrame) -> DataFrame:
    """One row for each statement with its updates in the order in which they are combined.

    Those scheduled earlier come first, so larger delays precede; then the
    order of rules, then that of a rule's emissions. A statement has at most
    one update from each rule and emission.
    """
    item = F.struct((-F.col("delta")).alias("early"), "ord", "emit", F.struct("l", "u").alias("b"), "static", "source")
    return updates.filter("delta >= 0").groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("q"))


def _narrowest(items: Column) -> Column:
    """Override: the narrowest interval, ties by source, then by its ends."""
    keyed = F.transform(items, lambda x: F.struct((x["b"]["u"] - x["b"]["l"]).alias("w"), F.coalesce(x["source"], F.lit("")).alias("s"), x["b"]["l"].alias("l"), x["b"]["u"].alias("u")))
    first = F.array_min(keyed)
    return F.struct(first["l"].alias("l"), first["u"].alias("u")).cast(TYPE)


def _combined(items: Column, mode: str) -> Column:
    return fold_intersection(F.transform(items, lambda x: x["b"])).cast(TYPE) if mode == "intersection" else _narrowest(items)


def combine(updates: DataFrame, mode: str = "intersection") -> DataFrame:
    """(label, arg0, arg1, l, u): each statement's updates combined once, whatever their delays."""
    got = _queued(updates).select(*KEY, _combined(F.col("q"), mode).alias("b"))
    return got.select(*KEY, F.col("b.l").alias("l"), F.col("b.u").alias("u"))


#: Steps after which the same due updates change nothing more: a gap resets to [0, 1], which meets them again.
SETTLES = 4


def runs(updates: DataFrame, steps: int, mode: str = "intersection") -> DataFrame:
    """(label, arg0, arg1, t, until, l, u, present, moved): a statement's states as runs of steps, from t until the last one, within 0 .. steps - 1.

    Updates with a delay of at most t are due at t. A statement that a static
    update has reached is frozen once it is present; a static update that
    comes later freezes what is there, and is itself not applied. moved is
    the largest change of an end at t; at the steps after it, nothing moves.

    A state changes when an update becomes due, and settles within SETTLES
    steps. Only these steps are gone through: a statement's work, and its
    rows, go with the number of its different delays, not with the horizon.
    """
    start = F.struct(unknown().cast(TYPE).alias("v"), F.lit(False).alias("present"), F.lit(False).alias("fixed"), F.lit(0.0).alias("d")).cast(_STATE)

    def moved(before: Column, fixed: Column, after: Column) -> Column:
        return F.struct(after.alias("v"), F.lit(True).alias("present"), fixed.alias("fixed"), change(before["v"], after).alias("d")).cast(_STATE)

    def step(before: Column, t: Column) -> Column:
        def after(due: Column, fixed: Column) -> Column:
            # The first insert is compared with [0, 1].
            idle = (F.size(due) == 0) | (fixed & before["present"])
            kept = F.struct(before["v"].alias("v"), before["present"].alias("present"), fixed.alias("fixed"), F.lit(0.0).alias("d")).cast(_STATE)
            to = once(_combined(due, mode), lambda x: intersection(before["v"], x).cast(TYPE) if mode == "intersection" else x)
            return F.when(idle, kept).otherwise(once(to, lambda x: moved(before, fixed, x)))

        return once(F.filter(F.col("q"), lambda x: -x["early"] <= t), lambda due: once(before["fixed"] | F.exists(due, lambda x: x["static"]), lambda fixed: after(due, fixed)))

    def advance(history: Column, t: Column) -> Column:
        return F.concat(history, F.array(once(F.element_at(history, -1), lambda before: step(before, t))))

    last = F.lit(steps - 1)
    due = F.filter(F.transform("q", lambda x: -x["early"]), lambda d: d <= last)
    times = F.array_sort(F.array_union(F.array(F.lit(0)), F.flatten(F.transform(F.array_distinct(due), lambda d: F.sequence(d, F.least(d + (SETTLES - 1), last))))))
    told = _queued(updates).withColumn("times", times).withColumn("h", F.aggregate("times", F.array(start), advance))
    each = told.select(*KEY, "times", F.posexplode(F.slice("h", 2, F.size("times"))).alias("i", "s"))
    until = F.coalesce(F.get("times", F.col("i") + 1) - 1, last)
    return each.select(*KEY, F.get("times", F.col("i")).alias("t"), until.alias("until"), F.col("s.v.l").alias("l"), F.col("s.v.u").alias("u"), F.col("s.present").alias("present"), F.col("s.d").alias("moved"))


def timeline(updates: DataFrame, steps: int, mode: str = "intersection") -> DataFrame:
    """(label, arg0, arg1, t, l, u, present, moved) for t = 0 .. steps - 1: runs(), a row for each step."""
    each = runs(updates, steps, mode).withColumn("at", F.explode(F.sequence("t", "until")))
    return each.select(*KEY, F.col("at").alias("t"), "l", "u", "present", F.when(F.col("at") == F.col("t"), F.col("moved")).otherwise(0.0).alias("moved"))


def per_step(told: DataFrame) -> DataFrame:
    """(t, changed, max_delta) of a timeline or of runs: statements that moved at t, and by how much at most (runs have no row where none begins)."""
    return told.groupBy("t").agg(F.count_if(F.col("moved") > 0).alias("changed"), F.max("moved").alias("max_delta"))


@dataclass(frozen=True)
class Convergence:
    """bound: stop when no end moved by more; changed: when no more statements changed; neither: nothing changed or pends."""

    bound: float = -1
    changed: int = -1

    def met(self, changed: int, max_delta: float, pending: bool) -> bool:
        if self.bound != -1:
            return max_delta <= self.bound
        if self.changed != -1:
            return changed <= int(self.changed)
        return changed == 0 and not pending


@dataclass(frozen=True)
class Run:
    """Facts at the step at which the run ended, the steps that ran, and whether it converged (None: one step, that ends either way)."""

    facts: DataFrame
    steps: DataFrame
    last: int
    converged: bool | None


def run(updates: DataFrame, tmax: int = 1, mode: str = "intersection", convergence: Convergence = Convergence(), emit_facts: bool = True, most_delay: int | None = None, single: bool = False) -> Run:
    """Run the timeline up to tmax steps (-1: until it converges).

    After the largest delay the due updates stay the same and an intersection
    or override settles within four steps, so no more steps are computed;
    a run without limit whose rules keep scheduling ahead ends there too.
    Only the per-step counts reach the driver, a row for each step.

    most_delay, if it is known to be 0, saves a pass over the updates. single
    tells that no statement has two updates: then a run of one step is those
    updates themselves, with nothing to group.
    """
    spark = updates.sparkSession
    most = 0 if most_delay == 0 else updates.agg(F.max("delta")).first()[0]
    settled = max(0, most or 0) + SETTLES
    steps = settled if tmax < 0 else min(tmax, settled)
    nothing = updates.select(*KEY, "l", "u").limit(0)
    counts = "t int, changed long, max_delta double"
    if steps == 0 or most is None or not emit_facts:
        ran = 0 if tmax == 0 else 1
        return Run(nothing, spark.createDataFrame([(0, 0, 0.0)][:ran], counts), ran - 1, bool(ran))
    if steps == 1:
        due = updates.filter("delta = 0")
        facts = due.select(*KEY, "l", "u") if single else combine(due, mode)
        return Run(facts, per_step(timeline(updates, 1, mode)), 0, None)
    told = runs(updates, steps, mode)
    seen = {r["t"]: (r["changed"], r["max_delta"]) for r in per_step(told).collect()}
    rows, last, converged = [], steps - 1, False
    for t in range(steps):
        changed, move = seen.get(t, (0, 0.0))
        rows.append((t, changed, float(move)))
        if convergence.met(changed, move, pending=most > 0):
            last, converged = t, True
            break
    facts = told.filter((F.col("t") <= last) & (F.col("until") >= last) & F.col("present")).select(*KEY, "l", "u")
    return Run(facts, spark.createDataFrame(rows, counts), last, converged)
